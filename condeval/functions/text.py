"""Text expressions: spans, prompt templates and answer parsing."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condeval.functions.columns import ColumnLike, as_column

# The label domain. Parsing yields one of LABELS or UNPARSEABLE.
LABELS = ("FIGURATIVE", "LITERAL", "INCOHERENT")
UNPARSEABLE = "UNPARSEABLE"
# The answer format, and the order in which a bare mention counts.
FINAL_LABEL = r"FINAL\s*LABEL\s*:\s*(FIGURATIVE|LITERAL|INCOHERENT)"
REASONING = r"(?s)<think>.*?</think>"
MENTION_ORDER = ("INCOHERENT", "LITERAL", "FIGURATIVE")


def same_surface(left: ColumnLike, right: ColumnLike) -> Column:
    """Case-insensitive equality; NULL on either side is NULL and so filters out."""
    return F.lower(as_column(left)) == F.lower(as_column(right))


def locate_spans(
    rows: DataFrame, text: str, span: str, start: str = "start", token: str = "token"
) -> DataFrame:
    """Where a span first occurs in a text, ignoring case, and in which token it ends.

    ``start`` is the 1-based position, NULL when absent. ``token`` is the 0-based
    index of the whitespace token that holds the span's last character, NULL for
    an absent or empty span. Offsets and lengths are both taken on the
    lower-cased strings, so they stay consistent where lowering changes length.

    The steps are columns of their own, so that each is computed once per row.
    """
    size = F.char_length("_span")
    found = (
        rows.withColumns({"_text": F.lower(text), "_span": F.lower(span)})
        .withColumn("_hit", F.nullif(F.position("_span", "_text"), F.lit(0)))
        .withColumn("_head", F.when(size > 0, F.substring("_text", F.lit(1), F.col("_hit") + size - 1)))
        .withColumn("_tokens", F.regexp_count("_head", F.lit(r"\S+")))
    )
    return found.select(
        *rows.columns,
        F.col("_hit").alias(start),
        (F.nullif("_tokens", F.lit(0)) - 1).alias(token),
    )


def locate_span_lists(rows: DataFrame, text: str, spans: str) -> DataFrame:
    """``locate_spans`` for an array of (kind, span) structs in each row.

    Returns the other columns and (kind, start, token), one row per span; a row
    without spans has one row of NULLs. The text is lower-cased once and searched
    inside its row, so it is never copied.
    """

    def hit(span: Column) -> Column:
        low = F.lower(span["span"])
        return F.struct(span["kind"].alias("kind"), low.alias("low"), F.position(low, F.col("_text")).alias("at"))

    def head(hit: Column) -> Column:
        size, start = F.char_length(hit["low"]), hit["at"]
        until = F.when((size > 0) & (start > 0), F.substring(F.col("_text"), F.lit(1), start + size - 1))
        tokens = F.regexp_count(until, F.lit(r"\S+"))
        return F.struct(hit["kind"].alias("kind"), start.alias("start"), tokens.alias("tokens"))

    others = [c for c in rows.columns if c not in (text, spans)]
    low = rows.select(*others, F.lower(text).alias("_text"), spans)
    hits = low.select(*others, "_text", F.transform(spans, hit).alias("_hits"))
    found = hits.select(*others, F.transform("_hits", head).alias("_found"))
    return found.select(*others, F.inline_outer("_found")).select(
        *others,
        "kind",
        F.nullif("start", F.lit(0)).alias("start"),
        (F.nullif("tokens", F.lit(0)) - 1).alias("token"),
    )


def fill_template(template: str, **fields: ColumnLike) -> Column:
    """Fill ``{name}`` places of a template from columns, in one pass.

    The template is split once on the driver, so braces inside values are never
    expanded again; ``{{`` and ``}}`` are literal braces. A NULL value makes the
    whole prompt NULL.
    """
    pieces: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion or name not in fields:
            raise ValueError(f"template place {{{name}}} has no plain column to fill it")
        pieces.append(as_column(fields[name]).cast("string"))
    return F.concat(*pieces) if pieces else F.lit("")


def strip_reasoning(response: ColumnLike) -> Column:
    """Drop closed reasoning blocks; an unclosed tag stays."""
    return F.regexp_replace(as_column(response), REASONING, "")


def parse_labels(rows: DataFrame, response: str, label: str = "label") -> DataFrame:
    """Add the label stated in a free-text answer; NULL only for a NULL answer.

    The stated final label wins; otherwise the first label of MENTION_ORDER
    that occurs anywhere; otherwise UNPARSEABLE. The cleaned answer is a column
    of its own, so that it is computed once per row.
    """
    cleaned = rows.withColumn("_clean", F.upper(F.trim(strip_reasoning(response))))
    staged = cleaned.withColumn("_stated", F.regexp_extract("_clean", FINAL_LABEL, 1))
    parsed = F.when(F.col("_stated") != "", F.col("_stated"))
    for mention in MENTION_ORDER:
        parsed = parsed.when(F.contains("_clean", F.lit(mention)), F.lit(mention))
    parsed = parsed.when(F.col("_clean").isNotNull(), F.lit(UNPARSEABLE))
    return staged.withColumn(label, parsed).drop("_clean", "_stated")


def full_text(prefix: ColumnLike, continuation: ColumnLike) -> Column:
    """Prefix and continuation as one string."""
    return F.concat(as_column(prefix), as_column(continuation))
