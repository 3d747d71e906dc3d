"""URL filters: rules first, then logistic regression on hashed character n-grams.

Only DataFrame and SQL functions are used. A rule names a host and the start of a path;
it fits that host and all its subdomains, and the longest fitting rule decides. Other
URLs are judged by a regression trained from a small labelled table.

The regression is trained by gradient descent, written for the labelled rows' shares in
the weights: with K the rows' common n-grams, one step is a -> (1 - decay) a +
rate (y - sigmoid(K a)). All steps are one aggregate over arrays in one row, as the
labelled table is small. The weights, a bounded array, then score URLs as a literal.

Defined cases: a URL that is NULL or has no ``://`` has an empty host and path, fits no
rule, and is judged by the regression's constant alone; URLs of any length are read
whole; rows that repeat get equal rows; an empty table gives an empty table; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
GRAMS = (3, 4)
BUCKETS = 4096
STEPS, RATE, DECAY = 150, 0.5, 0.002
# The labelled URLs: 1 to block, 0 to allow. They are the caller's to replace.
LABELLED = (
    ("http://docs.ridge.example/guide/start.html", 0),
    ("https://wiki.ridge.example/history/rivers", 0),
    ("https://library.town.example/books/catalogue", 0),
    ("https://blog.gardener.example/2019/05/pruning-roses", 0),
    ("https://news.harbour.example/en/4711", 0),
    ("https://news.harbour.example/de/1204.html", 0),
    ("https://museum.example/exhibitions/maps", 0),
    ("https://www.astronomers.example/papers/comets/", 0),
    ("https://m.weather.example/en/forecast/9", 0),
    ("http://journal.botany.example/volume/12/article/7", 0),
    ("https://school.example/lessons/algebra/3", 0),
    ("https://forum.sailors.example/threads/knots", 0),
    ("https://recipes.example/bread/rye.html", 0),
    ("https://archive.example/letters/1874/page/2", 0),
    ("https://blog.mountain.example/fr/randonnee/15", 0),
    ("https://university.example/lectures/notes.html", 0),
    ("https://ads.click.example/banner?campaign=7", 1),
    ("http://track.click.example/pixel/collect.gif", 1),
    ("https://casino-bonus.example/slots/free-spins", 1),
    ("http://cheap-pills.example/buy/discount", 1),
    ("https://shop.example/cart/checkout", 1),
    ("https://login.bank.example/account/signin", 1),
    ("https://poker-win.example/jackpot/now", 1),
    ("http://free-download.example/crack/keygen.exe", 1),
    ("https://adserver.example/click/redirect", 1),
    ("http://win-prize.example/claim/gift-card", 1),
    ("https://torrents.example/magnet/download", 1),
    ("https://dating-hot.example/join/free", 1),
    ("http://loans-fast.example/apply/now", 1),
    ("https://coupon-deals.example/discount/buy-now", 1),
    ("https://replica-watches.example/buy/cheap", 1),
    ("http://track.mail.example/unsubscribe/click", 1),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host of a URL and its path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (action, rule) of the longest rule that fits, the first of equals; else NULL."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of all n-grams of host and path, and bucket 0 for the constant."""
    whole = F.concat(F.lit("^"), host, path, F.lit("$"))
    lists = [
        F.when(
            F.length(whole) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))),
                lambda at, n=n: (F.pmod(F.xxhash64(F.substring(whole, at, F.lit(n))), F.lit(BUCKETS - 1)) + 1).cast("int"),
            ),
        ).otherwise(F.array().cast("array<int>"))
        for n in GRAMS
    ]
    return F.concat(F.array(F.lit(0)), *lists)


def trained(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED) -> list[float]:
    """Weights by bucket, from a small labelled table."""
    values = ", ".join("('{}', {}, {})".format(u.replace("'", "''"), y, i) for i, (u, y) in enumerate(labelled))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, y, i)")
    grams = rows.select("i", "y", F.explode(gram_buckets(*host_and_path(F.col("url")))).alias("bucket"))
    # Rows have length 1: a bucket counts its share of the row's n-grams.
    shares = grams.groupBy("i", "y", "bucket").agg(F.count("*").cast("double").alias("n"))
    norms = shares.groupBy("i").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    shares = shares.join(norms, "i").withColumn("x", F.col("n") / F.col("norm"))
    a, b = shares.select("i", "y", "bucket", "x"), shares.select(F.col("i").alias("j"), "bucket", F.col("x").alias("z"))
    kernel = a.join(b, "bucket").groupBy("i", "y", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    lines = kernel.groupBy("i", "y").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda s: s["k"]).alias("line")
    )
    table = lines.agg(F.array_sort(F.collect_list(F.struct("i", "y", "line"))).alias("t"))
    step = lambda alpha, _: F.transform(
        F.col("t"),
        lambda row: F.element_at(alpha, row["i"] + 1) * (1 - DECAY)
        + RATE
        * (
            row["y"]
            - 1
            / (
                1
                + F.exp(
                    -F.aggregate(
                        F.zip_with(row["line"], alpha, lambda k, s: k * s), F.lit(0.0), lambda p, q: p + q
                    )
                )
            )
        ),
    )
    alphas = table.select(
        F.posexplode(
            F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("t", lambda _: F.lit(0.0)), step)
        ).alias("i", "alpha")
    )
    weights = shares.join(alphas, "i").groupBy("bucket").agg(F.sum(F.col("alpha") * F.col("x")).alias("w"))
    out = [0.0] * BUCKETS
    for row in weights.collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["w"]
    return out


def judged(
    table: DataFrame,
    weights: list[float],
    rules: Sequence[tuple[str, str]] = RULES,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(key, host, path, rule, verdict, score): score is the regression's probability to block."""
    rows = table.select(F.col(key).alias("key"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    parts = rows.select("key", host.alias("host"), path.alias("path"))
    buckets = gram_buckets(F.col("host"), F.col("path"))
    raw = F.aggregate(
        buckets, F.lit(0.0), lambda total, bucket: total + F.element_at(F.lit(weights), bucket + 1)
    )
    scored = parts.withColumns(
        {
            "found": fitting_rule(F.col("host"), F.col("path"), rules),
            "score": 1 / (1 + F.exp(-raw / F.sqrt(F.size(buckets).cast("double")))),
        }
    )
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.action", method).alias("verdict"),
        "score",
    )
