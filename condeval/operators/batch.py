"""Caller-supplied generators and labellers over a table, in resumable steps.

No model is shipped. A caller passes a factory; it is called once per task, so a
model is loaded once per task, and what it returns is fed batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condeval.functions.columns import as_column, free_names
from condeval.functions.text import parse_labels
from condeval.operators.dealing import dealt_by_cost
from condeval.operators.grid import (
    COEFFICIENTS,
    SAMPLES,
    pending_conditions,
    pending_rows,
    sample_rows,
)
from condeval.sources.finished import finished_keys, rows_not_in
from condeval.sources.tables import append_step, read_results, remove_unlisted

Labeller = Callable[[], Callable[[list[str]], list[str]]]
Generator = Callable[[], Callable[[list[str], list[float], int], list[list[str]]]]

# What a call costs besides its prompt's length, in characters.
CALL_COST = 32
# Distinct prompts that are sorted by length together, as a power of two: less than Spark
# sends to Python at a time, so what it sends is no selection of a task's longest prompts.
SORTED_BITS = 10
# Rows of each task that a crash may lose, unless the caller says otherwise.
ROWS_PER_TASK = 256


def answer_batches(
    rows: DataFrame, prompt: Column | str, labeller: Labeller, batch_size: int = 16, answer: str = "answer"
) -> DataFrame:
    """Add the labeller's free-text answer to each row's prompt.

    Only the prompt crosses to Python; the other columns stay in the JVM. Prompts become
    Python strings one batch at a time. A NULL prompt is not sent and has a NULL answer.
    """

    @F.arrow_udf(T.StringType())
    def answers(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label_texts = labeller()
        for chunk in prompts:
            asked = chunk.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
            found: list[str | None] = [None] * len(chunk)
            for start in range(0, len(asked), batch_size):
                places = asked[start : start + batch_size]
                batch = [chunk[int(place)].as_py() for place in places]
                for place, told in zip(places, label_texts(batch), strict=True):
                    found[place] = told
            yield pa.array(found, pa.string())

    return rows.withColumn(answer, answers.asNondeterministic()(as_column(prompt)))


def label_batches(
    rows: DataFrame, prompt: Column | str, labeller: Labeller, batch_size: int = 16, label: str = "label"
) -> DataFrame:
    """Add a parsed label to each row."""
    answered = answer_batches(rows, prompt, labeller, batch_size, "_answer")
    return parse_labels(answered, "_answer", label).drop("_answer")


def label_distinct(
    rows: DataFrame,
    prompt: Column | str,
    labeller: Labeller,
    batch_size: int = 16,
    label: str = "label",
    tasks: int | None = None,
) -> DataFrame:
    """Add a parsed label to each row, asking the labeller once for each distinct prompt.

    Prompts are told apart by their digest, dealt to ``tasks`` (the session's parallelism by
    default) by their summed length, and batched with others of about their length. Labels
    go back to the rows by digest, so a prompt with most of all rows costs one call. A row
    without a prompt has no label.
    """
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    digest, asked, cost, run = free_names([*rows.columns, label], "_digest", "_prompt", "_answer", "_run")
    told = rows.withColumn(asked, as_column(prompt)).withColumn(digest, F.sha2(asked, 256))
    prompts = told.filter(F.col(asked).isNotNull()).select(digest, asked).dropDuplicates([digest])
    dealt = dealt_by_cost(prompts, digest, F.length(asked) + CALL_COST, tasks)
    runs = dealt.withColumn(run, F.shiftright(F.monotonically_increasing_id(), SORTED_BITS))
    runs = runs.sortWithinPartitions(run, F.length(asked)).drop(run)
    answered = answer_batches(runs, asked, labeller, batch_size, cost)
    labels = parse_labels(answered, cost, label).select(digest, label)
    return told.drop(asked).join(labels, digest, "left").select(*rows.columns, label)


def generate_batches(
    conditions: DataFrame,
    generator: Generator,
    prefix: str = "prefix",
    condition: str = "coefficient",
    samples: int = SAMPLES,
    batch_size: int = 16,
    texts: str = "continuations",
) -> DataFrame:
    """Add ``samples`` texts per row as an array, from its prefix and coefficient.

    A NULL prefix is not sent and has a NULL array. A generator that returns another
    number of rows or texts fails the task.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def write(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        write_texts = generator()
        for prefixes, coefficients in columns:
            found: list[list[str] | None] = [None] * len(prefixes)
            asked = prefixes.notna().to_numpy().nonzero()[0]
            for start in range(0, len(asked), batch_size):
                part = asked[start : start + batch_size]
                written = write_texts(prefixes.iloc[part].tolist(), coefficients.iloc[part].tolist(), samples)
                if len(written) != len(part) or any(len(texts) != samples for texts in written):
                    raise ValueError(f"the generator must return {samples} texts for each of {len(part)} rows")
                for place, texts in zip(part, written):
                    found[place] = list(texts)
            yield pd.Series(found, dtype=object)

    return conditions.withColumn(texts, write.asNondeterministic()(prefix, condition))


def _staging_path(spark: SparkSession, out_path: str) -> str:
    """A new folder on shared storage: in the session's checkpoint folder, else beside the output."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    name = f"condeval-pending-{uuid4()}"
    return f"{shared.rstrip('/')}/{name}" if shared else f"{out_path.rstrip('/')}-{name}"


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run_in_steps(
    pending: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    out_path: str,
    steps: int | None = None,
    tasks: int | None = None,
    rows_per_step: int | None = None,
    draw: Column | None = None,
) -> None:
    """Work through pending rows in steps that each enter the table whole; a crash loses at most one.

    A step holds about ``rows_per_step`` rows, ``ROWS_PER_TASK`` for each task unless given,
    so a crash loses about that many whatever the size of the job; ``steps`` fixes their
    number instead. ``work`` spreads a step's rows over tasks as it sees fit. Pending rows are staged once, each with a number in [0, 1) that the
    files are sorted by, so the inputs are scanned and anti-joined once and a step reads the
    row groups of its own range. ``draw`` is that number, by default drawn per row and not
    from a key: one repeated key cannot fill a step. The staged rows are removed when the
    run ends, and what a lost run left of its step when the next one begins.
    """
    spark = pending.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged_path = _staging_path(spark, out_path)
    remove_unlisted(spark, out_path)
    try:
        number = F.rand(0) if draw is None else draw
        pending.withColumn("_draw", number).sortWithinPartitions("_draw").write.parquet(staged_path)
        schema = T.StructType([*pending.schema.fields, T.StructField("_draw", T.DoubleType())])
        staged = spark.read.schema(schema).parquet(staged_path)
        waiting = staged.count()
        wanted = steps or -(-waiting // (rows_per_step or ROWS_PER_TASK * tasks))
        steps = min(wanted, waiting)
        for number in range(steps):
            draw = F.col("_draw")
            part = staged.filter((draw >= number / steps) & (draw < (number + 1) / steps)).drop("_draw")
            append_step(work(part), out_path)
    finally:
        _remove(spark, staged_path)


def run_generation(
    items: DataFrame,
    generator: Generator,
    out_path: str,
    keys: Sequence[str],
    coefficients: Sequence[float] = COEFFICIENTS,
    samples: int = SAMPLES,
    prefix: str = "prefix",
    condition: str = "coefficient",
    steps: int | None = None,
    tasks: int | None = None,
    batch_size: int = 16,
    rows_per_step: int | None = None,
    index: str | None = None,
) -> DataFrame:
    """Generate every missing condition of a suite, append, and return the whole table.

    A condition with any finished row is skipped. With ``index``, a name for the
    catalogue, finished conditions come from a bucketed index beside the results, which
    this brings up to date first, and only the items are shuffled to find what is missing.
    """
    spark = items.sparkSession
    schema = T.StructType(
        [
            *items.schema.fields,
            T.StructField(condition, T.DoubleType()),
            T.StructField("sample_i", T.IntegerType()),
            T.StructField("continuation", T.StringType()),
        ]
    )
    if index is None:
        done = read_results(spark, out_path, schema)
    else:
        done = finished_keys(spark, out_path, schema, keys, index, [condition])
    todo = pending_conditions(items, done, keys, coefficients, condition)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(part: DataFrame) -> DataFrame:
        texts = generate_batches(part.repartition(tasks), generator, prefix, condition, samples, batch_size)
        return sample_rows(texts).select(*schema.names)

    run_in_steps(todo, work, out_path, steps, tasks, rows_per_step)
    return read_results(spark, out_path, schema)


def run_labelling(
    rows: DataFrame,
    prompt: Column,
    labeller: Labeller,
    out_path: str,
    keys: Sequence[str],
    steps: int | None = None,
    tasks: int | None = None,
    batch_size: int = 16,
    rows_per_step: int | None = None,
    label: str = "label",
    index: str | None = None,
) -> DataFrame:
    """Label every row whose key is not labelled yet, append, and return the whole table.

    The labeller sees each distinct pending prompt once: all its rows are in one step.
    ``index`` names a bucketed index of the finished keys, as for ``run_generation``.
    """
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields, T.StructField(label, T.StringType())])
    if index is None:
        todo = pending_rows(rows, read_results(spark, out_path, schema), keys)
    else:
        todo = rows_not_in(rows, finished_keys(spark, out_path, schema, keys, index), keys)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = F.conv(F.substring(F.md5(prompt), 1, 12), 16, 10).cast("double")
    draw = F.coalesce(bits / float(1 << 48), F.rand(0))

    def work(part: DataFrame) -> DataFrame:
        return label_distinct(part, prompt, labeller, batch_size, label, tasks).select(*schema.names)

    run_in_steps(todo, work, out_path, steps, tasks, rows_per_step, draw)
    return read_results(spark, out_path, schema)
