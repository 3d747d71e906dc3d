"""Readers and writers of suites, pools, results and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def columns(**types: str | T.DataType) -> T.StructType:
    """A schema from names and types, without a session."""
    schema = T.StructType()
    for name, kind in types.items():
        schema = schema.add(name, kind)
    return schema


IDIOM_SUITE = columns(idiom="string", variant_id="integer", prefix="string")
FIGURATIVE_SUITE = columns(
    category="string", expression="string", variant_id="integer", prefix="string", gold="boolean"
)
DRAFT_SUITE = columns(expression="string", type="string", prefix="string", status="string")
POOL = columns(sentence="string", idiom="string", span="string", usage="string")
DIRECTION = columns(
    v=T.ArrayType(T.DoubleType()), s="double", midpoint="double", source_layer="integer", model="string", source="string"
)

# Folders of a table that is appended to in steps: steps, their list, and what is being written.
STEP, LISTED, WRITING = "step=", "_listed", "_writing"


def results_schema(
    suite: T.StructType, condition: str = "alpha_factor", labelled: bool = False, rated: bool = False
) -> T.StructType:
    """Columns of a result table over a suite, with a label or a hand label if asked."""
    added = [
        T.StructField(condition, T.DoubleType()),
        T.StructField("sample_i", T.IntegerType()),
        T.StructField("continuation", T.StringType()),
    ]
    if rated:
        added.append(T.StructField("human_label", T.StringType()))
    if labelled:
        added.append(T.StructField("label", T.StringType()))
    return T.StructType([*suite.fields, *added])


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _or_missing_input(read, path: str, hint: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"{path} not found. {hint}") from error
        raise


def read_csv_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    multiline: bool = True,
    hint: str = "Write it first.",
) -> DataFrame:
    """A header CSV with a declared schema; quoted commas, quotes and newlines survive.

    The header is checked against the schema. An empty field is NULL, and ``NA``
    or ``null`` are ordinary strings. A multi-line file is read by one task, so
    pass many files, or ``multiline=False`` when no field holds a newline.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )
    return _or_missing_input(reader.csv, path, hint)


def read_parquet_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    hint: str = "Write it first.",
) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return _or_missing_input(reader.parquet, path, hint)


def read_pools(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """The parts of a contrast pool, one frame each."""
    return [read_parquet_table(spark, path, POOL) for path in paths]


def _files(spark: SparkSession, path: str):
    """The file system that holds a path, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _children(spark: SparkSession, path: str) -> list:
    files, place = _files(spark, path)
    return list(files.listStatus(place)) if files.exists(place) else []


def committed_steps(spark: SparkSession, path: str) -> list[str]:
    """Names of the steps that are in a table."""
    return sorted(child.getPath().getName() for child in _children(spark, f"{path}/{LISTED}"))


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows written so far; an empty table before the first append.

    Of the folders that ``append_step`` makes only listed ones are read, next to the
    files that stand in the table's own folder.
    """
    steps = [f"{path}/{STEP}{name}" for name in committed_steps(spark, path)]
    plain = [
        child.getPath().toString()
        for child in _children(spark, path)
        if child.isFile() and not child.getPath().getName().startswith(("_", "."))
    ]
    if not steps and not plain:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*steps, *plain)


def append_step(rows: DataFrame, path: str) -> str:
    """Append rows to a table all at once or not at all, and name the step.

    They are written to a hidden folder, which enters the table by one rename and is then
    listed by an empty file. A run that is lost before that leaves the table as it was.
    Renaming a folder is one operation on HDFS and on local disks; where it is not, the list
    still holds whole steps only.
    """
    spark, name = rows.sparkSession, uuid4().hex
    hidden, shown = f"{path}/{WRITING}/{name}", f"{path}/{STEP}{name}"
    rows.write.parquet(hidden)
    files, place = _files(spark, hidden)
    if not files.rename(place, _files(spark, shown)[1]):
        raise OSError(f"{hidden} could not be renamed to {shown}")
    _list_step(spark, path, name)
    return name


def _list_step(spark: SparkSession, path: str, name: str) -> None:
    files, place = _files(spark, f"{path}/{LISTED}/{name}")
    files.create(place, False).close()


def remove_unlisted(spark: SparkSession, path: str) -> list[str]:
    """Remove what lost runs left of their steps; call it while no other run appends."""
    listed = set(committed_steps(spark, path))
    left = [child.getPath() for child in _children(spark, f"{path}/{WRITING}")]
    for child in _children(spark, path):
        name = child.getPath().getName()
        if name.startswith(STEP) and name.removeprefix(STEP) not in listed:
            left.append(child.getPath())
    for place in left:
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return [place.getName() for place in left]


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_csv_rows(rows: DataFrame, path: str) -> None:
    """Append to a folder of header CSV files, which ``read_csv_table`` reads as one table."""
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_report_csv(table: DataFrame, path: str) -> None:
    """A final table as one CSV file with a header.

    For report tables only: they hold one row per condition or series. What makes
    them stays spread over tasks; only the finished rows meet in one.
    """
    table.repartition(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
