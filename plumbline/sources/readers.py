"""Readers: exported question files to the canonical question table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import mcq
from ..session import checkpointed

TRUTHFUL_SCHEMA = (
    "question STRING, mc1_targets STRUCT<choices: ARRAY<STRING>, labels: ARRAY<INT>>"
)
OPEN_SCHEMA = (
    "options ARRAY<STRUCT<label: STRING, text: STRING>>, passage STRING, question STRING, "
    "answerKey STRING, dataset STRING"
)
# Accepted names of the two sources.
TRUTHFUL_NAMES = ("truthfulqa", "truthful_qa", "tqa")
OPEN_NAMES = ("open_llm", "open-llm", "openllm")
PIECE_LINES = 100_000


def numbered_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(_file, _line, _row): the lines of text files that hold records, with the records' numbers in
    their file, from 0. Blank lines, and with `header` each file's first line, are no records.

    Files are read in splits, each by one task and in order. The lines are written once with their
    split and place; records are counted where they are read, and the number of records in the splits
    before, a row for each split, completes a record's number. How files were split changes nothing.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("_line"),
    )
    placed = checkpointed(lines)
    split = ["_file", "_block"]
    if header:
        first = placed.groupBy(*split).agg(F.min("_at").alias("_at")).where("_block = 0")
        placed = placed.join(first, [*split, "_at"], "left_anti")
    # Places in a split go up by one at each line; blank lines are few and move those behind them.
    records = checkpointed(placed.where(F.trim("_line") != "").withColumn("_piece", F.expr(f"_at div {PIECE_LINES}")))
    piece = [*split, "_piece"]
    before = Window.partitionBy("_file").orderBy("_block", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = records.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n")).select(
        *piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*piece).orderBy("_at")
    return (
        records.withColumn("_own", F.row_number().over(inside) - 1)
        .join(offsets, piece)
        .select("_file", "_line", (F.col("_own") + F.col("_before")).alias("_row"))
    )


def _records(spark: SparkSession, path: str, file_format: str, schema: str) -> DataFrame:
    """Rows of line-wise JSON, or of CSV with a header in each file and nested columns as JSON, with
    `_file`, `_row` (the record's number in its file) and `qid` where the file has one."""
    fields = T.StructType.fromDDL(schema).fields
    if file_format == "csv":
        names = spark.read.option("header", True).csv(path).columns
        parsed = F.from_csv("_line", F.lit(", ".join(f"`{n}` string" for n in names)), {"escape": '"'})

        def column(f: T.StructField):
            if f.name not in names:
                return F.lit(None).cast(f.dataType).alias(f.name)
            raw = F.col(f"_r.`{f.name}`")
            nested = isinstance(f.dataType, (T.StructType, T.ArrayType))
            return (F.from_json(raw, f.dataType) if nested else raw.cast(f.dataType)).alias(f.name)

        own = F.col("_r.`qid`") if "qid" in names else F.lit(None).cast("string")
        columns = [own.alias("qid"), *[column(f) for f in fields]]
    else:
        parsed = F.from_json("_line", f"qid STRING, {schema}")
        columns = [F.col("_r.qid").alias("qid"), *[F.col(f"_r.`{f.name}`") for f in fields]]
    lines = numbered_lines(spark, path, header=file_format == "csv")
    return lines.withColumn("_r", parsed).select("_file", "_row", *columns)


def _scan(spark: SparkSession, path: str, file_format: str, schema: str) -> DataFrame:
    """Rows with a `qid`: a column of the file, else the ordinal of the record in path order."""
    if file_format == "parquet":
        if "qid" in spark.read.parquet(path).columns:
            return spark.read.schema(f"qid STRING, {schema}").parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        located = rows.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.row_index").alias("_row"),
        )
        return mcq.with_ordinal(located)
    rows = mcq.with_ordinal(_records(spark, path, file_format, schema), name="_ordinal")
    return rows.select(F.coalesce("qid", "_ordinal").alias("qid"), *[c for c in rows.columns if c not in ("qid", "_ordinal")])


def read_truthful(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    shuffle_options: bool = False,
    shuffle_seed: int | None = None,
) -> DataFrame:
    rows = _scan(spark, path, file_format, TRUTHFUL_SCHEMA)
    return mcq.from_truthful(rows, shuffle_options, shuffle_seed)


def read_open(
    spark: SparkSession, path: str, file_format: str = "parquet", split: str | None = None
) -> DataFrame:
    """`split` names a sub-folder of the export, such as train."""
    return mcq.from_open(
        _scan(spark, f"{path}/{split}" if split else path, file_format, OPEN_SCHEMA)
    )


def pick_source(name: str | None):
    """Reader function of a source name; case and outer blanks do not matter."""
    cleaned = (name or "").strip().lower()
    if cleaned in TRUTHFUL_NAMES:
        return read_truthful
    if cleaned in OPEN_NAMES:
        return read_open
    raise ValueError(f"Unknown dataset: {cleaned}")


def read_questions(
    spark: SparkSession,
    name: str,
    path: str,
    sample_size: int | None = None,
    seed: int | None = 1337,
    **options,
) -> DataFrame:
    """Canonical questions of a named source, optionally an exact seeded sample."""
    rows = pick_source(name)(spark, path, **options)
    return mcq.sample(rows, sample_size, ["qid"], seed)
