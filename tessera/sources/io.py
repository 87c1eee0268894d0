"""Readers and writers of JSONL records, run files and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import save


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line; blank lines are skipped, a malformed line is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_sections(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All sections.jsonl files below a folder; none is an error."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "sections.jsonl").text(root)
    if lines.isEmpty():
        raise FileNotFoundError(f"no sections.jsonl with records below {root}")
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


#: Files that a task writes, and parts of a scan (each of a few files, as Spark counts the cost of opening one) that a task reads.
FILES, PARTS = 1000, 64


def write_files(rows: DataFrame, path: str, by: str) -> None:
    """A text file for each value of ``by``, in a folder of its own, from rows of that column and ``value``.

    Files cost far more than their few bytes, so tasks are dealt by their number, and each task puts its own in place when
    it commits: the driver would move them one by one.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.select(by).distinct().count() // FILES))
    out = rows.repartition(tasks, by).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    out.partitionBy(by).text(path)


def _fewer_tasks(files: DataFrame) -> DataFrame:
    """Small files in fewer tasks: Spark's scan would start one for each few of them."""
    parts, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(4 * cores, -(-parts // PARTS))) if parts > 4 * cores else files


def read_files(spark: SparkSession, root: str, schema: T.StructType, *, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """S3: (records, dead letters) of all files below a folder, one JSON object a file, read once.

    Records have the columns of the schema and ``file_path``; dead letters are (file_path, reason, size): files that are
    blank, aren't JSON, are JSON of another kind than an object, or have a value of another type than the schema's. Each file
    with a byte in it is in one of the two (Spark's readers pass over files of no length).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = _fewer_tasks(files.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("value")))
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    record = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    variant = F.try_parse_json("value")
    reason = (
        F.when(F.trim("value", F.lit(" \t\r\n")) == "", "blank").when(variant.isNull(), "not JSON").when(
            ~F.schema_of_variant(variant).startswith("OBJECT"), "not an object"
        ).when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "a value of another type")
    )
    read = save(files.withColumn("r", record).select("file_path", "r", reason.alias("reason"), F.octet_length("value").alias("size")))
    good = read.where("reason is null").select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], "file_path")
    return good, read.where("reason is not null").select("file_path", "reason", "size")


def read_scope(
    spark: SparkSession,
    root: str,
    scope: str,
    schema: T.StructType,
    *,
    signature: str | None = None,
    combo_ids: list[str] | None = None,
    case_ids: list[str] | None = None,
    pattern: str = "*.json",
) -> DataFrame:
    """S3: the records of a scope's files with their paths; optional filters. ``read_files`` has the malformed ones, too."""
    df = read_files(spark, f"{root}/{scope}", schema, pattern=pattern)[0]
    if signature is not None:
        df = df.where(F.col("execution.signature") == signature)
    for name, values in (("combo_id", combo_ids), ("case_id", case_ids)):
        if values:
            df = df.where(F.col(name).isin(values))
    return df


def upsert_partitions(path: str, changes: DataFrame, by: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A stored table of a folder a value of ``by``, after changes to it; only folders that the changes name are written.

    ``merge`` makes the new rows of the named folders from (their rows, the changes). The old rows of these folders only
    are read (Spark prunes the others), and their files are replaced when the new ones are complete. A second run of the
    same changes leaves the same rows.
    """
    spark = changes.sparkSession
    new = save(changes)

    def stored() -> DataFrame:
        found = spark.read.parquet(path)
        return found.select(*[c for c in found.columns if c != by], F.col(by).cast(dict(new.dtypes)[by]).alias(by))

    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        named = new.select(by).distinct()
        old = stored().join(F.broadcast(named) if _few(new, by) else named, by, "left_semi")
    else:
        old = new.limit(0)
    merged = save(merge(old, new))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return stored()


def _few(rows: DataFrame, by: str, most: int = 100_000) -> bool:
    """Whether the distinct values are few enough to be sent to all tasks."""
    return rows.select(by).distinct().limit(most + 1).count() <= most


def write_jsonl(df: DataFrame, path: str) -> None:
    """Records as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, path: str, by: str | None = None) -> None:
    """Report rows as JSON, in a folder a value where asked."""
    (df.write.mode("overwrite").partitionBy(by) if by else df.write.mode("overwrite")).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; give it what review.csv_ready returns."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
