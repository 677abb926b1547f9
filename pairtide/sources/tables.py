"""Readers with fixed schemas, writers, and column guards."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_delimited(spark: SparkSession, path, schema: str | StructType, *, separator: str = ",") -> DataFrame:
    """A delimited file with a header, read with a given schema; nothing is inferred.  Columns may come in any order."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = require_columns(spark.read.csv(path, header=True, sep=separator), schema.names)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def read_pairs(spark: SparkSession, path, separator: str = "\t") -> DataFrame:
    """A headerless file whose first two columns are source and target; further columns are ignored."""
    raw = spark.read.csv(path, header=False, sep=separator)
    if len(raw.columns) < 2:
        raise ValueError("a pair file needs two columns")
    return raw.select(F.col("_c0").alias("source"), F.col("_c1").alias("target"))


def read_replicates(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several files as one table, with each row's file and the file's number in order of names."""
    kind = StructType.fromDDL(schema)
    rows = spark.read.csv(paths, header=True, schema=kind).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    numbers = spark.createDataFrame([(p.rsplit("/", 1)[-1], i) for i, p in enumerate(sorted(paths, key=lambda p: p.rsplit("/", 1)[-1]))], "source_file string, replicate int")
    return rows.join(F.broadcast(numbers), "source_file")


def read_document(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """A nested JSON document as a one-row table of structs."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_matrix(spark: SparkSession, path) -> DataFrame:
    """A sparse matrix in coordinate form: cell_id, gene_id, value; zeros are not stored."""
    return require_columns(spark.read.parquet(path), ["cell_id", "gene_id", "value"]).select("cell_id", "gene_id", F.col("value").cast("double").alias("value"))


def read_mapping(spark: SparkSession, path, key: str, value: str) -> DataFrame:
    """A mapping kept as a Parquet table of two columns; a key with two values is an error, equal rows count once."""
    rows = require_columns(spark.read.parquet(path), [key, value]).select(key, value).distinct()
    once = rows.groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias(value))
    message = F.concat(F.lit("several values for "), F.col(key).cast("string"))
    return once.select(key, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(value)).cast(rows.schema[value].dataType).alias(value))


def run_catalog(spark: SparkSession, path, keys: tuple[str, ...] = ("domain", "seed")) -> DataFrame:
    """The runs below a folder that is partitioned by ``keys``: their values, the number of files and their bytes."""
    files = require_columns(spark.read.parquet(path), keys).select(*keys, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_b")).distinct()
    return files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum("_b").alias("n_bytes"))


def write_runs(df: DataFrame, path, keys: list[str]) -> None:
    """``df`` as a folder of runs, one for each combination of ``keys``; rows of a run may lie in several files."""
    df.repartition(*keys, F.pmod(F.hash(*[c for c in df.columns if c not in keys]), F.lit(8))).write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The runs below ``path`` whose ``keys`` are in ``wanted``, a small table such as a filtered catalog; which folders are read is decided by its rows when the query runs."""
    runs = require_columns(spark.read.parquet(path), keys)
    return runs.join(F.broadcast(wanted.select(*keys).distinct()), keys)


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined with ``right`` by a row id; an id that is missing on a side, or is there twice, is an error."""
    one = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    both = one(left).withColumnRenamed("_n", "_l").join(one(right).withColumnRenamed("_n", "_r"), key, "full")
    ok = (F.coalesce("_l", F.lit(0)) == 1) & (F.coalesce("_r", F.lit(0)) == 1)
    message = F.concat(F.lit("rows don't align at "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(ok, F.col(key)).otherwise(F.raise_error(message).cast(left.schema[key].dataType))
    return both.withColumn(key, checked).drop("_l", "_r")


def read_layer(spark: SparkSession, path, layer: int) -> DataFrame:
    """One layer of a table of vectors that is partitioned by layer; the others are not read."""
    return spark.read.parquet(path).where(F.col("layer") == layer)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="pairtide-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a query when it ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How much of a table Spark hands to Python at once, and what that is for packed records, like a row group of a file of them.
_BATCH, _PACKED_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Tables of this process that were settled and not removed.
_settled: list[str] = []


@contextmanager
def passing(spark: SparkSession):
    """Removes the tables that were settled inside the block at its end, when all results that read them must have been written."""
    start = len(_settled)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _settled[start:]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        del _settled[start:]


def settled(df: DataFrame, name: str = "table", small: bool = True, passed: bool = False, packed: bool = False) -> DataFrame:
    """A table that later steps use several times, written once to the folder that the cluster shares; a small one, with a few rows a group, as one file.

    ``passed``: the shuffle files behind it are removed as soon as it is written; else Spark keeps them until its garbage is collected.
    ``packed``: rows are packed records, which tasks pass to Python, and later read, some ``_PACKED_BYTES`` at a time and not by thousands of rows."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    _settled.append(path)
    settings = ({_CLEANED: "true"} if passed else {}) | ({_BATCH: str(_PACKED_BYTES)} if packed else {})
    before = {c: spark.conf.get(c, None) for c in settings}
    options = {"parquet.block.size": str(_PACKED_BYTES), "parquet.page.size.row.check.min": "8"} if packed else {}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        (df.repartition(1) if small else df).write.options(**options).parquet(path)
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """Packed records that later steps use several times; see :func:`settled`."""
    return settled(df, name, small=False, passed=True, packed=True)


def write_delimited(df: DataFrame, path, *, separator: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=separator)


def write_layers(df: DataFrame, path) -> None:
    df.repartition("layer").write.mode("overwrite").partitionBy("layer").parquet(path)


def write_subsets(df: DataFrame, path, column: str) -> None:
    """One folder for each value of a column, named by its slug."""
    from ..functions.scalars import slug

    df.withColumn("subset", slug(F.col(column))).write.mode("overwrite").partitionBy("subset").parquet(path)


def write_summary(row: DataFrame, path, title: str) -> None:
    """A one-row table as a small Markdown text."""
    lines = F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), *[F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in row.columns])
    row.limit(1).select(lines.alias("value")).write.mode("overwrite").text(path)


def preview(df: DataFrame, rows: int = 24) -> None:
    df.show(rows, truncate=False)
