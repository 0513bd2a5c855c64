"""Shared plumbing of the corpus operators: input, shared scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB pattern of a word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a function of :func:`map_arrow` gets at once.
PIECE_BYTES = 4 << 20
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset (tests), a folder under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


@contextmanager
def set_for(spark: SparkSession, key: str, value: str):
    """Within, the setting is value. The session's own comes back afterwards."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """Queries run within let go of their shuffle files when they end."""
    return set_for(spark, _FREE, "true")


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder below the shared one; it goes when the driver ends, or with :func:`drop`."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, place = _place(spark, path)
    fs.deleteOnExit(place)
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for t in tables:
        drop_folder(t.sparkSession, t._scratch)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def ship(spark: SparkSession) -> None:
    """Gives executors this subpackage's modules, once a context, so that they need not have them installed."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the file from here to the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/graphloom_llm.zip", "w") as z:
        z.writestr("graphloom/__init__.py", "")
        for f in sorted(top.glob("*.py")):
            z.write(f, f"graphloom/llm/{f.name}")
    context.addPyFile(f"{folder}/graphloom_llm.zip")
    context._graphloom_shipped = True


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about limit bytes, a row at least."""
    for b in batches:
        step = max(1, int(b.num_rows * limit / max(b.nbytes, 1)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with the subpackage at hand on the executors, in small pieces.

    Spark bounds a batch by rows and by bytes (64 MB); functions get it in slices, so what they make of it stays small, however long
    the texts are. No setting of the session is touched: operators that are built first and run later keep their memory bounds.
    """
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: fn(pieces(batches)), schema)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def null_safe_keys(*columns) -> list[F.Column]:
    """Two columns for each: a value without nulls and whether it was null, so that joins and windows need no null-safe test."""
    return [x for c in columns for x in (F.coalesce(c, F.lit(0)), c.isNull())]
