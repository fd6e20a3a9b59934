"""What the operators of this subpackage share: word rules, checkpoints and input normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these (the contract's [\x20\x09-\x0D]).
BLANKS = " \t\n\x0b\f\r"
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, as in tests, an unset one becomes a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="keysieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path_of(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def cut(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder (in folders by a column, if given) and reads it again.

    Lineage ends here and lost executors cost nothing before it. The table goes with `discard`, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keysieve-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    fs, target = _path_of(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._cut_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system."""
    fs, target = _path_of(spark, path)
    fs.delete(target, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def binary(column) -> list:
    """An Arrow string column as Python bytes objects, None for null."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
