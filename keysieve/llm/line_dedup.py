"""Line deduplication over levelled sorted runs (DataFrame functions only).

Documents come in batches, from the largest doc_ids to the smallest, so a key's first sight is in the
largest doc_id that holds it. A batch's own keys are anti-joined with the runs of what came before:
those in no run are new, and the batch's largest doc_id that holds them is the one that keeps them.
The batch then becomes a run of level 0: for each of its keys the hash, in how many of its documents
it is, and, if it is new, who keeps it. When a level has `fanout` runs they are merged into one of the
next, so a key is rewritten a logarithmic number of times.

Runs are tables in the folder the cluster shares, divided by hash into as many buckets as a shuffle
has partitions and sorted within each, one file a bucket. So anti-joins and merges read the same
bucket of every run side by side: nothing is shuffled or sorted again.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm.common import BLANKS, ascii_lower, cut, remove, shared_dir, text_key

#: Settings under which a table of one sorted file a bucket is read as sorted, and joins of such tables are merges.
AS_STORED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """Stripped of blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hash_of(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key; null for keys that are too short to count."""
    key = key_of(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def document_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_key, line hash), once for each row and key; rows without doc_id take no part."""
    hashes = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), lambda x: hash_of(x, min_chars)), lambda h: h.isNotNull()))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.explode(hashes).alias("line"))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class LineRuns:
    """The runs of a corpus: (line, n_docs, last_doc), last_doc null for keys that an earlier batch has. All rows of a doc_id must be in one batch."""

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = 40):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.merges = 0

    def _write(self, run: DataFrame) -> str:
        name = f"keysieve_run_{uuid.uuid4().hex}"
        # Hashes can't be compressed.
        writer = run.write.format("parquet").option("compression", "uncompressed").bucketBy(self.buckets, "line").sortBy("line")
        writer.option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{shared_dir(self.spark)}/{name}")

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _pair(self, one: str, other: str) -> DataFrame:
        """Two runs as one: counts are added, and a key has one keeper at most."""
        a = self.spark.table(one)
        b = self.spark.table(other).select("line", F.col("n_docs").alias("more"), F.col("last_doc").alias("other_doc"))
        n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
        return a.join(b, "line", "full").select("line", n_docs.alias("n_docs"), F.coalesce("last_doc", "other_doc").alias("last_doc"))

    def _merged(self, names: list[str]) -> str:
        """All of some runs in a new one, two at a time."""
        names = [*names]
        while len(names) > 1:
            pair, names = names[:2], names[2:]
            names.append(self._write(self._pair(*pair)))
            self._drop(pair)
            self.merges += 1
        return names[0]

    def unknown(self, keys: DataFrame) -> DataFrame:
        """Rows of keys (line, ...) that are in no run: one anti-join a run."""
        for name in self._runs():
            keys = keys.join(self.spark.table(name), "line", "left_anti")
        return keys

    def new_lines(self, docs: DataFrame) -> DataFrame:
        """A batch's (doc_id, text_key, line) whose keys are in no run yet."""
        return self.unknown(document_lines(docs, self.min_chars))

    def add(self, docs: DataFrame) -> None:
        self.add_lines(document_lines(docs, self.min_chars))

    def add_lines(self, lines: DataFrame) -> None:
        """Adds the run of a batch's document lines, then merges full levels upwards."""
        keys = lines.groupBy("line").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        with settings(self.spark, AS_STORED):
            if self._runs():
                # Divided by hash once, like the runs, and taken from there for both joins.
                keepers = self.unknown(keys).select("line", "last_doc")
                keys = keys.drop("last_doc").join(keepers, "line", "left")
            self.levels[0].append(self._write(keys))
            for level, names in enumerate(self.levels):
                if len(names) >= self.fanout:
                    if level + 1 == len(self.levels):
                        self.levels.append([])
                    self.levels[level], merged = [], self._merged(names)
                    self.levels[level + 1].append(merged)

    def frequent(self, min_docs: int) -> DataFrame:
        """(line, last_doc) of keys in that many documents or more; the runs go."""
        if not self._runs():
            return self.spark.createDataFrame([], "line binary, last_doc long")
        with settings(self.spark, AS_STORED):
            run = self._merged(self._runs())
            found = cut(self.spark.table(run).where(F.col("n_docs") >= min_docs).select("line", "last_doc"), "frequent")
        self._drop([run])
        self.levels = [[]]
        return found


def line_dedup(spark: SparkSession, tables: DataFrame | list[DataFrame], min_docs: int = 5, min_chars: int = 40, fanout: int = 4, keep: list[str] | None = None, batches: int = 8) -> DataFrame:
    """The columns of keep (all but text, by default), the kept text, n_lines and n_dropped for each row of the table or tables.

    Lines whose key has at least min_chars code points and is found in at least min_docs documents go, except in the
    largest doc_id holding it. A null or empty text is one empty line. A row without doc_id isn't a document: it counts
    for no key and keeps all its lines. Rows of one doc_id count as one document and each give a row. A very long text is
    one row, as are its lines. Tables must agree in their columns; those called n_lines or n_dropped are replaced.
    Empty tables give an empty result. Documents are divided into `batches` ranges of doc_id with about equally many rows.
    """
    docs, *more = tables if isinstance(tables, list) else [tables]
    for table in more:
        docs = docs.unionByName(table)
    keep = [c for c in keep or docs.columns if c not in ("text", "n_lines", "n_dropped")]
    ids = docs.select(F.col("doc_id").cast("double").alias("id")).where("id is not null")
    bounds = sorted({*ids.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)})
    later = sum((F.col("doc_id") < F.lit(b)).cast("int") for b in bounds) if bounds else F.lit(0)
    lines = cut(document_lines(docs, min_chars).withColumn("batch", later), "lines", by="batch")
    runs = LineRuns(spark, fanout, min_chars)
    for batch in range(len(bounds) + 1):
        runs.add_lines(lines.where(F.col("batch") == batch))
    frequent = runs.frequent(min_docs)
    hits = lines.join(frequent, "line").where("doc_id < last_doc")
    gone = hits.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))
    text = lines_of(F.col("text"))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    joined = rows.join(gone, ["doc_id", "text_key"], "left")
    stays = lambda x: F.coalesce(~F.array_contains(F.col("gone"), hash_of(x, min_chars)), F.lit(True))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.filter(text, stays))
    cut_up = joined.select("row", F.size(text).cast("long").alias("n_lines"), kept.alias("kept"))
    return cut_up.select("row.*", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
