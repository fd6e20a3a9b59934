"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all values within half the radius (the value itself and, for a radius
of two, its 64 one-bit neighbours). Two fingerprints that differ in at most two bits share one of
them, so a shuffle on the emitted values brings all links together; a value has at most 65 emitters,
whatever the data, so no group is large. Neighbours in a group are verified by their bit distance.
Exact copies are one fingerprint and never meet as pairs. Components come from contraction rounds.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.llm.common import cut, text_key

BITS = 64


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp long) for each row: bit b is 1 if more than half of all word shingles' XXH64 (seed 42) have it.

    Null and word-less texts get fingerprint zero; texts with fewer words than a shingle have one shingle.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").lower().split()
                if not words:
                    continue
                grams = zip(*(words[i:] for i in range(width))) if len(words) >= width else iter([words])
                ones, n = np.zeros(BITS, np.int64), 0
                while part := [digest(b" ".join(g), 42) for g in itertools.islice(grams, 32_768)]:
                    n += len(part)
                    bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones += bits.sum(axis=0, dtype=np.uint32)
                out[row] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text"))).mapInArrow(run, "doc_id long, text_key long, fp long")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) with a < b over distinct fingerprints that connect all within the radius (0, 1 or 2), verified.

    Radius 2: all members of a group of equal ball values lie within one bit of it, so any two differ in two at most, and a
    chain through the sorted members connects them. Radius 1: the one-bit neighbours meet the fingerprints themselves.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    if not radius:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    flips = [F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")) for b in range(BITS)]
    if radius == 1:
        ball = nodes.select(F.col("fp").alias("a"), F.explode(F.array(*flips)).alias("b")).where("a < b")
        return ball.join(nodes.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    ball = nodes.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("value"))
    before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
    pairs = ball.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected graph; root is the smallest node of its component.

    Each round every node follows its smallest neighbour (pointers are then doubled), and edges are rewritten to the
    nodes followed, until none is left. Rounds are written to the shared folder; nothing but a row count reaches the
    driver. Minima are combined before each shuffle and joins are left to skew splitting, so hubs don't gather in a task.
    """
    edges = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b"), "edges")
    label = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while edges.take(1):
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        step = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("to")), "step")
        for _ in range(2):
            far = step.select(F.col("x").alias("mid"), F.col("to").alias("far"))
            step = step.join(far, step["to"] == far["mid"], "left").select("x", F.coalesce("far", "to").alias("to"))
        step = cut(step, "step")
        move = lambda df, c, to: df.join(step.select(F.col("x").alias(c), F.col("to").alias(to)), c, "left")
        edges = cut(move(move(edges, "a", "ta"), "b", "tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a < b").distinct(), "edges")
        label = cut(move(label, "root", "next").select("node", F.coalesce("next", "root").alias("root")), "labels")
    return label


def rooted(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of each row, and (fp, first, root): smallest doc_id and component of each fingerprint."""
    prints = cut(fingerprints(docs, width), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    label = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return prints, nodes.join(label, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row of docs.

    Rows that share a doc_id each get a row. A null doc_id takes part; it counts as larger than any other, so a
    component of such rows alone has component_id null. Very long texts are hashed whole, in blocks. Columns other than doc_id and text are ignored; an empty table
    gives an empty result.
    """
    prints, nodes = rooted(docs, width, radius)
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = nodes.join(smallest, "root").select("fp", "component_id")
    hex16 = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(by_print, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, whole: that with the smallest doc_id (a null one last), by a hash of the text among several."""
    prints, nodes = rooted(docs, width, radius)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    firsts = prints.groupBy("fp").agg(F.min(own).alias("own")).join(nodes.select("fp", "root"), "fp")
    kept = firsts.groupBy("root").agg(F.min("own").alias("own")).select(F.col("own.doc_id").alias("kept_id"), F.col("own.text_key").alias("kept_key"))
    key, none = F.xxhash64("text"), F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id_key"), key.alias("text_key"))
    kept = kept.select(F.coalesce("kept_id", none).alias("id_key"), F.col("kept_key").alias("text_key")).distinct()
    return rows.join(kept, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]).select("row.*")
