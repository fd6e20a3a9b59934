"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue.

Trees are fitted on a bounded sample and broadcast. Every vector is routed to its leaf in each tree. A
query visits leaves in order of the smallest margin by which it misses them, over all trees at once;
the rows found there are ranked by exact distance.

How many leaves a query visits follows the table: the exact neighbours of some queries are found among
all rows, and the budget is what reaches `recall` of them. So recall holds at any size; where vectors
are not clustered it is the share of rows scanned that holds, and time grows with their product.

Trees of a bounded sample have a bounded depth, so leaves grow with the table. A leaf of more than
`SPLIT` rows is divided further by the task that holds it, on its own rows, and a query goes on there
by a queue of the same kind: into parts by the margin by which it misses them, until that is no less
than the distance of the last neighbour it has. So this second step loses nothing.

Rows meet queries by a shuffle on buckets of leaves, where each query's rows are merged. Of equal
vectors only the k + 1 smallest ids can be among k nearest, so the others leave before the shuffle;
equal queries are searched once.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.llm.common import cut

#: Vectors that the trees are fitted on, at most, and queries whose exact neighbours set the leaf budget.
SAMPLE, TRIALS = 16_384, 128
#: Rows of a leaf beyond which the task that holds it divides it further.
SPLIT = 256


class Forest:
    """Complete binary trees: node i's children are 2i+1 and 2i+2; leaves are numbered through all trees."""

    def __init__(self, sample, depth: int, trees: int, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.depth, self.trees, self.nodes = depth, trees, (1 << depth) - 1
        dims = sample.shape[1]
        self.direction = np.zeros((trees, self.nodes, dims), np.float32)
        self.middle = np.zeros((trees, self.nodes), np.float32)
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for i in range(self.nodes):
                rows = parts.pop(i)
                d = rng.standard_normal(dims)
                if len(rows) >= 2:
                    a, b = rng.choice(rows, 2, replace=False)
                    if (gap := sample[a] - sample[b]).any():
                        d = gap
                d = (d / np.linalg.norm(d)).astype(np.float32)
                x = sample[rows] @ d
                m = np.float32(np.median(x)) if len(rows) else np.float32(0)
                self.direction[t, i], self.middle[t, i] = d, m
                parts[2 * i + 1], parts[2 * i + 2] = rows[x <= m], rows[x > m]

    def leaves_of(self, vectors):
        """(rows, trees) leaf numbers."""
        import numpy as np

        out = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", vectors, self.direction[t, node]) > self.middle[t, node]
                node = 2 * node + 1 + right
            out[:, t] = t * (self.nodes + 1) + node - self.nodes
        return out

    def missed(self, vector):
        """The largest margin by which a vector misses each leaf, over the leaf's path."""
        import numpy as np

        margin = self.direction @ vector - self.middle
        out = np.zeros((self.trees, 1), np.float32)
        for level in range(self.depth):
            m = margin[:, (1 << level) - 1 : (2 << level) - 1]
            sides = np.maximum(out, np.maximum(m, 0)), np.maximum(out, np.maximum(-m, 0))
            out = np.stack(sides, axis=2).reshape(self.trees, -1)
        return out.ravel()

    def search(self, vector, leaves: int):
        """The first leaves over all trees, by smallest missed margin."""
        import numpy as np

        return np.argsort(self.missed(vector), kind="stable")[:leaves]


class Parts:
    """A large leaf divided on its own rows, down to `leaf` rows, by directions between two of them. A node is its rows, or (direction, middle, place of its first child)."""

    def __init__(self, x, rows, leaf: int, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.nodes, todo = [None], [(0, rows)]
        while todo:
            at, rows = todo.pop()
            self.nodes[at] = rows
            if len(rows) <= leaf:
                continue
            a, b = rng.choice(rows, 2, replace=False)
            gap = x[a] - x[b]
            if not (norm := np.linalg.norm(gap)):
                continue
            direction = gap / norm
            along = x[rows] @ direction
            middle = np.median(along)
            left = along <= middle
            if left.all():
                continue
            self.nodes[at] = (direction, middle, len(self.nodes))
            todo += [(len(self.nodes), rows[left]), (len(self.nodes) + 1, rows[~left])]
            self.nodes += [None, None]


class Best:
    """The nearest rows of one query that were seen, each id once."""

    def __init__(self, x, ids, y, k: int):
        import numpy as np

        self.x, self.ids, self.y, self.k, self.compared = x, ids, y, k, 0
        self.found, self.scores = np.zeros(0, np.int64), np.zeros(0)

    @property
    def reach(self) -> float:
        """The distance beyond which nothing is wanted."""
        return self.scores[-1] if len(self.scores) == self.k else math.inf

    def see(self, rows) -> None:
        import numpy as np

        self.compared += len(rows)
        gap = self.x[rows] - self.y
        ids, scores = np.concatenate([self.found, self.ids[rows]]), np.concatenate([self.scores, np.sqrt((gap * gap).sum(axis=1))])
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, scores[first]))[: self.k]
        self.found, self.scores = ids[order], scores[first][order]

    def search(self, trees: list[Parts]) -> None:
        """Parts of several large leaves by one queue of missed margins, as long as they can hold something nearer."""
        queue = [(0.0, i, 0) for i in range(len(trees))]
        while queue:
            missed, i, at = heapq.heappop(queue)
            if missed > self.reach:
                return
            node = trees[i].nodes[at]
            if not isinstance(node, tuple):
                self.see(node)
                continue
            direction, middle, child = node
            margin = float(self.y @ direction - middle)
            heapq.heappush(queue, (max(missed, margin), i, child))
            heapq.heappush(queue, (max(missed, -margin), i, child + 1))


def matrix(column, kind: str = "float32"):
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def exact(rows: DataFrame, asks, points, k: int) -> DataFrame:
    """(asked, vec_id, vector, score): the k nearest rows of each of some queries (ids, vectors), other than itself, by distances to all rows."""
    import numpy as np

    vector = rows.schema["vector"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, points.shape[1])))] * len(asks)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), "float64")
            for q, y in enumerate(points):
                d = np.where(ids == asks[q], np.inf, np.sqrt(((x - y) ** 2).sum(axis=1)))
                first = np.lexsort((ids, d))[:k] if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                first = first[d[first] < np.inf]
                held = [np.concatenate(p) for p in zip(best[q], (d[first], ids[first], x[first]))]
                order = np.lexsort((held[1], held[0]))[:k]
                best[q] = tuple(h[order] for h in held)
        for q, (d, ids, x) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), asks[q])), pa.array(ids), pa.array(list(x), pa.list_(pa.float32() if "float" in vector else pa.float64())), pa.array(d)], names=["asked", "vec_id", "vector", "score"])

    nearest_first = Window.partitionBy("asked").orderBy("score", "vec_id")
    found = rows.select("vec_id", "vector").mapInArrow(run, f"asked long, vec_id long, vector {vector}, score double")
    return found.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k).drop("n")


def leaf_budget(forest: Forest, asks, points, found, recall: float) -> int:
    """Least number of leaves in which queries meet that share of their exact neighbours; found: a table of asked and vector."""
    import numpy as np

    places, asked = [], found["asked"].to_numpy()
    if not len(asked):
        return 1
    near = forest.leaves_of(matrix(found["vector"].combine_chunks()))
    for ask, point in zip(asks, points):
        if (own := asked == ask).any():
            place = np.empty(forest.trees * (forest.nodes + 1), np.int64)
            place[forest.search(point.astype(np.float32), len(place))] = np.arange(len(place))
            places.append(place[near[own]].min(axis=1))
    ranks = np.sort(np.concatenate(places))
    return int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) without null, zero and non-finite vectors, one row for each vec_id; floats stay floats, others become doubles."""
    v = F.col("embedding").cast("array<double>")
    kept = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    fine = F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast(kept)).alias("vector"))


def nearest(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100, trees: int = 12, leaf: int = 64, leaves: int | None = 96, sample: int = SAMPLE, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance, ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but the query's own. Vectors that are
    null, zero, or hold null or non-finite components take no part; vectors are compared with those of their own length
    (each length has its own forest); of rows that share a vec_id the smallest vector counts. With fewer candidates than k
    all those found are returned; an empty table gives an empty result. Other columns are ignored. A query visits `leaves`
    leaves, or as many more as `recall` needs; with None it visits all and the result is exact. At most `sample` vectors
    of a length, and the neighbours of `TRIALS` queries, reach the driver. Long vectors are handled like others.
    """
    rows = cut(usable(vectors), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy("length").collect()
    out = None
    for r in lengths:
        own = rows if len(lengths) == 1 else rows.where(F.size("vector") == r["length"])
        found = _of_one_length(spark, own, r["count"], k, every, trees, leaf, leaves, sample, recall)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _of_one_length(spark: SparkSession, rows: DataFrame, total: int, k: int, every: int, trees: int, leaf: int, leaves: int | None, sample: int, recall: float) -> DataFrame:
    import numpy as np

    whole, vector = leaves is None, rows.schema["vector"].dataType.simpleString()
    trees = 1 if whole else trees
    points = matrix(rows.orderBy(F.xxhash64("vec_id")).limit(sample).select("vector").toArrow()["vector"].combine_chunks())
    depth = max(0, min(math.ceil(math.log2(max(total / leaf, 1))), int(math.log2(max(len(points) / 8, 1)))))
    same = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = queries.groupBy("vector").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "vector")
    forest = Forest(points, depth, trees)
    if whole:
        leaves = forest.trees * (forest.nodes + 1)
    elif len(trials := asked.orderBy(F.xxhash64("vec_id")).limit(TRIALS).toArrow()):
        asks, wanted = trials["vec_id"].to_numpy(), matrix(trials["vector"].combine_chunks(), "float64")
        leaves = max(leaves, leaf_budget(forest, asks, wanted, exact(kept, asks, wanted, k).select("asked", "vector").toArrow(), recall))
    shared = spark.sparkContext.broadcast(forest)
    size = total / (1 << depth)
    salts = max(1, math.ceil(size / 4096))
    buckets = max(1, math.ceil(total * trees / (20_000 * salts)))

    def bucket_of(leaf):
        return ((leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            got = shared.value.leaves_of(matrix(batch.column(1)))
            for t in range(got.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got[:, t]), pa.array(bucket_of(got[:, t]))], names=["vec_id", "vector", "leaf", "bucket"])

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            for i, v in enumerate(matrix(batch.column(1))):
                found = shared.value.search(v, leaves)
                at = bucket_of(found)
                order = np.argsort(at, kind="stable")
                own, starts = np.unique(at[order], return_index=True)
                parts = pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), pa.array(found[order].astype(np.int64)))
                index = pa.array(np.full(len(own), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), parts, pa.array(own)], names=["vec_id", "vector", "leaves", "bucket"])

    def rank(key, data, asked):
        import pyarrow as pa

        out = [[], [], []]
        if data.num_rows and asked.num_rows:
            column = lambda t, c: t.column(c).combine_chunks()
            x, at = matrix(column(data, "vector"), "float64"), data["leaf"].to_numpy()
            y, want = matrix(column(asked, "vector"), "float64"), column(asked, "leaves")
            ids, asks = data["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            order = np.argsort(at, kind="stable")
            at, divided = at[order], {}
            for i in range(len(want)):
                own, best = want[i].values.to_numpy(), Best(x, ids, y[i], k + 1)
                small, large = [], []
                for number, lo, hi in zip(own, np.searchsorted(at, own, "left"), np.searchsorted(at, own, "right")):
                    if hi - lo <= SPLIT or whole:
                        small.append(order[lo:hi])
                    else:
                        if number not in divided:
                            divided[number] = Parts(x, order[lo:hi], leaf, int(number))
                        large.append(divided[number])
                if small and len(near := np.concatenate(small)):
                    best.see(near)
                best.search(large)
                if len(best.found):
                    out[0].append(np.full(len(best.found), asks[i]))
                    out[1].append(best.found)
                    out[2].append(best.scores)
        arrays = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"asked": pa.array(arrays[0], pa.int64()), "vec_id": pa.array(arrays[1], pa.int64()), "score": pa.array(arrays[2], pa.float64())})

    salt = (F.pmod(F.xxhash64("vec_id"), F.lit(salts)) if salts > 1 else F.lit(0)).cast("int")
    left = kept.mapInArrow(place, f"vec_id long, vector {vector}, leaf long, bucket long").withColumn("salt", salt)
    right = asked.mapInArrow(ask, f"vec_id long, vector {vector}, leaves array<long>, bucket long").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(rank, "asked long, vec_id long, score double")
    nearest_first = Window.partitionBy("asked").orderBy("score", "vec_id")
    found = found.groupBy("asked", "vec_id").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k + 1).drop("n")
    of = queries.select(F.col("vec_id").alias("query_id"), "vector").join(asked.select(F.col("vec_id").alias("asked"), "vector"), "vector").select("query_id", "asked")
    pairs = of.join(found, "asked").where("query_id <> vec_id")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
