"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A document is a byte string: each token (A-Z lower-cased) followed by a space, then one end byte. A
byte is eight binary decisions; each decision's context is the bits already known plus up to `depth`
earlier bytes, across tokens. Every node of that tree has a Krichevsky-Trofimov estimate, and a
node's prediction mixes its own estimate with its child's by the weights that context-tree weighting
gives after training.

The tree holds every context of the training texts, so it grows with them, and it is never in one place:
each depth is a table of nodes. Weights go up from the deepest level by one aggregation a level
(a node has 256 children at most), mixed predictions come down by one join a level. What a text needs
of the tree is one number for each gram (a byte and the `depth` bytes before it), so the tree gives
a table of the distinct grams of all texts with their log probabilities. The most frequent of
these grams, `near` at most, are broadcast, and so are the most frequent tokens; for what is rarer
a text sends (key, times), combined, to one shuffle join with both tables.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm.common import cut, discard

END = b"\n"


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series eight places further, and back; right to 1e-9."""
    y, product = x + 8, x
    for i in range(1, 8):
        product = product * (x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - 2 * math.lgamma(0.5)


def mask(depth: int) -> Column:
    return F.lit((1 << (8 * depth)) - 1)


def decisions(gram: Column) -> Column:
    """The eight decisions of a gram's last byte: heap (a 1, then the bits known) and bit."""
    byte = gram.bitwiseAND(F.lit(255))
    one = lambda j: F.struct(F.shiftright(byte, 8 - j).bitwiseOR(F.lit(1 << j)).alias("heap"), F.shiftright(byte, 7 - j).bitwiseAND(F.lit(1)).alias("bit"))
    return F.array(*map(one, range(8)))


def node_key(gram: Column, heap: Column, depth: int) -> Column:
    """A node of a depth: its context bytes, then heap."""
    return F.shiftleft(F.shiftright(gram, 8).bitwiseAND(mask(depth)), 8).bitwiseOR(heap)


def tree(grams: DataFrame, depth: int) -> list[DataFrame]:
    """For each depth (key, zero, one): log10 probabilities of a 0 and a 1 bit where a node of that depth is the deepest that exists.

    grams: (gram, n), n > 0. Both probabilities are summed on their own, so neither is ever rounded to zero.
    """
    rows = grams.select("gram", "n", F.explode(decisions(F.col("gram"))).alias("at")).select(node_key(F.col("gram"), F.col("at.heap"), depth).alias("key"), F.col("at.bit").alias("bit"), "n")
    level = rows.groupBy("key").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("zeros"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("ones"))
    own, deeper = F.col("own"), F.col("deeper")
    level = cut(level.withColumn("mixed", kt(F.col("zeros"), F.col("ones"))).withColumn("weight", F.lit(1.0)), "nodes")
    up = lambda d: F.shiftleft(F.shiftright(F.col("key"), 8).bitwiseAND(mask(d)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    found = [level]
    for d in range(depth - 1, -1, -1):
        level = found[0].groupBy(up(d).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("deeper")).withColumn("own", kt(F.col("zeros"), F.col("ones")))
        most = F.greatest(own, deeper)
        mixed = most + F.log(F.exp(own - most) + F.exp(deeper - most)) - math.log(2)
        found.insert(0, cut(level.select("key", "zeros", "ones", mixed.alias("mixed"), (1 / (1 + F.exp(F.least(deeper - own, F.lit(700.0))))).alias("weight")), "nodes"))
    total, w, out = F.col("zeros") + F.col("ones") + 1, F.col("weight"), []
    for d, nodes in enumerate(found):
        nodes = nodes.select("key", "weight", ((F.col("zeros") + 0.5) / total).alias("p0"), ((F.col("ones") + 0.5) / total).alias("p1"))
        if d:
            above = out[-1].select(F.col("key").alias("up"), F.col("acc0").alias("up0"), F.col("acc1").alias("up1"), F.col("left").alias("over"))
            nodes = nodes.withColumn("up", up(d - 1)).join(above, "up")
        else:
            nodes = nodes.withColumns({"up0": F.lit(0.0), "up1": F.lit(0.0), "over": F.lit(1.0)})
        nodes = nodes.select("key", (F.col("up0") + F.col("over") * w * F.col("p0")).alias("acc0"), (F.col("up1") + F.col("over") * w * F.col("p1")).alias("acc1"), (F.col("over") * (1 - w)).alias("left"), "p0", "p1")
        last = lambda acc, p: F.log10(F.col(acc) + F.col("left") * F.col(p))
        out.append(cut(nodes.select("key", "acc0", "acc1", "left", last("acc0", "p0").alias("zero"), last("acc1", "p1").alias("one")), "tree"))
    discard(*found)
    return out


def gram_scores(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(gram, seen, score): log10 probability of each gram's last byte after the others.

    A gram of the training texts (n > 0) has all its nodes at the deepest level; another one takes, for each of
    its decisions, the deepest node there is. Without any node a decision has probability one half.
    """
    depth = len(levels) - 1
    rows = grams.select("gram", "n", "seen", F.explode(decisions(F.col("gram"))).alias("at")).select("gram", "n", "seen", F.col("at.heap").alias("heap"), F.col("at.bit").alias("bit"))
    of = F.when(F.col("bit") == 1, F.col("one")).otherwise(F.col("zero"))
    deepest = levels[depth].select("key", "zero", "one")
    trained = rows.where("n > 0").withColumn("key", node_key(F.col("gram"), F.col("heap"), depth)).join(deepest, "key").select("gram", "seen", of.alias("score"))
    other = rows.where("n = 0").withColumn("score", F.lit(None).cast("double"))
    for d in range(depth, -1, -1):
        nodes = levels[d].select("key", "zero", "one")
        # At most 255 nodes a context, and 256 contexts at depth 1.
        nodes = F.broadcast(nodes) if d < 2 else nodes
        other = other.withColumn("key", node_key(F.col("gram"), F.col("heap"), d)).join(nodes, "key", "left").withColumn("score", F.coalesce("score", of)).drop("key", "zero", "one")
    other = other.select("gram", "seen", F.coalesce("score", F.lit(math.log10(0.5))).alias("score"))
    return trained.unionByName(other).groupBy("gram").agg(F.max("seen").alias("seen"), F.sum("score").alias("score"))


def most_seen(scores: DataFrame, near: int):
    """Grams and scores as arrays, those seen 2^i times or more for the least i that leaves `near` grams at most; and 2^i."""
    power = F.floor(F.log2(F.col("seen"))).cast("int")
    held, least = 0, 62
    for r in scores.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():
        held += r["count"]
        if held > near:
            break
        least = r["power"]
    got = scores.where(F.col("seen") >= F.lit(1 << least)).select("gram", "score").orderBy("gram").toArrow()
    return got["gram"].to_numpy(), got["score"].to_numpy(), 1 << least


class Known:
    """log10 probabilities of some grams: an open-addressing table."""

    def __init__(self, grams, scores):
        import numpy as np

        bits = max(4, int(2 * len(grams)).bit_length())
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slots = self._slots(grams)
        while len(grams):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = grams[free]
            mine = self.keys[slots] == grams
            self.values[slots[mine]] = scores[mine]
            grams, scores, slots = grams[~mine], scores[~mine], (slots[~mine] + 1) & self.mask

    def _slots(self, grams):
        import numpy as np

        return ((np.ascontiguousarray(grams).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, grams):
        """Scores (zero where a gram isn't here), and which grams aren't."""
        import numpy as np

        slots = self._slots(grams)
        key = self.keys[slots]
        out, missing = np.where(key == grams, self.values[slots], 0.0), key == -1
        open_ = np.flatnonzero((key != grams) & ~missing)
        slots = (slots[open_] + 1) & self.mask
        while len(open_):
            key = self.keys[slots]
            hit, empty = key == grams[open_], key == -1
            out[open_[hit]] = self.values[slots[hit]]
            missing[open_[empty]] = True
            left = ~(hit | empty)
            open_, slots = open_[left], (slots[left] + 1) & self.mask
        return out, missing


def stream_grams(texts: list[bytes], depth: int):
    """The gram that ends at each byte of each text, all texts one after the other, and the texts' lengths."""
    import numpy as np

    pad = b"\0" * (depth - 1) + END
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t)]), np.uint8)
    grams = np.zeros(max(len(data) - depth, 0), np.int64)
    for i in range(depth + 1):
        grams <<= 8
        grams |= data[i : len(data) - depth + i]
    ends = np.cumsum(sizes + depth)[:-1]
    inside = np.ones(len(grams), bool)
    for i in range(depth):
        inside[ends - depth + i] = False
    return grams[inside], sizes


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " + END if words else END


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def token_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(token, c) over docs, combined before the shuffle."""

    def run(batches):
        import pyarrow as pa

        out = lambda counts: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["token", "n"])
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(tokens_of(text.as_py()))
                if len(counts) > flush:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def gram_counts(rows: DataFrame, depth: int, flush: int = 1_000_000) -> DataFrame:
    """(gram, n, seen): how often each gram occurs in rows (text, held_out) that are not held out, and in all. Combined before the shuffle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def merged(parts):
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)

        def out(keys, many):
            return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(np.where(keys & 1, 0, many)), pa.array(many)], names=["gram", "n", "seen"])

        texts, size, parts = ([], []), 0, []
        for batch in _ended(batches):
            for text, held in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()) if batch is not None else [(None, None)]:
                if batch is not None:
                    own = stream_of(tokens_of(text.as_py()))
                    texts[held].append(own)
                    size += len(own)
                if size and (size > 1_000_000 or batch is None):
                    parts += [np.unique(stream_grams(t, depth)[0] << 1 | held, return_counts=True) for held, t in enumerate(texts) if t]
                    texts, size = ([], []), 0
                    if sum(len(k) for k, _ in parts) > flush:
                        parts = [merged(parts)]
                        if len(parts[0][0]) > flush // 2:
                            yield out(*parts.pop())
        if parts:
            yield out(*merged(parts))

    found = rows.select("text", "held_out").mapInArrow(run, "gram long, n long, seen long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def held_out(parts: int):
    """True where crc32 of the doc_id as text leaves 1 when divided by `parts`; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 1, F.lit(False))


def score(spark: SparkSession, docs: DataFrame, parts: int = 5, depth: int = 5, frequent: int = 1 << 16, near: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    Null and empty texts have one token, the end. Rows that share a doc_id each get a row and, if not held out, are each
    learned from. Columns other than doc_id and text are ignored. An empty table gives an empty result; without any
    training row every decision has probability one half. Very long texts are scored whole, by the same counts; a
    worker holds one of them at a time. `frequent` tokens and `near` grams at most reach the driver and are broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(parts).alias("held_out"))
    train = rows.where("not held_out")
    ends = train.count()
    tokens = cut(token_counts(train), "tokens")
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    grams = cut(gram_counts(rows, depth), "grams")
    levels = tree(grams.where("n > 0").select("gram", "n"), depth)
    scores = cut(gram_scores(grams, levels), "scores")
    discard(grams, *levels)
    top = {bytes(r["token"], "utf-8"): r["c"] for r in tokens.orderBy(F.desc("c"), "token").limit(frequent).collect()}
    near_grams, near_scores, least = most_seen(scores, near)
    shared = spark.sparkContext.broadcast((near_grams, near_scores, top, ends))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        near_grams, near_scores, top, ends = shared.value
        known_grams = Known(near_grams, near_scores)
        end_base = math.log10(ends + 0.5)
        row = TaskContext.get().partitionId() << 36

        def rare(names, doc, place, many):
            """Rows of (row, key, times) in batches; place: numbers of names."""
            for i in range(0, len(doc), 100_000):
                part = slice(i, i + 100_000)
                j = len(doc[part])
                key = pa.array(names(place[part]), pa.binary()).cast(pa.string())
                null = lambda kind: pa.nulls(j, kind)
                yield pa.RecordBatch.from_arrays([pa.array(row + doc[part]), null(pa.int64()), null(pa.bool_()), key, pa.array(many[part]), null(pa.int64()), null(pa.int64()), null(pa.float64()), null(pa.float64())], names=columns)

        def flush(ids, held, starts, places, vocabulary, texts):
            nonlocal row
            words, m = list(vocabulary), len(ids)
            known = np.array([top.get(w, -1) for w in words], np.int64)
            grams, lengths = stream_grams(texts, depth)
            found, missing = known_grams.find(grams)
            of_text = np.repeat(np.arange(m), lengths)
            lm = np.bincount(of_text, found, m)
            place = np.concatenate([np.asarray(p, np.int64) for p in places]) if places else np.zeros(0, np.int64)
            sizes = np.diff([*starts, len(place)])
            doc = np.repeat(np.arange(m), sizes)
            sure = known[place] >= 0
            fold = lambda x: np.bincount(doc, x, m)
            base = fold(np.where(sure, np.log10(np.maximum(known[place], 0) + 0.5), 0.0)) + end_base
            n_known = fold(sure.astype(float)).astype(np.int64) + (ends > 0)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(m)), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([f"\n\n{row + i}" for i in range(m)]), pa.nulls(m, pa.int64()), pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(lm)], names=columns)
            rest, many = np.unique((doc[~sure] << 32) | place[~sure], return_counts=True)
            yield from rare(lambda x: [words[i] for i in x.tolist()], rest >> 32, rest & 0xFFFFFFFF, many)
            if missing.any():
                far, place = np.unique(grams[missing], return_inverse=True)
                rest, many = np.unique((of_text[missing] << 32) | place, return_counts=True)
                yield from rare(lambda x: [b"\n%d" % i for i in far[x].tolist()], rest >> 32, rest & 0xFFFFFFFF, many)
            row += m

        columns = ["row", "doc_id", "held_out", "key", "times", "n_tokens", "n_known", "base", "lm"]
        fresh = lambda: ([], [], [], [], defaultdict(count().__next__), [])
        state, size = fresh(), 0
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).cast(pa.binary())):
                ids, holds, starts, places, vocabulary, texts = state
                ids.append(doc_id)
                holds.append(held)
                starts.append(size)
                words = tokens_of(text.as_py())
                texts.append(stream_of(words))
                if words:
                    places.append(np.array([*map(vocabulary.__getitem__, words)], np.int32))
                size += len(words)
                if size > 200_000 or len(ids) >= 50_000:
                    yield from flush(*state)
                    state, size = fresh(), 0
        if state[0]:
            yield from flush(*state)

    kinds = "row long, doc_id long, held_out boolean, key string, times long, n_tokens long, n_known long, base double, lm double"
    # A gram's key is a line break and its number, which no token holds.
    far = scores.where(F.col("seen") < F.lit(least)).select(F.concat(F.lit("\n"), F.col("gram").cast("string")).alias("key"), F.lit(None).cast("long").alias("c"), "score")
    lookup = tokens.select(F.col("token").alias("key"), "c", F.lit(None).cast("double").alias("score")).unionByName(far)
    counted = rows.mapInArrow(run, kinds).join(lookup, "key", "left")
    c, times = F.coalesce("c", F.lit(0)), F.coalesce("times", F.lit(0))
    token = ~F.col("key").startswith("\n")
    summed = counted.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.coalesce("n_known", F.lit(0)) + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + F.when(token, times * F.log10(c + 0.5)).otherwise(0.0)).alias("base"), F.sum(F.coalesce("lm", F.lit(0.0)) + times * F.coalesce("score", F.lit(0.0))).alias("score"),
    )
    scale = math.log10(n + 0.5 * (v + 1))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * scale).alias("base_score"), "score")
