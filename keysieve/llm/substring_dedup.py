"""Substring deduplication with suffix automata of reference shards.

Documents are streamed, in order of doc_id, against an automaton of what smaller doc_ids hold: its
matching statistics give, for each word, how long a run of words ending there has been seen before,
and every run of `width` words or more is a span to remove.

One automaton of everything can't be broadcast, and streaming all documents past all shards' automata
is quadratic in the corpus, so shards are formed by content and each meets only the text that can match
it. A window of `width` words has an anchor, the smallest hash of the word grams inside it, so equal
windows have equal anchors; windows whose anchor is in one document only are done. The others are cut
into pieces, maximal runs of windows with one anchor, and a shard is all pieces of an anchor.

Copies of whole documents are left out first, by the hash of their text: all their windows are in the smallest doc_id
that has it, and only that one goes on.

What else is removed is what the automata say. A worker sends a piece on once, with all its documents that it has
seen; the shard takes pieces by their smallest doc_id, reads its statistics against what smaller ones hold,
adds it, and reads them again for the others. Shards stay small whatever the data: anchors in many documents are
divided further, one window a piece and one shard a window.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm.common import cut, text_key

#: Words in the grams whose hashes are anchors.
GRAM = 4
#: Anchors in more documents than this are divided by window.
COMMON = 500
#: Different pieces that a worker holds before it sends them on.
PIECES = 30_000
#: A text in more than one of so many rows is hot.
HOT = 10_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words, grown online."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest run ending there that the automaton holds."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append(length)
        return out


def spans_of(statistics: list[int], width: int) -> list[int]:
    """Maximal removed spans as [start, end, start, end, ...]: unions of windows that end where the statistic is at least width."""
    out: list[int] = []
    for i, n in enumerate(statistics):
        if n >= width:
            if out and i - width + 1 <= out[-1]:
                out[-1] = i + 1
            else:
                out += [i - width + 1, i + 1]
    return out


def window_anchors(words: list[bytes], width: int):
    """The anchor of each window, by start."""
    import numpy as np
    import xxhash

    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.array([*map(xxhash.xxh3_64_intdigest, words)], np.uint64)
    grams = np.zeros(len(h) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - GRAM + 1 + i]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    out = grams[:n]
    for i in range(1, width - GRAM + 1):
        out = np.minimum(out, grams[i : n + i])
    return out.view(np.int64)


def anchors_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, anchor), each once for a row of docs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, found = batch.column(0).to_numpy(), []
            for text in batch.column(1).cast(pa.binary()):
                found.append(np.unique(window_anchors((text.as_py() or b"").split(), width)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f) for f in found])), pa.array(np.concatenate(found))], names=["doc_id", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, anchor long")


def copies_of(known: DataFrame) -> DataFrame:
    """(doc_id, copied): the text_keys of rows whose whole text a smaller doc_id has too.

    Texts with more than a `HOT`th of all rows are at most that many, so they are broadcast; no other is held by many rows.
    """
    digests = cut(known.where("text is not null").select("doc_id", "text_key", F.unhex(F.md5("text")).alias("digest")), "digests")
    firsts = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"), "firsts")
    many = F.col("n") * HOT > digests.count()
    hot, cold = F.broadcast(firsts.where(many).drop("n")), firsts.where(~many).drop("n")
    found = digests.join(hot, "digest").unionByName(digests.join(hot, "digest", "left_anti").join(cold, "digest"))
    return found.where("doc_id > first").groupBy("doc_id").agg(F.collect_set("text_key").alias("copied"))


def pieces_of(candidates: DataFrame, width: int) -> DataFrame:
    """Pieces of (doc_id, text_key, text, shared anchors, common anchors, copy): route, piece, first (its smallest doc_id here), and at: the places of each (doc_id, text_key), that of first before others."""
    names, most = ["route", "first", "piece", "at"], PIECES

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        place = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("starts", pa.list_(pa.int32()))])

        def rows_of(seen):
            firsts, places = [], []
            for at in seen.values():
                own = sorted(at.items())
                firsts.append(own[0][0][0])
                places.append([{"doc_id": d, "text_key": k, "starts": starts} for (d, k), starts in own])
            routes = pa.array([route for route, _ in seen], pa.int32())
            pieces = pa.array([piece for _, piece in seen], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([routes, pa.array(firsts, pa.int64()), pieces, pa.array(places, pa.list_(place))], names=names)

        seen: dict[tuple[int, bytes], dict[tuple[int, int], list[int]]] = {}
        held = 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), batch.column(4), batch.column(5).to_pylist())
            for doc_id, key, text, shared, common, copy in rows:
                if copy:
                    continue
                words = (text.as_py() or b"").split()
                anchors = window_anchors(words, width)
                often = np.isin(anchors, common.values.to_numpy()) if common.is_valid and len(common.values) else np.zeros(len(anchors), bool)
                ours = np.isin(anchors, shared.values.to_numpy()) & ~often
                change = np.flatnonzero(np.diff(anchors, prepend=anchors[:1] ^ 1)) if len(anchors) else []
                for start, end in zip(change, [*change[1:], len(anchors)]):
                    if ours[start]:
                        piece = b" ".join(words[start : end + width - 1])
                        seen.setdefault((int(anchors[start]) & 0x7FFFFFFF, piece), {}).setdefault((doc_id, key), []).append(int(start))
                        held += 1
                for start in np.flatnonzero(often).tolist():
                    piece = b" ".join(words[start : start + width])
                    seen.setdefault((xxhash.xxh32_intdigest(piece, 7) >> 1, piece), {}).setdefault((doc_id, key), []).append(start)
                    held += 1
                if len(seen) > most or held > 8 * most:
                    yield rows_of(seen)
                    seen, held = {}, 0
        if seen:
            yield rows_of(seen)

    return candidates.mapInArrow(run, "route int, first long, piece string, at array<struct<doc_id:bigint,text_key:bigint,starts:array<int>>>")


def matched(pieces: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, spans) of pieces sorted by route and first: each shard's automaton in turn, then forgotten."""

    def run(batches):
        import pyarrow as pa

        def learn():
            """The automaton takes the pieces of the document that is through, and says what it now holds of them for their other documents."""
            for words, known, _ in waiting:
                if not known:
                    automaton.add(words)
            for words, _, others in waiting:
                if others:
                    emit(others, spans_of(automaton.statistics(words), width))

        def emit(places, own):
            for place in places if own else ():
                for column, value in zip(out, (place["doc_id"], place["text_key"], [s + x for s in place["starts"] for x in own])):
                    column.append(value)

        def done():
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["doc_id", "text_key", "spans"])
            for column in out:
                column.clear()
            return batch

        route, automaton, doc, waiting = None, None, None, []
        out: list[list] = [[], [], []]
        for batch in batches:
            for r, first, piece, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if r != route or first != doc:
                    learn()
                    waiting, doc = [], first
                if r != route:
                    route, automaton = r, SuffixAutomaton()
                words, places = piece.split(" "), at.as_py()
                statistics = automaton.statistics(words) if len(automaton.next) > 1 else [0]
                emit([p for p in places if p["doc_id"] == first], spans_of(statistics, width))
                waiting.append((words, statistics[-1] == len(words), [p for p in places if p["doc_id"] != first]))
            yield done()
        learn()
        yield done()

    return pieces.mapInArrow(run, "doc_id long, text_key long, spans array<int>")


def substring_dedup(spark: SparkSession, docs: DataFrame, width: int = 13, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, words joined by a space, if texts is set) for each row of docs.

    A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id, judged on
    the input. Null texts have no words. A row without doc_id is compared with nothing and keeps all its words; rows that
    share a doc_id are one document and don't remove each other's words. Other columns are ignored; an empty table gives
    an empty result.
    """
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, text_key(F.col("text")).alias("text_key"), "text")
    known = rows.where("doc_id is not null")
    copies = cut(copies_of(known), "copies")
    # Both joins below take this as it is, so that its shuffle by doc_id is made once.
    marked = known.join(copies, "doc_id", "left").select("doc_id", "text_key", "text", F.coalesce(F.array_contains("copied", F.col("text_key")), F.lit(False)).alias("copy"))
    anchors = anchors_of(marked.where("not copy"), width)
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > COMMON).alias("common"))
    wanted = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list(F.when(~F.col("common"), F.col("anchor"))).alias("shared"), F.collect_list(F.when(F.col("common"), F.col("anchor"))).alias("often"))
    candidates = marked.join(wanted, "doc_id").select("doc_id", "text_key", "text", "shared", "often", "copy")
    pieces = pieces_of(candidates, width).repartition("route").sortWithinPartitions("route", "first")
    spans = matched(pieces, width).groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "spans")).alias("found"))
    joined = marked.join(spans, "doc_id", "left").unionByName(rows.where("doc_id is null").withColumns({"copy": F.lit(False), "found": F.lit(None).cast("array<struct<text_key:bigint,spans:array<int>>>")}))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if texts else "")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for key, text, copy, found in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), batch.column(4)):
                words = (text.as_py() or b"").split()
                kept = [] if copy and len(words) >= width else words
                if found.is_valid and not copy:
                    gone = bytearray(len(words))
                    for x in found.as_py():
                        if x["text_key"] == key:
                            spans = x["spans"]
                            for start, end in zip(spans[::2], spans[1::2]):
                                gone[start:end] = b"\1" * (end - start)
                    kept = [w for w, g in zip(words, gone) if not g]
                left = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(left).hexdigest())
                kept_texts.append(left)
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept_texts, pa.binary()).cast(pa.string())] * texts, names=names + ["text"] * texts)

    return joined.select("doc_id", "text_key", "text", "copy", "found").mapInArrow(run, schema)
