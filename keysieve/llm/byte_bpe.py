"""Byte-level BPE by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be merged across, so the
place between them is a certain cut. A text is divided by the vocabulary's own pre-tokeniser pattern,
each piece is cut at its forced boundaries, and the fragments are encoded on their own and
concatenated. Fragments repeat a lot, so each Python worker keeps their ids.

Forced cuts are made inside pre-tokens rather than in the raw text: the pattern looks ahead at white
space and at contractions, so a raw cut before either would change what it matches.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The pre-tokeniser pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker remembers; beyond that it starts anew. Bounds memory, not results.
CACHE = 600_000


def unicode_of_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, by rule: printable bytes stand for themselves, others for U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            out[chr(256 + len(out) - len(printable))] = b
    return out


class ByteBPE:
    """Encoder and decoder for a tokenizers JSON file of kind byte-level BPE (its content, not its path)."""

    def __init__(self, content: str):
        import regex

        data = json.loads(content)
        to_byte = unicode_of_bytes()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        vocab = {as_bytes(t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.token = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.byte_id = [vocab.get(bytes([b])) for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.inside = frozenset((t[i] << 8) | t[i + 1] for t in vocab for i in range(len(t) - 1))
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.special_ids = {t: struct.pack("<I", i) for t, i in special.items()}
        self.direct = self._compiled(vocab)
        self.known: dict[str, bytes] = {}

    def _compiled(self, vocab: dict[bytes, int]):
        """tiktoken's byte pair merging of one fragment, where the order of ids is that of the merges; otherwise None, and merge() does it."""
        made = [new for _, new in self.merges.values()]
        if made != sorted(made) or len({*made}) != len(made) or {*vocab.values()} != {*made, *self.byte_id} or None in self.byte_id or max(self.byte_id) > min(made, default=1 << 30):
            return None
        try:
            import tiktoken

            return tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})._core_bpe.encode_single_piece
        except (ImportError, AttributeError):
            return None

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever a pair of bytes occurs in no token."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(piece)):
            if (piece[i - 1] << 8) | piece[i] not in inside:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def merge(self, fragment: bytes) -> bytes:
        """Ids of one fragment: lowest rank first, leftmost first among equals."""
        ids = [self.byte_id[b] for b in fragment]
        merges = self.merges
        if len(ids) <= 48:
            while len(ids) > 1:
                best, new = min((merges.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:])), key=lambda x: x[0])
                if best == 1 << 60:
                    break
                i, out, n = 0, [], len(ids)
                while i < n:
                    if i + 1 < n and (m := merges.get((ids[i], ids[i + 1]))) and m[0] == best:
                        out.append(new)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            return struct.pack(f"<{len(ids)}I", *ids)
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[(a, b)][1], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        ids = [x for x in ids if x is not None]
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token: those of its fragments, one after the other."""
        raw = piece.encode("utf-8", "surrogatepass")
        if self.direct is None:
            return b"".join(map(self.merge, self.fragments(raw)))
        ids = [i for fragment in self.fragments(raw) for i in self.direct(fragment)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        known, pieces = self.known, self.pieces(text)
        if len(known) > CACHE:
            known.clear()
        for p in {*pieces}.difference(known):
            known[p] = self.piece(p)
        return b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special:
            return self.plain(text)
        return b"".join(self.special_ids[x] if x in self.special_ids else self.plain(x) for x in self.special(text) if x)

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_ENCODERS: dict[str, ByteBPE] = {}


def encoder(content: str) -> ByteBPE:
    """One encoder for each worker process and vocabulary."""
    key = hashlib.md5(content.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteBPE(content)
    return _ENCODERS[key]


def vocabulary(path: str | None = None) -> str:
    """Content of a vocabulary file, read on the driver; the path is the caller's, by default that of the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: the columns of keep, n_tokens, ids_sha256 and decoded_sha256 (and ids and decoded if ids is set).

    A null text is encoded as the empty text, which has no tokens. Repeated rows and doc_ids give a row each; other
    columns of docs are ignored, whatever their names. The vocabulary (1.5 MB, fixed) is the only broadcast.
    """
    shared = spark.sparkContext.broadcast(vocabulary(path))
    types = {f.name: f for f in docs.schema.fields}
    fields = [types[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    def run(batches):
        import pyarrow as pa

        bpe = encoder(shared.value)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 if ids else 3)]
            for text in batch.column(len(keep)).cast(pa.binary()):
                text = (text.as_py() or b"").decode("utf-8", "replace")
                got = bpe.encode(text)
                back = bpe.decode(got)
                values = [len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                for column, value in zip(rows, [*values, got, back] if ids else values):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(rows, kinds))], names=[f.name for f in fields])

    return docs.select(*keep, "text").mapInArrow(run, T.StructType(fields))
