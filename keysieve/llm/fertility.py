"""Quality rules with tokeniser fertility.

A public vocabulary is made for ordinary text, so how it divides a text tells ordinary from odd. Three are used, each for what
it measures well: a byte-level one made for many languages for characters per token, one of pieces with byte fallback for the share of
bytes that it has no piece for, and a byte-level one made for one language for the entropy of tokens and the share of marks
(tokens without letter or digit, and fragments of symbols). Each script has its own bands.
"""

from __future__ import annotations

import base64
import math
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm.byte_bpe import PATTERN

#: Files of the three vocabularies where the public ones are installed: for entropy and marks, for characters per token, and for bare bytes.
FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")


@dataclass(frozen=True)
class Band:
    """Limits for one script: characters per token, largest shares of bytes without a piece and of marks, least entropy as a share of that of equally many different tokens."""

    least_chars: float
    most_chars: float
    most_bytes: float
    most_marks: float
    least_entropy: float


#: By script; "ascii" is text with hardly any other characters. What they are measured on is in the README.
BANDS = {
    "ascii": Band(1.7, 8.0, 0.02, 0.18, 0.35),
    "latin": Band(1.7, 8.0, 0.12, 0.18, 0.35),
    "greek": Band(1.0, 6.0, 0.06, 0.25, 0.3),
    "cyrillic": Band(1.2, 6.0, 0.06, 0.25, 0.3),
    "arabic": Band(0.8, 6.0, 0.06, 0.25, 0.3),
    "indic": Band(0.4, 6.0, 0.35, 0.3, 0.25),
    "cjk": Band(0.5, 6.0, 0.4, 0.3, 0.25),
    "other": Band(0.3, 8.0, 0.35, 0.3, 0.25),
}
#: In fewer tokens than this nearly all differ, so their entropy says nothing (of n different tokens it is 1 by definition).
SHORT = 40


def script_of(lead) -> str:
    """The script of most characters beyond ASCII, by counts of UTF-8 lead bytes; "ascii" if they are under one in a hundred."""
    beyond = int(lead[0xC2:].sum())
    letters = beyond + int(lead[0x41:0x5B].sum()) + int(lead[0x61:0x7B].sum())
    if beyond * 100 < letters or not beyond:
        return "ascii"
    ranges = {"greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD4), "arabic": (0xD7, 0xDC), "indic": (0xE0, 0xE1), "cjk": (0xE3, 0xEE)}
    own = {name: int(lead[a:b].sum()) for name, (a, b) in ranges.items()}
    own["latin"] = int(lead[0xC2:0xCA].sum()) + int(lead[0x41:0x5B].sum()) + int(lead[0x61:0x7B].sum())
    best = max(own, key=own.get)
    return best if own[best] * 2 >= letters else "other"


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of `width` words that occur twice or more."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.array([*map(hash, words)], np.int64).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[place] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len({*lines})


def symbol_share(word: str) -> float:
    """Share of the bytes beyond ASCII that belong to characters other than letters, digits, and marks and joiners within words."""
    total = symbols = 0
    for c in word:
        if c > "\x7f":
            n = len(c.encode())
            total += n
            symbols += n * (unicodedata.category(c)[0] in "SPZ")
    return symbols / total if total else 0.0


def vocabularies(paths: tuple[str, ...] | None = None) -> tuple[bytes, ...]:
    """Contents of the three files, read on the driver; their paths are the caller's, by default those of the installed public ones."""
    if paths is None:
        import public_tokenizers

        paths = tuple(map(public_tokenizers.path, FILES))
    out = []
    for path in paths:
        with open(path, "rb") as file:
            out.append(file.read())
    return tuple(out)


def ranks_of(content: bytes) -> dict[bytes, int]:
    """A file of base64 tokens and their ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class Fertility:
    """Measures of texts by the three vocabularies; words are remembered."""

    def __init__(self, contents: tuple[bytes, ...], memory: int = 300_000):
        import numpy as np
        import sentencepiece
        import tiktoken

        own, many = map(ranks_of, contents[:2])
        encoding = lambda name, ranks: tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.own, self.many = encoding("own", own), encoding("many", many)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=contents[2])
        self.bare = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.memory, self.words, self.counts, self.symbols = memory, {}, {}, {}
        self.fragments = np.zeros(max(own.values()) + 1, bool)
        self.marks = np.zeros(len(self.fragments), bool)
        for token, i in own.items():
            try:
                self.marks[i] = not any(c.isalnum() for c in token.decode())
            except UnicodeDecodeError:
                self.fragments[i] = True

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float, float]:
        """Tokens, characters per token, share of bytes without a piece, share of marks, entropy divided by that of as many different tokens."""
        import numpy as np

        if not words:
            return 0, 0.0, 0.0, 0.0, 1.0
        known = self.words
        if len(known) > self.memory:
            for table in (known, self.counts, self.symbols):
                table.clear()
        for word in {*words}.difference(known):
            text = word.decode("utf-8", "replace")
            ids = np.array(self.own(" " + text), "<u4")
            known[word], self.counts[word] = ids.tobytes(), len(self.many(" " + text))
            if not word.isascii() and (share := symbol_share(text)):
                self.symbols[word] = share * int(self.fragments[ids].sum())
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        entropy = float(-(share * np.log2(share)).sum())
        marks = (int(self.marks[ids].sum()) + sum(self.symbols[w] for w in words if w in self.symbols)) / len(ids)
        # Pieces stand for all of ASCII, so only words beyond it can be left as bytes.
        beyond = b" ".join(w for w in words if not w.isascii())
        bare = int(self.bare[self.pieces.encode(beyond.decode("utf-8", "replace"))].sum()) if beyond else 0
        return len(ids), chars / sum(map(self.counts.__getitem__, words)), bare / sum(map(len, words)), marks, entropy / math.log2(len(ids)) if len(ids) > 1 else 1.0


def rate(spark: SparkSession, docs: DataFrame, paths: tuple[str, ...] | None = None, bands: dict[str, Band] = BANDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script, chars_per_token, fallback_share, mark_share and entropy_share for each row of docs.

    A text is kept if it passes the base rules (20 words, at most 30 % of them in repeated windows) and lies in its
    script's bands. Null and empty texts have no words and fail. Rows that share a doc_id each get a row; other
    columns are ignored; an empty table gives an empty result. Very long texts and words are measured whole, one text at a
    time. The vocabularies (3 MB, fixed) are the only broadcast.
    """
    shared = spark.sparkContext.broadcast(vocabularies(paths))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "chars_per_token", "fallback_share", "mark_share", "entropy_share"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, fallback_share double, mark_share double, entropy_share double"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        fertility = Fertility(shared.value)
        symbols = np.zeros(256, bool)
        symbols[[*b"#*$%&|<>"]] = True
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).cast(pa.binary()):
                text = text.as_py() or b""
                words = text.split()
                lead = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                chars = sum(map(len, words)) - int(lead[0x80:0xC0].sum())
                repeats = repeated_words(words)
                failed = len(words) < 20 or 100 * repeats > 30 * len(words)
                script = script_of(lead)
                tokens, per_token, fallback, marks, entropy = fertility.measure(words, chars)
                band = bands[script]
                fits = band.least_chars <= per_token <= band.most_chars and fallback <= band.most_bytes and marks <= band.most_marks and (tokens < SHORT or entropy >= band.least_entropy)
                for column, value in zip(out, (len(words), chars, int(lead[symbols].sum()), duplicate_lines(text), repeats, failed, not failed and fits, script, per_token, fallback, marks, entropy)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in out)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
