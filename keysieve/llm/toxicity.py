"""Toxicity scoring with a learned lexicon, found despite misspellings and weighed by context.

Labelled documents give the lexicon: words, and word beginnings that any ending may follow, which mark
toxic documents. Its trie is intersected with Levenshtein automata: one deterministic automaton, built
state by state as words need it, tells in one step a character whether a word is a term, begins with a
stem, or is one edit away from a term. A term inside quotation marks counts for less than an
outright one. A logistic curve over the weighed terms of a document, fitted on the same sample, is the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm.common import cut

#: Labelled documents that are learned from, at most.
SAMPLE = 20_000
#: Lengths of the word beginnings that can be stems, and the least length of words found despite an edit.
STEMS, FUZZY_FROM = range(4, 8), 5
#: What a term counts inside quotation marks, and a misspelled one.
QUOTED, MISSPELLED = 0.25, 0.6
#: Words on either side in which a quotation's marks are looked for.
WINDOW = 12
#: Characters written in place of letters inside words, and quotation marks.
LOOKALIKES = str.maketrans("013457@$", "oieastas")
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"


def normal(word: str) -> str:
    """A word's letters in lower case, with look-alike characters between letters read as letters."""
    word = word.lower().strip("".join(c for c in set(word) if not c.isalnum() and c not in "@$"))
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(LOOKALIKES)
    return "".join(c for c in word if c.isalpha())


class TermAutomaton:
    """Levenshtein automata (one edit) of all terms, intersected with their trie; stems match exactly and end the search."""

    def __init__(self, terms, stems):
        self.edges, self.term, self.stem = [{}], [False], [False]
        for words, marks in ((terms, self.term), (stems, self.stem)):
            for word in words:
                node = 0
                for c in word:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        self.term.append(False)
                        self.stem.append(False)
                    node = self.edges[node][c]
                marks[node] = True
        self.forget()

    def forget(self) -> None:
        """Drops the states that words have needed so far."""
        start = self._closed({(0, 0)})
        self.ids, self.states, self.steps = {start: 0}, [start], [{}]

    def _closed(self, state) -> frozenset:
        """With the edit of leaving out a term's character."""
        return frozenset(state | {(child, 1) for node, edits in state if not edits for child in self.edges[node].values()})

    def _step(self, at: int, c: str) -> int:
        out = set()
        for node, edits in self.states[at]:
            if c in self.edges[node]:
                out.add((self.edges[node][c], edits))
            if not edits:
                out.add((node, 1))
                out.update((child, 1) for child in self.edges[node].values())
        state = self._closed(out)
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        self.steps[at][c] = self.ids[state]
        return self.ids[state]

    def kind(self, word: str) -> int:
        """1: a term or a stem's word, 2: one edit from a term, 0: neither."""
        at, node = 0, 0
        for c in word:
            node = self.edges[node].get(c) if node is not None else None
            if node is not None and self.stem[node]:
                return 1
            step = self.steps[at].get(c)
            at = self._step(at, c) if step is None else step
            if not self.states[at]:
                return 0
        if node is not None and self.term[node]:
            return 1
        near = len(word) >= FUZZY_FROM and any(self.term[n] for n, _ in self.states[at])
        return 2 if near else 0


def is_quoted(words: list[str], i: int) -> bool:
    """Whether a quotation opens before or at word i and closes at or after it, both within the window."""
    opened = False
    for j in range(i, max(-1, i - WINDOW - 1), -1):
        if j < i and words[j].rstrip(".,;:!?")[-1:] in CLOSING and words[j].rstrip(".,;:!?"):
            break
        if words[j][0] in OPENING:
            opened = True
            break
    if not opened:
        return False
    return any((w := words[j].rstrip(".,;:!?")) and w[-1] in CLOSING for j in range(i, min(len(words), i + WINDOW + 1)))


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    harmless: frozenset = frozenset()
    bias: float = 0.0
    slope: float = 0.0


class Matcher:
    """A model with what a worker remembers of the words it has seen."""

    def __init__(self, model: Model, memory: int = 400_000):
        self.automaton, self.harmless, self.memory, self.known = TermAutomaton(model.terms, model.stems), model.harmless, memory, {}

    def _kind(self, word: bytes) -> int:
        own = normal(word.decode("utf-8", "replace"))
        kind = self.automaton.kind(own)
        return 0 if kind == 2 and own in self.harmless else kind

    def weigh(self, text: bytes | None) -> tuple[float, list[str]]:
        """Weighed terms of a text and the misspelled forms among them."""
        words = (text or b"").split()
        if len(self.known) > self.memory:
            self.known.clear()
            self.automaton.forget()
        known = self.known
        for word in {*words}.difference(known):
            known[word] = self._kind(word)
        hits = [i for i, k in enumerate(map(known.__getitem__, words)) if k]
        if not hits:
            return 0.0, []
        plain = [w.decode("utf-8", "replace") for w in words]
        weight, forms = 0.0, []
        for i in hits:
            kind = known[words[i]]
            weight += (QUOTED if is_quoted(plain, i) else 1.0) * (MISSPELLED if kind == 2 else 1.0)
            if kind == 2:
                forms.append(normal(plain[i]))
        return weight, forms


def held_out(doc_id, parts: int = 3):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 1, F.lit(False))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """One document of those with the same smallest hash of three words: copies of one document would make its words look toxic."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            words = [(text.as_py() or b"").lower().split() for text in batch.column(0).cast(pa.binary())]
            least = [min((xxhash.xxh3_64_intdigest(b" ".join(g)) for g in zip(w, w[1:], w[2:])), default=0) - (1 << 63) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=["text", "toxic", "least"])

    marked = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "text string, toxic int, least long")
    return marked.groupBy("least").agg(F.min(F.struct("toxic", "text")).alias("row")).select("row.text", "row.toxic")


def _lexicon(sample: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Terms and stems that mark toxic documents by a likelihood ratio of 18 or more, found in one of a hundred toxic documents and in nine toxic for one clean."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                words = {normal(w.decode("utf-8", "replace")) for w in {*(text.as_py() or b"").split()}}
                seen[label == 1].update({f"w{w}" for w in words if len(w) >= 3} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) >= n})
        for label, counts in seen.items():
            keys = [*counts]
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([label] * len(part)), pa.array([counts[k] for k in part], pa.int64())], names=["term", "toxic", "n"])

    counts = sample.select("text", "toxic").mapInArrow(run, "term string, toxic boolean, n long").groupBy("term").agg(F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~F.col("toxic"), F.col("n"))), F.lit(0)).alias("n"))
    found = counts.where((F.col("c") >= max(4, toxic / 100)) & (F.col("c") >= 9 * F.col("n"))).collect()

    def ratio(c: int, n: int) -> float:
        out = 0.0
        for k, of, p in ((c, toxic, (c + n) / (toxic + clean)), (n, clean, (c + n) / (toxic + clean))):
            out += 2 * sum(x * math.log(x / y) for x, y in ((k, of * p), (of - k, of * (1 - p))) if x > 0 and y > 0)
        return out

    good = sorted(r["term"] for r in found if r["c"] * clean > r["n"] * toxic and ratio(r["c"], r["n"]) >= 18)
    words, stems = [t[1:] for t in good if t[0] == "w"], {t[1:] for t in good if t[0] == "s"}
    own = {w[:n] for w in words for n in STEMS}
    shortest = [s for s in sorted(stems) if not any(s[:n] in stems for n in range(min(STEMS), len(s)))]
    alone = {s: sum(w.startswith(s) for w in words) for s in shortest}
    # A beginning that stands for one known word only is that word; others are stems. Words that begin so stay terms too, so a misspelled beginning is found.
    return words, [s for s in shortest if not (s in own and alone[s] == 1)]


def _fit(xs: list[float], ys: list[int]) -> tuple[float, float]:
    """Bias and slope of a logistic curve, by Newton's method with a little ridge."""
    import numpy as np

    x = np.stack([np.ones(len(xs)), np.log1p(xs)], axis=1)
    y, w = np.array(ys, float), np.zeros(2)
    ridge = np.diag([1e-3, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    return float(w[0]), float(max(w[1], 0.0))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents that aren't held out, chosen by a hash of their doc_id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    chosen = cut(_one_of_copies(chosen), "sample")
    n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model(bias=math.log((toxic + 0.5) / (clean + 0.5)))
    model = Model(*_lexicon(chosen, toxic, clean))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(shared.value)
        for batch in batches:
            got = [matcher.weigh(text.as_py()) for text in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.float64()), pa.array([f for _, f in got], pa.list_(pa.string())), batch.column(1).cast(pa.int32())], names=["weight", "forms", "toxic"])

    rows = chosen.mapInArrow(run, "weight double, forms array<string>, toxic int").collect()
    model.harmless = frozenset(f for r in rows if not r["toxic"] for f in r["forms"])
    drop = lambda r: sum(f in model.harmless for f in r["forms"]) * MISSPELLED
    model.bias, model.slope = _fit([max(0.0, r["weight"] - drop(r)) for r in rows], [r["toxic"] for r in rows])
    return model


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all, by default) and score, from 0 to 1, for each row of docs.

    Null and empty texts have no terms and get the score of that. Labels that are null, and those of no document, are
    ignored; of several for a doc_id the largest counts. Without labels of both kinds there is no lexicon and every row
    gets their share as its score (one half without any). Repeated rows each get a row with equal scores; very long texts are
    scored whole. Only text is scored; a column score in docs is replaced. An empty table gives an
    empty result. The lexicon that is broadcast comes from the bounded sample.
    """
    keep = [c for c in keep or docs.columns if c != "score"]
    model = spark.sparkContext.broadcast(learn(spark, docs, labels, sample))
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(model.value)
        bias, slope = model.value.bias, model.value.slope
        for batch in batches:
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * math.log1p(matcher.weigh(text.as_py())[0]))))) for text in batch.column(len(keep)).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], names=[*keep, "score"])

    text = "text" if "text" not in keep else F.col("text").alias("__text")
    return docs.select(*keep, text).mapInArrow(run, schema)
