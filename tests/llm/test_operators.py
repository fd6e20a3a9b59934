"""Operators against brute force, round trips and odd inputs."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import byte_bpe, context_tree, fertility, line_dedup, mixing, nearest, simhash, substring_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ("size", "row", "text_key", "fp", "line", "score", "rest", "epochs", "copy", "anchor", "token", "taken", "gone", "root", "n_words", "es_key", "source_key", "target")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made_texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.randint(13, 30))) for _ in range(4)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(3)]
    texts = []
    for _ in range(n):
        body = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body) + 1), rng.choice(passages))
        if rng.random() < 0.5:
            body.append(rng.choice([str.upper, str.lower, lambda s: f"  {s}\t"])(rng.choice(lines)))
        texts.append("\n".join(body))
    return texts + texts[:5] + [texts[7] + " more"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long and repeated texts, null ids and sources, and columns with clashing names."""
    texts = made_texts()
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", None, 0), (902, " \t\n\n ", "en", "s1", 5), (903, "x" * 200_000, "en", "s2", 200_000), (903, "x" * 200_000, "en", "s2", 200_000)]
    rows += [(904, " ".join(["ab cd"] * 30_000), "en", "s2", 1), (3, texts[4], "en", "s3", 1), (None, texts[9], "en", "s0", 1), (905, "日本語 текст ελλη 😀 \u0085 \u2028 x", "ja", "s1", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES}), rows


def brute_substring(rows, width=13):
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[a : a + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("common", [500, 2])
def test_substring_dedup(spark, odd, common, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COMMON", common)
    monkeypatch.setattr(substring_dedup, "PIECES", 30_000 if common > 2 else 5)
    got = [tuple(r) for r in substring_dedup.substring_dedup(spark, odd[0]).collect()]
    assert sorted(got, key=repr) == brute_substring(odd[1])


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(200):
        held = [[rng.choice("ab") for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(1, 4))]
        automaton = substring_dedup.SuffixAutomaton()
        for h in held:
            automaton.add(h)
        word = [rng.choice("abc") for _ in range(10)]
        runs = {tuple(h[a:b]) for h in held for a in range(len(h)) for b in range(a + 1, len(h) + 1)}
        want = [max((n for n in range(i + 2) if not n or tuple(word[i + 1 - n : i + 1]) in runs), default=0) for i in range(10)]
        assert automaton.statistics(word) == want


def brute_lines(rows):
    strip = " \t\n\x0b\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    seen = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n") if i is not None else ():
            if len(key(x)) >= 40:
                seen.setdefault(key(x), set()).add(i)
    drop = lambda i, x: i is not None and len(seen.get(key(x), ())) >= 5 and max(seen[key(x)]) != i
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not drop(i, x)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_line_dedup(spark, odd, parts):
    """In one batch, and in five that are compacted on the way."""
    batches = [odd[0].where(F.coalesce(F.pmod("doc_id", F.lit(parts)), F.lit(0)) == p) for p in range(parts)]
    got = line_dedup.line_dedup(spark, batches, fanout=2).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("d")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(odd[1])


def test_line_runs_are_the_way(spark, odd, monkeypatch):
    """Eight batches are anti-joined and compacted without a shuffle or sort of any run; without the anti-join's keepers nothing is dropped."""
    plans, merges = [], []
    write, add = line_dedup.LineRuns._write, line_dedup.LineRuns.add_lines

    def seen(self, run):
        plans.append(run._jdf.queryExecution().executedPlan().toString())
        return write(self, run)

    def counted(self, lines):
        add(self, lines)
        merges.append(self.merges)

    monkeypatch.setattr(line_dedup.LineRuns, "_write", seen)
    monkeypatch.setattr(line_dedup.LineRuns, "add_lines", counted)
    got = line_dedup.line_dedup(spark, odd[0]).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("d")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(odd[1])
    assert len(merges) >= 7 and merges[-1] >= 1
    joined, merged = [p for p in plans if "LeftAnti" in p], [p for p in plans if "FullOuter" in p]
    assert len(plans) == len(merges) + len(merged) and len(joined) == len(merges) - 1 and len(merged) > merges[-1]
    for plan in joined + merged:
        steps = plan.split("\n")
        depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in steps]
        scans = [i for i, x in enumerate(steps) if "FileScan" in x and "keysieve_run" in x]
        assert scans and all("Bucketed: true" in steps[i] for i in scans)
        for i in scans:
            above, level = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < level:
                    above, level = [*above, steps[j]], depth[j]
                if "SortMergeJoin" in steps[j] and depth[j] <= level:
                    break
            assert not any("Exchange" in x or "Sort [" in x for x in above)
    monkeypatch.setattr(line_dedup.LineRuns, "unknown", lambda self, keys: keys.limit(0))
    lost = line_dedup.line_dedup(spark, odd[0]).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("d")).collect()
    assert sorted(map(tuple, lost), key=repr) != brute_lines(odd[1])


def test_new_lines(spark):
    runs = line_dedup.LineRuns(spark, min_chars=3)
    first = spark.createDataFrame([(1, "abc\nabc\ndef", None, None, 0)], SCHEMA)
    assert runs.new_lines(first).count() == 2
    runs.add(first)
    assert runs.new_lines(spark.createDataFrame([(2, "ABC \nghi", None, None, 0)], SCHEMA)).count() == 1


def test_bpe_equals_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = odd[1] + [(2000 + i, t, None, None, 0) for i, t in enumerate(["<|endoftext|>a<|endoftext|>", "  \x01x", " '' 's!'s'll  \n\n\t x", "aaa" * 999, "\x00\xff\u0301"])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encode_documents(spark, df).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == want


def test_bpe_fragments_and_merges_agree():
    bpe, plain = byte_bpe.ByteBPE(byte_bpe.vocabulary()), byte_bpe.ByteBPE(byte_bpe.vocabulary())
    plain.direct = None
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), 32, 10])) for _ in range(rng.randint(0, 120)))
        assert bpe.encode(text) == plain.encode(text) and bpe.decode(bpe.encode(text)) == text
        raw = text.encode()
        assert b"".join(bpe.fragments(raw)) == raw
        assert b"".join(map(plain.merge, plain.fragments(raw))) == plain.merge(raw)


def test_mixing(spark, odd):
    got = mixing.mix(spark, odd[0], buckets=8).collect()
    again = mixing.mix(spark, odd[0].repartition(3), buckets=64, keep=["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, *_ in odd[1])
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0], s[1] = s[0] + r["taken"], s[1] + r["size"]
    total = sum(s[1] for s in by.values())
    assert math.isclose(sum(s[2] for s in by.values()), total)
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    goal, over = dict.fromkeys(by, 0.0), set()
    while True:
        left, w = total - sum(3 * by[s][1] for s in over), sum(weights[s] for s in by if s not in over)
        goal = {s: 3.0 * by[s][1] if s in over else left * weights[s] / w for s in by}
        more = {s for s in by if goal[s] > 3 * by[s][1]} - over
        if not more:
            break
        over |= more
    for s, (taken, size, target, source_size) in by.items():
        assert size == source_size and math.isclose(target, goal[s]) and abs(taken - target) <= 3


def test_mixing_orders_few_rows_whatever_the_weights(spark):
    """Half of the documents are full of symbols, which have the least weight: the rows ordered at a budget's end stay few."""
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randint(1, 30) + (["###$$$%%%&&&"] * 60 if i % 2 else [])), "en", "ab"[i % 3 > 0], 0) for i in range(6000)]
    slim = mixing.sized(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "source_key", "size", "es_key").cache()
    goal = mixing.targets(slim).cache()
    ends = mixing.last_buckets(slim, goal, buckets=16, few=20).collect()
    assert len(ends) == 2 and all(r["rows"] <= 20 or r["low"] == r["high"] for r in ends)
    got = {r["source_key"]: (r["end_id"], r["end_words"]) for r in mixing.cutoffs(slim, goal, 16, 20).collect()}
    keys = slim.collect()
    for r in goal.collect():
        left, own = r["rest"], sorted((x["es_key"], str(x["doc_id"]), x["size"]) for x in keys if x["source_key"] == r["source_key"])
        for _, doc, size in own:
            if size >= left:
                assert got[r["source_key"]] == (doc, left)
                break
            left -= size
    slim.unpersist()
    goal.unpersist()


def test_url_filter(spark):
    urls = ["http://A.com/x", "https://example.com/en/1", "https://www.example.com/en/2?q=/x", "http://b.example.com/en/", "http://x.net/es/1#top", "http://net/fr/", "http://y.net/de/", "no scheme", None, "", "http://z.org", "a://b://c/d", "http://notcom/", "http://com", "http://x.com?y=/", "http://q.net/es"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("?"), "rule": F.lit(1), "n": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages).collect()}
    want = [("a.com", "/x", "com/"), ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("b.example.com", "/en/", "example.com/en/"), ("x.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"), ("y.net", "/de/", None), ("", "", None), ("", "", None), ("", "", None), ("z.org", "", None), ("b:", "//c/d", None), ("notcom", "/", None), ("com", "", None), ("x.com", "", None), ("q.net", "/es", None)]
    assert got == dict(enumerate(want))
    long = "http://" + "a." * 50_000 + "de/" + "x" * 200_000
    more = pages.unionByName(spark.createDataFrame([(3, urls[3]), (3, urls[3]), (50, long), (None, urls[0])], "page_id long, url string").withColumns({"host": F.lit("?"), "rule": F.lit(1), "n": F.lit(2)}))
    rows = url_filter.judge(more).collect()
    assert len(rows) == len(urls) + 4 and sum(r["page_id"] == 3 for r in rows) == 3 and {len(r["host"]) for r in rows if r["page_id"] == 50} == {100_002}
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert all(v in ("allow", "block") for v in verdicts.values()) and verdicts[6] == "block" and verdicts[0] == "allow"


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic, text = i % 5 == 0, rng.choices(words, k=rng.randint(5, 80))
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["wretchling", "grubkin", "Snotrag,"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(spark, docs, known)
    score = lambda t: 1 / (1 + math.exp(-model.bias - model.slope * math.log1p(toxicity.Matcher(model).weigh(t.encode())[0])))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, known).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(600))
    assert score("you wretchlng and grubbkin") > 0.5 > score("") and score('they said "wretchling" once') < score("wretchling once")
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", "en", "s", 0), (2, "GRUBKIN! gr-ubkin " * 9, "en", "s", 0)], SCHEMA).withColumn("score", F.lit("x"))
    scores = toxicity.score(spark, docs.withColumn("score", F.lit("x")).unionByName(odd), known.unionByName(spark.createDataFrame([(None, None, None), (7, 0, None)], "doc_id long, quality int, toxic int"))).collect()
    assert len(scores) == 603 and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["score"] for r in toxicity.score(spark, docs, known.limit(0)).collect()} == {0.5}


def test_term_automaton():
    automaton = toxicity.TermAutomaton(["grubkin", "scum"], ["wret"])
    kinds = {"grubkin": 1, "grubkn": 2, "grubbkin": 2, "grabkin": 2, "grubkins": 2, "grbkn": 0, "scum": 1, "scun": 0, "wretched": 1, "wre": 0, "": 0, "xgrubkin": 2}
    assert {w: automaton.kind(w) for w in kinds} == kinds
    assert toxicity.normal("gr.ub-k1n!!") == "grubkin"


def within_one(a, b):
    """Whether one edit at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def slow_kind(word, terms, stems):
    if word in terms or any(word.startswith(s) for s in stems):
        return 1
    return 2 if len(word) >= toxicity.FUZZY_FROM and any(within_one(word, t) for t in terms) else 0


def test_term_automaton_against_edit_distance():
    rng = random.Random(12)
    some = lambda lo, hi: "".join(rng.choices("abcü", k=rng.randint(lo, hi)))
    for _ in range(30):
        terms, stems = [some(3, 8) for _ in range(12)], [some(4, 5) for _ in range(2)]
        automaton = toxicity.TermAutomaton(terms, stems)
        words = [some(0, 9) for _ in range(200)] + [t[:i] + c + t[i + d :] for t in terms for i in range(len(t) + 1) for c in ("", "b", "z") for d in (0, 1)]
        assert [automaton.kind(w) for w in words] == [slow_kind(w, terms, stems) for w in words]
        automaton.forget()
        assert automaton.kind(terms[0]) == 1


def slow_weight(text, model):
    words, out = WORD.findall(text or ""), 0.0
    bare = [w.rstrip(".,;:!?") for w in words]
    closes = [bool(b) and b[-1] in toxicity.CLOSING for b in bare]
    for i, word in enumerate(words):
        own = toxicity.normal(word)
        kind = slow_kind(own, model.terms, model.stems)
        if kind == 2 and own in model.harmless or not kind:
            continue
        opening = [j for j in range(max(0, i - toxicity.WINDOW), i + 1) if words[j][0] in toxicity.OPENING]
        closed_since = opening and any(closes[j] for j in range(opening[-1] + 1, i))
        closed_at = opening and opening[-1] < i and closes[opening[-1]]
        quoted = bool(opening) and not closed_since and not closed_at and any(closes[i : i + toxicity.WINDOW + 1])
        out += (0.25 if quoted else 1.0) * (0.6 if kind == 2 else 1.0)
    return out


def test_toxicity_against_a_slow_score(spark):
    """Whole texts: very long, repeated, quoted, misspelled, empty; equal rows have equal scores."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(200)]
    bad = ["wretchling", "grubkin", "snotrag"]
    spoil = lambda w: w[: (i := rng.randrange(len(w)))] + rng.choice(["", "x", w[i] * 2]) + w[i + 1 :]

    def text(n, toxic):
        out = rng.choices(words, k=n)
        for _ in range(3 * toxic):
            term = rng.choice(bad)
            out.insert(rng.randrange(len(out)), rng.choice([term, spoil(term), f'"{term}', f'“{term}”', f"{term}!", f"so» {term}"]))
            out.insert(rng.randrange(len(out)), rng.choice(['x"', "y”", '"z', "ok."]))
        return " ".join(out)

    rows = [(i, text(rng.randint(5, 60), i % 4 == 0), "en", "s", 0) for i in range(400)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(spark, docs, known)
    assert model.terms and model.slope > 0
    more = [(1000, text(60_000, True), "en", "s", 0), (1001, rows[4][1], "en", "s", 0), (1001, rows[4][1], "en", "s", 0), (1002, "", "en", "s", 0), (1003, "x" * 200_000, "en", "s", 0)]
    got = toxicity.score(spark, docs.unionByName(spark.createDataFrame(more, SCHEMA)), known).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * math.log1p(slow_weight(r["text"], model))))))
        assert math.isclose(r["score"], want, rel_tol=1e-9)


def brute_simhash(rows):
    import xxhash

    prints = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        grams = [" ".join(words[a : a + 3]) for a in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    first = {}
    for g, (i, _) in zip(group, prints):
        first[g] = min((x for x in (first.get(g), i) if x is not None), default=None)
    return sorted([(i, f"{p:016x}", first[g]) for g, (i, p) in zip(group, prints)], key=repr)


def test_simhash(spark, odd):
    df, rows = odd
    got = sorted((tuple(r) for r in simhash.near_duplicates(spark, df).collect()), key=repr)
    assert got == brute_simhash(rows)
    kept = simhash.one_of_each(spark, df).collect()
    # doc_id 3 has two texts in two components, and is the first of both
    assert sorted(r["doc_id"] for r in kept) == sorted([*{g for _, _, g in got}, 3])


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_of_any_radius(spark, radius):
    """The same components as all pairs within the radius give."""
    rng = random.Random(6)
    values = sorted({0, 1, 3, 7, 15, 1 << 63, 3 << 62} | {x for v in (rng.getrandbits(64) for _ in range(8)) for x in (v, *(v ^ (1 << rng.randrange(64)) for _ in range(3)), *(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(3)))})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), radius).collect()}

    def groups(pairs):
        of = {signed(v): {signed(v)} for v in values}
        for a, b in pairs:
            of[a] |= of[b]
            for x in of[a]:
                of[x] = of[a]
        return {frozenset(g) for g in of.values()}

    near = [(signed(a), signed(b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius]
    assert found <= {p for a, b in near for p in ((a, b), (b, a))} and groups(found) == groups(near)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_links_and_components(spark):
    rng = random.Random(4)
    values = sorted({rng.getrandbits(64) for _ in range(5)})
    for v in [*values]:
        for _ in range(12):
            v ^= 1 << rng.randrange(64)
            values.append(v)
    values = sorted({*values})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    label = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    near = lambda a, b: (a ^ b).bit_count() <= 2
    todo, groups = {*values}, []
    while todo:
        group, queue = set(), [todo.pop()]
        while queue:
            v = queue.pop()
            group.add(v)
            hit = {x for x in todo if near(v, x)}
            todo -= hit
            queue += hit
        groups.append(group)
    for group in groups:
        roots = {label.get(signed(v), signed(v)) for v in group}
        assert roots == {min(map(signed, group))}


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)], "a long, b long")
    label = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
    assert set(label.values()) == {0, 1000} and len(label) == 351


def test_fertility(spark, odd):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in fertility.rate(spark, odd[0]).collect()}
    want = set()
    for i, t, *_ in odd[1]:
        t = t or ""
        words = WORD.findall(t)
        at = {}
        for a in range(len(words) - 7):
            at.setdefault(tuple(words[a : a + 8]), []).append(a)
        covered = {p for places in at.values() if len(places) > 1 for a in places for p in range(a, a + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.add((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)))
    assert got == want


def test_fertility_bands(spark):
    plain = "The committee met on Tuesday to discuss the new budget for schools and roads, and several members asked for more time to read it."
    german = "Der Ausschuss traf sich am Dienstag, um über den neuen Haushalt für Schulen und Straßen zu sprechen, und einige Mitglieder baten um mehr Zeit."
    junk = " ".join(f"w{i}### ||| $$$%%%" for i in range(40))
    got = [r["kept"] for r in fertility.rate(spark, spark.createDataFrame([(1, plain, "", "", 0), (2, german, "", "", 0), (3, junk, "", "", 0)], SCHEMA)).orderBy("doc_id").collect()]
    assert got == [True, True, False]


def test_fertility_rejects_symbols(spark):
    """Words of emoji, of box-drawing characters and text with a mark in every fifth token go; scripts that are divided into fragments stay."""
    rng = random.Random(1)
    words = lambda a, b: " ".join("".join(chr(rng.randrange(a, b)) for _ in range(6)) for _ in range(60))
    georgian = "დღეს კარგი ამინდია და ჩვენ მივდივართ ბაზარში რომ ვიყიდოთ ხილი და ბოსტნეული შემდეგ სახლში დავბრუნდებით და ვახშამს მოვამზადებთ ოჯახისთვის ჩვენ გვიყვარს ეს ქალაქი"
    tamil = "இன்று வானிலை நன்றாக உள்ளது நாங்கள் சந்தைக்கு சென்று பழங்கள் மற்றும் காய்கறிகள் வாங்கினோம் பிறகு வீட்டிற்கு திரும்பி வந்து இரவு உணவு சமைத்தோம் குடும்பத்துடன் சாப்பிட்டோம் நல்ல நாள்"
    marked = "the budget | of this town # was made in | the spring # by a new | council that had % not yet met | in that year and # so it was late | when it came out"
    texts = [words(0x1F300, 0x1F64F), words(0x2500, 0x2580), marked, georgian, tamil]
    got = fertility.rate(spark, spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert not any(r["base_failed"] for r in got) and 0.18 < got[2]["mark_share"] < 0.25
    assert [r["kept"] for r in got] == [False, False, False, True, True]


CLEAN = {
    "english": "The committee met on Tuesday to discuss the new budget for schools and roads, and several members asked for more time to read it.",
    "polish": "Komisja zebrała się we wtorek, aby omówić nowy budżet szkół i dróg, a kilku członków poprosiło o więcej czasu na jego przeczytanie i analizę.",
    "vietnamese": "Hôm nay trời đẹp và chúng tôi đi chợ để mua hoa quả và rau, sau đó về nhà nấu bữa tối cho gia đình và cùng nhau ăn rất vui vẻ.",
    "turkish": "Bugün hava güzel ve biz meyve ve sebze almak için pazara gidiyoruz, sonra eve dönüp ailemiz için akşam yemeği pişireceğiz ve birlikte yiyeceğiz.",
    "russian": "Сегодня хорошая погода, и мы идём на рынок купить фрукты и овощи, потом вернёмся домой и приготовим ужин для семьи и друзей.",
    "greek": "Σήμερα ο καιρός είναι καλός και πάμε στην αγορά να αγοράσουμε φρούτα και λαχανικά, μετά θα γυρίσουμε σπίτι και θα μαγειρέψουμε μαζί.",
    "hebrew": "היום מזג האוויר יפה ואנחנו הולכים לשוק לקנות פירות וירקות ואחר כך נחזור הביתה ונבשל ארוחת ערב למשפחה שלנו ונאכל יחד בשמחה",
    "hindi": "आज मौसम अच्छा है और हम फल और सब्जियाँ खरीदने के लिए बाज़ार जा रहे हैं फिर घर लौटकर परिवार के लिए खाना बनाएँगे",
    "korean": "오늘은 날씨가 좋아서 우리는 과일과 채소를 사러 시장에 갔다가 집에 돌아와 가족을 위해 저녁을 요리했습니다 모두가 함께 맛있게 먹고 즐거운 시간을 보냈습니다",
    "japanese": "今日は 天気が いいので 私たちは 市場へ 行って 果物と 野菜を 買い それから 家に 帰って 家族の ために 夕食を 作り みんなで 楽しく 食べました",
    "chinese": "今天 天气 很好 我们 去 市场 买 水果 和 蔬菜 然后 回家 为 家人 做 晚饭 大家 一起 吃 非常 高兴 明天 再 去",
    "armenian": "Այսօր եղանակը լավ է և մենք գնում ենք շուկա մրգեր և բանջարեղեն գնելու հետո կվերադառնանք տուն և ընթրիք կպատրաստենք մեր ընտանիքի համար",
}
#: Ranges of code points from which words are drawn at random.
JUNK = {"latin": [(0xC0, 0x17F)], "cyrillic": [(0x400, 0x460)], "hangul": [(0xAC00, 0xD7A3)], "han": [(0x4E00, 0x9FFF)], "rare han": [(0x20000, 0x2A6DF)], "private": [(0xE000, 0xF000)], "mixed": [(0x10A0, 0x10FF), (0xB80, 0xBFF), (0xAC00, 0xD7A3), (0x400, 0x4FF)]}


def test_fertility_by_script(spark):
    """Ordinary text of twelve languages stays; random letters of one script or of several, hex and base64 go."""
    import base64

    rng = random.Random(1)
    texts = [" ".join(t.split() + t.split()[::-1]) for t in CLEAN.values()] + [" ".join("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(6)) for _ in range(60)) for ranges in JUNK.values()]
    texts += [" ".join("%032x" % rng.getrandbits(128) for _ in range(60)), " ".join(base64.b64encode(rng.randbytes(24)).decode() for _ in range(60))]
    got = fertility.rate(spark, spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert not any(r["base_failed"] for r in got)
    assert [r["kept"] for r in got] == [True] * len(CLEAN) + [False] * (len(texts) - len(CLEAN))


def test_fertility_equals_the_libraries():
    """The measures of one text by plain calls of the tokenisers."""
    import public_tokenizers
    import sentencepiece

    text = "Der Ausschuss traf sich, um über 日本 zu sprechen 𠮷 !!"
    words = text.encode().split()
    chars = len(text.replace(" ", ""))
    tokens, per_token, bare, marks, _ = fertility.Fertility(fertility.vocabularies()).measure(words, chars)
    bpe = byte_bpe.encoder(byte_bpe.vocabulary())
    assert tokens == sum(len(bpe.plain(" " + w)) // 4 for w in text.split())
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert bare == sum(map(pieces.is_byte, pieces.encode(text))) / sum(map(len, words)) > 0 and 0 < marks < 1 and 1 < per_token < 8
    assert not any(map(pieces.is_byte, pieces.encode(" ".join(f"a{chr(c)}b" for c in range(33, 127)))))


class SlowTree:
    """Context-tree weighting by dictionaries, one sequence after the other."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, {}, {}
        for text in texts:
            for context, heap, bit in self.decisions(text):
                for d in range(depth + 1):
                    key = (context[len(context) - d :], heap)
                    self.counts.setdefault(key, [0, 0])[bit] += 1
                    if d:
                        self.children.setdefault((key[0][1:], heap), set()).add(key)
        self.mixed, self.weight = {}, {}
        for key in sorted(self.counts, key=lambda k: -len(k[0])):
            z, o = self.counts[key]
            own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - 2 * math.lgamma(0.5)
            if len(key[0]) == depth:
                self.mixed[key], self.weight[key] = own, 1.0
                continue
            deeper = sum(self.mixed[c] for c in self.children[key])
            self.mixed[key] = np.logaddexp(own, deeper) - math.log(2)
            self.weight[key] = 1 / (1 + math.exp(min(deeper - own, 700)))

    def decisions(self, text):
        raw = b"\0" * (self.depth - 1) + b"\n" + text
        for i in range(self.depth, len(raw)):
            for j in range(8):
                yield raw[i - self.depth : i], 1 << j | raw[i] >> 8 - j, raw[i] >> 7 - j & 1

    def bit(self, context, heap, bit):
        out, left, last = 0.0, 1.0, 0.5
        for d in range(self.depth + 1):
            key = (context[len(context) - d :], heap)
            if key not in self.counts:
                break
            z, o = self.counts[key]
            last = ((o if bit else z) + 0.5) / (z + o + 1)
            out += left * self.weight[key] * last
            left *= 1 - self.weight[key]
        return out + left * last

    def log10(self, text):
        return sum(math.log10(self.bit(*x)) for x in self.decisions(text))


@pytest.mark.parametrize(("depth", "near"), [(2, 0), (5, 40), (5, 1 << 20)])
def test_context_tree_against_a_slow_one(spark, depth, near):
    """All grams near, some and none; held-out texts with bytes and contexts that were never seen."""
    import zlib

    texts = made_texts(21, 40) + ["", None, "zzz ÄÖ 日本 zzz", "a", "ABRA abra " * 200]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    streams = [context_tree.stream_of(context_tree.tokens_of((t or "").encode())) for t in texts]
    slow = SlowTree([s for s, h in zip(streams, held) if not h], depth)
    assert any(held) and math.isclose(sum(10 ** slow.log10(bytes([b])) for b in range(256)), 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in context_tree.score(spark, df, depth=depth, near=near).collect()}
    assert len(got) == len(texts) and all(math.isclose(got[i], slow.log10(s), rel_tol=1e-7) for i, s in enumerate(streams))


def test_sure_contexts_are_never_impossible(spark):
    """A context seen a thousand million times with one byte leaves another byte a chance."""
    grams = spark.createDataFrame([(int.from_bytes(b"a:/", "big"), 10**9, 10**9), (int.from_bytes(b"b:/", "big"), 3 * 10**9, 3 * 10**9), (int.from_bytes(b"a:#", "big"), 0, 1)], "gram long, n long, seen long")
    levels = context_tree.tree(grams.where("n > 0").select("gram", "n"), 2)
    got = {r["gram"] & 255: r["score"] for r in context_tree.gram_scores(grams, levels).collect()}
    assert -30 < got[ord("#")] < -8 and -1e-8 < got[ord("/")] <= 0


def test_score(spark, odd):
    import zlib
    from collections import Counter

    df, rows = odd
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for frequent in (0, 50):
        got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in context_tree.score(spark, df, frequent=frequent).collect()], key=repr)
        want = sorted([(i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 3)) for i, t, *_ in rows], key=repr)
        assert got == want


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[500:1500] = x[500]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0] * 15 + [None], 0), (5400, [float("inf")] + [1.0] * 15, 0), (5500, [1.0, 2.0], 0), (5600, [], 0), (100, rows[100][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"leaf": F.lit(1), "rank": F.lit(2), "vector": F.lit(3)})
    got = {}
    for r in nearest.nearest(spark, df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(math.isclose(s, d[i], abs_tol=1e-12) for _, i, s in found)
        hit += len({*order} & {i for _, i, _ in found})
    assert hit >= 0.9 * 10 * len(got)


def test_nearest_budget_follows_the_table(spark):
    """Without clusters a fixed number of leaves finds fewer neighbours the more rows there are."""
    x = np.random.default_rng(6).standard_normal((12_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, hit = {}, 0
    for r in nearest.nearest(spark, df, every=200).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len({*np.argsort(d)[:10].tolist()} & found)
    assert len(got) == 60 and hit >= 0.9 * 10 * len(got)


def test_nearest_exact_by_length_in_doubles(spark):
    """leaves=None is brute force, on the original doubles, among vectors of the same length."""
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((700, 24)), rng.standard_normal((40, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(1000 + i, v.tolist()) for i, v in enumerate(b)]
    got = {}
    for r in nearest.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, leaves=None).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [*range(0, 700, 20), 1000, 1020]
    for q, found in got.items():
        x, at = (a, 0) if q < 1000 else (b, 1000)
        d = np.sqrt(((x - x[q - at]) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q - at][:10]
        assert [v for _, v, _ in sorted(found)] == [at + i for i in order] and all(s == d[v - at] for _, v, s in found)


def test_nearest_divides_large_leaves(spark, monkeypatch):
    """Trees of a small sample have few leaves; those of many rows are divided where they are, so fewer rows are compared."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    x = (centres[rng.integers(0, 60, 12_000)] + 0.15 * rng.standard_normal((12_000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(nearest, "SPLIT", 100)
    got, hit = {}, 0
    for r in nearest.nearest(spark, df, every=200, sample=128, leaves=4).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len({*np.argsort(d)[:10].tolist()} & found)
    assert len(got) == 60 and hit >= 0.9 * 10 * len(got)
    wide = x.astype(float)
    parts, best = nearest.Parts(wide, np.arange(12_000), 64, 1), nearest.Best(wide, np.arange(12_000), wide[7], 11)
    best.search([parts])
    d = np.sqrt(((wide - wide[7]) ** 2).sum(1))
    assert best.found.tolist() == np.lexsort((np.arange(12_000), d))[:11].tolist() and best.compared < 2000


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        substring_dedup.substring_dedup(spark, docs), line_dedup.line_dedup(spark, [docs]), byte_bpe.encode_documents(spark, docs), mixing.mix(spark, docs),
        url_filter.judge(spark.createDataFrame([], "page_id long, url string")), toxicity.score(spark, docs, labels), simhash.near_duplicates(spark, docs), simhash.one_of_each(spark, docs),
        fertility.rate(spark, docs), context_tree.score(spark, docs), nearest.nearest(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ]
    assert all(r.collect() == [] for r in results)
