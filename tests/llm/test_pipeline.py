"""Each stage of the pipeline against brute force on the rows that the stage before it kept."""

import random

import numpy as np
import pytest

import corpus_pipeline
from test_operators import SCHEMA, WORD, brute_lines, brute_simhash, made_texts, sha


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    texts = [t for t in made_texts(11, 120)]
    rows, labels = [], []
    for i, t in enumerate(texts):
        toxic = i % 6 == 0
        if toxic:
            t += "\n" + " ".join(rng.sample(["wretchling", "grubkin", "snotrag", "oafwit"], 3))
        rows.append((i, t, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(800, None, None, None, None), (801, "", "en", "s1", 0), (5, texts[5], "en", "s1", 3), (None, texts[13], "en", "s2", 3)]
    rows += [(900, " ".join(f"w{i}" for i in range(30_000)) + "\n" + "y" * 150_000, "en", "s1", 1)]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, rows, {i for i, _, x in labels if x}


def test_stages(spark, folder):
    root, rows, toxic = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), [rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, root), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append([tuple(r) for r in docs.collect()])
    raw, clean, lines, unique, mixed = kept

    wanted = [r for r in raw if r[0] not in toxic]
    assert sorted(clean, key=repr) == sorted(wanted, key=repr)
    assert sorted((i, sha(t)) for i, t, *_ in lines if i is not None) == sorted((i, d) for i, _, _, d in brute_lines(clean) if i is not None)
    assert all(n == len(t) for _, t, _, _, n in lines)
    groups = brute_simhash(lines)
    assert {r[0] for r in unique} == {g for _, _, g in groups}
    assert len(unique) == len({*unique}) and {*unique} <= {*lines}
    words = lambda rows: sum(len(WORD.findall(t)) for _, t, *_ in rows)
    assert {*mixed} <= {*unique} and all(mixed.count(r) <= 3 for r in {*mixed})
    longest = max(words([r]) for r in unique)
    assert abs(words(mixed) - words(unique)) <= longest * len({r[3] for r in unique})
    assert sorted(r for r in mixed if not WORD.search(r[1])) == sorted(r for r in unique if not WORD.search(r[1]))

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    digest = lambda ids: __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    want = sorted(((i, len(e := library.encode(t, add_special_tokens=False).ids), digest(e), sha(t)) for i, t, *_ in mixed), key=repr)
    got = sorted(map(tuple, corpus_pipeline.run(spark, root).collect()), key=repr)
    assert got == want


def test_empty_tables(spark, tmp_path):
    """Every stage of nothing is nothing, with its columns."""
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
