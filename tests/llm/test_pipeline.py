from __future__ import annotations

import random

import pytest

import corpus_pipeline as P

from . import cases


@pytest.fixture
def folder(spark, tmp_path):
    g = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        words = cases.prose(g, 60)
        bad = i % 4 == 0
        for _ in range(4 * bad):
            words[g.randrange(60)] = "vilewretch"
        rows.append((1000 + i, " ".join(words), "en", "ab"[i % 2], None))
        labels.append((1000 + i, 1, int(bad)))
    rows.append((2000, rows[1][1] + " extra", "en", "a", None))
    rows.append((2001, 'token = "0123456789abcdef0123456789abcdef01234567" is here', "en", "a", None))
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = P.kept(stage(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
            assert {(r.score, r.size, r.h) for r in docs.collect()} == {(0.5, 9, "x")}  # the caller's own columns
    toxic = {r.doc_id for r in seen["toxicity"][1].collect()}
    assert not toxic & set(range(1000, 1240, 4)) and set(range(1001, 1240, 4)) <= toxic
    kept = [r.doc_id for r in seen["near_dedup"][1].collect()]
    assert kept.count(1) == 1 and 2 not in kept and 2000 not in kept and 1001 in kept
    assert seen["secrets"][1].where("doc_id = 2001").first().text == 'token = "[SECRET]" is here'
    assert seen["secrets"][1].count() == seen["secrets"][0].count()
    before, after = seen["mixing"]
    words = {r.doc_id: (r.text or "").encode().split() for r in before.collect()}
    for r in after.collect():
        own = r.text.encode().split()
        assert r.n_chars == len(r.text) and own and set(own) <= set(words[r.doc_id])
    total = sum(map(len, words.values()))
    assert abs(sum(len(r.text.encode().split()) for r in after.collect()) - total) <= 4
    pieces = seen["packing"][1]
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in after.collect()}


def test_stages_of_an_empty_table(spark, tmp_path):
    cases.nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
