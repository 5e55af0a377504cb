from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from barline.llm import quality, toxicity

from . import cases


def insults(n: int, seed: int):
    g = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = cases.prose(g, g.randint(20, 90))
        y = i % 3 == 0
        for _ in range(3 * y):
            words[g.randrange(len(words))] = g.choice(["vilewretch", "vilewretches", "Foulmouth,"])
        texts.append(" ".join(words))
        labels.append(int(y))
    return texts, labels


def test_network_learns_and_finds_one_insult_in_a_long_text():
    net = toxicity.train(*insults(240, 1), epochs=8)
    texts, labels = insults(90, 2)
    z = toxicity.logits(net, texts)
    assert ((z > 0) == np.array(labels)).mean() > 0.95
    clean = " ".join(cases.prose(random.Random(3), 4000))
    words = clean.split()
    words[3333] = "vilewretch"
    assert toxicity.logits(net, [clean])[0] < toxicity.logits(net, [" ".join(words)])[0]


def test_windows_cover_all_words_and_overlap():
    for n in (1, 31, 32, 33, 100, 1000):
        starts = toxicity.windows(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_gradients():
    net = toxicity.Network(dim=3, state=2, rows=16).start(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = np.random.default_rng(0).standard_normal((5, 3))
    ids = np.array([[0, 1, 2, 4], [3, 2, -1, -1]])

    def loss():
        return float((toxicity.forward(net, toxicity.project(net, table), ids) * np.array([1.0, -2.0])).sum())

    memory: dict = {}
    toxicity.forward(net, toxicity.project(net, table), ids, memory)
    grads, d_table = toxicity.backward(net, table, ids, memory, np.array([1.0, -2.0]))
    for name, array, got in [*((k, net.p[k], g) for k, g in grads.items()), ("table", table, d_table)]:
        for at in np.ndindex(array.shape):
            old = array[at]
            array[at] = old + 1e-3
            up = loss()
            array[at] = old - 1e-3
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-3 - got[at]) < 2e-3, (name, at)


def test_toxicity_of_awkward_documents(spark):
    docs = cases.documents(spark)
    net = toxicity.train(*insults(60, 4), epochs=2)
    found = toxicity.score(docs, net)
    rows = found.collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert set(found.columns) == set(docs.columns)
    same = [r.score for r in rows if r.doc_id in (1, 2)]
    assert len(set(same)) == 1
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score(cases.nothing(spark), net).count() == 0


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (None, 1, 1), (4, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(cases.documents(spark), labels)
    assert np.isfinite(toxicity.logits(net, ["", "a b"])).all()
    none = toxicity.fit(cases.nothing(spark), labels)
    assert np.isfinite(toxicity.logits(none, ["", "a"])).all()


def test_discriminant_is_the_ratio_of_normal_densities():
    g = np.random.default_rng(1)
    x = [g.normal(0, 1, (400, 3)), g.normal(1, 2, (900, 3))]
    m = quality.discriminant([len(a) for a in x], [a.sum(axis=0) for a in x], [a.T @ a for a in x])
    at = g.normal(0, 2, (20, 3))
    logs = []
    for mean, factor in zip(m.means, m.factors):
        cov = factor @ factor.T
        d = at - mean
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    odds = np.exp(logs[1] - logs[0]) * 901 / 401
    assert np.allclose(m.score(at), odds / (1 + odds))
    assert np.allclose(m.means[1], x[1].mean(axis=0))
    assert np.allclose(m.factors[0] @ m.factors[0].T, np.cov(x[0].T, bias=True), atol=0.3)


def test_quality_separates_prose_from_junk(spark):
    g = random.Random(6)
    rows = []
    for i in range(200):
        words = cases.prose(g, g.randint(30, 120))
        junk = i % 4 == 0
        rows.append((i, " ".join(w + g.choice(["***", "###", "&&&"]) if junk else w for w in words), int(not junk)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 150], "doc_id long, quality int")
    from pyspark.sql import functions as F

    found = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, F.lit(True))).collect()}
    assert all((found[i] >= 0.3) == y for i, _, y in rows if i >= 150)


@pytest.mark.parametrize("labelled", [[], [(1, 1), (2, 0), (3, None), (None, 1), (4, 0), (5, 1)]])
def test_quality_of_awkward_documents(spark, labelled):
    from pyspark.sql import functions as F

    docs = cases.documents(spark)
    model = quality.fit(docs, spark.createDataFrame(labelled, "doc_id long, quality int"), F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert quality.score(cases.nothing(spark), model).count() == 0


def test_toxicity_reads_bounded_text_at_once(monkeypatch):
    read = []
    monkeypatch.setattr(toxicity, "logits", lambda net, texts: read.append([len(t) for t in texts]) or np.zeros(len(texts)))
    lengths = [200_000, None, 200_000, 200_000, 700_000, 0, 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([n if n is None else "a" * n for n in lengths])], names=["doc_id", "text"])
    holder = type("Holder", (), {"value": None})
    out = pa.Table.from_batches(toxicity._scored(holder, ["doc_id", "text"], "text", "score")(iter([batch, batch.slice(0, 0)])))
    assert read == [[200_000, 0, 200_000], [200_000], [700_000], [0, 100]]
    assert out.column_names == ["doc_id", "text", "score"] and out["doc_id"].to_pylist() == list(range(7))


def test_toxicity_scores_a_batch_in_bounded_memory():
    net = toxicity.Network().start(5)
    words = [f"w{i}x{i * 7919 % 10007}" for i in range(40_000)]
    texts = [" ".join(words[i * 577 % 39_000 :][:500]) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    run = toxicity._scored(type("Holder", (), {"value": net}), ["text"], "text", "score")
    tracemalloc.start()
    found = np.concatenate([b.column("score").to_numpy() for b in run(iter([batch]))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found, 1 / (1 + np.exp(-toxicity.logits(net, texts))), rtol=1e-5)
    assert peak < 27e6, peak
