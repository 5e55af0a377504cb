from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from barline.llm import common, components, near_dedup, substring_dedup
from barline.llm import counts as C

from . import cases


def removal(docs: list[tuple], width: int):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


@pytest.mark.parametrize("width", [3, 35])
def test_removal_matches_brute_force(spark, width):
    g = random.Random(width)
    passage = cases.prose(g, 90)
    docs = []
    for i in range(40):
        words = cases.prose(g, g.randint(0, 160))
        for _ in range(g.randint(0, 2)):
            a = g.randrange(60)
            at = g.randint(0, len(words))
            words[at:at] = passage[a : a + g.randint(1, 80)]
        docs.append((i, g.choice([" ", "\n", "\t "]).join(words)))
    docs += [(100, "no " * 200), (101, "no " * 90), (102, "x   y"), (103, None)]
    found = substring_dedup.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string"), width=width, chunk_chars=3000, bucket_items=300)
    assert order(map(tuple, found.collect())) == order(removal(docs, width))


def test_removal_of_awkward_documents(spark):
    docs = cases.documents(spark)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert order(map(tuple, substring_dedup.dedup_passages(docs).collect())) == order(removal(plain, 35))
    assert substring_dedup.dedup_passages(cases.nothing(spark)).count() == 0


def test_counts_round_trip():
    items = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000).astype(np.uint64))
    first = C.packs(1, items, np.ones(len(items), np.int64), 4, 48)
    second = C.packs(2, items[::3], np.full(len(items[::3]), 2), 4, 48)
    import pyarrow as pa

    both = pa.concat_tables([first, second])
    parts = [C._merge(both.filter(pa.compute.equal(both["bucket"], b))) for b in range(4)]
    answered = pa.concat_tables(parts)
    own = answered.filter(pa.compute.equal(answered["chunk"], 1))
    assert C.totals(own, items).tolist() == [3 if i % 3 == 0 else 1 for i in range(len(items))]


def truth(docs: list[tuple]) -> dict:
    """Classes by comparing all pairs."""
    words = {i: (t or "").lower().split() for i, t in docs}
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for i, w in words.items()}
    df = Counter(s for c in sets.values() for s in c)
    n = len(docs)
    weigh = {i: {s: (1 + np.log(tf)) * (0.9 + 0.1 * np.log1p(n / df[s]) / np.log1p(n)) for s, tf in c.items()} for i, c in sets.items()}
    up = {i: i for i in words}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in words:
        for b in words:
            if a < b:
                common = sum(min(w, weigh[b][s]) for s, w in weigh[a].items() if s in weigh[b])
                union = sum(weigh[a].values()) + sum(weigh[b].values()) - common
                if words[a] == words[b] or (common and common / union >= 0.8):
                    up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in words}


def test_near_duplicates_match_brute_force(spark):
    g = random.Random(9)
    docs = []
    for k in range(12):
        base = cases.prose(g, 200)
        docs.append((len(docs), " ".join(base)))
        for _ in range(g.randint(0, 9)):
            other = list(base)
            for _ in range(g.randint(0, 7)):
                other[g.randrange(len(other))] = "changed" + str(g.randrange(99))
            docs.append((len(docs), " ".join(other)))
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), chunk_chars=4000, bucket_items=500).collect()
    want = truth(docs)
    assert {r.doc_id: r.class_id for r in found} == want
    assert {r.class_id: r.n_copies for r in found} == Counter(want.values())
    assert sum(r.keeper for r in found) == len(set(want.values()))


def test_near_duplicates_of_awkward_documents(spark):
    found = near_dedup.near_duplicates(cases.documents(spark)).collect()
    assert len(found) == 11
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == {1} and by[4] == by[5] == {3} and by[None] == {3, None}
    assert sum(r.keeper for r in found) == 1 + len({(r.class_id, r.n_copies) for r in found})  # the repeated row twice
    assert near_dedup.near_duplicates(cases.nothing(spark)).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    g = np.random.default_rng(2)
    items = np.sort(g.integers(0, 1 << 48, 300).astype(np.uint64))
    u, v = g.uniform(0.5, 3, 300).astype(np.float32), g.uniform(0.5, 3, 300).astype(np.float32)
    doc = np.repeat([0, 1], 300)
    _, drawn = near_dedup.samples(doc, np.concatenate([items, items]), np.concatenate([u, v]), 3000)
    alike = np.minimum(u, v).sum() / np.maximum(u, v).sum()
    assert abs((drawn[0] == drawn[1]).mean() - alike) < 0.04


@pytest.mark.parametrize("held", [2, 500_000])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (100, 101)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_near_copies_of_very_long_documents(spark):
    """Of 200,000 shingles several share their first 32 bits."""
    words = [f"w{i}" for i in range(200_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:199_000] + [f"v{i}" for i in range(1000)])), (3, "another text of a few words")]
    _, _, shingles, _ = near_dedup._shingles([docs[0][1]], near_dedup.SHINGLE)
    assert len(np.unique(shingles >> np.uint64(near_dedup.BITS - 32))) < len(shingles)
    assert near_dedup._wide(near_dedup._narrow(shingles)).tolist() == shingles.tolist()
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_true_pairs_among_many_copies_of_a_template(spark, monkeypatch):
    """Hundreds of documents below the similarity in one bucket, many blocks of it; a few pairs above it."""
    monkeypatch.setattr(near_dedup, "MEETING", 8)
    g = random.Random(11)
    template = " ".join(f"t{i}" for i in range(100))
    docs = [(i, f"{template} {' '.join(f'o{i}x{k}' for k in range(12))}") for i in range(400)]
    pairs = [(i, 1000 + i) for i in range(0, 400, 20)]
    docs += [(b, f"{template} o{a}x0 o{a}x1 {' '.join(f'p{a}x{k}' for k in range(10))}") for a, b in pairs]
    g.shuffle(docs)
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {i: i for i, _ in docs} | {b: a for a, b in pairs}


def test_words_are_hashed_in_bounded_memory():
    g = random.Random(3)
    texts = [" ".join(g.choice("ab cde fghi jklmno".split()) + str(g.randrange(999)) for _ in range(g.randrange(40))).encode() for _ in range(20_000)]
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        hashes, many = common.hashed_words(texts)
        assert tracemalloc.get_traced_memory()[1] < 8 * size
    finally:
        tracemalloc.stop()
    assert many.tolist() == [len(t.split()) for t in texts]
    for i in (0, 77, len(texts) - 1):  # the same hashes, whatever is hashed with a text
        a = int(many[:i].sum())
        assert hashes[a : a + many[i]].tolist() == common.hashed_words([texts[i]])[0].tolist()


def test_counts_are_added_up_in_ranges():
    g = np.random.default_rng(4)
    chunks = [np.unique(g.integers(0, 40_000, 30_000).astype(np.uint64) << np.uint64(28)) for _ in range(60)]
    packed = pa.concat_tables([C.packs(i, x, np.full(len(x), i + 1), 1, 44) for i, x in enumerate(chunks)])
    tracemalloc.start()
    try:
        found = C._merge(packed)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    rows = sum(map(len, chunks))
    assert rows > 2 * C.MERGED and peak < 60 * rows
    totals = Counter()
    for i, x in enumerate(chunks):
        totals.update(dict.fromkeys(x.tolist(), i + 1))
    for i, x in ((0, chunks[0]), (59, chunks[59])):
        assert C.totals(found.filter(pc.equal(found["chunk"], i)), x)[:500].tolist() == [totals[v] for v in x[:500].tolist()]


def test_near_duplicates_leave_no_shuffle_of_earlier_jobs(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        found = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    g = random.Random(11)
    texts = [" ".join(cases.prose(g, 400)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t + " x" * k) for i, t in enumerate(texts) for k in range(3)], "doc_id long, text string")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffled(), spark.conf.get(setting)
    found = near_dedup.near_duplicates(docs)
    left = sum(size for name, size in shuffled().items() if name not in before)
    assert left < 20_000  # counts of one row a task; the texts alone are 200 kB
    assert spark.conf.get(setting) == was
    assert found.select("class_id").distinct().count() == 30


def test_near_duplicates_with_few_or_many_keys(spark, monkeypatch):
    g = random.Random(12)
    rows = [(i * 10 + k, t + " x" * k) for i, t in enumerate(" ".join(cases.prose(g, 60)) for _ in range(20)) for k in range(i % 4)]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string")
    few = sorted(map(str, near_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dedup, "FEW", 0)
    assert sorted(map(str, near_dedup.near_duplicates(docs).collect())) == few and len(few) == len(rows) + 2
