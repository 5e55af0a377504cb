from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import katz, lexical_search, prefix_trie
from barline.llm.toxicity import held_out

from . import cases

# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def bag(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best(docs, items, k):
    """Every score of every pair, sorted."""
    held = [(i, Counter(bag(t)), len(bag(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n_docs, length = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    by_item = defaultdict(Counter)
    for i, t in set(items):
        by_item[i].update(bag(t))
    for item, words in by_item.items():
        found = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, times in words.items() if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if u else i, -s) for r, (s, u, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def some_texts(g, n, words=60):
    return [(i, " ".join(g.choice(["a", "the", "of"]) if g.random() < 0.4 else f"w{int(g.random() ** 3 * words)}" for _ in range(g.choice([0, 1, 5, 30, 120])))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 10, 400])
def test_search_equals_all_scores(spark, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "SAMPLE", 50)
    monkeypatch.setattr(lexical_search, "STEP", 2)
    g = random.Random(3)
    docs = some_texts(g, 300)
    docs += [(1000 + i, docs[7][1] + " w3 w3") for i in range(60)] + [(5, "The w1-W2 été ÉTÉ w1"), (5, "w3"), (None, "w3")]
    items = [(i, t) for i, t in some_texts(g, 25)] + [(90, "The THE the w1 w1 été"), (90, "w2"), (90, "w2"), (None, "w3"), (91, None), (92, "absent")]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k, item_terms=40)
    assert sorted(map(tuple, found.collect()), key=str) == best(docs, items, k)


def test_lists_are_not_read_to_their_end():
    g = np.random.default_rng(1)
    lists = []
    for _ in range(4):
        docs = g.permutation(20_000)
        parts = np.sort(g.pareto(1.5, 20_000) * 1000).astype(np.int64)[::-1] + 1
        lists.append((docs, parts))
    scores = np.zeros(20_000, np.int64)
    for d, p in lists:
        scores[d] += p
    kth = int(np.sort(scores)[-10])
    met, found = lexical_search.nra(lists, 20_000, 10, 0)
    assert sorted(zip(met.tolist(), found.tolist())) == [(d, int(s)) for d, s in enumerate(scores) if s >= kth]
    nothing, _ = lexical_search.nra(lists, 20_000, 10, int(scores.max()) + 1)
    assert len(nothing) == 0


def test_search_of_awkward_documents(spark):
    docs = cases.documents(spark)
    items = spark.createDataFrame([(1, "alpha0 w5x5 ONE été", 9), (None, "key", 1), (2, None, 1), (3, "", 1)], "item_id long, text string, score long")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, lexical_search.search(docs, items).collect()), key=str) == best(plain, [(r[0], r[1]) for r in items.collect()], 10)
    assert lexical_search.search(cases.nothing(spark), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


# --- conversations ---


def trie(rows, base, head):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {c: [*own.get(base(c), [])[: head(c)], *turns[head(c) :]] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check_trie(spark, rows, parts=4):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, node string").repartition(parts)
    found = prefix_trie.prefix_trie(table, F.expr("c - c % 5"), F.crc32(F.col("c").cast("string").cast("binary")) % 9)
    base, head = lambda c: c - int(math.fmod(c, 5)), lambda c: zlib.crc32(str(c).encode()) % 9
    assert sorted(map(tuple, found.collect()), key=str) == trie(rows, base, head)


def test_trie_equals_rebuilt_texts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEPTHS", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    g = random.Random(8)
    turns = [("user", "hello"), ("assistant", "hé"), ("user", ""), ("system", "be kind")]
    rows = []
    for c in [*range(-7, 60), 1000, 1003, 5_000_000_000]:
        for t in range(g.choice([1, 2, 5, 12])):
            rows.append((c, t, *g.choice(turns[: 2 if t < 6 else 4])))
    check_trie(spark, rows)


def test_trie_of_awkward_turns_and_one_long_conversation(spark):
    rows = [(0, None, None, None), (0, 1, "user", None), (0, 1, "user", ""), (0, 1, "user", ""), (1, 0, None, "x" * 300_000), (2, 0, "", "x" * 300_000), (None, 0, "user", "lost"), (3, 5, "a", "b"), (3, -5, "a:b", "c")]
    check_trie(spark, rows)
    # spread over several ranges
    check_trie(spark, [(c, t, "user", f"turn {t % 7}") for c, n in ((10, 900), (11, 40), (12, 900)) for t in range(n)])
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), F.col("c"), F.lit(1)).count() == 0


def test_failed_group_starts_again_with_other_maps(spark, monkeypatch):
    real, seeds = prefix_trie.maps, []

    def same(content, seed):  # with the first seed all turns stand for one map
        a, b = real(content, seed)
        return (a, b) if seed else (np.ones_like(a), np.ones_like(b))

    monkeypatch.setattr(prefix_trie, "maps", same)
    monkeypatch.setattr(prefix_trie, "prefixes", lambda turns, seed, f=prefix_trie.prefixes: seeds.append(seed) or f(turns, seed))
    check_trie(spark, [(c, t, "user", f"{c % 3} {t}") for c in range(6) for t in range(3)])
    assert seeds == [0, 1]


# --- backoff model ---


class Katz:
    """Counts in dictionaries, one probability at a time."""

    def __init__(self, texts, order):
        self.order = order
        self.count = [Counter() for _ in range(order + 1)]
        for w in map(self.tokens, texts):
            for k in range(1, order + 1):
                self.count[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        self.n = sum(self.count[1].values())
        self.rate = [None] + [katz.discounts([sum(c == r for c in self.count[k].values()) for r in range(1, katz.TRUSTED + 2)]) for k in range(1, order + 1)]
        self.after = defaultdict(list)
        for k in range(1, order + 1):
            for g in self.count[k]:
                self.after[g[:-1]].append(g[-1])
        self.weights = {}

    @staticmethod
    def tokens(text):
        return [*re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split(), None]

    def seen(self, g):
        c = self.count[len(g)][g]
        c = c * self.rate[len(g)][c - 1] if c <= katz.TRUSTED else c - katz.HALF
        return c / (self.count[len(g) - 1][g[:-1]] if len(g) > 1 else self.n)

    def p(self, w, context):
        g = (*context, w)
        if self.count[len(g)][g]:
            return self.seen(g)
        if not context:
            return 1 - sum(self.seen((x,)) for x in self.after[()])
        if not self.count[len(context)][context]:
            return self.p(w, context[1:])
        if context not in self.weights:
            self.weights[context] = (1 - sum(self.seen((*context, x)) for x in self.after[context])) / (1 - sum(self.p(x, context[1:]) for x in self.after[context]))
        return self.weights[context] * self.p(w, context[1:])

    def score(self, text):
        w = self.tokens(text)
        return sum(math.log10(self.p(x, tuple(w[max(0, i - self.order + 1) : i]))) for i, x in enumerate(w))

    def base(self, text):
        return sum(math.log10((self.count[1][x,] + 1) / (self.n + len(self.count[1]) + 1)) for x in self.tokens(text))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_model(spark, docs, order, **sizes):
    model = Katz([t for i, t in docs if not held(i)], order)
    found = katz.scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), held_out(F.col("doc_id"), 7, 2), order, **sizes).collect()
    expected = sorted(((i, held(i), len(model.tokens(t)), sum(model.count[1][x,] > 0 for x in model.tokens(t)), model.n, model.base(t), model.score(t)) for i, t in docs), key=lambda r: str(r[:4]))
    found = sorted(map(tuple, found), key=lambda r: str(r[:4]))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    by = lambda rows: sorted((r[:5], round(r[5], 6), round(r[6], 6)) for r in [(str(r[0]), *r[1:]) for r in rows])
    assert by(found) == by(expected)
    return model


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_model_equals_dictionaries(spark, order):
    g = random.Random(order)
    docs = [(i, " ".join(g.choice(["a", "the", "Of"]) if g.random() < 0.5 else f"w{int(g.random() ** 3 * 50)}" for _ in range(g.choice([0, 1, 2, 9, 60])))) for i in range(250)]
    docs += [(i, docs[3][1]) for i in range(300, 330)] + [(None, "a the of"), (None, None), (2000, "Never Seen before a the")]
    model = check_model(spark, docs, order, chunk_chars=900, bucket_items=100)
    vocabulary = [x for (x,) in model.count[1]] + ["unknown"]
    contexts = [(), *random.Random(1).sample(sorted((g[:-1] for k in range(2, order + 1) for g in model.count[k]), key=str), 20 if order > 1 else 0), (b"no", b"such")[: order - 1]]
    for c in contexts:
        assert sum(model.p(w, c) for w in vocabulary) == pytest.approx(1, abs=1e-12)


def test_model_of_awkward_documents(spark):
    docs = cases.documents(spark)
    check_model(spark, [(r.doc_id, r.text) for r in docs.collect()], 3)
    assert katz.scores(docs, held_out(F.col("doc_id"), 7, 2)).count() == docs.count()
    assert katz.scores(cases.nothing(spark), F.lit(False)).count() == 0
    none = katz.scores(docs, F.lit(True)).select("train_tokens", "n_known", "base_score", "score").distinct().collect()
    assert [tuple(r) for r in none] == [(0, 0, 0.0, 0.0)]


def test_katz_leaves_no_shuffle_of_earlier_jobs(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n.split("_")[1] for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs, before, was = cases.documents(spark), shuffled(), spark.conf.get(setting)
    katz.scores(docs, held_out(F.col("doc_id"), 7, 2))
    # the sum of characters and the counts of counts, which hold one row a task
    assert len(shuffled() - before) <= 2
    assert spark.conf.get(setting) == was


def test_katz_sums_of_contexts_are_whole_numbers():
    c = np.arange(1, 12)
    kept_ = katz._halves(c)
    assert kept_.dtype.kind == "i" and (kept_ / 2 == np.where(c > katz.TRUSTED, c - katz.HALF, c)).all()
