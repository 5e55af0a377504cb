from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barline.llm import common, mixing, packing

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def shared(sizes):
    """Targets by bisection of the level up to which words a unit of weight are taken."""
    w = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 10.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(3 * s, level * x) for s, x in zip(sizes, w)) < sum(sizes):
            low = level
        else:
            high = level
    return [min(3 * s, high * x) for s, x in zip(sizes, w)]


@pytest.mark.parametrize("sizes", [[10], [100, 100, 100], [1, 50, 1000, 0, 3], [0, 0], [7, 900, 2, 2, 900, 4, 1]])
def test_targets(sizes):
    assert np.allclose(mixing.targets(sizes), shared(sizes), atol=1e-6)


def test_splits_meet_quotas_and_part_draws():
    tree = mixing.Splits([50, 0, 700, 3], 7, 1)
    source = np.repeat([0, 2, 3], [50, 700, 3])
    draw = np.concatenate([np.arange(50), np.arange(700), np.arange(3)])
    shard = tree.shards_of(source, draw)
    sizes = np.bincount(shard, minlength=7)
    assert sizes.sum() == 753 and sizes.max() - sizes.min() <= 3
    for s in (0, 2, 3):  # a shard takes one range of a source's draws
        assert (np.diff(shard[source == s]) >= 0).all()
    again = mixing.Splits([50, 0, 700, 3], 7, 1)
    back = np.argsort(-draw, kind="stable")
    assert (again.shards_of(source[back], draw[back]) == shard[back]).all()


def test_shards_are_random_samples_of_the_mix():
    """What a shard gets of a source follows the hypergeometric law."""
    quotas, shards, runs = [300, 60, 640], 5, 400
    got = np.empty((runs, 3))
    for seed in range(runs):
        tree = mixing.Splits(quotas, shards, seed)
        shard = tree.shards_of(np.repeat([0, 1, 2], quotas), np.concatenate([np.arange(q) for q in quotas]))
        got[seed] = np.bincount(np.repeat([0, 1, 2], quotas)[shard == 2], minlength=3)
    assert (got.sum(axis=1) == 200).all()
    share = np.array(quotas) / 1000
    spread = 200 * share * (1 - share) * 800 / 999
    assert (np.abs(got.mean(axis=0) - 200 * share) < 5 * np.sqrt(spread / runs)).all()
    assert (np.abs(got.var(axis=0, ddof=1) / spread - 1) < 0.4).all()


def test_large_draws_stay_in_their_support():
    g = np.random.default_rng(1)
    for _ in range(50):
        k = mixing._draw(g, 3 * 10**9, 10**12, 5 * 10**11)
        assert abs(k - 1.4955 * 10**9) < 10**6
    assert mixing._draw(g, 5, 0, 3) == 3 and mixing._draw(g, 0, 9, 3) == 0


def test_mix_takes_targets_and_repeats_alike(spark):
    g = random.Random(4)
    rows = [(i, " ".join(cases.prose(g, g.choice([0, 3, 80, 700]))), g.choice(["big"] * 6 + ["mid", "low", "tail", None])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, draws = mixing.mix(docs, block_words=32, shard_words=4000)
    found = mixing.taken(documents, draws).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    totals, got = Counter(), Counter()
    for i, _, s in rows:
        totals[s] += size[i]
    names = sorted((s for s in totals if s is not None)) + [None]
    want = dict(zip(names, shared([totals[s] for s in names])))
    for r in found:
        got[r.source] += r.taken
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert len(found) == 150 and all(want[s] - 1.001 <= got[s] <= want[s] + 1e-6 for s in names)
    drawn = draws.collect()
    assert len({(r.doc_id, r.block, r["pass"]) for r in drawn}) == len(drawn)
    shards = defaultdict(list)
    for r in drawn:
        shards[r.shard].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= len(shards)
    first = {}
    for r in drawn:
        first[r.doc_id] = min(first.get(r.doc_id, (99, 0)), (r.shard, r.position))
    assert len({s for s, _ in first.values()}) > 1 and {r.doc_id: (r.shard, r.position) for r in found if r.taken} == first
    assert all(r.shard is None for r in found if not r.taken)
    again = mixing.taken(*mixing.mix(docs.repartition(5), block_words=32, shard_words=4000))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_mix_of_awkward_documents(spark):
    docs = cases.documents(spark)
    found = mixing.taken(*mixing.mix(docs)).collect()
    assert sorted(r.size for r in found) == sorted(len((r.text or "").encode().split()) for r in docs.collect())
    assert all(r.taken <= 3 * r.size for r in found)
    assert mixing.taken(*mixing.mix(cases.nothing(spark))).count() == 0


def unpacked(found, docs, length):
    """Check a packing piece by piece; the sequences' lengths."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, k, x) for k, x in enumerate(ids))
    got, sequences = Counter(), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        got.update((r.doc_id, r.start + k, int(x)) for k, x in enumerate(ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes, default=0) <= length
    return sizes


def test_packing_is_whole_and_full(spark):
    g = random.Random(8)
    docs = [(i, " ".join(cases.prose(g, g.choice([0, 5, 60, 400])))) for i in range(80)] + [(90, "  two  spaces\n\n and <|endoftext|> \t"), (91, "tail "), (92, "é́   x")]
    rows = [(i, t, "a" if i % 3 else g.choice(["b", None])) for i, t in docs]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), PATH, length=64, part_tokens=3000, quantum=16).collect()
    sizes = unpacked(found, docs, 64)
    assert sum(s < 64 for s in sizes) <= 1 + sum(sizes) // 2500
    sources = {i: s for i, _, s in rows}
    share = Counter()
    for r in found:
        share[sources[r.doc_id]] += r.length
    for part in {r.sequence_id >> 24 for r in found}:  # each part holds the mixture of the whole
        own = Counter()
        for r in found:
            if r.sequence_id >> 24 == part:
                own[sources[r.doc_id]] += r.length
        for s in share:
            assert abs(own[s] / sum(own.values()) - share[s] / sum(share.values())) < 0.01


def test_windows_keep_the_mixture():
    sizes = [60_000, 25_000, 14_000, 1_000]
    served, last = np.zeros(4), -1
    for window, queue, amount in packing.schedule(sizes, [0.0] * 4, 1024, 256):
        if window != last and window:
            assert np.abs(served - np.array(sizes) / sum(sizes) * 1024 * window).max() <= 1024
        served[queue] += amount
        last = window
    assert served.tolist() == sizes


def test_encoder_gives_the_tokenizer_s_ids():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    g = random.Random(2)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "'s", "12", "é", "!", " ", "　", "|", "\x1c", "\u0085", "<|endoftext|>", "\U0001f600"]
    batch = ["".join(g.choice(alphabet) for _ in range(g.randint(0, 40))) for _ in range(400)]
    encoder = packing.Encoder(PATH)
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(batch)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in batch]


def test_packing_of_awkward_documents(spark):
    docs = cases.documents(spark)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = unpacked(packing.pack(docs, PATH).collect(), plain, 1024)
    assert sum(s < 1024 for s in sizes) == 1
    assert packing.pack(cases.nothing(spark), PATH).count() == 0


def test_word_pattern():
    from barline.llm.common import WORD

    text = "a\x1cb \x85c\x0bd e\x00 f"
    assert [w.encode() for w in re.findall(WORD, text)] == text.encode().split()


def test_texts_become_pythons_by_slices(monkeypatch):
    monkeypatch.setattr(packing, "TEXTS", 10)
    texts = ["aaaa", "", "éé", "b" * 30, "c", "dddddddddd", ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "source": ["s"] * 7, "text": texts})
    found = list(packing._slices(batch))
    assert [f[0] for f in found] == [[0, 1, 2], [3], [4], [5, 6]]
    assert [t for f in found for t in f[2]] == texts and list(packing._slices(batch.slice(0, 0))) == []
    assert [f[2] for f in packing._slices(batch.slice(4))] == [["c"], ["dddddddddd", ""]]


def test_a_worker_releases_its_memory_after_its_rows(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(len(done)))
    rows = common.releasing(lambda batches: (b * 2 for b in batches))(iter([1, 2]))
    assert next(rows) == 2 and not done
    assert list(rows) == [4] and done == [0]
