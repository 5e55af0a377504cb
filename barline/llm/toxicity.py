"""Toxicity scores from a small bidirectional recurrent network over words and their characters.

A word enters as the sum of a hashed word embedding and hashed embeddings of its runs of 3 to 6
characters, edges marked. Gated recurrent units read each window of WINDOW words in both directions, attention
pools their states, and a logistic unit scores the window. A document's logit is the greatest of its
overlapping windows, in training (multiple instance learning) as in scoring, so one insult in a long
text weighs as much as in a short one. Everything is plain numpy; windows start every STRIDE words and
cover the whole text.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, text_slices

WINDOW, STRIDE = 32, 24
#: The labelled rows that training may see: at most so many of each label, in order of a hash, of at most so many characters.
TRAIN_ROWS, TRAIN_CHARS = 1500, 4000
#: Lengths of the character runs, a mark at either edge of a word counted.
RUNS = (3, 4, 5, 6)
#: Words whose features are worked out at once, and windows read at once.
WORD_BLOCK, WINDOW_BLOCK = 5_000, 2048
#: Characters of the texts that a task works on at once; a longer text alone. Workers keep part of what they took, so this bounds what
#: lies idle too; scores are those of larger blocks but for the rounding of products of matrices.
TEXT_BLOCK = 500_000


@dataclass
class Network:
    """Parameters by name; sizes: embedding, state, hashed rows (a power of two) of words and of character runs."""

    dim: int = 12
    state: int = 8
    rows: int = 1 << 16
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> "Network":
        g = np.random.default_rng(seed)
        d, h = self.dim, self.state

        def draw(*shape, scale):
            return (g.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": draw(self.rows, d, scale=0.1), "gram": draw(self.rows, d, scale=0.1)}
        for side in "fb":
            self.p |= {f"W{side}": draw(d, 3 * h, scale=d**-0.5), f"U{side}": draw(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, h, scale=(2 * h) ** -0.5), "v": draw(h, scale=h**-0.5), "o": draw(2 * h, scale=(2 * h) ** -0.5), "o0": np.zeros(1, np.float32)}
        return self


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _row(x: np.ndarray, rows: int) -> np.ndarray:
    return (_mix(x) & np.uint64(rows - 1)).astype(np.int64)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two edge marks, and where each word begins."""
    flat = np.frombuffer(("\x02" + "\x02\x02".join(words) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return flat, np.cumsum(sizes) - sizes


def features(words: list[str], rows: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(row of each word, for each length of runs: rows of the words' runs one after another, runs per word)."""
    flat, first = _letters(words)
    sizes = np.diff(np.append(first, len(flat)))
    ends = first + sizes
    code, runs = flat.copy(), []
    for n in range(2, max(RUNS) + 1):
        code = code[:-1] * np.uint64(1_000_003) + flat[n - 1 :] if len(code) > 1 else code[:0]
        if n in RUNS:
            many = np.maximum(sizes - n + 1, 0)
            inside = np.ones(len(flat), bool)
            for back in range(1, n):
                inside[(ends - back)[sizes >= back]] = False
            runs.append((_row(code[inside[: len(code)]] + np.uint64(n), rows), many))
    places = np.arange(len(flat), dtype=np.uint64) - np.repeat(first.astype(np.uint64), sizes)
    return _row(np.add.reduceat(_mix(flat + (places << np.uint64(32))), first), rows), runs


def embed(net: Network, words: list[str]) -> tuple[np.ndarray, tuple]:
    """Word vectors, and what they were made of."""
    row, runs = features(words, net.rows)
    out = net.p["word"][row]
    share = (1 / np.sqrt(np.maximum(sum(many for _, many in runs), 1))).astype(np.float32)[:, None]
    for run, many in runs:
        full = np.flatnonzero(many)
        if len(full):
            out[full] += np.add.reduceat(net.p["gram"][run], (np.cumsum(many) - many)[full]) * share[full]
    return out, (row, runs, share)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _read(net: Network, wide: np.ndarray, ids: np.ndarray, side: str, memory: list | None):
    """States of one direction; ``wide`` holds inputs of the gates r and z and of the candidate."""
    h = net.state
    u = net.p[f"U{side}"]
    n, steps = ids.shape
    state, out = np.zeros((n, h), np.float32), np.empty((n, steps, h), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x, y = wide[ids[:, t]], state @ u
        gates = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
        r, z = gates[:, :h], gates[:, h:]
        inner = y[:, 2 * h :]
        new = np.tanh(x[:, 2 * h :] + r * inner)
        if memory is not None:
            memory.append((t, state, r, z, inner, new))
        state = new + z * (state - new)
        out[:, t] = state
    return out


def project(net: Network, table: np.ndarray) -> dict[str, np.ndarray]:
    """Word vectors as gate inputs of either direction; the last row is that of no word."""
    return {side: np.vstack([table @ net.p[f"W{side}"] + net.p[f"c{side}"], net.p[f"c{side}"][None]]) for side in "fb"}


def forward(net: Network, wide: dict[str, np.ndarray], ids: np.ndarray, memory: dict | None = None) -> np.ndarray:
    """Logits of windows; ids: windows x WINDOW numbers of projected words, -1 where a window is short."""
    p, there = net.p, ids >= 0
    both = []
    for side in "fb":
        steps: list | None = None if memory is None else []
        both.append(_read(net, wide[side], ids, side, steps))
        if memory is not None:
            memory[side] = steps
    s = np.concatenate(both, axis=2)
    look = np.tanh(s @ p["A"])
    energy = np.where(there, look @ p["v"], -1e9)
    weight = np.exp(energy - energy.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,ntk->nk", weight, s)
    if memory is not None:
        memory |= {"s": s, "look": look, "weight": weight, "pooled": pooled}
    return pooled @ p["o"] + p["o0"][0]


def backward(net: Network, table: np.ndarray, ids: np.ndarray, memory: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients by parameter, and of ``table``; slope: of the loss by each window's logit."""
    p, h, grads = net.p, net.state, {}
    s, look, weight, pooled = (memory[k] for k in ("s", "look", "weight", "pooled"))
    grads["o"], grads["o0"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
    d_pooled = slope[:, None] * p["o"]
    d_s = weight[:, :, None] * d_pooled[:, None]
    d_weight = np.einsum("ntk,nk->nt", s, d_pooled)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    d_look = d_energy[:, :, None] * p["v"] * (1 - look**2)
    grads["v"] = np.einsum("nt,ntk->k", d_energy, look)
    grads["A"] = np.einsum("ntk,ntj->kj", s, d_look)
    d_s += d_look @ p["A"].T
    d_table = np.zeros((len(table) + 1, net.dim), np.float32)
    for side, at in (("f", 0), ("b", h)):
        u, d_state = p[f"U{side}"], np.zeros((len(ids), h), np.float32)
        d_u, d_wide = np.zeros_like(u), np.zeros((len(table) + 1, 3 * h), np.float32)
        for t, before, r, z, inner, new in reversed(memory[side]):
            g = d_s[:, t, at : at + h] + d_state
            d_new = g * (1 - z) * (1 - new**2)
            d_z = g * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_new], axis=1)
            d_inner = d_new * r
            d_u[:, : 2 * h] += before.T @ d_x[:, : 2 * h]
            d_u[:, 2 * h :] += before.T @ d_inner
            d_state = g * z + d_x[:, : 2 * h] @ u[:, : 2 * h].T + d_inner @ u[:, 2 * h :].T
            np.add.at(d_wide, ids[:, t], d_x)
        grads[f"U{side}"], grads[f"c{side}"] = d_u, d_wide.sum(axis=0)
        grads[f"W{side}"] = table.T @ d_wide[:-1]
        d_table += d_wide @ p[f"W{side}"].T
    return grads, d_table[:-1]


def windows(n: int) -> list[int]:
    """Starts of the windows of ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _spans(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, the end of its text, its document); no window without words."""
    starts, doc, stop, at = [], [], [], 0
    for i, n in enumerate(lengths):
        if n:
            own = windows(n)
            starts += [at + s for s in own]
            doc += [i] * len(own)
            stop += [at + n] * len(own)
        at += n
    return np.array(starts, np.int64), np.array(stop, np.int64), np.array(doc, np.int64)


def _lay_out(numbers: np.ndarray, starts: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """windows x WINDOW numbers, -1 beyond short texts."""
    place = starts[:, None] + np.arange(WINDOW)
    inside = place < stop[:, None]
    return np.where(inside, numbers[np.minimum(place, len(numbers) - 1)], -1)


def _cut(texts: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """(distinct words, their numbers in order, words per text); words in lower case."""
    seen: dict[str, int] = {}
    put, numbers, lengths = seen.setdefault, [], []
    for t in texts:
        own = t.lower().split()
        numbers += [put(w, len(seen)) for w in own]
        lengths.append(len(own))
    return list(seen), np.array(numbers, np.int64), lengths


def logits(net: Network, texts: list[str]) -> np.ndarray:
    """The greatest window logit of each text; of a text without words the network's bias."""
    words, numbers, lengths = _cut(texts)
    out = np.full(len(texts), -np.inf)
    if words:
        table = np.vstack([embed(net, words[i : i + WORD_BLOCK])[0] for i in range(0, len(words), WORD_BLOCK)])
        wide = project(net, table)
        starts, stop, doc = _spans(lengths)
        for i in range(0, len(doc), WINDOW_BLOCK):
            j = i + WINDOW_BLOCK
            np.maximum.at(out, doc[i:j], forward(net, wide, _lay_out(numbers, starts[i:j], stop[i:j])))
    return np.where(np.isfinite(out), out, net.p["o0"][0])


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = 8, batch: int = 64, rate: float = 4e-3, least: int = 200) -> Network:
    """Fit by Adam on documents; only the window that speaks loudest of each document learns. Few documents are
    seen more often, so that there are ``least`` steps.

    Without examples of both labels the network keeps its start and answers with the share of ones.
    """
    net = Network().start(seed)
    y = np.array(labels, np.float32)
    prior = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    if len(set(labels)) < 2:
        net.p["o"][:] = 0
        net.p["o0"][0] = np.log(prior / (1 - prior))
        return net
    g, step = np.random.default_rng(seed), 0
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior)).astype(np.float32)
    epochs = max(epochs, -(-least // max(1, -(-len(texts) // batch))))
    for epoch in range(epochs):
        order = g.permutation(len(texts))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            words, numbers, lengths = _cut([texts[j] for j in pick])
            starts, stop, doc = _spans(lengths)
            if not len(doc):
                continue
            ids = _lay_out(numbers, starts, stop)
            table, (row, runs, share) = embed(net, words)
            wide = project(net, table)
            z = forward(net, wide, ids)
            loud = np.lexsort((z, doc))
            loud = loud[np.append(doc[loud][1:] != doc[loud][:-1], True)]
            memory: dict = {}
            z = forward(net, wide, ids[loud], memory)
            own = pick[doc[loud]]
            grads, d_table = backward(net, table, ids[loud], memory, ((_sigmoid(z) - y[own]) * weight[own] / len(loud)).astype(np.float32))
            step += 1
            scale = rate * 0.25 ** (epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            used = np.flatnonzero(np.abs(d_table).sum(axis=1))
            sparse = {"word": (row[used], d_table[used])}
            per_run = np.vstack([np.repeat(d_table * share, many, axis=0) for _, many in runs])
            live = np.flatnonzero(np.abs(per_run).sum(axis=1))
            sparse["gram"] = (np.concatenate([run for run, _ in runs])[live], per_run[live])
            for k, (rows, d) in sparse.items():
                at, back = np.unique(rows, return_inverse=True)
                total = np.zeros((len(at), net.dim), np.float32)
                np.add.at(total, back, d)
                grads[k] = (at, total)
            for k, d in grads.items():
                at, d = d if isinstance(d, tuple) else (slice(None), d)
                first[k][at] = 0.9 * first[k][at] + 0.1 * d
                second[k][at] = 0.999 * second[k][at] + 0.001 * d**2
                net.p[k][at] -= scale * first[k][at] / (np.sqrt(second[k][at]) + 1e-8)
    return net


def examples(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """(text, y) of a bounded sample of labelled texts: TRAIN_ROWS of each label, least hash of doc_id first."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & allowed).distinct()
    texts = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS)
    found = known.join(texts, "doc_id")
    both = [found.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_ROWS) for y in (0, 1)]
    return both[0].unionByName(both[1]).select("text", "y")


def _train_in_task(batches):
    texts, labels = [], []
    for b in batches:
        texts += b.column("text").to_pylist()
        labels += b.column("y").to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels).p)], pa.binary())], names=["parameters"])


def _scored(net, kept: list[str], text: str, out: str):
    """Batches with scores, worked on by slices of TEXT_BLOCK characters; net: an object whose ``value`` is the network."""

    def run(batches):
        for part in (p for b in batches for p in text_slices(b, TEXT_BLOCK, text, pc.utf8_length)):
            z = logits(net.value, [t or "" for t in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(1 / (1 + np.exp(-z.astype(np.float64))))], names=[*kept, out])

    return releasing(run)


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` in [0, 1], in the place of one of that name.

    A text without words (null, empty) scores as the network's bias. Every row has a score: repeated rows and equal
    texts the same one, very long texts that of their loudest window, and all windows of the whole text are read. An
    empty table gives no rows; other columns are carried as they are.
    """
    kept = [c for c in docs.columns if c != out]
    frozen = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    schema = docs.select(*kept).schema.add(out, "double")
    return docs.select(*kept).mapInArrow(_scored(frozen, kept, text, out), schema)


def held_out(c: Column, n: int, r: int) -> Column:
    """Whether crc32 of the id as text leaves ``r`` modulo ``n``; false for null."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n == r, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from the labels ``toxic`` of rows outside the held-out third."""
    sample = examples(docs, labels, ~held_out(F.col("doc_id"), 3, 1))
    # the sample is bounded: one task reads it and trains, and the driver gets a network of fixed size
    made = sample.coalesce(1).mapInArrow(releasing(_train_in_task), "parameters binary").collect()
    return Network(p=pickle.loads(made[0]["parameters"])) if made else train([], [])
