"""Katz backoff language model over all training documents, and every document's log probability under it.

1. Documents are packed into chunks. A chunk sends its distinct n-grams once, with their occurrences in training
   documents and whether held-out ones hold them, sorted and cut into buckets by hash range. A bucket adds up, counts counts,
   and answers each chunk, by place, for the n-grams that others hold as well: total, whether a held-out document
   asks, and which chunk ``owns`` it. All other n-grams a chunk knows itself; an n-gram of three or more words is sent only
   if others hold both its parts of one word less.
2. With the totals a chunk evaluates its tokens recursively: the longest n-gram that was seen gives a discounted frequency,
   each longer one that was not, in a context that was, the context's backoff weight. Only held-out documents meet those.
3. A backoff weight is (1 - what the context's seen n-grams take) / (1 - what their endings take one order below): sums
   over distinct n-grams, added up by their owners for the contexts that held-out documents hold, merged by hash range
   and answered to the chunks that ask. So the probabilities of all words and of one unknown word sum to 1 in any context.
4. Good-Turing discounts come from counts of counts, known only when all buckets are done; until then sums are kept apart
   by the count class they will be multiplied by.

Katz discounts a count r <= TRUSTED by d_r = ((r+1) n_{r+1} / (r n_r) - A) / (1 - A), A = (TRUSTED+1) n_{TRUSTED+1} / n_1.
Where that isn't between 0 and 1, and above TRUSTED, a count gives HALF away, so that every context keeps a weight.
N-grams are compared by hashes: of 64 bits for words, of 56 for longer ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, grouped, hashed_words, kept, parts_for, shuffles_freed, texts
from .counts import bounds, deltas, planes, unplanes

ORDER, TRUSTED, HALF = 3, 5, 0.5
CLASSES = TRUSTED + 1
#: The hash of a text's end, which is no word.
END = np.uint64(0x6A09E667F3BCC909)
WORD_CHARS = 6
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STAT, DOCS, CONTEXT = range(3)
_OUT = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("held", pa.list_(pa.bool_())), ("stats", pa.list_(pa.int64())), ("asked", pa.binary()), ("items", pa.binary()), ("data", pa.binary())])
_KINDS = "kind int, chunk long, bucket int, held array<boolean>, stats array<bigint>, asked binary, items binary, data binary"


def _bits(level: int) -> int:
    return 64 if level == 1 else 56


def _zip(a: np.ndarray) -> bytes:
    return zstandard.compress(planes(a), 1) if len(a) else b""


def _unzip(b: bytes, kind) -> np.ndarray:
    return unplanes(zstandard.decompress(b), kind) if b else np.empty(0, kind)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _pack(chunk_chars: int, key):
    """Documents to chunks: a place in a task's input names one, so that a task that runs again makes the same ones."""
    names = ["chunk", "ids", "held", "lengths", "texts"]

    def row(part, n, ids, held, found):
        blob = zstandard.compress(b"".join(found), 3)
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(key)), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in found]], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=names)

    def pack(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, held, found, size = [], [], [], 0
        for b in batches:
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist()):
                t = t.encode()
                ids.append(i)
                held.append(h)
                found.append(t)
                size += len(t) + 1
                if size >= chunk_chars:
                    yield row(part, n, ids, held, found)
                    n, ids, held, found, size = n + 1, [], [], [], 0
        if ids:
            yield row(part, n, ids, held, found)

    return pack


class Grams:
    """The n-grams of a chunk, by the token they end with."""

    def __init__(self, table: pa.Table, order: int):
        self.ids, self.held, found = [], [], []
        for ids, held, lengths, blob in zip(*(table[c].to_pylist() for c in ("ids", "held", "lengths", "texts"))):
            self.ids += ids
            self.held += held
            whole, at = zstandard.decompress(blob).translate(_LOWER), 0
            for n in lengths:
                found.append(whole[at : at + n])
                at += n
        words, many = hashed_words(found)
        del found
        self.lengths = many + 1
        hashes = np.insert(words, np.cumsum(many), END)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        asking = np.array(self.held, bool)[self.doc]
        runs = Rolling(hashes)
        #: By level: distinct n-grams (sorted), a token at which each ends, its place among them by token (-1: text too short), own training count, asked.
        self.items, self.at, self.of, self.own, self.asked = {}, {}, {}, {}, {}
        for k in range(1, order + 1):
            valid = np.flatnonzero(self.place >= k - 1)
            h = hashes if k == 1 else runs.runs(valid - k + 1, k) >> np.uint64(64 - _bits(k))
            order_, first, items = grouped(h)
            inverse = np.empty(len(h), np.int64)
            inverse[order_] = np.repeat(np.arange(len(items)), np.diff(np.append(first, len(h))))
            self.items[k], self.at[k] = items, valid[order_[first]]
            self.of[k] = np.full(len(hashes), -1)
            self.of[k][valid] = inverse
            self.own[k] = np.bincount(inverse[~asking[valid]], minlength=len(items)).astype(np.int64)
            self.asked[k] = np.bincount(inverse[asking[valid]], minlength=len(items)) > 0


def _sent(g: Grams, k: int, shared: np.ndarray | None) -> np.ndarray:
    """Which n-grams of level k are sent: those whose both parts one level below are held by other chunks too."""
    if shared is None:
        return np.arange(len(g.items[k]))
    last = g.at[k]
    return np.flatnonzero(shared[g.of[k - 1][last - 1]] & shared[g.of[k - 1][last]])


_SENT = "chunk long, bucket int, items binary, counts binary"
_PACKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("items", pa.binary()), ("counts", pa.binary())])


def _pack_level(g: Grams, chunk: int, k: int, buckets: int, which: np.ndarray) -> list[dict]:
    items, sent = g.items[k][which], (g.own[k] << 1 | g.asked[k]).astype(np.uint32)[which]
    at = bounds(items, buckets, _bits(k))
    return [{"chunk": chunk, "bucket": k * buckets + b, "items": _zip(deltas(items[i:j])), "counts": _zip(sent[i:j])} for b, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]


def _send(order: int, buckets: int):
    """N-grams of the first two levels."""

    def sent(table: pa.Table) -> pa.Table:
        g = Grams(table, min(order, 2))
        return _rows(_PACKS, [r for k in g.items for r in _pack_level(g, table["chunk"][0].as_py(), k, buckets, _sent(g, k, None))])

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from sent(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    return send


def _send_more(k: int, buckets: int):
    """N-grams of level k, by the answers to the levels below."""

    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _PACKS.empty_table()
        g = Grams(docs, k)
        which = _known(g, _given(replies), k - 1, buckets)[-1]
        return _rows(_PACKS, _pack_level(g, docs["chunk"][0].as_py(), k, buckets, which))

    return send


def _given(replies: pa.Table) -> list[tuple]:
    return sorted(zip(*(replies[c].to_pylist() for c in ("bucket", "totals", "flags"))))


ANSWERS = "chunk long, bucket int, totals binary, flags binary"
_ANSWERS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("flags", pa.binary())])


def _merge(table: pa.Table) -> pa.Table:
    """Totals of a bucket; for the chunk -1 its counts of counts, its distinct n-grams and their sum."""
    table = table.sort_by("chunk")
    chunks, bucket = table["chunk"].to_pylist(), table["bucket"][0].as_py()
    parts = [np.cumsum(_unzip(x.as_py(), np.uint64), dtype=np.uint64) for x in table["items"]]
    sizes, items = [len(p) for p in parts], np.concatenate(parts)
    del parts
    sent = np.concatenate([_unzip(x.as_py(), np.uint32) for x in table["counts"]])
    order, first, _ = grouped(items)
    many = np.diff(np.append(first, len(items)))
    own = (sent >> 1)[order].astype(np.int64)
    totals, asked = np.add.reduceat(own, first), np.bitwise_or.reduceat((sent & 1)[order], first)
    rows = [{"chunk": -1, "bucket": bucket, "totals": _counted(totals)}]
    # the owner: the first of the chunks, sorted, with a training document that holds it
    owner = np.zeros(len(items) + 1, bool)
    owner[np.minimum.reduceat(np.where(own > 0, order, len(items)), first)] = True
    group = np.empty(len(items), np.int64)
    group[order] = np.repeat(np.arange(len(first)), many)
    shared = many > 1
    a = 0
    for chunk, n in zip(chunks, sizes):
        # in the order in which the chunk sent them: 0 for what no other chunk holds
        at = group[a : a + n]
        keep = shared[at]
        if keep.any():
            flags = np.where(keep, 1 + asked[at] + 2 * owner[a : a + n], 0).astype(np.uint8)
            rows.append({"chunk": chunk, "bucket": bucket, "totals": _zip(totals[at[keep]]), "flags": _zip(flags)})
        a += n
    return _rows(_ANSWERS, rows)


def _known(g: Grams, replies: list, upto: int, buckets: int):
    """By level up to ``upto`` the totals of a chunk's n-grams, which it owns, which are asked for; which were sent at each
    level, and at last which of the next level are to be."""
    total, owned, asked, sent = {}, {}, {}, {}
    which = None
    for k in range(1, upto + 1):
        sent[k] = _sent(g, k, which)
        total[k], owned[k], asked[k] = g.own[k].copy(), g.own[k] > 0, g.asked[k].copy()
        shared = np.zeros(len(g.items[k]), bool)
        begin = bounds(g.items[k][sent[k]], buckets, _bits(k))
        for bucket, totals, flags in replies:
            if bucket // buckets == k:
                f = _unzip(flags, np.uint8)
                at = np.flatnonzero(f)
                f, at = f[at] - 1, sent[k][at + begin[bucket % buckets]]
                total[k][at], owned[k][at], asked[k][at], shared[at] = _unzip(totals, np.int64), f >= 2, f % 2 == 1, True
        which = shared if k >= 2 else None
    more = _sent(g, upto + 1, which) if upto + 1 in g.items else None
    return total, owned, asked, sent, more


def _counted(totals: np.ndarray) -> bytes:
    """Counts of counts, distinct n-grams, and their sum."""
    return np.array([*np.bincount(np.minimum(totals, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2], (totals > 0).sum(), totals.sum()], np.int64).tobytes()


def _class(c: np.ndarray) -> np.ndarray:
    """0 to TRUSTED - 1 for the counts that are discounted, TRUSTED above."""
    return np.minimum(c, CLASSES) - 1


def _halves(c: np.ndarray) -> np.ndarray:
    """What is kept of a count before its discount, in halves: whole numbers, whose sums are exact and pack well."""
    return 2 * c - (c > TRUSTED)


def _evaluate(order: int, buckets: int, key):
    schema = pa.schema([("ids", pa.list_(key)), *_OUT])

    def evaluate(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:  # the chunk -1
            return _rows(schema, [{"kind": STAT, "bucket": b, "stats": np.frombuffer(t, np.int64).tolist()} for b, t in zip(replies["bucket"].to_pylist(), replies["totals"].to_pylist())])
        chunk, g = docs["chunk"][0].as_py(), Grams(docs, order)
        total, owned, asked, sent, _ = _known(g, _given(replies), order, buckets)
        rows = []
        for k in range(1, order + 1):  # what was not sent is counted here
            rows.append({"kind": STAT, "bucket": k * buckets, "stats": np.frombuffer(_counted(np.delete(total[k], sent[k])), np.int64).tolist()})
        n_docs, size = len(g.lengths), len(g.doc)
        count = {k: np.append(total[k], 0)[g.of[k]] for k in total}  # -1: none
        known = np.bincount(g.doc, count[1] > 0, n_docs).astype(np.int64)
        base = np.bincount(g.doc, np.log10(count[1] + 1.0), n_docs)
        # each token by the longest seen n-gram; on the way the contexts whose weights are needed
        part, classes, single = np.zeros(size), np.zeros(n_docs * order * TRUSTED, np.int64), np.zeros(n_docs, np.int64)
        open_, wanted = np.ones(size, bool), []
        for k in range(order, 0, -1):
            here = np.flatnonzero(open_ & (g.place >= k - 1))
            hit = here[count[k][here] > 0]
            c = count[k][hit]
            part[hit] = np.log10(_halves(c) * HALF)
            if k > 1:
                part[hit] -= np.log10(count[k - 1][hit - 1])
                miss = here[count[k][here] == 0]
                wanted.append((k, miss[count[k - 1][miss - 1] > 0]))
            else:
                single = np.bincount(g.doc[hit], minlength=n_docs)
            low = c <= TRUSTED
            classes += np.bincount((g.doc[hit[low]] * order + k - 1) * TRUSTED + c[low] - 1, minlength=len(classes))
            open_[hit] = False
        part = np.bincount(g.doc, part, n_docs)
        need_doc, need, base_at = [], [], 0
        for k, tokens in sorted(wanted, key=lambda x: x[0]):
            contexts, at = np.unique(g.of[k - 1][tokens - 1], return_inverse=True)
            need_doc.append(g.doc[tokens])
            need.append(at + base_at)
            base_at += len(contexts)
            rows += _context_rows(g, total, owned, asked, k, contexts, chunk, buckets)
        need_doc, need = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (need_doc, need))
        order_ = np.lexsort((need, need_doc))
        numbers = np.concatenate([g.lengths, known, single, np.bincount(need_doc, minlength=n_docs), *classes.reshape(n_docs, -1).T, base.view(np.int64), part.view(np.int64)])
        rows.append({"kind": DOCS, "chunk": chunk, "ids": g.ids, "held": g.held, "data": _zip(numbers), "asked": _zip(need[order_].astype(np.int32))})
        return _rows(schema, rows)

    return evaluate


def _context_rows(g: Grams, total, owned, asked, k: int, requests: np.ndarray, chunk: int, buckets: int) -> list[dict]:
    """What the chunk's own n-grams of level k add to contexts that are asked for, and the contexts it asks for itself."""
    u = np.flatnonzero(owned[k])
    last = g.at[k][u]
    context = g.of[k - 1][last - 1]
    keep = asked[k - 1][context]
    u, last, context = u[keep], last[keep], context[keep]
    below = total[k - 1][g.of[k - 1][last]]
    found, at = np.unique(context, return_inverse=True)
    types = np.bincount(at * CLASSES + _class(total[k][u]), minlength=len(found) * CLASSES).reshape(-1, CLASSES)
    taken = np.bincount(at * CLASSES + _class(below), _halves(below), len(found) * CLASSES).reshape(-1, CLASSES)
    # what the endings' counts are shares of: all tokens, or the context without its first word
    whole = total[k - 2][g.of[k - 2][g.at[k - 1][found]]] if k > 2 else np.ones(len(found), np.int64)
    own, want = g.items[k - 1][found], g.items[k - 1][requests]
    i, j = bounds(own, buckets, _bits(k - 1)), bounds(want, buckets, _bits(k - 1))
    rows = []
    for b in range(buckets):
        a, z, y, w = i[b], i[b + 1], j[b], j[b + 1]
        if z > a or w > y:
            data = [total[k - 1][found[a:z]], whole[a:z], *types[a:z].T.astype(np.int64), *taken[a:z].T.astype(np.int64)]
            rows.append({"kind": CONTEXT, "chunk": chunk, "bucket": k * buckets + b, "items": _zip(deltas(own[a:z])), "data": _zip(np.concatenate(data)), "asked": _zip(deltas(want[y:w]))})
    return rows


def discounts(counts: np.ndarray) -> np.ndarray:
    """d_1 to d_TRUSTED from how many n-grams were seen 1 to TRUSTED + 1 times."""
    out = 1 - HALF / np.arange(1, TRUSTED + 1)
    n = np.asarray(counts, float)
    if n[0] > 0:
        least = (TRUSTED + 1) * n[TRUSTED] / n[0]
        for r in range(1, TRUSTED + 1):
            if n[r - 1] > 0 and least < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - least) / (1 - least)
                out[r - 1] = d if 0 < d < 1 else out[r - 1]
    return out


def _weigh(order: int, buckets: int, found: dict[int, np.ndarray], tokens: int):
    """log10 of the backoff weights that each chunk asks a bucket for, in its order."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("weights", pa.binary())])

    def weigh(table: pa.Table) -> pa.Table:
        k = table["bucket"][0].as_py() // buckets
        items = np.concatenate([np.cumsum(_unzip(x.as_py(), np.uint64), dtype=np.uint64) for x in table["items"]])
        data = np.concatenate([_unzip(x.as_py(), np.int64).reshape(2 + 2 * CLASSES, -1) for x in table["data"]], axis=1)
        at, first, contexts = grouped(items)
        if len(at):
            whole, below = data[:2, at[first]].astype(float)
            types = np.add.reduceat(data[2 : 2 + CLASSES, at], first, axis=1)
            taken = np.add.reduceat(data[2 + CLASSES :, at], first, axis=1) * HALF
            given = np.append((1 - found[k]) * np.arange(1, CLASSES), HALF) @ types  # what the seen n-grams give away
            ends = np.append(found[k - 1], 1.0) @ taken / (tokens if k == 2 else below)
            weights = np.log10(given / whole) - np.log10(1 - ends)
        rows = []
        for chunk, want in zip(table["chunk"].to_pylist(), table["asked"].to_pylist()):
            if want:
                x = np.cumsum(_unzip(want, np.uint64), dtype=np.uint64)
                place = np.searchsorted(contexts, x)
                if (contexts[np.minimum(place, len(contexts) - 1)] != x).any():
                    raise ValueError("a context without its n-grams")
                rows.append({"chunk": chunk, "bucket": table["bucket"][0].as_py(), "weights": weights[place].tobytes()})
        return _rows(schema, rows)

    return weigh


def _finish(order: int, found: dict[int, np.ndarray], unknown: float, tokens: int, distinct: int, key):
    logs = np.concatenate([np.log10(found[k]) for k in range(1, order + 1)])
    schema = pa.schema([("doc_id", key), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(docs: pa.Table, weights: pa.Table) -> pa.Table:
        given = [np.frombuffer(w) for _, w in sorted(zip(weights["bucket"].to_pylist(), weights["weights"].to_pylist()))]
        given = np.concatenate(given) if given else np.empty(0)
        ids, held = docs["ids"][0].as_py(), docs["held"][0].as_py()
        numbers = _unzip(docs["data"][0].as_py(), np.int64).reshape(-1, len(ids))
        n, known, single, many = numbers[:4]
        classes, (base, part) = numbers[4:-2].T, numbers[-2:].view(np.float64)
        asked = _unzip(docs["asked"][0].as_py(), np.int32)
        backoff = np.bincount(np.repeat(np.arange(len(ids)), many), given[asked], len(ids))
        score = part + classes @ logs + backoff + (n - known) * unknown - single * (math.log10(tokens) if tokens else 0.0)
        base = base - n * math.log10(tokens + distinct + 1)
        return pa.Table.from_arrays([pa.array(ids, key), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(score)], schema=schema)

    return finish


def scores(docs: DataFrame, held_out: Column, order: int = ORDER, chunk_chars: int = 8_000_000, bucket_items: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held_out``, a condition on doc_id, says which rows the model does not learn from. Words are ``common.WORD`` runs, A-Z lower-cased,
    and every text ends with a token of its own; n-grams don't cross texts and the first words of a text have shorter
    contexts. score is the model's log10 probability of the whole text, base_score that of single tokens with one added
    to each count. Null and empty texts hold the end alone; very long texts are one document of a chunk. Repeated rows
    are learnt from and scored as often as they occur. Without training rows every token is the unknown one, of
    probability 1. An empty table gives no rows; other columns are ignored.
    """
    plain = texts(docs).withColumn("held_out", held_out)
    kind = docs.schema["doc_id"].dataType
    key = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    chars = plain.agg(F.sum(F.length("text"))).first()[0]
    buckets = parts_for(chars, bucket_items * WORD_CHARS)
    chunks = plain.mapInArrow(_pack(chunk_chars, key), f"chunk long, ids array<{kind.simpleString()}>, held array<boolean>, lengths array<bigint>, texts binary")
    with shuffles_freed(docs.sparkSession):
        # each level's n-grams, chunks and answers lie on disk only while they are exchanged
        chunks = kept(chunks, "chunks")
        answers = kept(chunks.mapInArrow(_send(order, buckets), _SENT).groupBy("bucket").applyInArrow(_merge, ANSWERS), "answers")
        for k in range(3, order + 1):
            more = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_more(k, buckets), _SENT)
            answers = answers.unionByName(kept(more.groupBy("bucket").applyInArrow(_merge, ANSWERS), "answers"))
        found = kept(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_evaluate(order, buckets, key), f"ids array<{kind.simpleString()}>, {_KINDS}"), "evaluated")

    stats = {k: np.zeros(TRUSTED + 3, np.int64) for k in range(1, order + 1)}
    level = F.expr(f"bucket DIV {buckets}").alias("level")
    for r in found.where(F.col("kind") == STAT).groupBy(level).agg(*(F.sum(F.col("stats")[i]) for i in range(TRUSTED + 3))).collect():  # one row per level
        stats[r[0]] += np.array(r[1:], np.int64)
    rates = {k: discounts(s[: TRUSTED + 1]) for k, s in stats.items()}
    distinct, tokens = (int(x) for x in stats[1][-2:])
    given = float((1 - rates[1]) @ (np.arange(1, CLASSES) * stats[1][:TRUSTED])) + HALF * float(distinct - stats[1][:TRUSTED].sum())
    unknown = math.log10(given / tokens) if tokens else 0.0
    weights = found.where(F.col("kind") == CONTEXT).select("chunk", "bucket", "items", "data", "asked").groupBy("bucket").applyInArrow(_weigh(order, buckets, rates, tokens), "chunk long, bucket int, weights binary")
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = found.where(F.col("kind") == DOCS).select("chunk", "ids", "held", "data", "asked")
    return rows.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(_finish(order, rates, unknown, tokens, distinct, key), schema)
