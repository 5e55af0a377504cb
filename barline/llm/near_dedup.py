"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

1. Shingles of five words; their document frequencies are counted exactly over the corpus
   (:mod:`counts`), so each chunk of documents knows the weights of its own shingles.
2. Only documents whose weight lies mostly on shingles of several documents can have a partner. For these
   improved consistent weighted sampling draws SAMPLES samples of each weighted set; two
   documents agree in a sample with a probability equal to their weighted Jaccard similarity.
3. Documents with equal words form one class at once, with one representative. Representatives that
   agree in all samples of a band meet in a bucket, cut into blocks of bounded size. A block proposes the
   spanning forest of most agreeing samples, one pair less than it has members; pairs that agree too seldom
   are let go, the proposed ones are verified on the weighted sets.
4. Classes are the components of verified links. A bucket that still holds several classes is dealt to blocks
   anew, and each class meets its nearest other ones by a pair that agrees most, until a round finds no link.
5. Then every pair that can still be a link is tested: of members of different classes that met in a bucket larger
   than a block, or that agree often enough in a block. Shingles are ordered by document frequency; two sets at a
   similarity s share a shingle so early that what precedes it leaves both enough weight (:func:`_prefixes`), so
   only pairs with such a shingle are met, whatever the bucket's size. What all copies of a template share comes last.

Weight of a shingle: (1 + ln tf) * (1 - DAMP + DAMP * idf), idf = ln(1 + N/df) / ln(1 + N). The idf is
damped because a large group of near copies lowers the idf of what its members share, though not of
what sets them apart: undamped, the group would be no group any more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts as C
from .common import Rolling, hashed_words, kept, mixed, parts_for, release, releasing, shuffles_freed, stored, texts
from .components import components

SHINGLE, SIMILARITY, BANDS, ROWS, DAMP = 5, 0.8, 12, 3, 0.1
BITS = 48
#: Samples of a document (the first BANDS * ROWS make the bands), and the share of agreeing ones below which a pair is
#: let go: those of a pair at 0.8 agree so seldom less than once in 2,000 times.
SAMPLES, LEAST_AGREEING = 128, 0.68
BLOCK = 50_000
#: Members of a bucket that are compared with each other.
MEETING = 512
#: Other classes that a class of a block meets in a round, and the samples by which its choice of a pair may err.
NEAREST, NOISE = 8, 8
#: Characters of a word, roughly; sets the size of buckets, no result.
WORD_CHARS = 6
#: Keys that are broadcast at most, to pick their rows without an exchange of all; sets no result.
FEW = 100_000


def _shingles(texts_: list[str], n: int):
    """(digests, document, shingle, tf), by document and shingle; documents of fewer words have one shingle."""
    lowered = [t.lower().encode() for t in texts_]
    digests = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in lowered]
    words, lengths = hashed_words(lowered)
    if not len(words):
        return digests, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    many = np.where(lengths > 0, np.maximum(lengths - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(lengths)), many)
    first = np.cumsum(lengths) - lengths
    starts = first[doc] + np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
    hashes = Rolling(words).runs(starts, np.minimum(lengths, n)[doc]) >> np.uint64(64 - BITS)
    found = []
    for a in range(0, len(lengths), 1 << 64 - BITS):  # as many documents as fit beside a shingle's bits
        i, j = np.searchsorted(doc, [a, a + (1 << 64 - BITS)])
        key = np.sort((doc[i:j] - a).astype(np.uint64) << np.uint64(BITS) | hashes[i:j])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        found.append(((key[at] >> np.uint64(BITS)).astype(np.int64) + a, key[at] & np.uint64((1 << BITS) - 1), np.diff(np.append(at, len(key)))))
    return digests, *(np.concatenate(x) for x in zip(*found))


def _weights(hashes: np.ndarray, tf: np.ndarray, replies: pa.Table, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of shingles, and how many documents of the corpus hold each."""
    df = C.totals(replies, hashes)
    idf = np.log1p(n_docs / df) / np.log1p(n_docs)
    return ((1 + np.log(tf)) * (1 - DAMP + DAMP * idf)).astype(np.float32), df


def _draws(k: int) -> tuple[np.uint64, np.uint64]:
    """The seeds of sample k."""
    a, b = (xxhash.xxh3_64_intdigest(f"sample {k} {x}".encode()) for x in "ab")
    return np.uint64(a), np.uint64(b | 1)


def samples(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, int32 samples of each): consistent weighted samples, of entries sorted by document.

    For each entry and sample: r, c ~ Gamma(2, 1), b ~ Uniform(0, 1) from the shingle alone;
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The entry of least a is the
    sample, together with its t. The exponentials behind the Gammas come from a table of 2**16 steps.
    """
    exponential = -np.log((np.arange(65536, dtype=np.float64) + 0.5) / 65536).astype(np.float32)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(doc))
    out = np.empty((len(starts), k), np.int32)
    ln_w = np.log(weights)
    seeds = [_draws(j) for j in range(k)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        h, lw, local = hashes[a:b], ln_w[a:b], starts[i:j] - a
        sizes = ends[i:j] - starts[i:j]
        for s, (seed, factor) in enumerate(seeds):
            u = mixed(h ^ seed).view(np.uint16).reshape(-1, 4)
            r = exponential[u[:, 0]] + exponential[u[:, 1]]
            c = exponential[u[:, 2]] + exponential[u[:, 3]]
            beta = ((h * factor) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(lw / r + beta)
            score = np.log(c) - r * (t - beta) - r
            least = np.minimum.reduceat(score, local)
            hit = np.flatnonzero(score == np.repeat(least, sizes))
            hit = hit[np.searchsorted(hit, local)]
            out[i:j, s] = mixed(h[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32).view(np.int32)
        i = j
    return doc[starts], out


def _narrow(hashes: np.ndarray) -> bytes:
    """Shingles in their BITS bits: fewer would name two shingles of a long document alike."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def _wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) * 8 // BITS, 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(b, np.uint8).reshape(-1, BITS // 8)
    return out.view(np.uint64).ravel()


def _send(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        release()  # what earlier groups took
        _, _, hashes, _ = _shingles(table["text"].to_pylist(), SHINGLE)
        items, own = np.unique(hashes, return_counts=True)
        return C.packs(table["chunk"][0].as_py(), items, own, buckets, BITS)

    return send


def _sketch(n_docs: int, similarity: float):
    """Samples and weighted sets of the documents that can have a partner: what two documents share occurs in
    both, so shingles of several documents must hold ``similarity`` of the weight. A set lies by document frequency
    and shingle; ``alone`` shingles at its start are in no other document."""

    def sketch(docs: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        digests, doc, hashes, tf = _shingles(docs["text"].to_pylist(), SHINGLE)
        drawn, items, weighed, alone = ([None] * docs.num_rows for _ in range(4))
        if len(doc):
            weights, df = _weights(hashes, tf, replies, n_docs)
            share = np.bincount(doc, weights * (df > 1), docs.num_rows) >= (similarity - 1e-6) * np.bincount(doc, weights, docs.num_rows)
            some = share[doc]
            doc, hashes, weights, df = doc[some], hashes[some], weights[some], df[some]
            which, found = samples(doc, hashes, weights, SAMPLES)
            rarest = np.lexsort((hashes, df, doc))
            hashes, weights = hashes[rarest], weights[rarest]
            single = np.bincount(doc, df == 1, docs.num_rows).astype(np.int64)
            at = np.searchsorted(doc, np.append(which, docs.num_rows))
            for d, s, a, b in zip(which.tolist(), found.tolist(), at[:-1].tolist(), at[1:].tolist()):
                drawn[d], items[d], weighed[d] = s, _narrow(hashes[a:b]), weights[a:b].tobytes()
                alone[d] = int(single[d])
        made = {"digest": pa.array(digests, pa.binary()), "samples": pa.array(drawn, pa.list_(pa.int32())), "items": pa.array(items, pa.binary()), "weights": pa.array(weighed, pa.binary()), "alone": pa.array(alone, pa.int32())}
        return pa.table({"row_key": docs["row_key"], "doc_id": docs["doc_id"], **made})

    return sketch


def _verify(threshold: float):
    def verify(batches):
        for batch in batches:
            found = []
            for a, b, ai, aw, bi, bw in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "a_items", "a_weights", "b_items", "b_weights"))):
                x, y = _wide(ai), _wide(bi)
                u, v = np.frombuffer(aw, np.float32).astype(np.float64), np.frombuffer(bw, np.float32).astype(np.float64)
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                common = np.minimum(u[i], v[j]).sum()
                if common / (u.sum() + v.sum() - common) >= threshold - 1e-9:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return releasing(verify)


def forest(agree: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of the spanning forest of greatest agreement, none below ``least``."""
    n = len(agree)
    out, best, near = [], agree[0].astype(float), np.zeros(n, np.int64)
    best[0] = -1
    for _ in range(n - 1):
        i = int(best.argmax())
        if best[i] >= least:
            out.append((int(near[i]), i))
        row = np.where(best < 0, -1.0, agree[i])
        row[i] = best[i] = -1
        better = row > best
        best[better], near[better] = row[better], i
    return out


def _class_pairs(own: np.ndarray, classes: np.ndarray, least: float, g: np.random.Generator) -> np.ndarray:
    """Of a block of several classes: for each class and its NEAREST other ones a pair of members that agrees most,
    but for a little noise: so the buckets of two classes put forward different pairs of them."""
    n, order = len(own), np.argsort(classes, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(classes[order]) != 0]))
    agree = (own[order][:, None] == own[order][None]).sum(axis=2)
    rank = np.where(agree >= least, agree + g.integers(0, NOISE, (n, n)), 0)
    best = np.maximum.reduceat(rank * (n * n) + np.arange(n * n).reshape(n, n), first, axis=1)
    best = np.maximum.reduceat(best, first, axis=0)
    np.fill_diagonal(best, -1)
    near = np.take_along_axis(best, np.argsort(-best, axis=1)[:, :NEAREST], axis=1).ravel()
    pair = near[near >= n * n] % (n * n)
    return np.stack([order[pair // n], order[pair % n]], axis=1)


def _edges(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each block begins, and its size."""
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(axis=1)]))
    return first, np.diff(np.append(first, len(block)))


def _propose(width: int, first_round: bool, turn: int):
    """Pairs of every block."""
    least = LEAST_AGREEING * width

    def pairs(block, key, component, drawn):
        first, sizes = _edges(block)
        two = first[sizes == 2]
        two = two[(drawn[two] == drawn[two + 1]).sum(axis=1) >= least]
        two = two[component[two] != component[two + 1]]
        found = [(key[two], key[two + 1])]
        for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = drawn[a : a + n]
            if first_round:
                edges = np.array(forest((own[:, None] == own[None]).sum(axis=2), least), np.int64).reshape(-1, 2)
            else:
                edges = _class_pairs(own, component[a : a + n], least, np.random.default_rng([turn, *(block[a] & 0x7FFFFFFF).tolist()]))
            found.append((key[a + edges[:, 0]], key[a + edges[:, 1]]))
        a, b = (np.concatenate(x) for x in zip(*found))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return _whole_blocks(width, pairs)


def _close(width: int):
    """Members of blocks of more than two that agree often enough with a member of another class."""
    least = LEAST_AGREEING * width

    def close(block, key, component, drawn):
        found = [key[:0]]
        for a, n in ((a, n) for a, n in zip(*_edges(block)) if n > 2):
            own, classes = drawn[a : a + n], component[a : a + n]
            agree = (own[:, None] == own[None]).sum(axis=2) >= least
            found.append(key[a : a + n][(agree & (classes[:, None] != classes[None])).any(axis=1)])
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["row_key"])

    return _whole_blocks(width, close)


def _whole_blocks(width: int, work):
    """``work`` over batches cut between blocks; rows come sorted by block."""

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([batch.column("bucket").to_numpy(), batch.column("part").to_numpy()], axis=1)
            drawn = batch.column("samples").flatten().to_numpy().reshape(-1, width)
            own = (block, batch.column("row_key").to_numpy(), batch.column("component").to_numpy(), drawn)
            own = own if rest is None else tuple(np.concatenate(x) for x in zip(rest, own))
            earlier = np.flatnonzero((own[0] != own[0][-1]).any(axis=1))
            last = int(earlier[-1]) + 1 if len(earlier) else 0
            rest = tuple(x[last:] for x in own)
            if last:
                yield work(*(x[:last] for x in own))
        if rest is not None:
            yield work(*rest)

    return releasing(run)


def _prefixes(similarity: float):
    """Of each set the shingles at which its first common one with a set at ``similarity`` can stand.

    With weights A and B, of which a and b precede the first common shingle, sets share at most min(A - a, B - b),
    which must be similarity / (1 + similarity) * (A + B). So a is at most (1 - similarity) A, and in one of the
    two sets (``short``) at most (1 - similarity) / (1 + similarity) A.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())

    def prefixes(batches):
        for batch in batches:
            found, n = [], 0
            for key, component, items, weights, alone in zip(*(batch.column(c).to_pylist() for c in ("row_key", "component", "items", "weights", "alone"))):
                w = np.frombuffer(weights, np.float32).astype(np.float64)
                total, before = w.sum(), np.cumsum(w) - w
                upto = int(np.searchsorted(before, (1 - similarity + 1e-6) * total, side="right"))
                if upto > alone:
                    tokens, before = _wide(items)[alone:upto].view(np.int64), before[alone:upto]
                    same = (np.full(len(tokens), x) for x in (key, component, total))
                    row = [tokens, *same, before, before <= ((1 - similarity) / (1 + similarity) + 1e-6) * total]
                    found.append([row[i] for i in (0, 1, 2, 4, 3, 5)])
                    n += len(tokens)
                if n > 500_000:
                    yield out(found)
                    found, n = [], 0
            if found:
                yield out(found)

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*found), kinds)], names=["token", "row_key", "component", "before", "total", "short"])

    return prefixes


def _remaining(members: DataFrame, classes: DataFrame | None, sides: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different classes that can be at ``similarity``: of members of buckets larger than a block, and
    of those that a block finds close."""
    dealt = _dealt(members, classes, sides, 0)
    near = dealt.where(F.col("n") <= MEETING).mapInArrow(_close(SAMPLES), "row_key long")
    large = _dealt(members, classes, None, 0).where(F.col("n") > MEETING).select("row_key")
    wanted = near.unionByName(large).distinct()
    wanted = _named(wanted, classes).join(vectors.hint("merge"), "row_key")
    tokens = kept(wanted.mapInArrow(_prefixes(similarity), "token long, row_key long, component long, before double, total double, short boolean"), "prefixes")
    # at each shingle the members of its largest class meet those of the others, and these each other
    counted = tokens.groupBy("token", "component").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    groups = counted.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("classes"), F.max("short").alias("short"))
    groups = groups.where("classes > 1 AND short").select("token", "major")
    placed = kept(tokens.join(groups, "token").withColumn("minor", F.col("component") != F.col("major")).drop("major"), "placed")
    x = placed.where("short").select("token", *(F.col(c).alias(f"x_{c}") for c in ("row_key", "component", "before", "total", "minor")))
    y = placed.select("token", *(F.col(c).alias(f"y_{c}") for c in ("row_key", "component", "before", "total", "minor")))
    enough = f"least(x_total - x_before, y_total - y_before) >= {similarity / (1 + similarity) - 1e-6!r} * (x_total + y_total)"
    met = x.where("x_minor").join(y, "token").unionByName(x.where("NOT x_minor").join(y.where("y_minor"), "token"))
    return met.where("x_component != y_component").where(enough).select(F.least("x_row_key", "y_row_key").alias("a"), F.greatest("x_row_key", "y_row_key").alias("b")).distinct()


def _named(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``members`` with the class of each as ``component``."""
    if classes is None:
        return members.withColumn("component", F.col("row_key"))
    named = members.join(classes.hint("merge"), members["row_key"] == classes["node"], "left")
    return named.select(*members.columns, F.coalesce("component", "row_key").alias("component"))


def _of(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is among ``keys``: without an exchange of the rows if the keys are few."""
    return rows.join(keys.hint("broadcast" if keys.count() <= FEW else "merge"), column, "left_semi")


def _dealt(members: DataFrame, classes: DataFrame | None, sides: DataFrame | None, turn: int) -> DataFrame:
    """Members of the ``n`` of buckets that hold several classes; with ``sides`` also their samples, dealt to blocks."""
    open_ = _named(members.select("bucket", "row_key"), classes)
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    held = open_.join(sizes.hint("merge"), "bucket")
    if sides is None:
        return held.select("bucket", "row_key", "component", "n")
    part = F.pmod(F.xxhash64(F.lit(turn), "row_key"), F.ceil(F.col("n") / MEETING).cast("long")).alias("part")
    dealt = held.join(sides.hint("merge"), "row_key").select("bucket", part, "row_key", "component", "samples", "n")
    return dealt.repartition(F.col("bucket"), F.col("part")).sortWithinPartitions("bucket", "part")


def _meetings(members: DataFrame, classes: DataFrame | None, sides: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) to verify, of members of a bucket that are not of one class yet."""
    dealt = _dealt(members, classes, sides, turn).drop("n")
    return dealt.mapInArrow(_propose(SAMPLES, classes is None, turn), "a long, b long").distinct()


def _linked(docs: DataFrame, similarity: float, chunk_chars: int, bucket_items: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(sketches of all rows, the representative of each digest, the class of each linked representative; None without links)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    plain = texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    chars, n_docs = plain.agg(F.sum(F.length("text")), F.count("*")).first()
    n_chunks, buckets = parts_for(chars, chunk_chars), parts_for(chars, bucket_items * WORD_CHARS)
    rows = plain.select(F.pmod("row_key", F.lit(n_chunks)).cast("int").alias("chunk"), "row_key", "doc_id", "text")
    packed = rows.groupBy("chunk").applyInArrow(_send(buckets), C.PACKS)
    replies = C.answers(packed)
    schema = f"row_key long, doc_id {key}, digest binary, samples array<int>, items binary, weights binary, alone int"
    sketches = kept(rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_sketch(n_docs, similarity), schema), "sketches")

    first = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "row_key", "samples")).alias("r")
    copies = kept(sketches.groupBy("digest").agg(first, F.count("*").alias("n")).select("digest", "r.*", "n"), "copies")

    # representatives that share a band with another
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.col("samples")[b * ROWS + i] for i in range(ROWS))) for b in range(BANDS)))
    spread = copies.where("samples IS NOT NULL").select("row_key", F.explode(bands).alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = kept(spread.join(shared, "bucket"), "members")
    wanted = kept(members.select("row_key").distinct(), "wanted")
    sides = kept(_of(copies.select("row_key", "samples"), wanted, "row_key"), "samples")
    # identical rows share a row_key: one of them
    vectors = kept(_of(sketches.where("items IS NOT NULL"), wanted, "row_key").groupBy("row_key").agg(F.first("items").alias("items"), F.first("weights").alias("weights"), F.first("alone").alias("alone")), "vectors")

    # no join of the rounds broadcasts more than FEW keys: what they relate grows with the corpus, and the driver would build every relation
    sets = vectors.select(F.col("row_key").alias("b"), F.col("items").alias("b_items"), F.col("weights").alias("b_weights"))
    classes, tested, turn, last = None, [], 0, False
    while True:
        met = _remaining(members, classes, sides, vectors, similarity) if last else _meetings(members, classes, sides, turn)
        if tested:
            met = met.join(docs.sparkSession.read.parquet(*tested).hint("merge"), ["a", "b"], "left_anti")
        met, path = stored(met, "met")
        tested.append(path)
        # later rounds propose few pairs: only the sets of these travel
        own = sets if met.count() > FEW // 2 else _of(sets, met.select("b").union(met.select("a")).distinct(), "b")
        paired = met.join(own.select(*(F.col(c).alias(c.replace("b", "a", 1)) for c in own.columns)).hint("merge"), "a").join(own.hint("merge"), "b")
        new = kept(paired.mapInArrow(_verify(similarity), "a long, b long"), "links")
        none = new.isEmpty()
        if not none:
            # what is linked so far is named by its classes: as many links as members, contracted by the tasks that read them
            links = new if classes is None else new.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b")))
            classes = components(links)
        if last:
            break
        last = none
        turn += 1
    return sketches, copies, classes


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, chunk_chars: int = 4_000_000, bucket_items: int = 4_000_000) -> DataFrame:
    """One row per input row: doc_id, row_key (of id and text), class_id, n_copies, keeper.

    class_id is the least doc_id of the class (null only if all its ids are), keeper marks the rows whose
    row_key stands for the class; identical rows share a row_key. Words are cut at white space and compared
    in lower case, of very long texts all. Documents without words (null, empty) are copies of each other and of nothing else. Other
    columns are ignored; an empty table gives an empty result.
    """
    # every job but the last writes its rows: what it shuffled needn't stay beside what the next ones shuffle
    with shuffles_freed(docs.sparkSession):
        sketches, copies, classes = _linked(docs, similarity, chunk_chars, bucket_items)
    named = copies.withColumn("component", F.col("row_key")) if classes is None else copies.join(classes.hint("merge"), copies["row_key"] == classes["node"], "left").withColumn("component", F.coalesce("component", "row_key"))
    heads = named.groupBy("component").agg(F.min(F.struct("unknown", "doc_id", "row_key")).alias("h"), F.sum("n").alias("n_copies"))
    whole = named.select("digest", "component").join(heads, "component").select("digest", F.col("h.doc_id").alias("class_id"), F.col("h.row_key").alias("head"), "n_copies")
    return sketches.select("digest", "doc_id", "row_key").join(whole, "digest").select("doc_id", "row_key", "class_id", "n_copies", (F.col("row_key") == F.col("head")).alias("keeper"))
