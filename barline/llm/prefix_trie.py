"""A trie of rebuilt conversations, from fingerprints that compose without rebuilding a text.

1. Every turn stands for an invertible affine map x -> a x + b modulo a prime, in LANES lanes, drawn from its
   content's SHA-256; a sequence of turns stands for the composition of their maps, which is associative. Stored turns,
   sorted by conversation and place and cut into blocks by range, are composed by a segmented scan; a
   conversation that runs over several blocks gets the composition of its earlier blocks in front.
2. A rebuilt conversation is a head of its base and a suffix of its own: its prefixes' maps are f(base, i), and
   f(own, j) after the inverse of f(own, h) after f(base, h). One map for each conversation joins the two.
3. Prefixes of equal depth and fingerprint are a node. Members refer to a stored turn each, by whose content the
   group is verified: with equal last turns equal fingerprints at one depth are equal ones at the depth before (the
   maps are invertible), so all turns are equal. A group that fails makes the whole start again with other maps.
4. A node's smallest member owns it. Sums over a subtree are, over the members of its top, what each owns from there down.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, mixed

LANES, PRIME = 4, (1 << 31) - 1
#: Depths of a conversation that are summed together, and ids of a node that are joined to one string.
DEPTHS, IDS = 4096, 65_536
_A, _B = [f"a{i}" for i in range(LANES)], [f"b{i}" for i in range(LANES)]
_MAP = ", ".join(f"{c} long" for c in (*_A, *_B))


def maps(content: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of turns from the first two words of their digests (n x 2): n x LANES each, a never 0."""
    p, out = np.uint64(PRIME), []
    for k in range(2 * LANES):
        salt = np.array([seed * 64 + k + 1], np.uint64)
        out.append(mixed(content[:, 0] ^ mixed(content[:, 1] + mixed(salt))))
    a = np.stack([x % (p - np.uint64(1)) + np.uint64(1) for x in out[:LANES]], axis=1)
    return a, np.stack([x % p for x in out[LANES:]], axis=1)


def after(a, b, then_a, then_b):
    """The map (a, b) and the other one after it."""
    p = np.uint64(PRIME)
    return then_a * a % p, (then_a * b + then_b) % p


def scanned(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of each row with all before it back to row ``first``, its segment's beginning."""
    a, b, step, place = a.copy(), b.copy(), 1, np.arange(len(a)) - first
    while len(place) and step <= place.max():
        at = np.flatnonzero(place >= step)
        a[at], b[at] = after(a[at - step], b[at - step], a[at], b[at])
        step *= 2
    return a, b


def inverse(a: np.ndarray) -> np.ndarray:
    p, out, power, n = np.uint64(PRIME), np.ones_like(a), a, PRIME - 2
    while n:
        if n & 1:
            out = out * power % p
        power, n = power * power % p, n >> 1
    return out


def _columns(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    return [pa.array(x.astype(np.int64)) for x in (*a.T, *b.T)]


def _lanes(batch, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack([batch.column(prefix + c).to_numpy(zero_copy_only=False).astype(np.uint64) for c in names], axis=1) for names in (_A, _B))


def _scan(seed: int):
    """Rows sorted by conversation and place: place in the block, content, composed maps."""

    def scan(batches):
        block, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            content = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(-1, 4)[:, :2]
            start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            first = np.repeat(start, np.diff(np.append(start, len(conv))))
            a, b = scanned(first, *maps(content, seed))
            place = np.arange(len(conv)) - first + 1
            if last is not None and last[0] == conv[0]:
                own = first == 0
                place[own] += last[1]
                a[own], b[own] = after(last[2], last[3], a[own], b[own])
            last = conv[-1], place[-1], a[-1], b[-1]
            number = content.astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(conv), block, np.int32)), pa.array(place), batch.column("n_bytes"), pa.array(number[:, 0].copy()), pa.array(number[:, 1].copy()), *_columns(a, b)], names=["conv_id", "block", "pos", "n_bytes", "m1", "m2", *_A, *_B])

    return scan


def _carry(batches):
    """For each block of a conversation that has several: turns of the earlier ones and their composition."""
    for batch in batches:
        rows = []
        for conv, blocks in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist()):
            n, a, b = 0, [1] * LANES, [0] * LANES
            for x in blocks:
                rows.append((conv, x["block"], n, *a, *b))
                n += x["pos"]
                b = [(x[i] * v + x[j]) % PRIME for i, j, v in zip(_A, _B, b)]
                a = [x[i] * v % PRIME for i, v in zip(_A, a)]
        names = ["conv_id", "block", "before", *(f"c_{c}" for c in (*_A, *_B))]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * (1 + 2 * LANES)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _joint(batches):
    """The map that stands for a rebuilt conversation's head in front of its own maps."""
    for batch in batches:
        (base_a, base_b), (own_a, own_b) = _lanes(batch, "base_"), _lanes(batch, "own_")
        back = inverse(own_a)
        a = back * base_a % np.uint64(PRIME)
        b = back * ((base_b + np.uint64(PRIME) - own_b) % np.uint64(PRIME)) % np.uint64(PRIME)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("c", "h", "head")), *_columns(a, b)], names=["c", "h", "head", *(f"g_{c}" for c in (*_A, *_B))])


def _packs(batches):
    """Sorted (node, depth, c): ids of a node joined to strings of at most IDS ids."""
    for batch in batches:
        node, depth, c = (batch.column(n).to_numpy() for n in ("node", "depth", "c"))
        at = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])) if len(c) else np.empty(0, np.int64)
        at = np.unique(np.concatenate([at, np.arange(0, len(c), IDS)])) if len(c) else at
        joined = [",".join(map(str, c[i:j].tolist())) for i, j in zip(at.tolist(), np.append(at[1:], len(c)).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(depth[at]), pa.array(c[at]), pa.array(joined, pa.string())], names=["node", "depth", "first", "ids"])


def _digests(batches):
    """Sorted packs of ids: the digest of each node's ids."""
    key, digest = None, None
    for batch in batches:
        out = []
        for node, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("node", "depth", "ids"))):
            if (node, depth) == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield _ends(out)
    if key is not None:
        yield _ends([(*key, digest.hexdigest())])


def _ends(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "ends_sha256"])


def _composed(first: str, then: str) -> tuple[list[Column], list[Column]]:
    a = [(F.col(then + x) * F.col(first + x)) % PRIME for x in _A]
    return a, [(F.col(then + x) * F.col(first + y) + F.col(then + y)) % PRIME for x, y in zip(_A, _B)]


def _fingerprint(b: list[Column]) -> list[Column]:
    return [(b[0] * (PRIME + 1) + b[1]).alias("f1"), (b[2] * (PRIME + 1) + b[3]).alias("f2")]


def _identity(columns, prefix: str) -> list[Column]:
    return [F.coalesce(c, F.lit(1 if n in _A else 0)).cast("long").alias(prefix + n) for n, c in columns.items()]


def prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """conv_id, pos (from 1), n_bytes, content m1 and m2, and the map of the first ``pos`` turns."""
    ordered = turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    rows = kept(ordered.select("conv_id", "digest", "n_bytes").mapInArrow(_scan(seed), f"conv_id long, block int, pos long, n_bytes long, m1 long, m2 long, {_MAP}"), "turns")
    blocks = rows.groupBy("conv_id", "block").agg(F.max_by(F.struct("pos", *_A, *_B), "pos").alias("x")).select("conv_id", "block", "x.*")
    # as many blocks of a conversation as there are partitions, at most
    several = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "pos", *_A, *_B))).alias("blocks")).where(F.size("blocks") > 1)
    carried = several.mapInArrow(_carry, "conv_id long, block int, before long, " + ", ".join(f"c_{c} long" for c in (*_A, *_B)))
    met = rows.join(carried, ["conv_id", "block"], "left")
    met = met.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "n_bytes", "m1", "m2", *_A, *_B, *_identity({c: F.col(f"c_{c}") for c in (*_A, *_B)}, "c_"))
    a, b = _composed("c_", "")
    return kept(met.select("conv_id", "pos", "n_bytes", "m1", "m2", *(x.alias(n) for x, n in zip((*a, *b), (*_A, *_B)))), "prefixes")


def members(found: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(rebuilt conversations: c, total turns; their prefixes: c, depth, fingerprint f1 and f2, n_bytes and content of
    the last turn). ``base`` and ``head`` are functions of the column c."""
    lengths = found.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = kept(lengths.select(F.col("conv_id").alias("c"), "n").withColumns({"base": base.cast("long"), "h": head.cast("long")}), "conversations")
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    totals = kept(convs.select("c", "base", "n", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")), "rebuilt")

    ends = found.select("conv_id", "pos", *_A, *_B)
    at_head = ends.select(F.col("conv_id").alias("base"), F.col("pos").alias("head"), *(F.col(c).alias(f"base_{c}") for c in (*_A, *_B)))
    at_own = ends.select(F.col("conv_id").alias("c"), F.col("pos").alias("h"), *(F.col(c).alias(f"own_{c}") for c in (*_A, *_B)))
    joined = totals.where("n > h").join(at_head, ["base", "head"], "left").join(at_own, ["c", "h"], "left")
    joined = joined.select("c", "h", "head", *(x for side in ("base_", "own_") for x in _identity({c: F.col(side + c) for c in (*_A, *_B)}, side)))
    joint = joined.mapInArrow(_joint, "c long, h long, head long, " + ", ".join(f"g_{c} long" for c in (*_A, *_B)))
    own = found.join(joint, found["conv_id"] == joint["c"]).where("pos > h")
    own = own.select("c", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), *_fingerprint(_composed("g_", "")[1]), "n_bytes", "m1", "m2")
    heads = found.join(totals.select("c", "base", "head").where("head > 0"), F.col("conv_id") == F.col("base")).where("pos <= head")
    heads = heads.select("c", F.col("pos").alias("depth"), *_fingerprint([F.col(b) for b in _B]), "n_bytes", "m1", "m2")
    return totals.select("c", "total"), own.unionByName(heads)


def prefix_trie(conversations: DataFrame, base: Column, head: Column, seed: int = 0) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``base`` and ``head``, of the column c, say which conversation gives the head of conversation c and how many turns: those of
    the base as stored (all if it has fewer, none if it has no rows), then c's own turns after its first ``head``.
    Turns are ordered by turn, null first; rows of one turn by the SHA-256 of their content, so that identical rows are
    turns like others and reruns agree. Null role and text are empty; a row of a null conv_id belongs to no conversation.
    An empty table has no node, not even a root. Texts count by their bytes, whatever their length. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).where("conv_id IS NOT NULL")
    while True:
        rebuilt, rows = members(prefixes(turns, seed), base, head)
        rows = kept(rows, "members")
        groups = rows.groupBy("depth", "f1", "f2").agg(F.min("c").alias("node"), F.count("*").alias("n_convs"), *(f(m).alias(f"{n}_{m}") for m in ("m1", "m2") for n, f in (("least", F.min), ("most", F.max))))
        groups = kept(groups, "groups")
        if groups.where("least_m1 != most_m1 OR least_m2 != most_m2").isEmpty():
            break
        seed += 1
    placed = kept(rows.join(groups.select("depth", "f1", "f2", "node", "n_convs"), ["depth", "f1", "f2"]).select("c", "depth", "node", "n_convs", "n_bytes"), "placed")
    owned = placed.where("c = node").select("node", "depth", "n_convs", "n_bytes")
    above = placed.select(F.col("c").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    root, n_convs = rebuilt.agg(F.min("c"), F.count("*")).first()
    top_node = F.lit(root).cast("long")
    nodes = kept(owned.join(above, ["node", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, top_node).otherwise(F.col("parent"))), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = kept(nodes.select("node", "depth", "parent", "n_convs", (F.col("n_bytes") * (F.col("n_convs") - 1)).alias("saved")).join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "family")

    # what each member owns from a depth down: inside a stretch of depths, and of the stretches below
    value = nodes.select(F.col("node").alias("c"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    line = placed.select("c", "depth", "node").join(value, ["c", "depth"], "left").withColumns({"stretch": F.expr(f"depth DIV {DEPTHS}"), "leaves": F.coalesce("leaves", F.lit(0)), "saved": F.coalesce("saved", F.lit(0))})
    inside = W.partitionBy("c", "stretch").orderBy(F.desc("depth"))
    stretches = line.groupBy("c", "stretch").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = W.partitionBy("c").orderBy(F.desc("stretch")).rowsBetween(W.unboundedPreceding, -1)
    stretches = stretches.select("c", "stretch", F.sum("leaves").over(below).alias("low_leaves"), F.sum("saved").over(below).alias("low_saved")).where("low_leaves IS NOT NULL")
    line = line.select("node", "depth", "c", "stretch", F.sum("leaves").over(inside).alias("leaves"), F.sum("saved").over(inside).alias("saved")).join(stretches, ["c", "stretch"], "left")
    summed = line.groupBy("node", "depth").agg(*(F.sum(F.col(x) + F.coalesce(f"low_{x}", F.lit(0))).alias(f"all_{x}") for x in ("leaves", "saved")))

    last = placed.join(rebuilt, "c").where("depth = total").select("node", "depth", "c")
    last = last.unionByName(rebuilt.where("total = 0").select(top_node.alias("node"), F.lit(0).cast("long").alias("depth"), "c"))
    packs = last.repartitionByRange("node", "depth", "c").sortWithinPartitions("node", "depth", "c").mapInArrow(_packs, "node long, depth long, first long, ids string")
    ends = packs.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_digests, "node long, depth long, ends_sha256 string")

    every = nodes.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("all_saved"), F.coalesce(F.sum((F.col("n_children") == 0).cast("long")), F.lit(0)).alias("all_leaves"), F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"))
    top = every.where(F.lit(n_convs > 0)).select(top_node.alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n_convs).cast("long").alias("n_convs"), "n_children", F.greatest(F.lit(1), "all_leaves").alias("all_leaves"), "all_saved")
    whole = nodes.join(summed, ["node", "depth"]).select(*top.columns).unionByName(top)
    whole = whole.join(ends, ["node", "depth"], "left")
    return whole.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("all_leaves").cast("long").alias("n_leaves"), F.col("all_saved").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
