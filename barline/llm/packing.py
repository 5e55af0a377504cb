"""Packing of tokenised documents into full sequences with the corpus's mixture in each.

1. Documents are tokenised once, cut into blocks of bounded size and written, tokens compressed.
2. Each source is a queue. A block's place in its queue comes from counts of (source, slot) groups
   and a running sum inside a slot, slots being hash ranges of bounded size.
3. The corpus is dealt to parts of about PART tokens. Part s of S takes from a source of T tokens its
   tokens from floor(T s / S) to floor(T (s + 1) / S): every part has the target proportions, and the
   remainder of T s / S is the deficit that the source carries into part s.
4. Inside a part deficit round-robin fills window after window: each window adds every source's share
   of its tokens to that source's credit; the source with the most credit is served, by QUANTUM tokens
   at least, and what is not served is carried on. All windows but a part's last are full.
"""

from __future__ import annotations

import json
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, parts_for, releasing, text_slices, texts

LENGTH, END = 1024, 0
BLOCK, PART, QUANTUM = 1 << 16, 1 << 22, 256
#: Words whose tokens a worker remembers (these stay in its memory from task to task), and blocks of one source in a slot.
REMEMBERED, SLOT = 150_000, 20_000
#: Bytes of text that are cut into words at once.
TEXTS = 500_000
# Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _worker_state() -> types.ModuleType:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_barline_worker", types.ModuleType("_barline_worker"))


def _byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """The tokens of a tokenizers file by rank, if it is a byte-level BPE whose merges make its ids in order; else None.

    Such a file and its ranks encode alike, and encoding by ranks is quicker.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab")
    usual = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
    if not usual or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    letters, extra = _byte_letters(), {t["content"] for t in spec.get("added_tokens", ())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab["".join(p)] for p in pairs]
    if order != sorted(order) or min(order, default=256) < 256 or sorted(i for t, i in vocab.items() if len(t) == 1) != list(range(256)):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in extra}


class Encoder:
    """Token ids as bytes. A space between two other characters begins a token, so the words of a text
    between such spaces are encoded apart, and the tokens of words are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {}
        ranks = ranked(path)
        self.quick = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.quick:
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    @classmethod
    def at(cls, path: str) -> "Encoder":
        state = _worker_state()
        if getattr(state, "path", None) != path:
            state.encoder, state.path = cls(path), path
        return state.encoder

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.quick.encode_ordinary(text) if self.quick else self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, words: list[str]) -> None:
        """Remember the tokens of words, each after a space."""
        if self.quick:
            ids = self.whole(" " + " ".join(words))
            ends = np.cumsum([len(w.encode()) + 1 for w in words])
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * ids.itemsize
            data = ids.tobytes()
            self.known.update(zip(words, (data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()))))
        else:
            found = self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
            self.known.update(zip(words, (np.array(e.ids, self.kind).tobytes() for e in found)))

    def encode(self, batch: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [t.split(" ") for t in batch]
        new = set().union(*(c[1:] for c in cut)).difference(self.known)
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}  # their space is none between two other characters
        if words := list(new - odd):
            self._learn(words)
        out = []
        for t, (head, *rest) in zip(batch, cut):
            if not rest or not head or head[-1].isspace() or (odd and not odd.isdisjoint(rest)):
                out.append(self.whole(t).tobytes())
            else:
                out.append(self.whole(head).tobytes() + b"".join(map(self.known.__getitem__, rest)))
        return out


def _slices(batch: pa.RecordBatch):
    """(doc_ids, sources, texts) of consecutive rows, of TEXTS bytes of text together or of one row: only these become Python's."""
    for part in text_slices(batch, TEXTS):
        yield tuple(part.column(n).to_pylist() for n in ("doc_id", "source", "text"))


def _tokenise(path: str, ids: pa.DataType):
    def run(batches):
        encoder = Encoder.at(path)
        width = np.dtype(encoder.kind).itemsize
        end = np.array([END], encoder.kind).tobytes()
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for keys, sources, found in _slices(b):
                rows = []
                for key, source, tokens in zip(keys, sources, encoder.encode(found)):
                    tokens += end
                    n = len(tokens) // width
                    for k in range(0, n, BLOCK):
                        part = tokens[k * width : (k + BLOCK) * width]
                        rows.append((key, source, k, len(part) // width, n, packer.compress(part)))
                cols = list(zip(*rows))
                kinds = (ids, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "source", "first", "n", "doc_tokens", "tokens"])

    return releasing(run)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, first (tokens of the document before the block), n, doc_tokens, tokens (compressed)."""
    rows = texts(docs, F.col("source").cast("string").alias("source"))
    key = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.mapInArrow(_tokenise(path, to_arrow_type(key)), f"doc_id {key.simpleString()}, source string, first long, n long, doc_tokens long, tokens binary")


def schedule(sizes: list[int], credit: list[float], length: int, quantum: int):
    """(window, queue, amount) in order, until all queues are empty.

    A window adds length * share to each queue's credit and is then filled from the queue of most credit;
    a queue is served its whole credit, ``quantum`` at least, as far as room and queue allow.
    """
    left = np.array(sizes, np.int64)
    total = int(left.sum())
    share = left / max(total, 1)
    credit = np.array(credit, float)
    window = 0
    while total:
        room = min(length, total)
        credit += share * room
        while room:
            i = int(np.argmax(np.where(left > 0, credit, -np.inf)))
            amount = int(min(room, left[i], max(quantum, int(credit[i]))))
            credit[i] -= amount
            left[i] -= amount
            room -= amount
            total -= amount
            yield window, i, amount
        window += 1


def _pack(length: int, quantum: int, kind: str, ids: pa.DataType, with_tokens: bool):
    def pack(table: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        width = np.dtype(kind).itemsize
        order = sorted(range(table.num_rows), key=lambda i, s=table["queue"].to_pylist(), x=table["place"].to_pylist(): (s[i], x[i]))
        rows = table.take(order)
        part = rows["part"][0].as_py()
        queue, skip, take, first, doc_tokens, keys, carried = (rows[n].to_pylist() for n in ("queue", "skip", "take", "first", "doc_tokens", "doc_id", "carried"))
        blobs = rows["tokens"]
        names = sorted(set(queue))
        own = {q: [i for i in range(len(queue)) if queue[i] == q] for q in names}
        at = {q: [0, 0] for q in names}
        current: dict[int, tuple[int, np.ndarray]] = {}
        out: list[tuple] = []
        window, offset = -1, 0
        for w, k, amount in schedule([sum(take[i] for i in own[q]) for q in names], [carried[own[q][0]] for q in names], length, quantum):
            q = names[k]
            if w != window:
                window, offset = w, 0
            while amount:
                place = at[q]
                i = own[q][place[0]]
                if current.get(q, (-1,))[0] != i:
                    current[q] = (i, np.frombuffer(unpacker.decompress(blobs[i].as_py()), kind)[skip[i] : skip[i] + take[i]].astype("<u4"))
                n = min(amount, take[i] - place[1])
                piece = current[q][1][place[1] : place[1] + n].tobytes()
                row = (keys[i], first[i] + skip[i] + place[1], n, zlib.crc32(piece), doc_tokens[i], (part << 24) + window, offset)
                out.append((*row, piece) if with_tokens else row)
                place[1] += n
                offset += n
                amount -= n
                if place[1] == take[i]:
                    at[q] = [place[0] + 1, 0]
        kinds = [ids, *[pa.int64()] * 6, *[pa.binary()] * with_tokens]
        names_ = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_tokens]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names_)

    return pack


def pack(docs: DataFrame, path: str, length: int = LENGTH, part_tokens: int = PART, quantum: int = QUANTUM, with_tokens: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids (uint32 as bytes).

    ``path`` names a tokenizers file. Every document ends with the token END, so null and empty texts have
    one token; special strings in a text are ordinary text. A null source is a queue of its own. Repeated
    rows are packed once each; blocks that tie in id and place lie by their tokens, so what ties is equal and reruns agree.
    Very long texts are cut to blocks of BLOCK tokens. Other columns, whatever their names, are ignored. An empty table gives no pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = docs.schema["doc_id"].dataType
    laid = kept(tokens(docs, path), "tokens")
    many, total = laid.agg(F.count("*"), F.sum("n")).first()
    slots, parts = parts_for(many, SLOT), parts_for(total, part_tokens)
    by_place = W.partitionBy("queue", "slot").orderBy("h", "doc_id", "first").rowsBetween(W.unboundedPreceding, -1)
    blocks = laid.withColumns({"queue": F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), "h": F.xxhash64("doc_id", "first", "tokens"), "slot": F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "first", "tokens"), F.lit(slots))}).drop("source")
    groups = blocks.groupBy("queue", "slot").agg(F.sum("n").alias("n"))
    before = groups.select(
        "queue",
        "slot",
        F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(W.partitionBy("queue")).alias("all"),
    )
    placed = blocks.join(before, ["queue", "slot"]).withColumn("x", F.col("before") + F.coalesce(F.sum("n").over(by_place), F.lit(0)))

    def wide(e: str) -> str:
        return f"CAST({e} AS DECIMAL(38, 0))"

    def part_of(x: str) -> str:  # the last part that begins at x or before
        return f"CAST((({wide(x)} + 1) * {parts} - 1) DIV {wide('all')} AS BIGINT)"

    def begin(s: str) -> str:
        return f"CAST(({wide('all')} * {s}) DIV {parts} AS BIGINT)"

    spread = placed.withColumn("part", F.explode(F.expr(f"sequence({part_of('x')}, {part_of('x + n - 1')})")))
    cut = spread.withColumn("from", F.greatest(F.col("x"), F.expr(begin("part")))).withColumn("to", F.least(F.col("x") + F.col("n"), F.expr(begin("(part + 1)"))))
    segments = cut.where("`to` > `from`").select(
        "part",
        "queue",
        F.col("from").alias("place"),
        (F.col("from") - F.col("x")).alias("skip"),
        (F.col("to") - F.col("from")).alias("take"),
        F.expr(f"CAST(({wide('all')} * part) % {parts} AS DOUBLE) / {parts}").alias("carried"),
        "doc_id",
        "first",
        "doc_tokens",
        "tokens",
    )
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    schema = f"doc_id {key.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_tokens
    return segments.groupBy("part").applyInArrow(_pack(length, quantum, kind, to_arrow_type(key), with_tokens), schema)
