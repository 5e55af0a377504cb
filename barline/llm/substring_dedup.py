"""Removal of passages that occur more than once, by automata of repeated phrases.

1. Every window of ``width`` consecutive words is hashed; the corpus counts all windows exactly
   (:mod:`counts`), so a chunk of documents learns which of its windows recur anywhere.
2. Runs of recurring windows are confirmed passages. Each chunk compiles the passages it met into
   its own Aho-Corasick automaton, a shard of the corpus's dictionary: the words of a passage that is
   not in a chunk need no place in its automaton.
3. All documents of the chunk are streamed through the automaton, which locates every occurrence;
   covered words go.

Windows are compared by 64-bit hashes of their word sequences.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts as C
from .common import Rolling, chunked, ident, parts_for, texts, window_starts, word_hashes

#: Symbols of an automaton: a word is four letters of six bits, each place with letters of its own.
PLACES = np.array([0x100, 0x140, 0x180, 0x1C0], np.uint32)
SPAN = 64
#: Characters of a word, roughly; sets the size of buckets, no result.
WORD_CHARS = 6


def _words(table: pa.Table, width: int):
    """(words by document, numbers of all words, lengths, window starts, their documents, hashes)."""
    seen: dict[bytes, int] = {}
    words = [t.encode().split() for t in table["text"].to_pylist()]
    lengths = np.array([len(w) for w in words], np.int64)
    numbers = np.fromiter((i for w in words for i in ident(w, seen)), np.int64, int(lengths.sum()))
    starts, doc = window_starts(lengths, width)
    hashes = Rolling(word_hashes(seen)[numbers]).runs(starts, width) if len(starts) else np.empty(0, np.uint64)
    return words, numbers, lengths, starts, doc, hashes


def _letters(numbers: np.ndarray) -> str:
    n = numbers.astype(np.uint32)[:, None]
    spread = (n >> np.array([0, 6, 12, 18], np.uint32)) & np.uint32(63)
    return (spread + PLACES).astype("<u4").tobytes().decode("utf-32-le")


def _runs(flags: np.ndarray, starts: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(first word, word after the last) of each longest run of flagged windows of one document."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(starts[at]) != 1) | (np.diff(doc[at]) != 0))
    first = np.concatenate([[0], cut + 1])
    last = np.concatenate([cut, [len(at) - 1]])
    return list(zip(starts[at[first]].tolist(), (starts[at[last]] + width).tolist()))


def _automaton(runs: list[tuple[int, int]], numbers: np.ndarray, width: int):
    """Passages as overlapping pieces of at most SPAN words, any ``width`` of them inside one piece."""
    span, stride = max(SPAN, 2 * width), max(1, max(SPAN, 2 * width) - width + 1)
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    done = set()
    for a, b in runs:
        starts = {*range(a, max(a, b - span) + 1, stride), max(a, b - span)}
        for s in starts:
            piece = numbers[s : min(b, s + span)]
            if (key := piece.tobytes()) not in done:
                done.add(key)
                found.add_word(_letters(piece))
    if done:
        found.make_automaton()
    return found if done else None


def covered(numbers: np.ndarray, lengths: np.ndarray, runs: list[tuple[int, int]], width: int) -> np.ndarray:
    """True for each word that lies in an occurrence of a passage; every document is streamed."""
    size = len(numbers)
    out = np.zeros(size + 1, np.int64)
    found = _automaton(runs, numbers, width)
    if found is None:
        return np.zeros(size, bool)
    in_passage = np.zeros(int(numbers.max()) + 1, bool)
    for a, b in runs:
        in_passage[numbers[a:b]] = True
    known = np.zeros(size + 2, bool)
    known[1:-1] = in_passage[numbers]
    # a document's stretches of words that occur in passages at all; an occurrence crosses no other word
    edge = np.zeros(size + 1, bool)
    edge[np.cumsum(lengths)] = True
    edge[0] = True
    open_ = np.flatnonzero(known[1:-1] & (~known[:-2] | edge[:-1]))
    close = np.flatnonzero(known[1:-1] & (~known[2:] | edge[1:])) + 1
    for a, b in zip(open_.tolist(), close.tolist()):
        if b - a >= width:
            for end, n in found.iter(_letters(numbers[a:b])):
                stop = a + (end + 1) // 4
                out[stop - n // 4] += 1
                out[stop] -= 1
    return np.cumsum(out[:-1]) > 0


def _send(buckets: int, width: int):
    def send(table: pa.Table) -> pa.Table:
        *_, hashes = _words(table, width)
        items, own = np.unique(hashes, return_counts=True)
        return C.packs(table["chunk"][0].as_py(), items, own, buckets, 64)

    return send


def _clean(width: int, with_text: bool):
    def clean(docs: pa.Table, replies: pa.Table) -> pa.Table:
        words, numbers, lengths, starts, doc, hashes = _words(docs, width) if docs.num_rows else ([], *[np.empty(0, np.int64)] * 4, np.empty(0, np.uint64))
        again = C.totals(replies, hashes) > 1
        gone = covered(numbers, lengths, _runs(again, starts, doc, width), width)
        removed, digests, kept_texts, at = [], [], [], 0
        for w in words:
            g = gone[at : at + len(w)]
            n = int(g.sum())
            left = b" ".join(w if not n else [x for x, drop in zip(w, g.tolist()) if not drop])
            removed.append(n)
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept_texts.append(left.decode())
            at += len(w)
        columns = {"doc_id": docs["doc_id"], "n_words": pa.array(lengths.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array(kept_texts, pa.string())
        return pa.table(columns)

    return clean


def dedup_passages(docs: DataFrame, width: int = 35, with_text: bool = True, chunk_chars: int = 8_000_000, bucket_items: int = 4_000_000) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text.

    Words are ``common.WORD`` runs, unchanged. A word goes if any window of ``width`` words that covers
    it starts a second time anywhere, in the same document too; windows are judged on the input.
    Null and empty texts have no words and keep none (the digest of the empty string); texts shorter
    than a window are kept whole. Repeated rows are rows like others, so their windows recur. A null
    doc_id stays null. Very long texts are read whole, as a chunk of their own size. Other columns are ignored. An empty table gives an empty result.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = chunked(texts(docs), chunk_chars)
    buckets = parts_for(rows.agg(F.sum(F.length("text"))).first()[0], bucket_items * WORD_CHARS)
    packed = rows.groupBy("chunk").applyInArrow(_send(buckets, width), C.PACKS)
    replies = C.answers(packed)
    schema = f"doc_id {key}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_clean(width, with_text), schema)
