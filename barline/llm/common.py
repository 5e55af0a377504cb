"""What several operators share: input columns, intermediate tables, words and their hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: A word: the longest run of anything but the space and the five ASCII white space controls.
WORD = r"[^\x20\x09-\x0D]+"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: lineage ends here."""
    return stored(df, label)[0]


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """:func:`kept`, and where: several tables are read as one by their paths."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, what a job shuffled is deleted as the job ends, not when the driver happens to collect its garbage.

    For jobs that write their rows (:func:`kept`) and are not run again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give memory that a Python worker doesn't use back to the system: idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def releasing(work):
    """``work`` on batches of a task, after which the worker's memory is released."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def text_slices(batch: pa.RecordBatch, size: int, column: str = "text", length=pc.binary_length):
    """Consecutive rows of a batch, of ``size`` bytes (by ``length``) of text together or of one row: what becomes Python's objects at once."""
    lengths = pc.fill_null(length(batch.column(column)), 0)
    ends, at = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def texts(df: DataFrame, *columns: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the named columns and the text (null: empty), whatever else the table holds."""
    return df.select(F.col(key).alias("doc_id"), *columns, F.coalesce(F.col(text), F.lit("")).alias("text"))


def n_words(c: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(total: int | None, size: int) -> int:
    """How many parts of about ``size`` a whole of ``total`` makes; grows in proportion, 1 at least."""
    return max(1, -(-int(total or 0) // size))


def chunked(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """(chunk, doc_id, text): rows dealt to chunks of about ``chunk_chars`` characters.

    The chunk is a function of the row alone, so a recomputed task finds the same rows in it.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    n = parts_for(chars, chunk_chars)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(chunk.alias("chunk"), "doc_id", "text")


def ident(words: list[bytes], seen: dict[bytes, int]) -> list[int]:
    """Dense numbers of words, extending ``seen``."""
    put = seen.setdefault
    return [put(w, len(seen)) for w in words]


def word_hashes(seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hash of each word of ``seen``, by its number."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in seen), np.uint64, len(seen))


#: Bytes of text that are hashed at once: the working arrays take some 30 times as much.
HASHED = 1 << 18


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of the texts, in order; words per text), without a step per word.

    A word's hash adds up a random value for each byte at its place in the word. Whole texts are taken together up to HASHED bytes.
    """
    found, a, size = [], 0, 0
    for b, t in enumerate(texts, 1):
        size += len(t) + 1
        if size >= HASHED or b == len(texts):
            found.append(_hashed(texts[a:b]))
            a, size = b, 0
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, many = zip(*found)
    return np.concatenate(hashes), np.concatenate(many)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    blob = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = (blob != 32) & ((blob - np.uint8(9)) > 4)
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = end - start
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    if len(place):
        key = place << 8 | blob[solid]
        value = _BYTES[np.minimum(key, len(_BYTES) - 1)]
        far = np.flatnonzero(key >= len(_BYTES))
        value[far] = mixed(key[far].astype(np.uint64) + np.uint64(BASE))
        hashes = mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64) * np.uint64(BASE))
    else:
        hashes = np.empty(0, np.uint64)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def grouped(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the values, equal ones in any; where a new value begins in that order; the values, distinct and sorted)."""
    order = np.argsort(a)
    ranked = a[order]
    new = np.ones(len(a), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    return order, first, ranked[first]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
#: The values of all bytes at the first places of a word.
_BYTES = mixed(np.arange(32 << 8, dtype=np.uint64) + np.uint64(BASE))


class Rolling:
    """Hashes of all runs of ``n`` consecutive words over one long array of word hashes.

    Prefix sums of h[t] * BASE**t modulo 2**64; a run's value is a difference, moved back to power 0.
    """

    def __init__(self, hashes: np.ndarray):
        size = len(hashes)
        powers = np.ones(size + 1, np.uint64)
        powers[1:] = np.uint64(BASE)
        self.inverse = np.ones(size + 1, np.uint64)
        self.inverse[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(size + 1, np.uint64)
        np.add.accumulate(hashes * powers[:-1], out=self.sums[1:])

    def runs(self, starts: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[starts + n] - self.sums[starts]) * self.inverse[starts])


def window_starts(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat start, document) of every run of ``n`` words inside one document."""
    many = np.maximum(lengths - n + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), many)
    first = np.cumsum(lengths) - lengths
    base = np.cumsum(many) - many
    return first[doc] + (np.arange(len(doc)) - base[doc]), doc
