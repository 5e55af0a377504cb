"""A cleaning pipeline over documents: each stage's rows are written as Parquet and are the next one's documents.

toxicity rejects documents, near_dedup keeps one of each class, secrets replaces what it finds, mixing repeats or thins
sources to target weights, packing lays the rest out in sequences of tokens.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import mixing, near_dedup, packing, secrets, toxicity
from barline.llm.common import kept, releasing, text_slices

#: No stage but the reading of tables has a form in SQL; see tests/llm for the brute-force versions.
ORACLE_SQL = None
TOXIC = 0.7
#: Bytes of text that a task cuts at once; sets no result.
SLICE = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the network learns from the labels of these documents."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net, out="__toxicity").where(F.col("__toxicity") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each class of near duplicates; of rows equal in id and text the one whose
    columns have the least hash."""
    heads = near_dedup.near_duplicates(docs).where("keeper").select(F.col("row_key").alias("__head")).distinct()
    named = docs.withColumn("__key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    kept_ = named.join(heads, F.col("__key") == F.col("__head"), "left_semi")
    return kept_.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs, kept(secrets.scan(docs), "findings"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document: its whole text, or in a last pass the blocks taken."""
    documents, draws = mixing.mix(docs)
    passes = draws.groupBy("row_key", "i", "copy", "pass").agg(F.sum("words").alias("w"), F.sort_array(F.collect_list(F.struct("block", "words"))).alias("blocks"))
    sizes = documents.select("row_key", "i", "copy", "size", "source")
    part = F.when(F.col("w") < F.col("size"), F.col("blocks"))
    chosen = passes.join(sizes, ["row_key", "i", "copy"]).select(F.col("row_key").alias("__chosen"), F.col("source").alias("__source"), part.alias("__blocks"))
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text")).dropDuplicates(["__key", "source"])
    met = rows.join(chosen, (F.col("__key") == F.col("__chosen")) & F.col("source").eqNullSafe(F.col("__source"))).select(*docs.columns, "__blocks")

    columns, size = docs.columns, mixing.BLOCK_WORDS

    def cut(batches):
        for b in (part for batch in batches for part in text_slices(batch, SLICE)):
            texts = []
            for t, blocks in zip(b.column("text").to_pylist(), b.column("__blocks").to_pylist()):
                if blocks is None:
                    texts.append(t)
                else:
                    words = t.encode().split()  # at the white space of common.WORD
                    texts.append(b" ".join(w for k in blocks for w in words[k["block"] * size : k["block"] * size + k["words"]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], names=columns)

    mixed = met.mapInArrow(releasing(cut), docs.schema)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of the mix."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_tokens=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
