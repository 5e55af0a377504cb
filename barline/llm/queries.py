"""The operators over the driver's tables, and SQL that computes the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept
from . import exact_search, html_extraction, katz, lexical_search, mixing, near_dedup, near_search, packing, prefix_trie, quality, secrets, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_repeated_passages")
def repeated_passages(spark, sf):
    return substring_dedup.dedup_passages(table(spark, sf, "documents"), with_text=False)


@query("op4_near_duplicates")
def near_duplicates(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "n_copies")


@query("op1_toxicity")
def toxicity_scores(spark, sf):
    docs = table(spark, sf, "documents")
    net = toxicity.fit(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_quality")
def quality_scores(spark, sf):
    seen = kept(quality.with_statistics(table(spark, sf, "documents").select("doc_id", "text")), "statistics")
    held = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(seen, table(spark, sf, "labels"), ~held)
    return quality.score(seen, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_mixing")
def mixing_sources(spark, sf):
    documents, draws = mixing.mix(table(spark, sf, "documents"))
    return mixing.taken(documents, draws).select("doc_id", "size", "source_size", "target", "taken", "shard", "position")


@query("op8_packing")
def packing_documents(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_tokens=False)


@query("op7_exact_top_k")
def exact_top_k(spark, sf):
    return exact_search.top_k(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


@query("op9_multi_index")
def multi_index(spark, sf):
    return near_search.nearest_neighbours(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


@query("op6_wrapper_extraction")
def wrapper_extraction(spark, sf):
    return html_extraction.extract(table(spark, sf, "pages"))


@query("op3_secrets")
def secret_findings(spark, sf):
    found = secrets.scan(table(spark, sf, "documents"))
    return found.select("doc_id", "start", "length", "key", F.sha2("value", 256).alias("value_sha256"), "score")


# DuckDB has no crc32: by bytes, from the table that the reflected polynomial gives
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda acc, x: xor(acc >> 8, list_extract({crcs}, (1 + (xor(acc, x) & 255))::BIGINT))))"""
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))) AS crcs)"


@query(
    "op12_prefix_trie",
    f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list(turn ORDER BY pos) AS turns FROM turns GROUP BY conv_id),
hashed AS (SELECT c, turns, {CRC32.format(text="c::VARCHAR", crcs="crcs")} % 9 AS h FROM own, crc),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 5),
rows_ AS (SELECT c, turns, len(turns) AS total, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
prefixes AS (SELECT c, total, depth, sha256(turns[1:depth]::VARCHAR) AS key, strlen(turns[depth].t) AS bytes FROM rows_),
groups AS (SELECT depth, key, min(c) AS node, count(*) AS n_convs, max(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = depth) AS ends FROM prefixes GROUP BY depth, key),
placed AS (SELECT p.c, p.depth, g.node, g.n_convs, g.bytes, g.ends FROM prefixes p JOIN groups g ON p.depth = g.depth AND p.key = g.key),
nodes AS (
  SELECT a.node, a.depth, b.node AS parent, a.n_convs, a.ends, coalesce(a.bytes, 0) * (a.n_convs - 1) AS saved
  FROM placed a LEFT JOIN placed b ON b.c = a.c AND b.depth = a.depth - 1 WHERE a.c = a.node),
family AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n
  LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY ALL) k ON k.parent = n.node AND k.depth = n.depth),
below AS (
  SELECT p.node, p.depth, sum(f.saved) AS saved, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM placed p JOIN family f ON f.node = p.c AND f.depth >= p.depth GROUP BY p.node, p.depth)
SELECT f.node AS conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM family f JOIN below b ON b.node = f.node AND b.depth = f.depth
""",
)
def conversation_trie(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"), F.expr("c - c % 5"), F.crc32(F.col("c").cast("string").cast("binary")) % 9)


@query(
    "op11_lexical_search",
    r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
corpus AS (SELECT count(*) AS n_docs, sum(len(terms))::HUGEINT AS length FROM words WHERE len(terms) > 0),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
bags AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
held AS (SELECT d, doc_id, len(terms) AS n, unnest(terms) AS term FROM words),
tfs AS (SELECT d, doc_id, n, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM bags) GROUP BY d, doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, corpus GROUP BY term, n_docs),
scored AS (
  SELECT b.item_id, t.d, t.doc_id, sum(b.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.n * c.n_docs) // c.length))))::BIGINT AS score
  FROM bags b JOIN tfs t ON t.term = b.term JOIN weights w ON w.term = b.term, corpus c GROUP BY b.item_id, t.d, t.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
""",
)
def ranked_lexical_search(spark, sf):
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_katz")
def katz_scores(spark, sf):
    return katz.scores(table(spark, sf, "documents"), toxicity.held_out(F.col("doc_id"), 7, 2))
