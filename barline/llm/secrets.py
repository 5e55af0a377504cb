"""Secret scan: candidates by patterns, false positives removed by a random forest. DataFrame operations only.

A candidate is a quoted value of 8 characters and more after an assignment, whole up to its closing quote, an
issued token with all its dotted segments, a form in which providers issue keys, an unquoted value of 8 characters and
more assigned to a credential's name, or a run of at least 16 base64 characters that holds a digit. Its features are its length, the shares and transitions of its character classes, how
much of it common letter groups cover, whether it stands in a path, and the words next to it. A forest fitted
on labelled findings gives the probability of a secret.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kept

# Forms in which providers issue keys, words that stand by secrets, by stand-ins, by digests; common English letter groups.
ISSUED = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9\-]{10}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{17})"
CREDENTIAL = "token|secret|passw|pwd|api.?key|apikey|access.?key|auth|credential|private|bearer|signature"

RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
#: Up to the quote that opened it, whatever its length.
QUOTED = "|".join(rf"(?<=[=:][ \t]{{0,1}}{q})[^\s{q}]{{8,}}+(?={q})" for q in "\"'`")
#: A token of dotted segments.
DOTTED = r"(?<![A-Za-z0-9+/_\-])eyJ[A-Za-z0-9_\-]{13,}+(?:\.[A-Za-z0-9_\-]++)++"
#: Forms of issued keys, with or without a digit.
KEY = rf"(?<![A-Za-z0-9+/_\-]){ISSUED[1:]}[A-Za-z0-9+/_\-]*+={{0,2}}"
#: Values assigned to a credential's name, in the query of a URL up to the next part, elsewhere up to white space; what
#: the lookbehinds see is part of the left neighbour.
NAME = rf"(?i:{CREDENTIAL.replace('.?', '[_.-]?')})\w{{0,64}}"
QUERY = rf"""(?<==)(?<=[?&]\w{{0,6}}{NAME}=)[^\s&#"'`]{{8,}}+"""
ASSIGNED = rf"""(?<=[=:>][ \t]{{0,3}})(?<={NAME}["'`]?[ \t]{{0,3}}(?:=>|:=|=|:)[ \t]{{0,3}})(?!["'`=:>])(?:[^\s"'`,;]|["'`,;](?=[^\s"'`,;])){{8,}}+"""
#: left neighbour, separator, value
CANDIDATE = rf"""([^\s"'`=:;,|]{{0,40}})(["'`]?[ \t]{{0,3}}(?:=>|:=|=|:)?[ \t]{{0,3}}["'`]?)({QUOTED}|{DOTTED}|{KEY}|{QUERY}|{ASSIGNED}|{RUN})"""
#: Holds in every text that holds a candidate, and is quicker.
HINT = "|".join([RUN, DOTTED, KEY, rf"""{NAME}["'`]?[ \t]{{0,3}}(?:=>|:=|=|:)[ \t]{{0,3}}[^\s"'`]\S{{7}}""", *(rf"[=:][ \t]{{0,1}}{q}[^\s{q}]{{8,}}+{q}" for q in "\"'`")])
#: Of the labelled findings, so many at most train the forest, least hash first.
TRAIN_FINDINGS, TREES, DEPTH = 20_000, 20, 6
NEAR = 60

STAND_IN = "example|sample|dummy|placeholder|changeme|your|test|fake|xxxx|redacted"
DIGEST = "sha1|sha256|md5|commit|checksum|digest|integrity|etag|uuid|guid|revision|isbn|phone|card|order"
GROUPS = "the|and|ing|ion|ent|for|tha|ter|est|ers|ati|hat|ate|all|her|his|ver|tio|com|www|http|html|index|page|file|image|user|name|data|test|key|id"


def _share(v: Column, pattern: str) -> Column:
    return F.regexp_count(v, F.lit(pattern)) / F.length(v)


def features() -> dict[str, Column]:
    v, left = F.col("value"), F.lower(F.concat_ws(" ", "before", "key"))
    last, next_ = F.regexp_extract("before", r"(\S*)\s*$", 1), F.regexp_extract("after", r"^\W*(\S*)", 1)
    near = F.lower(F.concat_ws(" ", last, "key", next_))
    letters = F.regexp_replace(F.lower(v), "[^a-z]", "")
    return {
        "size": F.length(v),
        "digits": _share(v, "[0-9]"),
        "uppers": _share(v, "[A-Z]"),
        "lowers": _share(v, "[a-z]"),
        "others": _share(v, "[^A-Za-z0-9]"),
        "turns": _share(v, "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "variety": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "hexadecimal": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "numeric": v.rlike("^[0-9_\\-]+$").cast("int"),
        "vowels": F.when(F.length(letters) > 0, _share(letters, "[aeiou]")).otherwise(0.0),
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), GROUPS, "")) / F.length(v),
        "path": (v.contains("/") | F.col("before").rlike("(?:://|/)\\S*$") | F.col("after").rlike("^\\.[a-z]{2,4}\\b")).cast("int"),
        "assigned": F.col("separator").rlike("[=:]").cast("int"),
        "quoted": F.col("separator").rlike("[\"'`]$").cast("int"),
        "credential": left.rlike(rf"(?:{CREDENTIAL})\w*\W*$").cast("int"),
        "issued": v.rlike(ISSUED).cast("int"),
        "stand_in": (near.rlike(rf"(?<![\w.@])(?:{STAND_IN})(?![\w.@])") | F.lower(v).rlike(STAND_IN)).cast("int"),
        "digest": left.rlike(rf"\b(?:{DIGEST})\b").cast("int"),
        "prose": (F.col("separator").rlike(r"[:=]\s+$") & v.rlike(r"^[\p{L}'().!?\-]+$")).cast("int"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, start (from 1), length, key, value and the features of every candidate of the whole texts."""
    text = F.col("text")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").where(text.rlike(HINT)).dropDuplicates(["row_key"])
    cut = rows.select("doc_id", "row_key", F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    one = F.transform(
        F.sequence(F.lit(0), F.size("found") - 1),
        lambda i: F.struct(
            F.get("found", i).alias("all"),
            F.length(F.get("gaps", i)).alias("gap"),
            F.right(F.get("gaps", i), F.lit(NEAR)).alias("before"),
            F.left(F.get("gaps", i + 1), F.lit(NEAR)).alias("after"),
        ),
    )
    each = cut.where(F.size("found") > 0).select("doc_id", "row_key", F.posexplode(one).alias("at", "m")).select("doc_id", "row_key", "at", "m.*")
    # a quoted value ends before its quote, which is the character after the match
    whole = F.concat(F.col("all"), F.left("after", F.lit(1)))
    each = each.withColumns({n: F.regexp_extract(whole, CANDIDATE, g) for n, g in (("key", 1), ("separator", 2), ("value", 3))})
    upto = W.partitionBy("row_key").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("all")).over(upto)
    placed = each.withColumn("start", (end - F.length("value") + 1).cast("long")).withColumn("length", F.length("value").cast("long"))
    return placed.withColumns({n: c.cast("double") for n, c in features().items()}).drop("all", "gap", "at")


FEATURES = ["size", "digits", "uppers", "lowers", "others", "turns", "variety", "hexadecimal", "numeric", "vowels", "covered", "path", "assigned", "quoted", "credential", "issued", "stand_in", "digest", "prose"]


def weak_labels(found: DataFrame) -> DataFrame:
    """``label`` by rule, for corpora without reviewed findings: 1 for a form that providers issue and for a varied value assigned to a
    credential's name that isn't an unquoted word of a sentence, 0 for such a word and what no such name precedes and is assigned to nothing, or is a number, digest, stand-in or path; others are left out."""
    named = (F.col("credential") == 1) & (F.col("assigned") == 1)
    issued = F.col("issued") == 1
    sure = issued | named & (F.col("numeric") == 0) & (F.col("stand_in") == 0) & (F.col("prose") == 0) & (F.col("variety") * F.col("size") >= 6)
    not_so = ~issued & (F.col("credential") == 0) & ((F.col("assigned") == 0) | (F.col("numeric") == 1) | (F.col("digest") == 1) | (F.col("stand_in") == 1) | (F.col("path") == 1))
    return found.withColumn("label", F.when(sure, 1.0).when(not_so | (named & ((F.col("stand_in") == 1) | (F.col("prose") == 1))), 0.0)).where("label IS NOT NULL")


def fit(labelled: DataFrame, seed: int = 3):
    """A forest from findings with ``label``; None if they hold fewer than two labels."""
    order = F.xxhash64("row_key", "start")
    bounded = labelled.select(*FEATURES, "label", order.alias("h")).orderBy("h", *FEATURES).limit(TRAIN_FINDINGS)
    packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(bounded.coalesce(1)).select("features", "label").persist()
    try:
        if packed.select("label").distinct().count() < 2:
            return None
        return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=2).fit(packed)
    finally:
        packed.unpersist()


def score(found: DataFrame, forest) -> DataFrame:
    """``found`` with ``score``, the probability of a secret. Without a forest every candidate counts as one."""
    if forest is None:
        return found.withColumn("score", F.lit(1.0))
    held = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    return forest.transform(held).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, row_key, start, length, key, value, score of every finding, ``score`` at least ``threshold``.

    ``labelled`` holds findings (as :func:`candidates` gives them) with ``label``; without it :func:`weak_labels`
    provides them. ``start`` counts characters from 1. Null and empty texts have no findings; a text that occurs in
    several rows of equal doc_id is scanned once (row_key, of id and text, names them all); a null doc_id stays null. Very long
    texts are read whole; of candidates that overlap the first counts. An empty table gives no findings; other columns, whatever
    their names, are ignored. Values have eight characters at least; a credential's name may go on for 64 characters.
    """
    found = kept(candidates(docs), "candidates")  # read for fitting and for scoring
    forest = fit(weak_labels(found) if labelled is None else labelled)
    return score(found, forest).where(F.col("score") >= threshold).select("doc_id", "row_key", "start", "length", "key", "value", "score")


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; n_chars, where there, is that of the new text."""
    spans = findings.groupBy(F.col("row_key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    joined = docs.withColumn("__row", F.xxhash64("doc_id", "text")).join(spans, F.col("__row") == F.col("__key"), "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(1).cast("long").alias("at"))
    made = F.aggregate(
        "__spans",
        begin,
        lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"], s["start"] - a["at"]), F.lit(mark)).alias("out"), (s["start"] + s["length"]).alias("at")),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"], F.length("text"))),
    )
    new = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(made)
    columns = [new.alias("text") if c == "text" else F.when(F.col("__spans").isNull(), F.col(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*columns)
