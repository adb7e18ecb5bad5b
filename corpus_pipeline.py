"""A corpus from raw documents: quality, lines, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kindred.llm.bpe import FILE, tokenize
from kindred.llm.common import table, text_key
from kindred.llm.lines import dedup_lines
from kindred.llm.mixing import mix, place_key
from kindred.llm.neardup import near_duplicates
from kindred.llm.quality import learn, score
from kindred.session import pin

#: Words that `tokens` looks up instead of folding: half of what the operator alone takes, as the table also
#: passes through the driver, which the earlier stages have used before. Rows do not depend on it.
FREQUENT = 1 << 17
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier calls good."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; a document that loses all its lines goes."""
    kept = dedup_lines(docs.select(*COLUMNS)).where("n_removed = 0 or trim(kept_text) <> ''")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least doc_id.

    Of rows with that doc_id and the same text one stays; documents without words stay.
    """
    found = near_duplicates(docs)
    first = found.where("doc_id <=> class_id").groupBy("doc_id", F.coalesce("copy_class", "key")).agg(F.min("key").alias("key"))
    kept = docs.select(*COLUMNS).withColumn("key", text_key())
    same = (kept["doc_id"].eqNullSafe(first["doc_id"])) & (kept["key"] == first["key"])
    return kept.join(first.select("doc_id", "key"), same, "left_semi").dropDuplicates(["doc_id", "key"]).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    keyed = docs.select(*COLUMNS).withColumn("key", place_key())
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    # Rows alike in doc_id, text and source share a key; what the mix takes of them is dealt out in turn.
    taken = mix(docs.select(*COLUMNS)).select("key", source.alias("name"), "repeats")
    taken = taken.groupBy("key", "name").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("rows")).where("repeats > 0")
    left = keyed.withColumn("name", source)
    nth = F.row_number().over(Window.partitionBy("key", "name").orderBy("key"))
    joined = left.withColumn("nth", nth).join(taken, ["key", "name"])
    own = F.floor(F.col("repeats") / F.col("rows")) + F.when(F.col("nth") <= F.col("repeats") % F.col("rows"), 1).otherwise(0)
    joined = joined.withColumn("own", own.cast("int")).where("own > 0")
    return joined.withColumn("turn", F.explode(F.sequence(F.lit(1), "own"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number and digest of the token ids, digest of the decoded bytes."""
    done = tokenize(docs.select("doc_id", "source", "text"), public_tokenizers.path(FILE), FREQUENT)
    return done.select(
        "doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: the classifier and the tokens have none. A brute-force test of the whole chain is missing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = pin(docs)
    return docs
