"""Corpus pipeline: drop toxic documents, near-duplicates and benchmark leaks, mask personal data, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored as Parquet and reread as the next one's
docs. All but the last return the columns of documents. Rows with null or empty texts pass through every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, small, stored
from tessera.llm.decontaminate import without_contamination
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.pii import redact
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.toxicity import score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated toxicity score under 0.5."""
    scored = score(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more: the first by id and text.

    Rows go by id and text, so rows of different texts under one id are judged one by one; of rows equal in both one
    stays. Rows with a null id, and rows without words, are no copies of anything and stay.
    """
    key = ["doc_id", "ka", "kb"]
    found = near_duplicates(docs, k=5, percent=80, with_keys=True)
    gone = stored(found.filter("not is_first").select(*key).distinct(), "duplicates")
    repeated = stored(found.filter("is_first and doc_id is not null and n_shingles > 0").groupBy(*key).count().filter("count > 1").select(*key), "repeated")
    rows = pick(docs, *COLUMNS).withColumns({"ka": F.xxhash64("text"), "kb": F.xxhash64(F.lit(7), "text")})
    rows = rows.join(small(gone, gone.count()), key, "left_anti")
    if n := repeated.count():
        again = small(repeated, n)
        rows = rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(key))
    return rows.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return without_contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows. Null texts stay null."""
    rows = redact(pick(docs, *COLUMNS).withColumn("n_chars", F.struct("n_chars", F.col("text").isNull().alias("none"))), *COLUMNS)
    text = F.when(F.col("n_chars.none"), F.lit(None).cast("string")).otherwise(F.col("text"))
    n = F.when(F.col("n_chars.none"), F.col("n_chars.n_chars")).otherwise(F.char_length("text").cast("long"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", n.cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path(), special_tokens=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("packing", packing)]

#: Classifier, signatures and tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
