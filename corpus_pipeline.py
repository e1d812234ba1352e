"""A training corpus from documents: language ID, exact dedup, near-duplicate removal, secret redaction, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all of
docs and returns a DataFrame. All but the last return the columns of documents, so the
output of one, written as Parquet and read again, is the docs of the next. Stages set the
session's bytes per batch that goes to Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.llm.common import Workspace, bounded_batches, load, lower_ascii
from crawlspark.llm.exact_dedup import exact_dedup
from crawlspark.llm.language_id import fit, identify
from crawlspark.llm.ngram_join import similar_components
from crawlspark.llm.packing import pack
from crawlspark.llm.secret_scan import redact_secrets

#: Below every id that documents have.
_NO_ID = -(2**63)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with lang as identified; rejected ones and those without a letter go.

    With no labelled text to learn from, only documents without a letter go, null text among
    them. Ids are not read; rows that repeat are treated alike.
    """
    bounded_batches(spark)
    model = fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = identify(docs, model, prefix).where(~F.col(f"{prefix}rejected")).withColumn("lang", F.col(f"{prefix}lang_pred"))
    return found.select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z and a-z alike, null as empty): the one with the largest doc_id.

    A null id ranks below all others. Of rows that share that id, too, the one whose hash is least stays.
    """
    bounded_batches(spark)
    kept = exact_dedup(docs).where("kept").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    # the row is one column, so that no name of docs can clash
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256).alias("sha"))
    one = keyed.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return one.groupBy("id", "sha").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles with a Jaccard of 0.8 or more: the one with the least doc_id.

    One row, too, where ids are null (they rank first) or repeat. Texts without words, null among them, all stay.
    """
    bounded_batches(spark)
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows != ids:  # null or repeated ids: rows get own ones, in the order of id, then hash of the text
        keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text").sort("id", F.sha2(F.coalesce("text", F.lit("")), 256))
        keyed = Workspace(spark, "near-rows").save(keyed.select("row", F.monotonically_increasing_id().alias("id"), "text"), "keyed")
        kept = similar_components(keyed.select(F.col("id").alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
        return keyed.join(kept, F.col("id") == F.col("kept_id"), "left_semi").select("row.*")
    kept = similar_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return keyed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars made to fit; null and empty texts, ids and other columns as they are."""
    bounded_batches(spark)
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens; null and empty texts are one token, rows with null or repeated ids stand for themselves."""
    import public_tokenizers

    bounded_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The languages, sets of near duplicates and tokens are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written and read again."""
    work = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
