"""From raw documents to packed sequences: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents. Null texts count as empty, rows
without a doc_id go through like any, repeated rows are documents of their own until the near-duplicate stage keeps one of
them, texts of any length are taken whole, and an empty table gives an empty result; columns beside those of documents go through the filters and have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import materialize, prepare, table
from leafloom.llm.mixing import DOMAIN_WEIGHTS, LANG_WEIGHTS, mix
from leafloom.llm.packing import pack
from leafloom.llm.quality import THRESHOLD, fit_on, score_documents
from leafloom.llm.shingle_join import keep_one_alike
from leafloom.llm.suffix_dedup import suffix_array_dedup

#: The mix takes this share of the tokens that reach it, in one epoch, so that no document is used twice.
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 1, "pipeline-1"


def _apart(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text): the columns of docs but the text wait in a struct, where no operator's own columns can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), "doc_id", "text")


def _back(out: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return out.select(*[new.get(c, F.col("_row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at the threshold or above."""
    prepare(spark)
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    return _back(score_documents(_apart(docs), model, keep_from=THRESHOLD), docs, text=F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word Jaccard similarity 0.8 or more hold together: SimHash groups first, the rest exactly."""
    return keep_one_alike(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long byte strings that occur elsewhere too; a document that is left empty stays as an empty one."""
    return _back(suffix_array_dedup(_apart(docs), as_text=True), docs, text=F.col("kept"), n_chars=F.length("kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical budgets take.

    The mix takes rows, and rows with one id, text, language and source are alike to it: where it takes fewer of them than there are, that
    many stay (with the smallest of their further columns).
    """
    keys = ["_id", "_md5", "_lang", "_source"]
    chosen = mix(docs, {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    none, word = F.lit(-(2**63)), lambda c: F.coalesce(F.col(c), F.lit(""))
    named = [F.coalesce(F.col("doc_id").cast("long"), none).alias("_id"), word("lang").alias("_lang"), word("source").alias("_source")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *named, F.md5(word("text")).alias("_md5"))
    taken = chosen.select(*named, F.col("text_md5").alias("_md5"), F.lit(0).alias("_held"), F.lit(1).alias("_taken"))
    counts = keyed.select(*keys, F.lit(1).alias("_held"), F.lit(0).alias("_taken")).unionByName(taken).groupBy(*keys).agg(F.sum("_held").alias("_held"), F.sum("_taken").alias("_taken"))
    counts = materialize(counts.where("_taken > 0"), "mix-taken")
    whole = keyed.join(counts.where("_taken >= _held").select(keys), keys, "left_semi").select("_row")
    some = keyed.join(counts.where("_taken < _held"), keys)  # repeated rows only: one for each group goes into the shuffle from a task
    some = some.groupBy(*keys, "_taken").agg(F.min("_row").alias("_row")).select("_row", F.explode(F.sequence(F.lit(1), F.col("_taken").cast("int")))).select("_row")
    return whole.unionAll(some).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("mixing to target weights", mixing), ("packing", packing)]

#: Tokenizing and fingerprinting are beyond SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k + 1}")
    return docs
