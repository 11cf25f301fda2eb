"""A training corpus from raw documents: stages that each work on all that the one before kept.

toxicity drops what the classifier rejects; near-duplicates keep one document of each class (5-word
shingles, similarity 0.8 or more); substring dedup cuts lines, paragraphs, texts and passages that an earlier
document has and drops documents of which nothing is left; mixing repeats the documents of small sources to
their weights; packing deals the words of every document into sequences. Mixing hands on rows alone: its
permutations say in which order they would be read, and packing makes an order of its own.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each result to the shared folder, reads it again for the next stage, and deletes it
when that is written.

Defined results: rows without doc_id are scored like others, have no class and all go on, and rank last among
repeats of lines; null and empty texts, and those without a word, are in no class and go on to packing, where
they get a place of length 0; of repeated rows one stays; of equal units the document of smallest doc_id keeps
its own; null is a source of its own; other columns of documents, whatever their names, pass all stages but the
last, which does not read them; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelane.llm.common import materialise, release, table
from carelane.llm.jaccard_join import one_of_each_group
from carelane.llm.packing import pack_documents
from carelane.llm.source_mixing import mix
from carelane.llm.substring_dedup import dedup
from carelane.llm.toxicity import train, without_toxic


def _named(docs: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator reads, and all others in a struct ``row``, so that no name clashes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*(others or [F.lit(None).alias("none")])).alias("row"))


def _all(rows: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """The columns that ``_named`` parted, in their old order."""
    return rows.select(*[F.col(c) if c in names else F.col("row")[c].alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return one_of_each_group(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what earlier documents have; n_chars, where there is one, counts what is left."""
    cut = dedup(_named(docs, "doc_id", "text"))
    kept = cut.where("dedup.n_removed = 0 or dedup.n_removed < dedup.n_words")
    if "n_chars" in docs.columns:
        left = F.when(F.col("dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
        kept = kept.withColumn("row", F.col("row").withField("n_chars", left))
    return _all(kept, docs.columns, "doc_id", "text")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return _all(mix(_named(docs, "doc_id", "text", "source")), docs.columns, "doc_id", "text", "source")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot state a trained classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        release(before)
    return docs
