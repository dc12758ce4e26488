"""Corpus pipeline: toxicity, repeated lines, near-duplicates, benchmark leaks, piece encoding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. Rows with null ids or null texts, empty
texts and repeated rows go through every stage as the operators' docstrings say; empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.decontaminate import without_leaks
from tarnwell.llm.line_dedup import remove_repeated_lines
from tarnwell.llm.minhash_dedup import MinHash, near_duplicates
from tarnwell.llm.queries import tokenizer_file
from tarnwell.llm.scratch import Scratch, working_tables
from tarnwell.llm.sentencepieces import encode_pieces
from tarnwell.llm.toxicity import train, without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; labels of held-out rows are not learned from."""
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated three-line windows cut out; n_chars counts what is left."""
    out = remove_repeated_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates (five words, 0.8).

    Rows that repeat an id share its fate: all go if one of their texts is a duplicate of a smaller
    id's, else all stay. Rows with a null id stay.
    """
    dropped = near_duplicates(docs, MinHash(shingle=5)).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids; round_trip: whether they decode to its text (false for null texts). lang and source where docs has them."""
    model = tokenizer_file("piece_bpe_32k.model")
    names = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    rows = encode_pieces(docs.select(*names, F.coalesce("text", F.lit("")).alias("text"), F.col("text").alias("kept_text")), model, decoded=True)
    return rows.select(*names, F.size("ids").cast("long").alias("n_tokens"), "ids", F.coalesce(F.col("decoded") == F.col("kept_text"), F.lit(False)).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", minhash_stage),
    ("decontamination", decontamination_stage),
    ("sentencepieces", encoding_stage),
]

# Learned scores, similarity classes and sentencepiece ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again; what a stage needed in between goes with it."""
    scratch, written = Scratch(spark, "pipeline"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with working_tables(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*written)
        written = [docs]
    return docs
