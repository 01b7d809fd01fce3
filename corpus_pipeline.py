"""A training-corpus pipeline over `documents`: each stage works on all that the one before kept.

Of ids that repeat, every row goes through each stage on its own. No stage reads more than the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm import decontaminate, line_dedup, near_join, piece_codec, quality
from snapfold.llm.common import scratch
from snapfold.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects: a score under 0.3. It learns from the labelled documents of sf_dir."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out(F.col("doc_id")))
    scored = quality.score_documents(docs.select(*COLUMNS), quality.train(whole, labels), tuple(COLUMNS))
    return scored.filter("score >= 0.3").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines (20 code points or more, in 3 documents or more) from all but the largest id; n_chars follows."""
    out = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def _text_key(docs: DataFrame) -> DataFrame:
    """docs with _row, the hash of the text: decisions are on rows, not on ids alone."""
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more on 5-word shingles hold together, the one of smallest id stays.

    Rows of one id with different texts are documents of their own; of equal rows one stays.
    """
    found = near_join.near_rows(docs).filter("kept").groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_of")).agg(F.count(F.lit(1)).alias("_times"))
    kept = _text_key(docs).join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_of")))
    return kept.filter("_times = 1").select(*COLUMNS).unionByName(kept.filter("_times > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark passage; other rows of the same id stay."""
    leaks = decontaminate.contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_of")).distinct()
    return _text_key(docs).join(leaks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_of")), "left_anti").select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces: doc_id, n_tokens, ids, decoded."""
    return piece_codec.encode_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

#: Boosted trees and merge agendas have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
