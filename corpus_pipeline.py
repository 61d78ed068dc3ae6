"""A training-data pipeline over `documents`: toxic documents go, near copies go, personal data are rewritten, sources are mixed to target weights, and the mix is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
Before a stage, executors give back the memory that the one before has left them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accord.llm import common, mixing, near_duplicates, pieces_bpe, sanitise, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment scorer, taught by `labels`, predicts toxic are rejected; all others stay as they are.

    Null and empty texts are judged as texts without evidence, texts of any length whole; equal texts go or stay together. Without
    labels of both kinds nothing is learnt: all texts have the share of toxic labels, and stay unless that is half or more. An
    empty table stays empty; other columns are carried along.
    """
    return toxicity.without_toxic(docs, toxicity.learned(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at similarity 0.8 of 5-word shingles, the one with the smallest doc_id stays.

    Documents without words (null, empty, blank) are linked with none and stay; rows without a doc_id stay; of rows that repeat
    a doc_id one stays. An empty table stays empty; other columns are carried along.
    """
    common.rested(spark)
    return near_duplicates.deduplicated(docs, percent=80)


def rewrite_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and words that disclose them are replaced in the texts; every document stays.

    Null texts stay null and empty ones empty; repeated rows are rewritten alike. n_chars follows the new text; other columns
    are carried along. An empty table stays empty.
    """
    common.rested(spark)
    return sanitise.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: documents stand as often as they are taken, in part where blocks of them are.

    Documents without words (null, empty, blank) are not in it. Repeated rows are taken each on their own; a null source is a
    source, the last. n_chars follows the text; other columns are carried along. Without rows the mix is empty.
    """
    common.rested(spark)
    return mixing.mixture(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of the mix, a row for each time that a document stands in it. Null and empty texts have no ids; an empty table gives an empty one."""
    common.rested(spark)
    return pieces_bpe.encoded_digests(docs, pieces_bpe.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", rewrite_personal_data),
    ("mixing", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: Trained scores, component search and tokenization can't be said in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
