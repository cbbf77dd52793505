"""From raw documents to tokens: each stage reads what its predecessor wrote.

For every stage: null and empty texts pass through (they hold nothing toxic, nothing personal and no words, and have no copies), very long texts are
handled whole, an empty table gives an empty one, columns beyond COLUMNS are dropped, and reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import bpe, jaccard, mixing, pii, toxicity
from gapweave.llm.common import materialised, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold; learned from labelled rows that aren't held out.

    A score at the threshold is toxic.  Repeated rows share their fate.  Without labels of either kind nothing is rejected.
    """
    net = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs.select(*COLUMNS), net)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8.

    The smallest id stays (a null one only if no other is there), on a tie of ids the smaller hash of the text; of rows that repeat both, one.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars counts anew.  Of overlapping spans the outer one is replaced, on a tie the first kind by name."""
    return pii.redact(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights; a document stands as often as the mix takes it, three times at most.

    Documents without words are never taken; a null source is one of its own; equal rows are taken alike.
    """
    return mixing.mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the decoded text of each document; repeated rows give repeated rows."""
    coded = bpe.encode_decode(docs, bpe.default_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("toxicity", without_toxic), ("ngram_jaccard", one_of_each), ("pii", without_pii), ("mixing", mixed), ("bpe", tokens)]
#: A trained network, similarity groups and tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
