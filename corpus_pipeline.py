"""From raw documents to packed sequences: classifier, rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), judges all rows that the one before it kept and returns them with the columns of
documents; the last returns the packed pieces. Stages are written and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import jaccard, packing, quality_model, quality_rules, secrets
from attestry.llm.common import save, table
from attestry.llm.queries import WORD_BPE, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the documents that it is given."""
    return quality_model.keep(docs, quality_model.learn(docs, table(spark, sf_dir, "labels")))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie beyond their group's limits go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return jaccard.keep_one(docs, 5, 80, 100)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the text."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap, certified."""
    return packing.pack_documents(docs, vocabulary(WORD_BPE), memory=WORDS)


#: Words that a worker remembers in packing. Workers of a pipeline share their executor with all that its stages have grown.
WORDS = 75_000

STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_filter), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_removal), ("best-fit packing", packed)]

#: A trained model takes part, so SQL can't give the rows; tests compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")) if i < len(STAGES) - 1 else stage(spark, docs, sf_dir)
    return docs
