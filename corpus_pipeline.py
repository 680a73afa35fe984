"""From raw documents to token ids: five stages, each written as Parquet before the next one reads it.

Documents that the classifier or the rules reject go, one document of each
group of near duplicates stays, documents that hold a benchmark item go, and
what is left is encoded. All stages but the last return the columns of
documents, whatever their names: a stage's own columns never meet them. Cases:
a document is a doc_id with a text: in the third stage rows that share both
count as one, rows of one doc_id with different texts are different documents,
and so are those without doc_id, of which one stays where no document of its
group has an id; the operators say what happens to other odd rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm import decontaminate, minhash, quality_classifier, quality_rules, sentencepieces
from linecue.llm.common import checkpointed, document, shared_path, table

#: Leaking documents that are broadcast at most; their keys have 16 bytes.
MAX_BROADCAST = 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores LEAST_SCORE or more; it learns from the labelled ones among them."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name in map(str.lower, docs.columns):
        name += "_"
    return quality_classifier.score(docs, model, name).where(F.col(name) >= quality_classifier.LEAST_SCORE).drop(name)


def _whole(docs: DataFrame) -> DataFrame:
    """(doc, whole): a document's identity and its row as one value."""
    return docs.select(document().alias("doc"), F.struct("*").alias("whole"))


def by_the_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble the trusted ones."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("whole"))
    return quality_rules.judge(rows, quality_rules.trusted_labels(table(spark, sf_dir, "labels")), carried=("whole",)).where("kept").select("whole.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group, once, also where rows are repeated."""
    keyed = _whole(docs).withColumn("key", F.struct(F.col("doc.doc_id").isNull().alias("nameless"), "doc.doc_id", "doc.row"))
    groups = minhash.near_duplicates(keyed.select("key", "whole.text"), width=5, key="key")
    # Rows repeated as a whole are put together before they are dealt out.
    once = keyed.groupBy("key").agg(F.first("whole").alias("whole"))
    return once.join(groups.where("kept").select("key").distinct().hint("merge"), "key", "left_semi").select("whole.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = checkpointed(decontaminate.leaking(docs, table(spark, sf_dir, "benchmark")))
    few = found.count() <= MAX_BROADCAST
    return _whole(docs).join(F.broadcast(found) if few else found.hint("merge"), "doc", "left_anti").select("whole.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's ids and of the text decoded from them."""
    return sentencepieces.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("quality rules", by_the_rules),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
