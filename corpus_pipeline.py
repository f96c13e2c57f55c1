"""The corpus pipeline: five stages from raw documents to packed training windows.

Each stage works on all that the stage before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontamination, near_dedup, packing, passages, toxic_spans
from pagewright.llm.queries import table, vocabulary_file
from pagewright.llm.shared import Workspace

#: A text whose toxicity score reaches this goes.
TOXIC = 0.7


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again after texts were cut."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the field, trained on labels that are not held out, scores as toxic."""
    return toxic_spans.without_toxic(docs, toxic_spans.train(docs, table(spark, sf_dir, "labels")), TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; links at a similarity of 0.8 on shingles of five words."""
    return near_dedup.keep_one(docs, percent=80, size=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of at least 50 words that an earlier document has; texts of which nothing is left go.

    What repeats only inside one document stays.
    """
    found = passages.repeated_passages(docs, words=50, identity=0.8).where("doc <> other")
    return _counted(passages.cut_passages(docs, found))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of benchmark windows; a text of which more than half is hit goes as a whole."""
    return _counted(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.5))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: rows are the pieces of documents, with their token ids."""
    return packing.pack(docs, vocabulary_file("byte_bpe_50k.json"), vocabulary_file("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("packing", packed),
]

#: Trained scores and sketches are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = ws.table(docs)
    return docs
