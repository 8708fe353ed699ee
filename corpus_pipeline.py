"""The corpus pipeline: documents that a language model may learn from, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's rows as Parquet under the shared checkpoint folder
and reads them again as the next one's documents, so a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, jaccard, mixing, pii, toxicity
from recollect.llm.common import cleared, forget, scratch, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go. It learns from the documents table and its labels."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, spans=False)
    return scored.filter(F.col("toxic_score") < toxicity.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks; n_chars follows the text."""
    clean = pii.redact(docs, tuple(pii.PATTERNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emit(docs)


STAGES = [("toxicity", toxic_out), ("ngram_jaccard", near_copies_out), ("decontamination", benchmark_out), ("pii", private_out), ("mixing", mixed)]

#: The tagger is trained, so SQL can't tell its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{scratch(spark)}/recollect-pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        with cleared():  # a stage's own tables go once its rows are written, and so do its predecessor's rows
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        docs.saved_at = out
        if before is not None:
            forget(before)
        before = docs
    return docs
