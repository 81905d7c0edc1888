"""Corpus pipeline: toxic texts out, shared lines out, near copies out, benchmark leaks out, then token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import bpe_automaton, chosen_path, line_dedup, tiling, toxicity
from wattloom.llm.common import held_out, table
from wattloom.llm.queries import vocabulary_path
from wattloom.session import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. Labels are learned from as in the query of the operator."""
    train = ~held_out("doc_id", 5)
    labels = table(spark, sf_dir, "labels").where(train)
    model = toxicity.fit(docs.where(train), labels.where("toxic = 1"), toxicity.prior_of(labels))
    return model.with_score(docs, column="__toxicity").where(F.col("__toxicity") < 0.5).drop("__toxicity")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents share; every document stays. ``n_chars`` follows the text."""
    out = line_dedup.dedup(docs)
    lengths = {"n_chars": F.length("__kept").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns({"text": F.col("__kept"), **lengths}).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: that with the smallest id, null after all others.

    Classes are told by texts: an id used for unrelated texts keeps a row of each.
    """
    return chosen_path.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go, whether they have an id or not."""
    leaks = tiling.matches(docs, table(spark, sf_dir, "benchmark")).select("d").distinct()
    keyed = docs.withColumn("__d", tiling.document_key("doc_id", "text"))
    return keyed.join(leaks, keyed["__d"] == leaks["d"], "left_anti").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, with digests of the ids and of the text that they decode to."""
    out = bpe_automaton.round_trip(docs, vocabulary_path("byte_bpe_50k.json"))
    return out.select(
        F.col("doc").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Learned scores, near copies and token ids cannot be said in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the stage before it kept, written in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
