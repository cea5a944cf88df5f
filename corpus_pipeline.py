"""From documents to a training mix: language, near duplicates, repeated passages, benchmark leaks, mixing.

A document is one message of the stream named by its source.  Every stage takes and, but for the
last, returns the columns of ``documents``; further columns, of any name, pass through.  The result
of a stage is written before the next one begins, which then deletes the tables that earlier
stages have left behind, so the disk holds those of one stage at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.contamination import find_contamination
from threadloom.llm.language import UNKNOWN, identify_languages, language_model
from threadloom.llm.mixing import curriculum
from threadloom.llm.near import near_duplicates
from threadloom.llm.queries import as_messages, cyclic_schedules
from threadloom.llm.substrings import drop_repeated_passages
from threadloom.session import intermediates, materialize, release, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables of the stages that ran before, by application.
_LEFT: dict[str, list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """Delete what earlier stages wrote (unless ``docs`` still reads it) before this one begins."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        release(spark, left, unless=docs)
        with intermediates() as paths:
            out = stage(spark, docs, sf_dir)
        left += paths
        return out

    return run_stage


def packed(docs: DataFrame) -> DataFrame:
    """``text`` and all other columns as one, so that no name of theirs meets an operator's."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again; ``changed`` ones from ``rows``."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c if c == "text" else f"_doc.`{c}`") for c in docs.columns])


@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of no language (no text, or no letter in it) go; mixed ones stay.

    Where no document has a language label, nothing can be learned and all with a letter stay.
    """
    model = language_model(docs.select("text", "lang"))
    rows = packed(docs)
    if not model["langs"]:
        return unpacked(rows.where(F.col("text").rlike("\\p{L}")), docs)
    return unpacked(identify_languages(rows, model).where(F.col("lang_pred") != UNKNOWN), docs)


@tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the one of the smallest id.

    Rows are told apart by a number of their own, so texts alone decide: rows of different text stay
    even if their id is null or repeated.  A null id is the smallest; among rows of one id a hash
    of the row decides, so the same row stays in every run.
    """
    place = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"), place.alias("_place"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "rows")
    found = near_duplicates(rows.select(F.col("_row").alias("msg_id"), "text")).select(F.col("msg_id").alias("_row"), "component_id")
    ranked = rows.select("_row", F.struct("_place", "_row").alias("_first"))
    first = ranked.join(found, "_row").groupBy("component_id").agg(F.min("_first").alias("_first"))
    return unpacked(rows.join(first.select(F.col("_first._row").alias("_row")), "_row", "left_semi"), docs)


@tidy
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier leave the text; documents stay."""
    rows = packed(docs).withColumn("msg_id", F.col("_doc.doc_id").cast("long"))
    cut = drop_repeated_passages(rows)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("_doc.n_chars"))
    return unpacked(cut, docs, **new)


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage go."""
    found = find_contamination(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(found.where("not contaminated"), docs)


@tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words to take of each document and its place in training, in that order."""
    msgs = as_messages(docs)
    mix = curriculum(msgs, cyclic_schedules(msgs))
    return mix.select(F.col("msg_id").alias("doc_id"), F.col("dataset").alias("source"), "size", F.col("dataset_size").alias("source_size"), "target", "taken", "position")


STAGES = [
    ("language", language),
    ("near_duplicates", near),
    ("repeated_passages", substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language models and similarity components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
