"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import decontaminate, linededup, simhash
from graphloom.llm import packing as bins
from graphloom.llm import toxicity as toxic
from graphloom.llm.common import table


def toxicity(spark, docs, sf_dir):
    """Documents that are predicted toxic go."""
    return toxic.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Repeated lines go, all but one; documents stay, with what is left of their texts."""
    out = linededup.dedup_lines(docs.drop("n_chars"))
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of copies the row with the smallest id stays; rows that share an id or have none are rows of their own."""
    return simhash.representatives(docs)


def decontamination(spark, docs, sf_dir):
    """Passages of benchmark items are cut out; documents stay."""
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """One row per piece of a document in its bin."""
    return bins.pack(docs)

