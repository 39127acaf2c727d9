"""The corpus pipeline: documents -> without toxic ones -> without repeated lines -> one of each near-duplicate group ->
without benchmark passages -> packed bins.  Each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from graphloom.llm import stages
from graphloom.llm.common import table, written

STAGES = [
    ("toxicity", stages.toxicity),
    ("line dedup", stages.line_dedup),
    ("near-duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("packing", stages.packing),
]

#: The toxicity stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
