"""Extension points for models: replies are looked up in a cache table, misses are asked in batches, results validated."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.noise import BUILDER
from graphloom.functions.text import strip
from graphloom.operators.feedback import misses
from graphloom.operators.graph import RELATIONS

# Other names of the relations.
ALIASES = {"前置依赖": "prerequisite", "并列关系": "parallel", "包含关系": "containment", "应用关系": "application", "contains": "containment", "includes": "containment", "depends_on": "prerequisite", "applies_to": "application"} | {r: r for r in RELATIONS}


def offline(prompts: list[str]) -> list[str]:
    """Stands in for a model: no reply to anything."""
    return [""] * len(prompts)


def replies(requests: DataFrame, cache: DataFrame, parts: list[str], prompt: str, model: Callable[[list[str]], list[str]] = offline, pause: float = 0.0, batch: int = 16) -> DataFrame:
    """key, reply of every request: cached ones, and what the model says to the others; empty replies are not worth caching."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                some = pdf.iloc[k : k + batch]
                yield pd.DataFrame({"key": some["key"], "reply": model(some["prompt"].tolist())})
                time.sleep(pause)

    asked = misses(requests, cache, *parts).select("key", F.col(prompt).alias("prompt")).dropDuplicates(["key"]).mapInPandas(run, "key string, reply string")
    return cache.select("key", "reply").unionByName(asked)


def sample(chunks: DataFrame, per_book: int = 5, least: int = 200, most: int = 2000) -> DataFrame:
    """book_id, chunk_name, chunk_text of the first chunks of each book that are long enough, cut to what a prompt takes."""
    order = Window.partitionBy("book_id").orderBy("chunk_name")
    rows = chunks.where(F.length("content") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_book)
    return rows.select("book_id", "chunk_name", F.substring("content", 1, most).alias("chunk_text"))


def embed(chunks: DataFrame, encode: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "content") -> DataFrame:
    """Adds an embedding column; encode() loads the model once a task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode()
        for s in batches:
            yield pd.Series(model(s.fillna("").tolist()))

    return chunks.withColumn("embedding", run(text))


def valid_reply(raw: DataFrame) -> DataFrame:
    """Extracted triples with trimmed ends of two characters or more, a known relation and no noise."""
    t = raw.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "relation", "object", "evidence")})
    t = t.withColumn("relation", F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), F.lower("relation")))
    return t.where(F.col("relation").isNotNull() & (F.length("subject") >= 2) & (F.length("object") >= 2) & (F.col("evidence") != "") & ~BUILDER(F.col("subject")) & ~BUILDER(F.col("object")))


