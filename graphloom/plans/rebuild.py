"""The whole batch: chunks -> triples -> per-book graphs -> merged graph with decisions -> tiers -> essence -> snapshot.

Each stage that later ones read more than once is written, so a lost executor or a failed stage does not start the batch over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import natural_key
from graphloom.operators import essence, export, graph, merge, sections
from graphloom.operators.triples import extract


@dataclass(frozen=True)
class Paths:
    out: str

    def __getattr__(self, name: str) -> str:
        return f"{self.out}/{name}"


def _stage(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def rebuild(spark: SparkSession, chunks: DataFrame, out: str, rounds: int = 200) -> dict[str, DataFrame]:
    """chunks(book_id, chunk_name, path, content)."""
    at = Paths(out)
    placed = chunks.withColumn("chunk_pos", F.row_number().over(Window.partitionBy("book_id").orderBy(natural_key(F.col("chunk_name")))).cast("long"))
    triples = _stage(extract(sections.chunk_identity(placed)), at.triples)
    clean = merge.filter_noise(triples)
    per_book = _stage(graph.edges(clean, "last"), at.edges)
    merged = _stage(graph.merged_edges(per_book), at.merged)
    exact = merge.exact_matches(merge.book_nodes(clean)).select(F.array("label").alias("nodes"), "books", "confidence")
    against = merge.conflicts(per_book).select(F.array("source", "target").alias("nodes"), F.array_sort(F.array_distinct("books")).alias("books"), "confidence")
    more = merge.complements(per_book).select(F.array("source").alias("nodes"), F.array("book_id", "other").alias("books"), "confidence")
    decisions = _stage(merge.decision_log(("merge", exact), ("conflict", against), ("complement", more)), at.decisions)
    ranked = _stage(graph.centrality(merged, rounds), at.centrality)
    hits = merge.label_in_chunk(ranked.select(F.col("id").alias("label")), chunks.select(F.col("path").alias("chunk_id"), "content"))
    texts = hits.join(chunks.select(F.col("path").alias("chunk_id"), "content"), "chunk_id").groupBy(F.col("label").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x.content), "\n").alias("content"))
    nodes = ranked.join(texts, "id", "left").withColumn("label", F.col("id"))
    body = F.coalesce("content", F.lit(""))
    nodes = nodes.withColumns({"summary": essence.summary(body, F.col("label")), "passages": F.when(F.col("tier") < 4, essence.key_passages(body)).otherwise(F.array().cast("array<string>"))})
    text = _stage(essence.rendered(nodes), at.essence)
    degrees = graph.degree(merged)
    shown = export.snapshot_nodes(degrees, export.node_books(merged), export.decision_index(decisions))
    links = export.snapshot_links(export.readable_edges(merged, degrees.select("id", F.col("id").alias("label"))))
    return {"triples": triples, "edges": per_book, "merged": merged, "decisions": decisions, "nodes": nodes, "essence": text, "snapshot_nodes": shown, "snapshot_links": links, "report": merge.merge_report(per_book, merged, decisions)}
