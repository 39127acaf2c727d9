"""The readable snapshot: nodes and links for a user interface, and JSON shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.noise import EXPORT
from graphloom.functions.text import display_label
from graphloom.operators.graph import RELATIONS, SHOWN, lookup

# Display names of the books.
BOOKS = {"01_局部解剖学": "01 局部解剖学", "02_组织学与胚胎学": "02 组织学与胚胎学", "03_生理学": "03 生理学", "04_医学微生物学": "04 医学微生物学", "05_病理学": "05 病理学", "06_传染病学": "06 传染病学", "07_病理生理学": "07 病理生理学"}


def readable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a known relation between nodes that exist and are not noise."""
    ok = nodes.where(~EXPORT(F.col("label"))).select("id")
    e = edges.where(F.col("relation").isin(*RELATIONS))
    return e.join(ok.withColumnRenamed("id", "source"), "source", "left_semi").join(ok.withColumnRenamed("id", "target"), "target", "left_semi")


def decision_index(decisions: DataFrame) -> DataFrame:
    """Per node the decision of highest confidence; node ids lose their book prefix."""
    rows = decisions.select("decision_id", "type", "confidence", F.explode("nodes").alias("node")).withColumn("id", F.element_at(F.split("node", "::"), -1))
    best = Window.partitionBy("id").orderBy(F.desc("confidence"), "decision_id")
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").select("id", "decision_id", "type", "confidence")


def node_books(edges: DataFrame) -> DataFrame:
    """Sorted distinct books of the edges at each node."""
    rows = edges.select(F.explode(F.array("source", "target")).alias("id"), "books")
    return rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("books")))).alias("books"))


def snapshot_nodes(degrees: DataFrame, books: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, name, val, type, books, decision_id of nodes(id, degree)."""
    kind = F.when(F.col("type").isNotNull(), "merged").otherwise("concept")
    joined = degrees.join(books, "id", "left").join(decisions.select("id", "decision_id", "type"), "id", "left")
    return joined.select("id", display_label(F.col("id")).alias("name"), F.least(F.lit(26), F.col("degree") + 7).alias("val"), kind.alias("type"), F.coalesce("books", F.array().cast("array<string>")).alias("books"), "decision_id")


def snapshot_links(edges: DataFrame) -> DataFrame:
    relabel = F.transform("books", lambda b: F.coalesce(lookup(BOOKS, b), b))
    return edges.select("source", "target", F.col("relation").alias("type"), F.coalesce(lookup(SHOWN, F.col("relation")), F.col("relation")).alias("label"), relabel.alias("books"))


def ranked_links(edges: DataFrame, degrees: DataFrame, most: int = 360) -> DataFrame:
    """Application edges first, then more books, then greater degree sum; the first `most`."""
    d = degrees.select("id", "degree")
    e = edges.join(d.withColumnsRenamed({"id": "source", "degree": "d1"}), "source").join(d.withColumnsRenamed({"id": "target", "degree": "d2"}), "target")
    order = [F.when(F.col("relation") == "application", 0).otherwise(1), F.desc(F.size("books")), F.desc(F.col("d1") + F.col("d2")), "source", "target"]
    return e.orderBy(*order).limit(most).select("source", "target", "relation", (F.col("d1") + F.col("d2")).alias("weight"))


def cytoscape(nodes: DataFrame, edges: DataFrame, elements: bool = False) -> DataFrame:
    """JSON objects of a graph's parts, one a row: kind, ord, json.  elements: edge ids are u__v instead of numbers."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("ord"), F.to_json(F.struct(F.struct("id", F.col("id").alias("label")).alias("data"))).alias("json"))
    eid = F.concat("source", F.lit("__"), "target") if elements else F.concat(F.lit("e"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source", "target")) - 1).cast("string"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat("source", F.lit("__"), "target").alias("ord"), F.to_json(F.struct(F.struct(eid.alias("id"), "source", "target", "relation").alias("data"))).alias("json"))
    return n.unionByName(e)


def summary(nodes: DataFrame, edges: DataFrame, visible: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(visible.agg(F.count("*").alias("visible")))


def without_node(edges: DataFrame, nodes: DataFrame, gone: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("id") != gone), edges.where((F.col("source") != gone) & (F.col("target") != gone))
