"""Tables of documents and chunks from folders of any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import book_id, stem, strip
from graphloom.sources import office

#: File extensions and what reads them.
KINDS = {"md": "md", "markdown": "md", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xlsm": "xlsx"}
READ = {"md": lambda b: b.decode("utf-8", "replace"), "pdf": office.pdf_markdown, "docx": office.docx_markdown, "xlsx": office.xlsx_markdown}
TRIPLE = "subject string, relation string, object string, evidence string, source_path string, book_id string, chapter string, section string, confidence double, extractor string, metadata map<string,string>"


#: What opening a file counts as, in bytes, when files are dealt into tasks, and into how many tasks folders are listed.
OPEN_COST, LISTED_BY = "65536", "64"


def _dealt(spark: SparkSession, read) -> DataFrame:
    """read(session) in a session whose tasks take many small files each; what it returns goes on in the caller's session.

    By Spark's own count a file costs 4 MB, so that three or four of them are a task.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTED_BY)
    found = read(own)
    return spark.createDataFrame([], found.schema).unionByName(found)


def _extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def files(spark: SparkSession, *paths: str, every: bool = False) -> DataFrame:
    """path, source_type, file_size, file_mtime, content of the readable files below the paths.

    every: files of other kinds are an error instead of being passed over.
    """
    f = _dealt(spark, lambda s: s.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), _extension(F.col("path")))
    f = f.select("path", kind.alias("source_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"), "content")
    if every:
        return f.withColumn("source_type", F.when(F.col("source_type").isNotNull(), F.col("source_type")).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), "path"))))
    return f.where("source_type is not null")


def load_markdown(spark: SparkSession, *paths: str, every: bool = False) -> DataFrame:
    """book_id, path, source_type, file_size, file_mtime, markdown of documents of all kinds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["markdown"] = [READ[k](b) for k, b in zip(pdf["source_type"], pdf["content"], strict=True)]
            yield pdf.drop(columns="content")

    rows = files(spark, *paths, every=every).mapInPandas(run, "path string, source_type string, file_size long, file_mtime timestamp, markdown string")
    return rows.withColumn("book_id", book_id(F.col("path")))


def chunks(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """book_id, chunk_name, path, content of markdown files with more than so many characters."""
    t = _dealt(spark, lambda s: s.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    t = t.where(_extension(F.col("path")).isin("md", "markdown") & (F.length(strip(F.col("content"))) > least))
    return t.select(F.element_at(F.split("path", "/"), -2).alias("book_id"), stem(F.col("path")).alias("chunk_name"), "path", "content")


def book_chunks(chunk_table: DataFrame, roots: DataFrame, few: int = 3, factor: int = 2) -> DataFrame:
    """book_id with how its chunks are to be had: virtual where a root text exists and chunks are few or small against it."""
    have = chunk_table.groupBy("book_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    root = roots.select("book_id", F.octet_length("markdown").alias("root_bytes"))
    both = have.join(root, "book_id", "left")
    virtual = F.col("root_bytes").isNotNull() & ((F.col("n") <= few) | (F.col("root_bytes") > factor * F.col("bytes")))
    return both.select("book_id", "n", virtual.alias("virtual"))


def triples(spark: SparkSession, path: str, books: list[str] | None = None) -> DataFrame:
    """Triples of JSON files *.triples.json, of the books whose file name holds one of the given ids."""
    t = spark.read.schema(TRIPLE).json(path, multiLine=True, pathGlobFilter="*.triples.json", recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_name"))
    if books:
        t = t.where(F.exists(F.array(*(F.lit(b) for b in books)), lambda b: F.contains("file", b)))
    return t


def endpoint(c):
    """An end of a link, which may be an id or an object with one, or with a name."""
    held = F.from_json(F.when(c.startswith("{"), c), "id string, name string")
    return F.when(held.isNotNull(), F.coalesce(held["id"], held["name"], F.lit(""))).otherwise(c)


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of node-link JSON, under either of its two names; edges without both ends are dropped."""
    edge = "array<struct<source:string,target:string,relation:string,books:array<string>,confidence:double>>"
    j = spark.read.schema(f"links {edge}, edges {edge}").json(path, multiLine=True)
    e = j.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*").where("source is not null and target is not null")
    return e.withColumns({"source": endpoint(F.col("source")), "target": endpoint(F.col("target"))})


def with_content(hits: DataFrame, chunk_table: DataFrame, key: str = "path") -> DataFrame:
    """Search hits with the whole text of their chunks in place of the snippet."""
    return hits.drop("content").join(chunk_table.select(key, "content"), key)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Merge decisions of a JSON array, or none where there is no file."""
    schema = "decision_id string, type string, nodes array<string>, books array<string>, confidence double, resolved boolean, teacher_feedback string"
    return or_else(spark, path, lambda p: spark.read.schema(schema).json(p, multiLine=True), schema).where("decision_id is not null")


def or_else(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """read(path), or an empty table where nothing is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return read(path) if there else spark.createDataFrame([], schema)
