"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches by falling doc_id.  A run is a table of line keys (128 hash bits), each with the document that holds
it, bucketed and sorted by key: a batch, which is reduced to such a table first, meets a run in a merge join without exchange
or sort.  The merge anti-join of a batch against all runs finds the keys that no run has: they are new, their holder is the
largest document of the batch with them - and so of all, as later batches have smaller ones - and they become a run of level 0.
Keys that a run has only add to the number of documents that hold them.  So every key is in exactly one run.  Two runs of a
level are compacted into one of the next by a merge of both, so that a batch meets only a logarithmic number of runs.

Defined results: a null or empty text is one empty line; a document whose id is null counts as one document smaller
than all others; rows with the same id count as one document, each row keeps or loses lines by that id; empty tables give
empty results; columns other than the text come back in the struct `row`, whatever their names.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, dropped, join_counted, remove, scratch, shuffle_partitions, written

#: Code points that a key must have, and documents that must hold it, before its lines go.
MIN_CHARS, MIN_DOCS = 20, 3
#: Batches at least, bytes of text above which there are more of them, and runs of one level that are compacted.
BATCHES, BATCH_BYTES, FANOUT = 4, 10**12, 2
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)

KEY = ["k1", "k2"]


def line_keys(docs: DataFrame, doc_id="doc_id", text="text", min_chars=MIN_CHARS) -> DataFrame:
    """doc_id (null: NO_ID), body (a hash of the text, which tells rows of one id apart), line, k1, k2 of every line with a key that is long enough."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(t).alias("body"), F.posexplode(F.split(t, "\n")).alias("line", "raw"))
    lines = lines.select("doc_id", "body", "line", F.btrim("raw", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.withColumn("key", ascii_lower(F.col("key")))
    return lines.select("doc_id", "body", "line", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


@contextmanager
def sorted_scans(spark: SparkSession):
    """Let scans of bucketed tables say that a bucket of one file is sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The levelled runs (k1, k2, holder) and the batches (k1, k2, n_docs, last); their state is the list of tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.batches: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, entries: DataFrame, what: str) -> str:
        """A table in the shared folder; entries are hashed by key into as many partitions, so a bucket is one sorted file."""
        name = f"line_{what}_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, f"line-{what}")
        entries.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def fresh(self, batch: str) -> DataFrame:
        """The entries of a batch whose keys no run has."""
        out = self.spark.table(batch)
        for run in self.runs():
            out = out.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        return out

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one; no key is in both."""
        other = self.spark.table(b).withColumnRenamed("holder", "other").hint("merge")
        return self.spark.table(a).join(other, KEY, "full_outer").select(*KEY, F.coalesce("holder", "other").alias("holder"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of line_keys.  Its documents are smaller than those of the batches before."""
        one = lines.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        batch = self._write(one, "batch")
        with sorted_scans(self.spark):
            self.levels[0].append(self._write(self.fresh(batch).select(*KEY, F.col("last").alias("holder")), "run"))
            self.batches.append(batch)
            for k, level in enumerate(self.levels):
                if len(level) == FANOUT:
                    if k + 1 == len(self.levels):
                        self.levels.append([])
                    self.levels[k + 1].append(self._write(self.merged(*level), "run"))
                    for name in level:
                        self._drop(name)
                    level.clear()

    def repeated(self, min_docs: int) -> DataFrame:
        """k1, k2, n_docs, holder of the keys that so many documents hold."""
        every, runs = ([self.spark.table(n) for n in names] for names in (self.batches, self.runs()))
        for rest in (every, runs):
            while len(rest) > 1:
                rest.append(rest.pop(0).unionByName(rest.pop(0)))
        often = every[0].groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        return often.join(runs[0], KEY).select(*KEY, "n_docs", "holder")

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)


def lines_to_drop(docs: DataFrame, doc_id="doc_id", text="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS, batch_bytes=BATCH_BYTES) -> DataFrame:
    """doc_id (null: NO_ID), body, lines (the numbers of those that go), of every document that loses any."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    batches = max(BATCHES, -(-size // batch_bytes))
    cuts = docs.select(F.col(doc_id).cast("long").alias("i")).agg(F.percentile_approx("i", [1 - k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = sum(((F.col("doc_id") <= c).cast("int") for c in cuts or []), F.lit(0))  # the largest documents come first
    keyed = line_keys(docs, doc_id, text, min_chars).withColumn("batch", batch)
    path = scratch(spark, "lines")
    keyed.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(keyed.schema).parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).drop("batch"))
    # a key has more lines than documents only where a document repeats it; the largest holder bounds that
    bad = written(runs.repeated(min_docs), "line-keys")
    runs.close()
    hit = join_counted(lines.drop("batch"), bad, KEY, "n_docs", lines.count()).where(F.col("doc_id") != F.col("holder"))
    out = written(hit.groupBy("doc_id", "body").agg(F.collect_set("line").alias("lines")), "line-drops")
    dropped(bad)
    remove(spark, path)
    return out


def _cut(at: int):
    """Arrow batches of documents (struct) and the numbers of the lines that go -> the rest of the struct, kept text, counts."""

    def run(batches):
        for batch in batches:
            fields = batch.column(0).flatten()
            names = [f.name for f in batch.column(0).type]
            text, gone = fields.pop(at), batch.column(1).to_pylist()
            names.pop(at)
            kept, total = [], []
            for t, drop in zip(text, gone, strict=True):
                lines = (t.as_py() or "").split("\n")
                total.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [x for i, x in enumerate(lines) if i not in drop]
                kept.append("\n".join(lines) if t.is_valid else None)
            out = [pa.StructArray.from_arrays(fields, names), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array([len(d or ()) for d in gone], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["row", "kept", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """row (a struct of all columns of docs but the text), kept (the text without the lines that go), n_lines before dropping, n_dropped."""
    drops = lines_to_drop(docs, doc_id, text, **how)
    rest = [f for f in docs.schema if f.name != text]
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    joined = left.join(drops, ["doc_id", "body"], "left").select("row", "lines")
    schema = "row struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rest) + ">, kept string, n_lines long, n_dropped long"
    return joined.mapInArrow(_cut(docs.columns.index(text)), schema)
