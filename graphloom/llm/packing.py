"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Lengths are code points.  A text longer than the capacity is cut into full pieces and a rest; no text is truncated.
Pieces are dealt by hash into shards of about SHARD pieces, so that one source or one group of copies spreads evenly, and
each shard is packed by itself in descending order of length.  Open bins are ordered by residual and carry a bitmap of
their sources and one of their duplicate clusters; the successor search starts at the piece's length and goes on to the
next larger residual until the tightest bin without a conflict is found, else a bin is opened.

No bin holds two documents of one source or of one duplicate cluster (equal texts).  Defined results: a null or empty
text is one piece of length 0; a null source never conflicts; repeated rows are copies and so land in different bins;
ties go by id and piece; empty tables give empty results; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD = 8192, 4096
SCHEMA = "bin_id long, slot int, doc_id long, piece int, start long, length int, source string, cluster long, residual int"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each piece, in the order given, and the bins' residuals.  A source of -1 never conflicts.

    open_at maps a residual to its bins, oldest first; ordered lists the residuals that occur.
    """
    ordered: list[int] = []
    open_at: dict[int, list[int]] = {}
    source_map: list[int] = []
    cluster_map: list[int] = []
    residual: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c, chosen = (1 << source if source >= 0 else 0), 1 << cluster, -1
        k = bisect_left(ordered, size)
        while k < len(ordered) and chosen < 0:
            bins = open_at[ordered[k]]
            for j, b in enumerate(bins):
                if not (source_map[b] & s or cluster_map[b] & c):
                    chosen = b
                    del bins[j]
                    if not bins:
                        del open_at[ordered[k]], ordered[k]
                    break
            else:
                k += 1
        if chosen < 0:
            chosen = len(residual)
            residual.append(capacity)
            source_map.append(0)
            cluster_map.append(0)
        source_map[chosen] |= s
        cluster_map[chosen] |= c
        residual[chosen] -= size
        left = residual[chosen]
        if left in open_at:
            open_at[left].append(chosen)
        else:
            open_at[left] = [chosen]
            insort(ordered, left)
        out.append(chosen)
    return out, residual


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, residual = best_fit(pdf.length.tolist(), pd.factorize(pdf.source)[0].tolist(), pd.factorize(pdf.cluster)[0].tolist(), capacity)
        pdf["bin_id"] = pdf.shard * (1 << 32) + pd.Series(bins, dtype="int64")
        pdf["slot"] = pdf.groupby("bin_id").cumcount().astype("int32")
        pdf["residual"] = pd.Series([residual[b] for b in bins], dtype="int32")
        return pdf[["bin_id", "slot", "doc_id", "piece", "start", "length", "source", "cluster", "residual"]]

    return run


def pack(docs: DataFrame, doc_id="doc_id", text="text", source="source", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: bin_id, slot, doc_id, piece, start and length (code points), source, cluster, residual (of the bin)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.length(t).cast("long").alias("size"), F.xxhash64(t).alias("cluster"))
    last = F.greatest(F.ceil(F.col("size") / capacity).cast("int") - 1, F.lit(0))
    shards = max(1, -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // shard))
    # equal rows are counted and dealt out again by number, so that they spread over the shards whichever task is run again
    rows = rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("length", F.least(F.col("size") - F.col("start"), F.lit(capacity)).cast("int"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "copy"), F.lit(shards)))
    return rows.select("shard", "doc_id", "piece", "start", "length", "source", "cluster").groupBy("shard").applyInPandas(_pack(capacity), SCHEMA)
