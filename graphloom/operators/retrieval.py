"""Keyword, vector and graph retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import page_of, stem, terms

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content", tokens=terms) -> DataFrame:
    """term, key, tf, dl: the inverted index of a built engine."""
    rows = chunks.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def statistics(chunks: DataFrame, text: str = "content", tokens=terms) -> DataFrame:
    """term, df; the row without a term counts the documents (df) and their tokens (length).  One pass over the texts."""
    t = chunks.select(tokens(F.col(text)).alias("t"))
    rows = t.select(F.size("t").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length"))


def corpus(stats: DataFrame) -> DataFrame:
    """One row: n documents, average length."""
    return stats.where("term is null").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))


def idf(stats: DataFrame) -> DataFrame:
    """term, df, idf; terms in over half the documents get EPSILON times the mean idf."""
    d = stats.where("term is not null").select("term", "df").crossJoin(F.broadcast(corpus(stats)))
    d = d.withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = d.agg(F.avg("raw").alias("mean"))
    return d.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Distinct terms of questions that are broadcast against the texts; with more of them the join is shuffled.
ASKED = 100_000


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "content", tokens=terms) -> DataFrame:
    """query_id, key, score over queries(query_id, question); repeated query terms count again.

    Two passes over the texts: one counts documents by term, the other counts the asked terms in each text, so that only their
    postings leave a task.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    stats = statistics(chunks, text, tokens)
    sought = asked.select("term").distinct()
    if sought.limit(ASKED + 1).count() <= ASKED:
        sought = F.broadcast(sought)
    rows = chunks.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    index = rows.join(sought, "term", "left_semi").groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return scores(index, asked, idf(stats), corpus(stats), key)


def scores(index: DataFrame, asked: DataFrame, weights: DataFrame, n: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score of postings(term, key, tf, dl) for asked(query_id, term, times)."""
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = index.join(asked, "term").join(weights, "term").crossJoin(F.broadcast(n.select("avgdl")))  # n is one row
    return hit.groupBy("query_id", key).agg(F.sum(weight).alias("score"))


def top(scored: DataFrame, k: int, by: str = "query_id", key: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def all_distances(vectors: DataFrame, queries: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, distance of every vector to every query: a stated query set of a few questions."""
    q = F.broadcast(queries.select("query_id", F.col(vector).alias("__q")))
    return vectors.crossJoin(q).select("query_id", key, squared_l2(F.col(vector), F.col("__q")).alias("distance"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """query_id, key, distance, rank of the k nearest, ties by key: a stated query set against all rows, `block` queries a pass.

    A task keeps its k nearest of each query, so no more than that leaves it.
    """
    spark, passes, part = vectors.sparkSession, [], []

    def nearest(held):
        import numpy as np
        import pyarrow as pa

        ids, points = held.value
        points = np.array(points, dtype=np.float64)

        def run(batches):
            best = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in ids]
            for batch in batches:
                own = batch.column(0).to_numpy()
                rows = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64) if len(own) else np.zeros((0, 1))
                for j, p in enumerate(points if len(own) else ()):
                    d = np.square(rows - p).sum(axis=1)
                    if len(best[j][0]) == k:
                        near = np.flatnonzero(d <= best[j][0][-1])
                        d, of = d[near], own[near]
                    else:
                        of = own
                    d, of = np.concatenate((best[j][0], d)), np.concatenate((best[j][1], of))
                    order = np.lexsort((of, d))[:k]
                    best[j] = d[order], of[order]
            count = [len(d) for d, _ in best]
            if sum(count):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count), pa.int64()), pa.array(np.concatenate([o for _, o in best]), pa.int64()), pa.array(np.concatenate([d for d, _ in best]))], names=["query_id", key, "distance"])

        return run

    def search(part):
        held = spark.sparkContext.broadcast(([r[0] for r in part], [list(r[1]) for r in part]))
        passes.append(vectors.select(F.col(key).cast("long"), vector).mapInArrow(lambda batches, held=held: nearest(held)(batches), f"query_id long, `{key}` long, distance double"))

    for r in queries.select(F.col("query_id").cast("long"), vector).toLocalIterator():
        part.append(r)
        if len(part) == block:
            search(part)
            part = []
    if part or not passes:
        search(part)
    while len(passes) > 1:
        passes.append(passes.pop(0).unionByName(passes.pop(0)))
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return passes[0].withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def minmax(df: DataFrame, column: str, to: str) -> DataFrame:
    s = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return df.crossJoin(F.broadcast(s)).withColumn(to, (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-6)).drop("__lo", "__hi")


def fused(keyword: DataFrame, distance: DataFrame, k: int, alpha: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score, rank: per query alpha times the keyword score and 1 - alpha times the nearness, both scaled over all keys."""
    both = distance.join(keyword.withColumnRenamed("score", "keyword"), ["query_id", key], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    range_ = both.groupBy("query_id").agg(F.min("keyword").alias("lo"), F.max("keyword").alias("hi"), F.max("distance").alias("far"))  # a row a query
    kw = (F.col("keyword") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)
    near = 1 - F.col("distance") / (F.col("far") + 1e-6)
    scored = both.join(F.broadcast(range_), "query_id").select("query_id", key, (alpha * kw + (1 - alpha) * near).alias("score"))
    return top(scored, k, key=key)


def citations(hits: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    parts = F.split(F.col(path), "/")
    name = stem(F.col(path))
    return hits.withColumns({"source": F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), "chapter": name, "page": page_of(name), "snippet": F.substring(F.col(content), 1, 300), "score": F.bround("score", 3)})


def haystack(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def graph_query(nodes: DataFrame, question: str, limit: int = 8) -> DataFrame:
    """Nodes(id, pos, name, essence, reasoning, books, val) that hold words of the question: 3 in the name, 1 elsewhere."""
    hay = haystack(F.col("name"), F.col("essence"), F.col("reasoning"), F.array_join("books", " "))
    score = sum((F.when(F.contains(F.col("name"), F.lit(t)), 3).when(F.contains(hay, F.lit(t)), 1).otherwise(0) for t in question.split()), F.lit(0))
    return nodes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("val"), "pos").limit(limit)


def related_links(links: DataFrame, matched: DataFrame, limit: int = 8) -> DataFrame:
    """Links(pos, source, target) at either end of the matched nodes, in order."""
    m = matched.select("id")
    a = links.join(m.withColumnRenamed("id", "source"), "source", "left_semi").select("pos", "source", "target")
    b = links.join(m.withColumnRenamed("id", "target"), "target", "left_semi").select("pos", "source", "target")
    return a.unionByName(b).distinct().orderBy("pos").limit(limit)


def answer(question: str, matched: DataFrame, links: DataFrame) -> DataFrame:
    """One line about the best match and up to three of its relations."""
    head = matched.limit(1).select("name", F.coalesce(F.nullif("reasoning", F.lit("")), "essence").alias("said"))
    told = links.orderBy("pos").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("source", F.lit(" -> "), "target").alias("t")))), lambda x: x.t), "; ").alias("links"))
    return head.crossJoin(told).select(F.concat(F.lit(f"{question}: "), "name", F.lit(". "), "said", F.when(F.col("links") != "", F.concat(F.lit(" "), "links")).otherwise("")).alias("answer"))


def search_v1(nodes: DataFrame, question: str, k: int = 5) -> DataFrame:
    """4 for the question in the name, 1 in the text, twice the share of its characters found; over 8."""
    q = question.lower()
    hay = F.lower(haystack(F.col("name"), F.col("essence"), F.col("reasoning"), F.array_join("books", " ")))
    overlap = sum((F.contains(hay, F.lit(c)).cast("int") for c in q), F.lit(0)) / max(len(q), 1)
    score = F.when(F.contains(F.col("name"), F.lit(q)), 4).otherwise(0) + F.contains(hay, F.lit(q)).cast("int") + overlap * 2
    return nodes.withColumn("raw", score).where("raw > 0").orderBy(F.desc("raw"), "pos").limit(k).withColumn("score", F.least(F.col("raw") / 8, F.lit(1.0)))


def search_v2(nodes: DataFrame, question: str, k: int = 5, with_books: bool = True) -> DataFrame:
    """Words in the name 8 (one character 4), else in the essence 3; the question in the name 10; CJK overlap 4; boosts; over 15.

    with_books=False leaves the books out of the text, which is the third variant.
    """
    import re

    words = [t for t in re.split(r"[\s，,、]+", question) if t]
    q, name, essence = question.lower(), F.lower("name"), F.lower(F.coalesce("essence", F.lit("")))
    hay = haystack(name, essence, F.lower(F.array_join("books", " "))) if with_books else haystack(name, essence)
    score = sum((F.when(F.contains(name, F.lit(t)), 8 if len(t) >= 2 else 4).when(F.contains(essence, F.lit(t)), 3).otherwise(0) for t in words), F.lit(0))
    score = score + F.when(F.contains(name, F.lit(q)), 10).otherwise(0)
    chars = [c for c in q if "一" <= c <= "鿿"]
    if len(chars) >= 2:
        score = score + sum((F.contains(hay, F.lit(c)).cast("int") for c in chars), F.lit(0)) / len(chars) * 4
    score = score * F.when(F.col("type") == "merged", 1.4).otherwise(1.0) * F.when(F.col("val") > 10, 1.3).otherwise(1.0)
    return nodes.withColumn("raw", score).where("raw > 1").orderBy(F.desc("raw"), "pos").limit(k).withColumn("score", F.least(F.col("raw") / 15, F.lit(1.0)))


def snippet_choice(essence: Column, reasoning: Column, books: Column) -> Column:
    """The essence unless it is boiler-plate, else the reasoning, else where it comes from."""
    dull = F.contains(essence, F.lit("是整合图谱中的知识节点")) | F.contains(essence, F.lit("语义相似度"))
    stale = F.contains(reasoning, F.lit("由单本图谱与跨教材合并结果生成"))
    return F.when((essence != "") & ~dull, essence).when((reasoning != "") & ~stale, reasoning).otherwise(F.concat(F.lit("来自「"), F.array_join(books, "、"), F.lit("」，在图谱中可查看其邻接关系与原文出处。")))


def ui_search(nodes: DataFrame, keyword: str) -> DataFrame:
    text = haystack(F.col("name"), F.col("essence"), F.col("reasoning"), F.array_join("books", " "))
    score = F.when(F.contains(F.col("name"), F.lit(keyword)), 4).otherwise(0) + F.contains(text, F.lit(keyword)).cast("int") + F.col("val") / 50
    return nodes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "pos").limit(1)


def ui_filter(nodes: DataFrame, links: DataFrame, relations: list[str], keyword: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes on active links that hold the keyword, and the active links between them."""
    active = links.where(F.col("relation").isin(*relations))
    linked = active.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    text = haystack(F.col("name"), F.col("essence"), F.col("reasoning"), F.array_join("books", " "))
    kept = nodes.join(linked, "id", "left_semi").where(F.contains(text, F.lit(keyword.strip())))
    s = kept.select(F.col("id").alias("source"))
    return kept, active.join(s, "source", "left_semi").join(s.withColumnRenamed("source", "target"), "target", "left_semi")


