"""A search engine over chunks: built once into tables, opened from them, and asked by keyword and vector together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import snippet, terms
from graphloom.operators import retrieval

# What a model is told and what stands in for its reply.
RULES = "你是一位医学教学助手。根据以下教材原文回答用户问题。\n规则：1) 只基于提供的原文回答，不要编造；2) 引用时标注来源编号如 [1][2]；3) 如果原文不足以回答，明确说明。\n\n## 教材原文\n"
ASKED, REPLY = "\n\n## 用户问题\n", "\n\n请回答："
NO_HIT = "中未找到足够相关的内容。"


@dataclass(frozen=True)
class Engine:
    """postings (bucketed by term range), terms, corpus, chunks and, where there are vectors, vectors; all Parquet below a path."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def built(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/chunks/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def build(self, chunks: DataFrame, vectors: DataFrame | None = None, tokens=terms) -> Engine:
        """chunks(chunk_id, path, content), vectors(chunk_id, embedding).  The chunks are written last, so a broken build is built anew."""
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        write(retrieval.postings(chunks, tokens=tokens).repartitionByRange("term").sortWithinPartitions("term"), "postings")
        write(retrieval.statistics(chunks, tokens=tokens), "statistics")
        stats = self._table("statistics")
        write(retrieval.corpus(stats), "corpus")
        write(retrieval.idf(stats), "terms")
        if vectors is not None:
            write(vectors.select("chunk_id", "embedding"), "vectors")
        write(chunks.select("chunk_id", "path", "content"), "chunks")
        return self

    def built_from(self, chunks: Callable[[], DataFrame], vectors: Callable[[], DataFrame] | None = None) -> Engine:
        """This engine, built first if it is not yet."""
        return self if self.built() else self.build(chunks(), vectors() if vectors else None)

    def keyword(self, questions: DataFrame, tokens=terms) -> DataFrame:
        """query_id, chunk_id, score: only the postings of asked terms are read, as the terms prune row groups."""
        asked = questions.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        sought = [r.term for r in asked.select("term").distinct().limit(retrieval.ASKED + 1).collect()]
        index = self._table("postings")
        if len(sought) <= 1000:
            index = index.where(F.col("term").isin(sought))
        return retrieval.scores(index, asked, self._table("terms"), self._table("corpus"))

    def search(self, questions: DataFrame, k: int = 5, alpha: float = 0.5, tokens=terms) -> DataFrame:
        """query_id, rank, chunk_id, path, content (a snippet), score over questions(query_id, question, embedding).

        Without an embedding, or without vectors, the keyword part decides alone.
        """
        chunks = self._table("chunks").select("chunk_id")
        if "embedding" in questions.columns:
            far = retrieval.all_distances(self._table("vectors"), questions)
        else:
            far = chunks.crossJoin(F.broadcast(questions.select("query_id"))).withColumn("distance", F.lit(0.0))  # a stated query set
            alpha = 1.0
        hits = retrieval.fused(self.keyword(questions, tokens), far, k, alpha)
        return hits.join(self._table("chunks"), "chunk_id").select("query_id", "rank", "chunk_id", "path", snippet(F.col("content")).alias("content"), "score")


def prompts(questions: DataFrame, hits: DataFrame, context: int = 5, shown: int = 3) -> DataFrame:
    """query_id, question, citations, prompt, fallback: what a model is asked, and what is said without one."""
    cited = retrieval.citations(hits).select("query_id", F.struct("rank", "source", "chapter", "page", "snippet", "score").alias("c"))
    of = cited.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("citations"))  # k a question
    q = questions.select("query_id", "question").join(of, "query_id", "left")
    held = F.coalesce("citations", F.array().cast(of.schema["citations"].dataType))
    part = lambda c: F.concat(F.lit("["), c.rank.cast("string"), F.lit("] 来源：《"), c.source, F.lit("》，"), c.chapter, F.lit("（第"), c.page, F.lit("页）\n内容："), c.snippet)
    said = lambda c: F.concat(F.lit("- 《"), c.source, F.lit("》"), c.chapter, F.lit(": "), F.substring(c.snippet, 1, 120), F.lit("..."))
    prompt = F.concat(F.lit(RULES), F.array_join(F.transform(F.slice(held, 1, context), part), "\n\n"), F.lit(ASKED), "question", F.lit(REPLY))
    found = F.concat(F.lit("针对「"), "question", F.lit("」，检索到 "), F.size(held).cast("string"), F.lit(" 条相关段落。\n\n（LLM 暂不可用，检索结果直出）：\n"), F.array_join(F.transform(F.slice(held, 1, shown), said), "\n"))
    none = F.concat(F.lit("针对「"), "question", F.lit("」，在教材"), F.lit(NO_HIT))
    return q.select("query_id", "question", held.alias("citations"), prompt.alias("prompt"), F.when(F.size(held) > 0, found).otherwise(none).alias("fallback"))


def answers(asked: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """query_id, question, answer, citations of prompts(): the model's reply, or the fallback where it has none or there is nothing to cite."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "reply": model(pdf["prompt"].tolist())})

    kind = asked.schema["query_id"].dataType.simpleString()
    replies = asked.where(F.size("citations") > 0).select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, reply string")
    answer = F.coalesce(F.nullif("reply", F.lit("")), "fallback")
    return asked.join(replies, "query_id", "left").select("query_id", "question", answer.alias("answer"), "citations")


def status(spark: SparkSession, root: str, folders: dict[str, str]) -> DataFrame:
    """artifact, files: how many files lie below each folder of the root, 0 where it is missing."""
    hadoop, rows = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, folder in folders.items():
        at = hadoop.Path(f"{root}/{folder}")
        fs, n = at.getFileSystem(conf), 0
        if fs.exists(at):
            found = fs.listFiles(at, True)
            while found.hasNext():
                n += not found.next().getPath().getName().startswith(("_", "."))
        rows.append((name, n))
    return spark.createDataFrame(rows, "artifact string, files long")
