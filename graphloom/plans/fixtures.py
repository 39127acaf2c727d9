"""Inputs of the registered queries: graphs, labels, markdown and replies derived from all rows of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of six books: suppliers and brands of all line items."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    odd = F.col("l_linenumber") % 2 == 1
    relation = F.element_at(F.array(*(F.lit(x) for x in ("prerequisite", "parallel", "containment", "application"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return l.join(s, "l_suppkey").join(p, "l_partkey").select(
        F.concat("l_returnflag", "l_linestatus").alias("book_id"), F.when(odd, F.col("s_name")).otherwise(F.col("p_brand")).alias("subject"), relation.alias("relation"),
        F.when(odd, F.col("p_brand")).otherwise(F.col("s_name")).alias("object"), F.col("l_discount").alias("confidence"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("evidence"),
        F.concat(F.lit("ch"), (F.col("l_orderkey") % 7).cast("string")).alias("chapter"), F.concat(F.lit("p"), (F.col("l_orderkey") % 3).cast("string")).alias("source_path"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    )


TRIPLES_A = """
a AS (
  SELECT l_returnflag || l_linestatus AS book_id, CASE WHEN l_linenumber % 2 = 1 THEN s_name ELSE p_brand END AS subject,
         CASE l_orderkey % 4 WHEN 0 THEN 'prerequisite' WHEN 1 THEN 'parallel' WHEN 2 THEN 'containment' ELSE 'application' END AS relation,
         CASE WHEN l_linenumber % 2 = 1 THEN p_brand ELSE s_name END AS object, l_discount AS confidence, 'order ' || l_orderkey AS evidence,
         'ch' || (l_orderkey % 7) AS chapter, 'p' || (l_orderkey % 3) AS source_path, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
), e AS (
  SELECT book_id, subject AS source, object AS target, arg_min(relation, seq) AS relation, max(confidence) AS confidence,
         string_agg(evidence, ';' ORDER BY seq) AS evidence, count(*) AS triples FROM a GROUP BY ALL
), m AS (
  SELECT source, target, arg_min(relation, book_id) AS relation, arg_min(confidence, book_id) AS confidence, string_agg(book_id, ',' ORDER BY book_id) AS books FROM e GROUP BY ALL
)"""


def edges_b(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """A graph with triangles, cycles and self-loops: customers, their suppliers, and the nations of both."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))
    pair = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    bought = pair(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")), name("C", "o_custkey"), name("S", "l_suppkey"))
    lives = pair(c, name("C", "c_custkey"), name("N", "c_nationkey")).unionByName(pair(s, name("S", "s_suppkey"), name("N", "s_nationkey")))
    around = pair(n, name("N", "n_nationkey"), name("N", F.col("n_nationkey") * F.col("n_nationkey") % 25)).unionByName(pair(c, name("N", F.col("c_custkey") % 25), name("C", "c_custkey")))
    every = bought.unionByName(lives).unionByName(around)
    return every.distinct() if distinct else every


EDGES_B = """
b AS (
  SELECT 'C' || o_custkey AS source, 'S' || l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION SELECT 'N' || n_nationkey, 'N' || (n_nationkey * n_nationkey % 25) FROM nation UNION SELECT 'N' || (c_custkey % 25), 'C' || c_custkey FROM customer
), ends AS (
  SELECT source AS id FROM b UNION ALL SELECT target FROM b
), und AS (
  SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM b WHERE source <> target
)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, markdown: conversations as texts with headings."""
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("## "), "role", F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x.t)
    return c.groupBy("conv_id").agg(F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(parts, "\n")).alias("markdown"))


MARKDOWN = """
md AS (
  SELECT conv_id, '# conv ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id
), ln AS (
  SELECT conv_id, i AS pos, regexp_replace(l[i], '\\s+$', '') AS line FROM (SELECT conv_id, string_split(markdown, chr(10)) AS l FROM md), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), pt AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS part FROM ln
), sec AS (
  SELECT conv_id, part, arg_min(line, pos) AS first, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\.{4,}', '...', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS body,
         bool_or(line <> '' AND NOT regexp_matches(line, '^\\s*#{1,6}\\s')) AS ok FROM pt GROUP BY conv_id, part
), sections AS (
  SELECT conv_id, regexp_extract(first, '^#{1,6}\\s+(.+?)\\s*$', 1) AS title, body AS markdown, row_number() OVER (PARTITION BY conv_id ORDER BY part) - 1 AS idx,
         length(regexp_extract(first, '^(#{1,6})\\s', 1)) AS level FROM sec WHERE ok
)"""


def nodes_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot nodes made of parts."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" "), "p_name").alias("essence"), F.concat("p_brand", F.lit(" part")).alias("reasoning"),
        F.array("p_brand").alias("books"), F.col("p_size").alias("val"), F.when(F.col("p_size") > 25, "merged").otherwise("concept").alias("type"),
    )


NODES_P = """
p AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS pos, p_name AS name, p_type || ' ' || p_name AS essence, p_brand || ' part' AS reasoning, p_brand AS book, p_size AS val,
         CASE WHEN p_size > 25 THEN 'merged' ELSE 'concept' END AS type FROM part
)"""

#: Labels for the text and noise functions.
LABELS = [
    "## 第一章 绪论", "一、心肌细胞的电生理", "(二)血液循环....... 12", "动作__电位  与 静息电位", "<!-- page: 3 -->心电图 | 检查：", "第 10 版", "主编 张三", "人民卫生出版社", "张三丰", "心脏", "心电图",
    "Cell membrane", "细胞膜的结构和功能", "12345", "03_生理学", "ISBN 978-7", "a1!!", "钱亦华", "免疫调节", "# Heading ...... 7", "—动脉粥样硬化。", "user@example.com", "某某大学基础医学院", "1.2 概念", "💡提示内容", "主要", "目录", "", "x", "……", "血压  的  调节;",
]
MARKS = [
    "# 第一章 循环\n## 心肌细胞的生理\n心肌细胞可用于心律失常诊断的研究工作。心电图检查用于评估心肌缺血的程度；短句。\n## 血管系统调节\n血管内皮功能异常可导致动脉粥样硬化的形成。\n",
    "# 前言\n没有标题的内容很短。\n", "正文没有标题,只有很长的一句话,说明神经系统与内分泌调节有关,参与代谢。",
    "# 绪论\n开头\n## 第一节 概述\n内容一内容一内容一\n## 第二节 方法\n内容二内容二内容二\n# 第二章 呼吸\n内容三内容三内容三\n## 第一节 概述\n内容四内容四内容四\n",
]
HEADS = ["第一章 总论", "一、定义", "(3)分类", "1.2 方法", "Big title", "第二节 内容", "绪论", "body", "Chapter 4", "第三编概说"]
DIRTY = ["a....b", "  x\t\ty  ", "p\n\n\n\nq", "全　角", "bad�char", "", ".....", "end \n"]


def picked(values: list[str], key):
    """The value whose number is the key modulo their count."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def picked_sql(values: list[str], key: str) -> str:
    return "([" + ", ".join("'%s'" % v.replace("'", "''") for v in values) + f"])[{key} % {len(values)} + 1]"


WORD = r"(\p{L}+)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, word (the first one), body (the whole text, with line feeds and blanks as its only blanks) of every document."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x09\\x0b-\\x1f\\x85\\u00a0\\u2028\\u2029\\u3000]", " ")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.regexp_extract(F.coalesce("text", F.lit("")), WORD, 1).alias("word"), t.alias("body"))


DOCUMENTS = r"""dw AS (SELECT doc_id AS i, regexp_extract(coalesce(text, ''), '(\p{L}+)', 1) AS word, regexp_replace(coalesce(text, ''), '[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]', ' ', 'g') AS body FROM documents)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, t: a label for every document, two thirds of them with a word of its own."""
    label = picked(LABELS, F.col("i"))
    return documents(spark, sf_dir).select("i", F.when(F.col("i") % 3 == 0, label).otherwise(F.concat(label, F.lit(" "), "word")).alias("t"))


LABELS_SQL = f"{DOCUMENTS}, lit AS (SELECT i, CASE WHEN i % 3 = 0 THEN {picked_sql(LABELS, 'i')} ELSE {picked_sql(LABELS, 'i')} || ' ' || word END AS t FROM dw)"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, t: markdown with chapters, sections and the whole text of every document."""
    return documents(spark, sf_dir).select("i", F.concat(picked(MARKS, F.col("i")), F.lit("\n## "), "word", F.lit("的结构\n"), "body").alias("t"))


MARKS_SQL = f"{DOCUMENTS}, lit AS (SELECT i, {picked_sql(MARKS, 'i')} || chr(10) || '## ' || word || '的结构' || chr(10) || body AS t FROM dw)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, t: what a model may say, with two words of every turn of a conversation."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("i"), *(F.regexp_extract(F.coalesce("text", F.lit("")), r"([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)", k).alias(f"w{k}") for k in (1, 2)))
    a, b = F.col("w1"), F.col("w2")
    said = [("YES, ", a, ""), ("no - ", a, ""), ("Maybe NO ", a, ""), (" It is YES ", a, " "), ("unclear ", a, ""), ("", a, ""), ('```json\n[{"subject": "ab', a, '", "relation": "contains", "object": "cd%s"}]\n```'), ('x {"subject": "q', a, '", "relation": "parallel", "object": "r%s"} y {broken} '), ('[not json {"subject": "s', a, '", "relation": "includes", "object": "t%s"}]')]
    forms = [F.concat(F.lit(x), y, F.lit(z.split("%s")[0]), *((b, F.lit(z.split("%s")[1])) if "%s" in z else ())) for x, y, z in said]
    return c.select("i", F.element_at(F.array(*forms), (F.col("i") % len(forms) + 1).cast("int")).alias("t"))


REPLIES_SQL = r"""cw AS (SELECT (conv_id * 1000 + turn)::BIGINT AS i, regexp_extract(coalesce(text, ''), '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 1) AS w1, regexp_extract(coalesce(text, ''), '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2) AS w2 FROM conversations)"""
