"""Compression of a graph and its chunks into a budgeted text: summaries, rendering, strict budget, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import plain_sentences, strip
from graphloom.operators.order import running

# Words that mark a key passage; names of the tiers; the note at the cut.
KEYWORDS = (
    "动脉", "静脉", "神经", "血管", "淋巴", "心脏", "肺", "肝", "肾", "胃", "肠", "脑", "脊髓", "骨骼", "肌肉", "关节", "皮肤", "细胞", "组织", "器官", "系统", "功能", "结构", "解剖",
    "病理", "生理", "临床", "诊断", "治疗", "手术", "药物", "感染", "炎症", "肿瘤", "免疫", "代谢", "内分泌", "遗传", "综合征", "疾病", "症状", "体征", "检查", "影像",
)
TIERS = {1: "核心知识", 2: "重点知识", 3: "了解知识", 4: "拓展知识"}
NOTE = "> 已达到 30% 预算，后续低优先级条目省略。"


def summary(text: Column, label: Column, n: int = 80) -> Column:
    """First sentence of over eight characters that captions no figure or table, cut at n; else the label."""
    s = F.filter(plain_sentences(text), lambda x: (F.length(x) > 8) & ~x.startswith("图") & ~x.startswith("表"))
    raw = F.when(F.size(s) > 0, F.concat(F.get(s, F.lit(0)), F.lit("。"))).otherwise(label)
    return F.concat(F.substring(raw, 1, n), F.when(F.length(raw) > n, "…").otherwise(""))


def key_passages(text: Column, keywords: tuple[str, ...] = KEYWORDS, most: int = 5) -> Column:
    return F.slice(F.filter(plain_sentences(text), lambda x: x.rlike("|".join(keywords))), 1, most)


# What a model is asked for, by tier.
ASK = ("请用一句话（不超过80字）总结以下医学教材文本的核心知识点。知识点：", "\n\n原文：\n", "\n\n摘要：")
ASK_SHORT = ("用一句话概括：", "\n", "\n摘要：")


def summary_prompt(tier: Column, label: Column, text: Column) -> Column:
    """What a model is asked for a node of tier 1 to 3; null for tier 4 and for nodes without a text."""
    long, short = F.substring(text, 1, 1500), F.substring(text, 1, 500)
    prompt = F.when(tier <= 2, F.concat(F.lit(ASK[0]), label, F.lit(ASK[1]), long, F.lit(ASK[2]))).otherwise(F.concat(F.lit(ASK_SHORT[0]), label, F.lit(ASK_SHORT[1]), short, F.lit(ASK_SHORT[2])))
    return F.when((tier < 4) & (F.coalesce(text, F.lit("")) != ""), prompt)


def model_summary(tier: Column, reply: Column, label: Column, text: Column) -> Column:
    """A model's reply within its bounds, else what the rules say."""
    said = F.nullif(strip(F.coalesce(reply, F.lit(""))), F.lit(""))
    return F.when((tier < 4) & said.isNotNull(), F.substring(said, 1, F.when(tier <= 2, 150).otherwise(100))).otherwise(fallback_summary(tier, label, text))


def fallback_summary(tier: Column, label: Column, text: Column) -> Column:
    """The first two sentences that caption nothing; tier 4 is cut at 80 characters."""
    s = F.slice(F.filter(plain_sentences(F.coalesce(text, F.lit(""))), lambda x: (F.length(x) > 8) & ~x.startswith("图") & ~x.startswith("表")), 1, 2)
    raw = F.when(F.size(s) > 0, F.concat(F.array_join(s, "。"), F.lit("。"))).otherwise(label)
    return F.when(tier == 4, F.substring(raw, 1, 80)).otherwise(raw)


def preview(nodes: DataFrame, text: str = "content", n: int = 200) -> DataFrame:
    """Nodes as they are stored: the start of the text in place of the text."""
    return nodes.withColumn("chunk_content_preview", F.substring(text, 1, n)).drop(text)


def active_report(raw: DataFrame, strict: DataFrame, by: str, target: float = 0.3) -> DataFrame:
    """One report of both by key: the strict one's figures where there is one, else the raw one's."""
    s = strict.select(by, *(F.col(c).alias(f"__{c}") for c in ("original_chars", "compressed_chars", "ratio")))
    both = raw.join(s, by, "left")
    pick = {c: F.coalesce(f"__{c}", c).alias(c) for c in ("original_chars", "compressed_chars", "ratio")}
    return both.select(by, *pick.values(), F.col("ratio").alias("raw_ratio"), (F.coalesce("__ratio", "ratio") <= target).alias("target_met"), F.col("__ratio").isNotNull().alias("strict"))


def two_sentences(text: Column) -> Column:
    """What stands in for a model's summary."""
    return F.array_join(F.slice(plain_sentences(text), 1, 2), "。")


def rendered(nodes: DataFrame) -> DataFrame:
    """tier, rank, lines of nodes(id, label, tier, score, summary, content, passages): a list item for tiers 3 and 4, a headed entry above.

    Only ids, tiers and scores are put in order; the texts join their ranks once.
    """
    numbered = running(nodes.select("id", "tier", "score"), [F.col("tier"), F.desc("score"), F.col("id")], "__n")
    starts = numbered.groupBy("tier").agg((F.min("__n") - 1).alias("__start"))  # a row per tier
    ranks = numbered.join(F.broadcast(starts), "tier").select(F.col("id").alias("__id"), F.col("tier").alias("__tier"), (F.col("__n") - F.col("__start")).cast("int").alias("rank"))
    n = nodes.drop("rank").join(ranks, (F.col("id") == F.col("__id")) & (F.col("tier") == F.col("__tier"))).drop("__id", "__tier")
    quote = F.when(F.coalesce("summary", F.lit("")) != "", F.array(F.concat(F.lit("> "), "summary"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    content = F.coalesce("content", F.lit(""))
    cut = F.when(F.length(content) > 300, F.array(F.lit(""), F.lit("*(原文已截断)*"))).otherwise(F.array().cast("array<string>"))
    excerpt = F.when((F.col("tier") == 1) & (content != ""), F.concat(F.array(F.lit("<details>"), F.lit("<summary>📖 原文摘录</summary>"), F.lit(""), F.substring(content, 1, 300)), cut, F.array(F.lit(""), F.lit("</details>"), F.lit("")))).otherwise(F.array().cast("array<string>"))
    passages = F.when((F.col("tier") == 2) & (F.size("passages") > 0), F.concat(F.transform(F.slice("passages", 1, 2), lambda p: F.concat(F.lit("- "), F.substring(p, 1, 120))), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.format_string("### %d. %s", "rank", "label"), F.lit(""))
    item = F.array(F.concat(F.lit("- **"), "label", F.lit("**: "), F.substring("summary", 1, 60)))
    return n.select("tier", "rank", "id", F.when(F.col("tier") >= 3, item).otherwise(F.concat(head, quote, excerpt, passages)).alias("lines"))


def strict_budget(lines: DataFrame, budget: Column | int, doc: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines(doc, pos, line) kept within a budget of characters: headings, quotes, links and blanks, up to the first that overflows.

    `<details>` blocks are expected to be gone (see without_details); relation lines and body text are left out.
    """
    t = F.regexp_replace(F.col(line), r"(?U)\s+$", "")
    kept = lines.withColumn("kept", t).where(~t.startswith("*关联:") & (t.startswith("#") | t.startswith(">") | t.startswith("- [") | t.startswith("**摘要**") | (t == "")))
    used = F.sum(F.length("kept") + 1).over(Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kept.withColumn("used", used).where(F.col("used") < budget).select(doc, pos, "kept", "used")


def without_details(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<details>.*?</details>", ""), r"\n{3,}", "\n\n")


def budget(original: Column, ratio: float = 0.3) -> Column:
    """Characters allowed: the share of the original, 2000 at least for originals of 10000 and more."""
    b = F.floor(original * ratio)
    return F.when(original >= 10_000, F.greatest(b, F.lit(2000))).otherwise(b)


def cut_to(text: Column, allowed: Column) -> Column:
    """The hard cut that follows when a kept text is still too long."""
    note = f"\n{NOTE}\n"
    return F.when(F.length(text) > allowed, F.concat(F.regexp_replace(F.substr(text, F.lit(1), F.greatest(F.lit(0), allowed - len(note))), r"(?U)\s+$", ""), F.lit(note))).otherwise(text)


def compression(nodes: DataFrame, original: str, compressed: str) -> DataFrame:
    """Node count, share of tier 1 (the reported core coverage), characters before and after, ratio."""
    r = nodes.agg(F.count("*").alias("nodes"), F.avg((F.col("tier") == 1).cast("double")).alias("core_coverage"), F.sum(original).alias("original_chars"), F.sum(compressed).alias("compressed_chars"))
    return r.withColumn("ratio", F.col("compressed_chars") / F.greatest("original_chars", F.lit(1)))


def coverage(nodes: DataFrame) -> DataFrame:
    """Per tier: nodes, and those with a text of their own."""
    return nodes.groupBy("tier").agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("content", F.lit("")) != "").alias("mapped"))


def tier_samples(nodes: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), "id"))
    return nodes.withColumn("rank", rank).where(F.col("rank") <= k).select("tier", "rank", "id", F.bround("score", 4).alias("score"), F.substring("summary", 1, 100).alias("summary"))
