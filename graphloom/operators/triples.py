"""Rule-based triple extraction from chunks(book_id, chunk_pos, path, chapter, section, content).

Every triple carries seq = (chunk_pos, phase, idx), the order in which a sequential extractor would emit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.noise import noise_chunk, valid_concept
from graphloom.functions.text import clean_label, lines, sentences
from graphloom.operators.acyclic import accept_acyclic
from graphloom.operators.graph import dedup_triples

# Words that mark a sentence as an application, the topics sought in its absence, and the forms that such sentences have.
APPLICATION_HINTS = ("用于", "有助于", "有利于", "诊断", "治疗", "防治", "预防", "评估", "临床", "疾病", "病理", "综合征", "异常", "病例", "检查", "药物", "靶点", "手术")
TOPICS = ("诊断", "治疗", "防治", "预防", "评估", "疾病", "病理", "异常", "临床")
SUBJECT, OBJECT = r"([\x{4e00}-\x{9fa5}A-Za-z0-9α-ωΑ-Ωβγδμ\-]{2,18})", "([^。；;，,]{2,32})"
APPLICATIONS = (
    SUBJECT + "(?:可|能)?用于" + OBJECT,
    SUBJECT + "(?:有助于|有利于|参与|影响)" + OBJECT,
    SUBJECT + "(?:是|为)" + OBJECT + "(?:诊断|治疗|防治|预防|评估|基础|靶点)",
    SUBJECT + "(?:异常|障碍|缺陷)(?:可|会|能)?(?:导致|引起|造成)" + OBJECT,
    SUBJECT + "(?:与)" + OBJECT + "(?:有关|相关)",
)
MOST_APPLICATIONS = 6
KEEP = ["book_id", "chunk_pos", "path", "chapter", "section"]


def _triples(df: DataFrame, subject, relation: str, object_, evidence: Column, confidence: float | Column, phase: int, idx: Column) -> DataFrame:
    seq = F.struct(F.col("chunk_pos").cast("long").alias("chunk_pos"), F.lit(phase).alias("phase"), idx.cast("int").alias("idx"))
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select("book_id", F.col("path").alias("source_path"), "chapter", "section", subject.alias("subject"), F.lit(relation).alias("relation"), object_.alias("object"), evidence.alias("evidence"), sure.cast("double").alias("confidence"), F.lit("rule").alias("extractor"), seq.alias("seq"))


def subheadings(chunks: DataFrame) -> DataFrame:
    """KEEP, idx, heading: valid labels of headings of level 2 to 6, each once, in order."""
    rows = chunks.select(*KEEP, F.posexplode(lines(F.col("content"))).alias("pos", "raw")).where(F.col("raw").rlike(r"(?U)^\s*#{2,6}\s+\S"))
    rows = rows.withColumn("heading", clean_label(F.col("raw"))).where(valid_concept(F.col("heading")))
    first = rows.groupBy(*KEEP, "heading").agg(F.min("pos").alias("pos"))
    return first.withColumn("idx", F.row_number().over(Window.partitionBy("book_id", "chunk_pos").orderBy("pos"))).drop("pos")


def containment(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    book, chapter, section = F.col("book_id"), F.col("chapter"), F.col("section")
    a = _triples(chunks.where(valid_concept(chapter)), book, "containment", chapter, F.concat(book, F.lit(" > "), chapter), 0.95, 1, F.lit(0))
    b = _triples(chunks.where(valid_concept(section) & (chapter != section)), chapter, "containment", section, F.concat(chapter, F.lit(" > "), section), 0.9, 2, F.lit(0))
    c = _triples(heads, section, "containment", F.col("heading"), F.concat(section, F.lit(" > "), F.col("heading")), 0.88, 3, F.col("idx"))
    return a.unionByName(b).unionByName(c)


def adjacent(heads: DataFrame) -> DataFrame:
    return heads.withColumn("next", F.lead("heading").over(Window.partitionBy("book_id", "chunk_pos").orderBy("idx"))).where("next is not null")


def parallel(heads: DataFrame) -> DataFrame:
    """Neighbouring headings, in both directions."""
    both = adjacent(heads).select(*KEEP, "idx", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("heading").alias("s"), F.col("next").alias("o")), F.struct(F.lit(1).alias("d"), F.col("next").alias("s"), F.col("heading").alias("o")))).alias("x"))
    return _triples(both, F.col("x.s"), "parallel", F.col("x.o"), F.concat("x.s", F.lit(" | "), "x.o"), 0.78, 5, F.col("idx") * 2 + F.col("x.d"))


def section_order(chunks: DataFrame) -> DataFrame:
    """Each section of a book after the one before it."""
    order = chunks.withColumn("before", F.lag("section").over(Window.partitionBy("book_id").orderBy("chunk_pos"))).where("before is not null")
    return _triples(order, F.col("before"), "prerequisite", F.col("section"), F.concat("before", F.lit(" -> "), "section"), 0.65, 7, F.lit(0))


def prerequisites(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """Heading order within chunks and section order across them, as far as no cycle comes of it."""
    a = _triples(adjacent(heads), F.col("heading"), "prerequisite", F.col("next"), F.concat("heading", F.lit(" -> "), "next"), 0.68, 4, F.col("idx"))
    c = a.unionByName(section_order(chunks)).withColumnsRenamed({"subject": "source", "object": "target"})
    return accept_acyclic(c).where("accepted").drop("accepted").withColumnsRenamed({"source": "subject", "target": "object"})


def topic(sentence: Column) -> Column:
    """The text around the first topic that a sentence has."""
    around = [F.when(F.instr(sentence, t) > 0, F.substring(F.regexp_replace(clean_label(F.substr(sentence, F.greatest(F.lit(1), F.instr(sentence, t) - 10), F.instr(sentence, t) + 17 - F.greatest(F.lit(0), F.instr(sentence, t) - 11))), "^[，,。；;、]+", ""), 1, 32)) for t in TOPICS]
    return F.coalesce(*around, F.lit(""))


def applications(chunks: DataFrame) -> DataFrame:
    """Per chunk up to six sentences that say what something is used for, related to or causes."""
    s = F.col("sentence")
    rows = chunks.select(*KEEP, F.posexplode(sentences(F.col("content"))).alias("idx", "sentence")).where(s.rlike("|".join(APPLICATION_HINTS)))
    # candidates in order of preference, the topic last; each is cleaned and tested once
    found = [F.struct(F.lit(k).alias("order"), F.regexp_extract(s, p, 1).alias("subject"), F.regexp_extract(s, p, 2).alias("object"), F.lit(0.72).alias("confidence")) for k, p in enumerate(APPLICATIONS)]
    found.append(F.struct(F.lit(len(APPLICATIONS)).alias("order"), F.col("section").alias("subject"), topic(s).alias("object"), F.lit(0.62).alias("confidence")))
    rows = rows.select(*KEEP, "idx", "sentence", F.inline(F.array(*found))).where("subject <> '' and object <> ''")
    tail = F.when(F.col("order") < len(APPLICATIONS), F.regexp_replace(clean_label(F.col("subject")), "[可能]$", "")).otherwise(F.col("subject"))
    rows = rows.withColumns({"subject": tail, "object": clean_label(F.col("object"))}).where(valid_concept(F.col("subject"))).where(valid_concept(F.col("object")))
    rows = rows.groupBy(*KEEP, "idx", "sentence").agg(F.min_by(F.struct("subject", "object", "confidence"), "order").alias("found"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "chunk_pos").orderBy("idx"))).where(F.col("n") <= MOST_APPLICATIONS)
    return _triples(rows, F.col("found.subject"), "application", F.col("found.object"), F.substring(s, 1, 160), F.col("found.confidence"), 6, F.col("idx"))


def extract(chunks: DataFrame) -> DataFrame:
    """All triples of the chunks that are not noise, the first of equal ones."""
    noise = noise_chunk(F.col("section"), F.col("content")) & (F.length("content") < 1200)
    kept = chunks.where(~noise)
    heads = subheadings(kept)
    return dedup_triples(containment(kept, heads).unionByName(prerequisites(kept, heads)).unionByName(parallel(heads)).unionByName(applications(kept)))
