"""Splitting of markdown into sections and chunks, and the manifest of a section table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.noise import valid_concept
from graphloom.functions.text import clean_label, clean_text, file_safe, stem, strip, word_safe

HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*$"
PAGE = r"(?U)^<!--\s*page:\s*(\d+)\s*-->\s*$"
CHAPTER = r"(?U)^#\s+(第[一二三四五六七八九十]+章|绪论|前言|目录|附录)(.*)"
SECTION = r"(?U)^#+\s+(第[一二三四五六七八九十]+节)(.*)"


def _lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split(F.col(text), r"\R")).alias("pos", "raw"))


def split_sections(docs: DataFrame, keys: list[str], text: str = "markdown", default_title: Column | None = None) -> DataFrame:
    """keys, title, markdown, index, level, page_start, page_end: a section per heading with a body; a text without any is one section.

    Page markers carry forward; a section starts on the page that was current at its heading.
    """
    title0 = default_title if default_title is not None else F.lit("")
    order = Window.partitionBy(*keys).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(docs, keys, text).withColumn("line", F.regexp_replace("raw", r"(?U)\s+$", ""))
    rows = rows.withColumns({"head": F.col("line").rlike(HEADING), "page": F.nullif(F.regexp_extract("line", PAGE, 1), F.lit("")).cast("int")})
    rows = rows.withColumns({"part": F.sum(F.col("head").cast("int")).over(upto), "current": F.last("page", ignorenulls=True).over(upto)})
    body = ~F.col("line").rlike(r"(?U)^\s*#{1,6}\s+") & ~F.col("line").rlike(r"(?U)^\s*<!--.*-->\s*$") & (strip(F.col("line")) != "")
    parts = rows.groupBy(*keys, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("body"),
        F.min_by("line", "pos").alias("first"), F.bool_or("head").alias("has_head"),
        F.when(F.bool_or("head"), F.min_by("current", "pos")).alias("at_head"), F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos"))).alias("first_page"),
        F.max_by("current", "pos").alias("page_end"), F.bool_or(body).alias("meaningful"),
    )
    parts = parts.withColumn("markdown", clean_text(F.col("body"))).where(F.col("meaningful") & (F.col("markdown") != ""))
    found = parts.join(docs.select(*keys, title0.alias("__title")).dropDuplicates(keys), keys).select(
        *keys, clean_text(F.when(F.col("has_head"), F.regexp_extract("first", HEADING, 2)).otherwise(F.col("__title"))).alias("title"), "markdown",
        (F.row_number().over(Window.partitionBy(*keys).orderBy("part")) - 1).alias("index"),
        F.when(F.col("has_head"), F.length(F.regexp_extract("first", HEADING, 1))).otherwise(1).alias("level"),
        F.coalesce("at_head", "first_page").alias("page_start"), "page_end",
    )
    whole = docs.withColumn("__clean", clean_text(F.col(text))).where(F.col("__clean") != "").join(found.select(*keys).distinct(), keys, "left_anti")
    none = F.lit(None).cast("int")
    return found.unionByName(whole.select(*keys, title0.alias("title"), F.col("__clean").alias("markdown"), F.lit(0).alias("index"), F.lit(1).alias("level"), none.alias("page_start"), none.alias("page_end")))


def enrich(sections: DataFrame, book: str = "book_id") -> DataFrame:
    """Metadata of each section, as strings."""
    file = {}
    for k in ("file_size", "file_mtime"):
        if k in sections.columns:
            file[k] = F.col(k).cast("string")
    values = {"section_id": F.format_string("%s:%04d", F.col(book), F.col("index")), "char_count": F.length("markdown").cast("string"), **file}
    return sections.withColumn("metadata", F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))))


def manifest(sections: DataFrame, book: str = "book_id") -> DataFrame:
    """Per book: sections, characters, distinct pages with their range; the row with a null book holds the totals."""
    pages = F.when(F.col("page_start").isNotNull(), F.sequence("page_start", F.coalesce("page_end", "page_start")))
    counted = sections.rollup(book).agg(F.count("*").alias("sections"), F.sum(F.length("markdown")).alias("characters"))
    paged = sections.select(book, F.explode(pages).alias("page")).distinct().rollup(book).agg(F.count("*").alias("pages"), F.min("page").alias("page_min"), F.max("page").alias("page_max"))
    return counted.join(paged, counted[book].eqNullSafe(paged[book]), "left").select(counted[book], "sections", "characters", F.coalesce("pages", F.lit(0)).alias("pages"), "page_min", "page_max")


def chapter_chunks(docs: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """keys, part, chapter, section, content: a chunk per chapter or section line; a chapter resets the section."""
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(docs, keys, text)
    name = lambda p: F.nullif(file_safe(F.concat(strip(F.regexp_extract("raw", p, 1)), strip(F.regexp_extract("raw", p, 2)))), F.lit(""))
    rows = rows.withColumns({"chapter": name(CHAPTER), "section": name(SECTION)})
    rows = rows.withColumn("section", F.when(F.col("chapter").isNotNull(), F.lit("00_概要")).otherwise(F.col("section")))
    rows = rows.withColumns({"part": F.sum(F.col("section").isNotNull().cast("int")).over(upto), "chapter": F.last("chapter", ignorenulls=True).over(upto), "section": F.last("section", ignorenulls=True).over(upto)})
    return rows.groupBy(*keys, "part").agg(
        F.coalesce(F.first("chapter"), F.lit("00_绪论")).alias("chapter"), F.coalesce(F.first("section"), F.lit("00_开篇")).alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x.raw), "\n").alias("content"),
    )


def saved_chunks(chunks: DataFrame, book: list[str]) -> DataFrame:
    """Chunks under their file names; a later chunk of the same name overwrites, and collisions are counted."""
    named = chunks.where(F.length(strip(F.col("content"))) >= 10).withColumn("name", F.concat(F.substring(word_safe(F.col("chapter")), 1, 50), F.lit("_"), F.substring(word_safe(F.col("section")), 1, 50), F.lit(".md")))
    return named.groupBy(*book, "name").agg(F.max_by("content", "part").alias("content"), (F.count("*") - 1).alias("overwritten"))


def virtual_chunks(docs: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Chunks of a root text at headings of level 1 and 2 with a valid label; bodies under 20 characters are dropped."""
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _lines(docs, keys, text).withColumn("title", clean_label(F.col("raw")))
    rows = rows.withColumn("head", F.col("raw").rlike(r"(?U)^#{1,2}\s+\S") & valid_concept(F.col("title")))
    rows = rows.withColumns({"part": F.sum(F.col("head").cast("int")).over(upto), "title": F.last(F.when(F.col("head"), F.col("title")), ignorenulls=True).over(upto)})
    parts = rows.where("part > 0").groupBy(*keys, "part").agg(F.first("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x.raw), "\n").alias("content"))
    return parts.where(F.length(strip(F.col("content"))) >= 20)


def chunk_identity(chunks: DataFrame, path: str = "path", text: str = "content", book: str = "book_id") -> DataFrame:
    """chapter: first part of the file name; section: first heading, else the last part."""
    parts = F.filter(F.transform(F.split(stem(F.col(path)), "_"), clean_label), lambda p: p != "")
    heading = clean_label(F.regexp_extract(text, r"(?Um)^\s*(#.*)$", 1))
    chapter = F.coalesce(F.get(parts, F.lit(0)), F.col(book))
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(chapter)
    return chunks.withColumns({"chapter": chapter, "section": F.coalesce(F.nullif(heading, F.lit("")), last)})


def kept_chunks(docs: DataFrame, text: str = "content") -> DataFrame:
    return docs.where(F.length(strip(F.col(text))) > 20)
