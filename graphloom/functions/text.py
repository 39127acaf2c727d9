"""Scalar text functions as Column expressions.  Patterns carry (?U), so that blanks and word characters are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"


def strip(c: Column) -> Column:
    """Blanks of any alphabet off both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, r"\R")


def clean_text(c: Column) -> Column:
    c = F.translate(c, "　\x08�", " ")
    for pattern, to in ((r"\.{4,}", "..."), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def clean_text_script(c: Column) -> Column:
    """The batch script's cleaning: control marks and long dot leaders only."""
    return strip(F.regexp_replace(F.translate(c, "\x08�", ""), r"\.{4,}", "..."))


# What is taken off a label, in this order.
LABEL_STEPS = (
    (r"(?U)^#+\s*", ""), (r"(?U)\.{3,}\s*\d*\s*$", ""), (r"(?U)[_\s]+", " "),
    (r"(?U)^[一二三四五六七八九十]+[、.．]\s*", ""), (r"(?U)^[(（][一二三四五六七八九十\d]+[)）]\s*", ""),
)


def clean_label(c: Column) -> Column:
    """A heading or path part as a label: without comments, marks, dot leaders, underscores and numbering."""
    c = strip(F.regexp_replace(c, r"<!--.*?-->", ""))
    for pattern, to in LABEL_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return F.btrim(c, F.lit(" \t\r\n-—|:：，,。；;"))


def display_label(c: Column) -> Column:
    """A label for the exported snapshot."""
    c = strip(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f]", ""), r"(?U)\s+", " "))
    return F.substring(F.regexp_replace(c, r"(?U)\.{3,}\s*\d*$", ""), 1, 60)


def undigited(c: Column) -> Column:
    """A label without digits, blanks, bars and dots, for searching in chunk texts."""
    return F.regexp_replace(c, r"(?U)[\d\s|｜·…]+", "")


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def book_id(path: Column) -> Column:
    return F.coalesce(F.nullif(strip(stem(path)), F.lit("")), F.lit("untitled"))


def letter_ratio(c: Column) -> Column:
    """Letters of any alphabet per character; 0 for the empty string."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences of a markdown text without headings and blanks, cut after full stops and semicolons."""
    flat = F.regexp_replace(F.regexp_replace(c, r"(?Um)^#{1,6}\s+.*$", ""), r"(?U)\s+", "")
    return F.filter(F.split(flat, r"(?<=[。；;])"), lambda s: F.length(s) >= least)


def plain_sentences(c: Column) -> Column:
    """Sentences for summaries: markup stripped, cut at stops, semicolons and line ends, over five characters."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "#+ ", ""), r"\*+", ""), "[│|]", "")
    return F.filter(F.transform(F.split(c, r"[。；\n]"), strip), lambda s: F.length(s) > 5)


def first_label(c: Column) -> Column:
    """First line that is not empty as a label; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(lines(c), clean_label), lambda x: x != ""), F.lit(0)), F.lit(""))


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|]', "_")


def word_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w]", "_")


def natural_key(c: Column) -> Column:
    """Digit runs padded, so that the key sorts numbers by value."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def markdown_table(rows: Column) -> Column:
    """A pipe table of an array of rows of cells; ragged rows are padded, empty ones dropped."""
    cell = lambda x: F.replace(F.replace(clean_text(F.coalesce(x, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    kept = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    padded = F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    show = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    body = F.when(F.size(padded) > 1, F.transform(F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(1))), show)).otherwise(F.array(show(F.array_repeat(F.lit(""), width))))
    table = F.concat(F.array(show(F.get(padded, F.lit(0))), show(F.array_repeat(F.lit("---"), width))), body)
    return F.when(F.size(kept) == 0, "").otherwise(F.array_join(table, "\n"))


# Numberings that make a heading, and its level, in the order in which they are tried.
HEADING_RULES = (
    (r"^(绪论|前言|导论|总论)$", 1),
    (r"(?i)^(chapter|part|section)\s+\d+", 1),
    (r"^第\s*[一二三四五六七八九十百零〇\d]+\s*[篇编章]\b", 1),
    (r"^第\s*[一二三四五六七八九十百零〇\d]+\s*节\b", 2),
    (r"^[一二三四五六七八九十]+[、.．]\s*", 3),
    (r"^[(（][一二三四五六七八九十\d]+[)）]\s*", 4),
    (r"^\d+(?:\.\d+){1,3}\s+", 3),
)


def heading_level(text: Column, size: Column, common: Column, largest: Column, bold: Column) -> Column:
    """Heading level of a text block: numbering first, then fonts; 0 for body text.  largest: the largest heading size, if any."""
    t = clean_text(text)
    font = F.when(size >= common + 2.5, F.when(largest.isNull() | (size >= largest - 0.2), 1).otherwise(2)).when((size >= common + 1.2) | (bold & (size >= common + 0.5)), 3).otherwise(0)
    numbered = [F.when(t.rlike("(?U)" + p), level) for p, level in HEADING_RULES]
    return F.coalesce(*numbered, F.when((F.length(t) > 60) | (common <= 0), 0).otherwise(font))


# What the batch script takes for a heading, and what marks a case study.
SCRIPT_CHAPTER, SCRIPT_ITEM, SCRIPT_CASE = "^(第[一二三四五六七八九十]+[章节]|绪论|前言)", "^[一二三四五六七八九十]、", "病例"


def heading_level_script(text: Column, size: Column, common: Column, sizes: Column) -> tuple[Column, Column]:
    """Level and text of a block as the batch script has them: numbering before fonts; case studies keep level 0 and get a mark.

    sizes: the sizes above the common one, largest first.
    """
    t = clean_text_script(text)
    second = F.when(F.size(sizes) > 1, F.get(sizes, F.lit(1))).otherwise(size)
    font = F.when(size <= common + 1, 0).when(size >= F.coalesce(F.get(sizes, F.lit(0)), size), 1).when(size >= second, 2).otherwise(3)
    level = F.when(t.rlike(SCRIPT_CHAPTER), 1).when(t.rlike(SCRIPT_ITEM), 3).when(t.contains(SCRIPT_CASE), 0).otherwise(font)
    numbered = t.rlike(SCRIPT_CHAPTER) | t.rlike(SCRIPT_ITEM)
    return level, F.when(~numbered & t.contains(SCRIPT_CASE), F.concat(F.lit("### 💡 "), t)).otherwise(t)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def size_text(c: Column) -> Column:
    """Bytes in units of 1024 with up to two decimals."""
    unit = F.when(c < 1, 0).otherwise(F.least(F.lit(4), F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)) + 1e-12)))
    value = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c / F.pow(F.lit(1024.0), unit)), r"0+$", ""), r"\.$", "")
    return F.concat(F.when(c < 1, F.lit("0")).otherwise(value), F.lit(" "), F.get(F.array(*(F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB"))), unit.cast("int")))


def snippet(c: Column, n: int = 500) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat(*parts)), 1, 12)


def page_of(name: Column) -> Column:
    """First all-digit part of an underscored name."""
    return F.coalesce(F.get(F.filter(F.split(name, "_"), lambda p: p.rlike(r"^\d+$")), F.lit(0)), F.lit(""))


def unfenced(c: Column) -> Column:
    """A model's reply without code fences."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s*```(?:json)?\s*", ""), r"(?U)\s*```\s*$", ""))


def json_objects(reply: Column, schema: str) -> Column:
    """Objects in a model's reply: its outermost array if that parses, else every flat object that does."""
    plain = unfenced(reply)
    whole = F.from_json(F.nullif(F.regexp_extract(plain, r"(?s)\[.*\]", 0), F.lit("")), f"array<{schema}>")
    flat = F.filter(F.transform(F.regexp_extract_all(plain, F.lit(r"\{[^{}]*\}"), 0), lambda o: F.from_json(o, schema)), lambda o: F.to_json(o) != "{}")
    return F.when(F.size(F.filter(whole, lambda o: F.to_json(o) != "{}")) > 0, whole).otherwise(flat)


def verdict(reply: Column) -> Column:
    """(same, confidence) of a yes/no reply: sure at its start, less so within ten characters, else undecided."""
    t, head = F.upper(F.btrim(reply)), F.substring(F.upper(F.btrim(reply)), 1, 10)
    same = F.when(t.startswith("YES"), True).when(t.startswith("NO"), False).when(head.contains("YES"), True).otherwise(False)
    sure = F.when(t.startswith("YES"), 0.75).when(t.startswith("NO"), 0.85).when(head.contains("YES"), 0.7).when(head.contains("NO"), 0.8).otherwise(0.5)
    return F.struct(same.alias("same"), sure.alias("confidence"))


def terms(c: Column) -> Column:
    """Default tokens: lower-case words, digits, and two-character pieces of CJK runs; a segmenter can be put in its place."""
    t = F.lower(c)
    words = F.regexp_extract_all(t, F.lit(r"([a-z0-9]+)"), 1)
    runs = F.regexp_extract_all(t, F.lit(f"([{CJK}]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(words, pairs)
