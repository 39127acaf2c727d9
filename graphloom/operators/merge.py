"""Alignment and merging of per-book graphs, with a decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.noise import MERGER
from graphloom.functions.text import strip, undigited
from graphloom.operators.order import running


def book_nodes(triples: DataFrame) -> DataFrame:
    return triples.select("book_id", F.explode(F.array("subject", "object")).alias("label")).distinct()


def filter_noise(triples: DataFrame, noise=MERGER) -> DataFrame:
    return triples.where(~noise(F.col("subject")) & ~noise(F.col("object")))


def noise_stats(triples: DataFrame, noise=MERGER) -> DataFrame:
    """Per book: triples before and after, noise nodes."""
    hit = noise(F.col("subject")) | noise(F.col("object"))
    t = triples.groupBy("book_id").agg(F.count("*").alias("before"), F.count_if(~hit).alias("after"))
    n = book_nodes(triples).groupBy("book_id").agg(F.count_if(noise(F.col("label"))).alias("noise_nodes"))
    return t.join(n, "book_id").withColumn("removed", F.col("before") - F.col("after"))


def exact_matches(nodes: DataFrame) -> DataFrame:
    """Labels of two or more characters that two or more books share."""
    label = strip(F.col("label"))
    return nodes.where(F.length(label) >= 2).groupBy(label.alias("label")).agg(F.array_sort(F.collect_set("book_id")).alias("books")).where(F.size("books") >= 2).withColumn("confidence", F.lit(0.95))


def conflicts(edges: DataFrame, compat: bool = False) -> DataFrame:
    """Edges of one relation in both directions.

    Once per pair and without the symmetric relation; compat: once per direction, self-loops and parallel edges included.
    """
    e = edges.groupBy("source", "target", "relation").agg(F.array_sort(F.collect_list("book_id")).alias("books"))
    back = e.select(F.col("source").alias("target"), F.col("target").alias("source"), "relation", F.col("books").alias("back_books"))
    both = e.join(back, ["source", "target", "relation"])
    if not compat:
        both = both.where("source < target and relation <> 'parallel'")
    return both.select("source", "target", "relation", F.concat("books", "back_books").alias("books"), F.lit(0.5).alias("confidence"))


def complements(edges: DataFrame) -> DataFrame:
    """For each ordered pair of books and shared node: edges out of it that the first book has and the second lacks."""
    nodes = edges.select("book_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    pairs = edges.select("book_id", "source", "target").distinct()
    held = pairs.join(nodes.select(F.col("book_id").alias("other"), F.col("id").alias("source")), "source").where("other <> book_id")
    lacking = held.join(pairs.select(F.col("book_id").alias("other"), "source", "target"), ["other", "source", "target"], "left_anti")
    return lacking.groupBy("book_id", "other", "source").agg(F.count("*").alias("missing")).withColumn("confidence", F.lit(0.7))


def semantic_candidates(hits: DataFrame, labels: DataFrame, least: float = 0.7, snippet: int = 500, auto: float = 0.85) -> DataFrame:
    """For each retrieved snippet of a node the first node of a later book that it names, each pair once by its best score.

    Chunks are taken by falling score; a pair that one of auto or more has given is passed over in the next ones.

    hits(book_id, label, chunk_id, score, content), labels(book_id, label): a label's first four characters propose the pairs,
    containment decides.
    """
    head = F.substring("content", 1, snippet)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(head) - 3, F.lit(1))), lambda i: F.substr(head, i, F.lit(4))))
    h = hits.where((F.col("score") >= least) & (F.length("label") >= 4)).select(F.col("book_id").alias("b1"), F.col("label").alias("l1"), "chunk_id", "score", head.alias("head"), grams.alias("grams"))
    l = labels.where(F.length("label") >= 4).select(F.col("book_id").alias("b2"), F.col("label").alias("l2"), F.substring("label", 1, 4).alias("gram"))  # noqa: E741
    pairs = h.withColumn("gram", F.explode("grams")).drop("grams").join(l, "gram")
    found = pairs.where((F.col("b2") > F.col("b1")) & F.contains("head", "l2") & (F.col("l1") != F.col("l2"))).select("b1", "l1", "chunk_id", "score", "b2", "l2").distinct()
    named = found.groupBy("b1", "l1", "chunk_id", "score").agg(F.array_sort(F.collect_list(F.struct("b2", "l2"))).alias("named"))
    chunks = named.groupBy("b1", "l1").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "chunk_id", "score", "named"))).alias("chunks"))
    kind = "array<struct<b2:string,l2:string,chunk_id:%s,score:double>>" % named.schema["chunk_id"].dataType.simpleString()

    def take(held, c):
        sure = F.transform(F.filter(held, lambda x: x.score >= auto), lambda x: F.struct(x.b2.alias("b2"), x.l2.alias("l2")))
        free = F.slice(F.filter(c.named, lambda m: ~F.array_contains(sure, m)), 1, 1)
        new = F.transform(free, lambda m: F.struct(m.b2.alias("b2"), m.l2.alias("l2"), c.chunk_id.alias("chunk_id"), c.score.cast("double").alias("score")))
        return F.concat(held, new).cast(kind)

    held = chunks.select("b1", "l1", F.explode(F.aggregate("chunks", F.array().cast(kind), take)).alias("x")).select("b1", "l1", "x.*")
    best = Window.partitionBy("b1", "l1", "b2", "l2").orderBy(F.desc("score"), "chunk_id")
    return held.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def verdicts(candidates: DataFrame, auto: float = 0.85, replies: DataFrame | None = None) -> DataFrame:
    """merge above the threshold; below, what the classifier's replies(b1, l1, l2, same, confidence) say, else pending."""
    if replies is None:
        replies = candidates.select("b1", "l1", "l2", F.lit(None).cast("boolean").alias("same"), F.lit(None).cast("double").alias("confidence"))
    sure = F.when(F.col("score") >= auto, F.col("score")).when(F.col("same"), F.col("confidence")).when(~F.col("same"), F.greatest(F.lit(0.1), F.col("score") - 0.4)).otherwise(F.col("score"))
    return candidates.join(replies, ["b1", "l1", "l2"], "left").select("b1", "l1", "b2", "l2", "score", F.bround(sure, 3).alias("confidence"), ((F.col("score") >= auto) | F.col("same").isNotNull()).alias("resolved"))


def decision_log(*decisions: tuple[str, DataFrame]) -> DataFrame:
    """decision_id, type, nodes, books, confidence over decisions(nodes, books, confidence), numbered by type and content.

    Numbers run through the whole log, by ranges of its order.
    """
    rows = None
    for phase, (kind, d) in enumerate(decisions):
        one = d.select(F.lit(phase).alias("phase"), F.lit(kind).alias("type"), "nodes", "books", F.bround("confidence", 3).alias("confidence"))
        rows = one if rows is None else rows.unionByName(one)
    numbered = running(rows, [F.col(c) for c in ("phase", "nodes", "books", "confidence")], "number")
    return numbered.select(F.format_string("D%05d", "number").alias("decision_id"), "type", "nodes", "books", "confidence")


def merge_report(per_book: DataFrame, merged: DataFrame, decisions: DataFrame) -> DataFrame:
    ends = lambda e, *by: e.select(*by, F.explode(F.array("source", "target")).alias("id")).distinct()
    before = per_book.agg(F.count("*").alias("edges_before")).crossJoin(ends(per_book, "book_id").agg(F.count("*").alias("nodes_before")))
    after = merged.agg(F.count("*").alias("edges_after")).crossJoin(ends(merged).agg(F.count("*").alias("nodes_after")))
    kinds = decisions.agg(*(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("merge", "conflict", "complement")))
    ratio = F.round(1 - F.col("nodes_after") / F.greatest("nodes_before", F.lit(1)), 6)
    return before.crossJoin(after).crossJoin(kinds).withColumn("dedup_ratio", ratio)  # one-row frames


#: Characters of labels that one automaton holds; more labels are more automata, run over a text one after another.
BLOCK_CHARS = 2_000_000


def label_in_chunk(labels: DataFrame, chunks: DataFrame, top: int = 3, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """label, chunk_id, score, rank: chunks that contain a label, the earlier the better.

    One pass over the chunks: an automaton of all labels finds the first place of each, and only numbers leave the task.
    """
    spark = chunks.sparkSession
    rows = labels.select("label", undigited(F.col("label")).alias("needle")).where(F.length("needle") >= 2).groupBy("needle").agg(F.collect_set("label").alias("labels"))
    blocks, part, size = [], [], 0
    for r in rows.toLocalIterator():
        part.append((r.needle, sorted(r.labels)))
        size += len(r.needle)
        if size >= block_chars:
            blocks.append(spark.sparkContext.broadcast(part))
            part, size = [], 0
    if part:
        blocks.append(spark.sparkContext.broadcast(part))

    def automata():
        import ahocorasick

        for b in blocks:
            one = ahocorasick.Automaton()
            for needle, of in b.value:
                one.add_word(needle, (len(needle), of))
            one.make_automaton()
            yield one

    def run(batches):
        import pyarrow as pa

        built = list(automata()) if len(blocks) == 1 else None
        for batch in batches:
            found = {"row": [], "label": [], "at": [], "length": []}
            texts = [t.as_py() or "" for t in batch.column(1)]
            for one in built or automata():
                for i, t in enumerate(texts):
                    first: dict[str, tuple[int, list[str]]] = {}
                    for end, (n, of) in one.iter(t):
                        first.setdefault(of[0], (end - n + 1, of))
                    for at, of in first.values():
                        for label in of:
                            for k, v in zip(found, (i, label, at, len(t)), strict=True):
                                found[k].append(v)
            ids = batch.column(0).take(pa.array(found["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found["label"], pa.string()), pa.array(found["at"], pa.int64()), pa.array(found["length"], pa.int64())], names=["chunk_id", "label", "at", "length"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    hit = chunks.select("chunk_id", F.col("content").cast("string").alias("content")).mapInArrow(run, f"chunk_id {kind}, label string, at long, length long")
    scored = hit.select("label", "chunk_id", (1 - F.col("at") / F.col("length")).alias("score"))
    best = Window.partitionBy("label").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def relevant(decisions: DataFrame, live: DataFrame, compat: bool = False) -> DataFrame:
    """Merge decisions of confidence 0.7 or more with two or more nodes that exist; book prefixes are stripped unless compat."""
    node: Column = F.col("node") if compat else F.element_at(F.split("node", "::"), -1)
    rows = decisions.where("type = 'merge' and confidence >= 0.7").select("decision_id", F.posexplode("nodes").alias("pos", "node")).withColumn("id", node)
    rows = rows.join(live.select("id").distinct(), "id", "left_semi")
    return rows.groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x.id).alias("ids")).where(F.size("ids") >= 2)


def representatives(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per group the node with the longest content, the first on a tie.  groups(decision_id, ids), sizes(id, chars)."""
    rows = groups.select("decision_id", F.posexplode("ids").alias("pos", "id")).join(sizes, "id", "left")
    return rows.groupBy("decision_id").agg(F.max_by("id", F.struct(F.coalesce("chars", F.lit(0)).alias("chars"), (-F.col("pos")).alias("pos"))).alias("representative"), F.count("*").alias("members"))
