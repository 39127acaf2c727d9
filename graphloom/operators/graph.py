"""Property graphs from triples: nodes, edges, degrees, cycles, reachability, PageRank, clustering, tiers.

Tables: triples(book_id, subject, relation, object, confidence, evidence, seq), edges(book_id, source, target, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.order import quantiles
from graphloom.operators.state import cut

RELATIONS = ("prerequisite", "parallel", "containment", "application")
#: Labels of the relations.
LABELS = {"prerequisite": "前置依赖", "parallel": "并列关系", "containment": "包含关系", "application": "应用关系"}
SHOWN = {"prerequisite": "Prerequisite", "parallel": "Parallel", "containment": "Inclusion", "application": "Application"}


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def dedup_triples(triples: DataFrame, seq: str = "seq") -> DataFrame:
    """First triple of each subject, relation, object and source path."""
    first = Window.partitionBy("subject", "relation", "object", "source_path").orderBy(seq)
    return triples.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def invalid_reason(subject: Column, relation: Column, object_: Column, evidence: Column) -> Column:
    """First reason against a triple, else null."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(~F.coalesce(relation.isin(*RELATIONS), F.lit(False)), F.concat(F.lit("unsupported relation: "), F.coalesce(relation, F.lit(""))))
        .when(empty(subject) | empty(object_), "empty subject or object").when(empty(evidence), "empty evidence").when(subject == object_, "self-loop")
    )


def edges(triples: DataFrame, policy: str = "first", by: tuple[str, ...] = ("book_id",), most: int | None = None) -> DataFrame:
    """One edge per pair: attributes of its first or last triple, greatest confidence (first) or the last's, evidence in order.

    most bounds the evidence that an edge carries to its first triples, where a pair may have more than fits a row; `triples`
    counts all of them.  Without a use of the evidence none is gathered.
    """
    if policy not in ("first", "last"):
        raise ValueError(f"edge policy {policy}")
    if policy == "first" and most is not None:
        pair = [*by, "subject", "object"]
        early = triples.withColumn("__k", F.row_number().over(Window.partitionBy(*pair).orderBy("seq"))).where(F.col("__k") <= most)
        told = edges(early.drop("__k"), policy, by).select(*by, "source", "target", "evidence")
        return edges(triples, policy, by).drop("evidence").join(told, [*by, "source", "target"]).select(*by, "source", "target", "relation", "confidence", "evidence", "triples")
    pick = F.min_by if policy == "first" else F.max_by
    confidence = F.max("confidence") if policy == "first" else F.max_by("confidence", "seq")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x.evidence)
    evidence = listed if policy == "first" else F.array(F.max_by("evidence", "seq"))
    return triples.groupBy(*by, F.col("subject").alias("source"), F.col("object").alias("target")).agg(pick("relation", "seq").alias("relation"), confidence.alias("confidence"), evidence.alias("evidence"), F.count("*").alias("triples"))


def nodes(triples: DataFrame) -> DataFrame:
    """Nodes in order of first appearance; the last book wins; chapters as a sorted set."""
    ends = triples.select("book_id", "chapter", F.explode(F.array(F.struct(F.struct("seq", F.lit(0).alias("end")).alias("at"), F.col("subject").alias("id")), F.struct(F.struct("seq", F.lit(1).alias("end")).alias("at"), F.col("object").alias("id")))).alias("x")).select("book_id", "chapter", "x.*")
    return ends.groupBy("id").agg(F.min("at").alias("first_at"), F.max_by("book_id", "at").alias("book_id"), F.array_sort(F.collect_set("chapter")).alias("chapters"))


def merged_edges(per_book: DataFrame) -> DataFrame:
    """Over per-book edges: the first book's relation and confidence, all books."""
    return per_book.groupBy("source", "target").agg(F.min_by("relation", "book_id").alias("relation"), F.min_by("confidence", "book_id").alias("confidence"), F.array_sort(F.collect_list("book_id")).alias("books"))


def degree(edges_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """In- plus out-degree; a self-loop counts twice."""
    ends = edges_.select(*by, F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy(*by, "id").agg(F.count("*").alias("degree"))


def relation_counts(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy("relation").agg(F.count("*").alias("n"))


def quality(triples: DataFrame) -> DataFrame:
    """Per book: nodes, edges, triples, triples of each relation, nodes of degree at most 1, invalid triples, prerequisite cycles of two."""
    e = edges(triples)
    d = degree(e, ("book_id",)).groupBy("book_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") <= 1).alias("low_degree"))
    n = e.groupBy("book_id").agg(F.count("*").alias("edges"))
    bad = invalid_reason(F.col("subject"), F.col("relation"), F.col("object"), F.col("evidence")).isNotNull()
    t = triples.groupBy("book_id").agg(F.count("*").alias("triples"), *(F.count_if(F.col("relation") == r).alias(r) for r in RELATIONS), F.count_if(bad).alias("invalid"))
    name = lambda end: F.concat("book_id", F.lit("\x01"), end).alias(end)
    c = cycles(e.where("relation = 'prerequisite'").select(name("source"), name("target")), 2)
    c = c.groupBy(F.substring_index(F.col("nodes")[0], "\x01", 1).alias("book_id")).agg(F.count("*").alias("cycles"))
    return t.join(n, "book_id").join(d, "book_id").join(c, "book_id", "left").withColumn("cycles", F.coalesce("cycles", F.lit(0)).cast("long"))


def undirected(edges_: DataFrame) -> DataFrame:
    return edges_.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()


def clustering(edges_: DataFrame) -> DataFrame:
    """id, triangles, clustering coefficient of the undirected graph without self-loops.

    Edges point from the endpoint of lower degree, so that a hub is never the middle of all pairs of its neighbours.
    """
    pairs = undirected(edges_)
    d = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = pairs.join(d.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    out = ranked.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = out.alias("x").join(out.alias("y"), F.col("x.a") == F.col("y.a")).where("x.b < y.b").select(F.col("x.a").alias("a"), F.col("x.b").alias("u"), F.col("y.b").alias("v"))
    corners = wedge.join(pairs, ["u", "v"]).select(F.explode(F.array("a", "u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    every = edges_.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    t, k = F.coalesce("triangles", F.lit(0)), F.coalesce("d", F.lit(0))
    return every.join(corners, "id", "left").join(d, "id", "left").select("id", t.cast("long").alias("triangles"), F.when(k < 2, 0.0).otherwise(2.0 * t / (k * (k - 1))).alias("clustering"))


def pagerank(edges_: DataFrame, rounds: int, alpha: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """id, rank after so many rounds, or sooner once the change is below nodes * tolerance; dangling mass is spread evenly."""
    pairs = cut(edges_.select("source", "target").distinct())  # each round reads it again
    out = pairs.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out"))
    every = cut(pairs.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(out, "id", "left"))
    n = every.count()
    if not n:
        return every.select("id", F.lit(0.0).alias("rank"))
    rank = every.select("id", "out", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        given = rank.where("out is not null").join(pairs, rank.id == pairs.source).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = rank.join(given, "id", "left").crossJoin(F.broadcast(lost))  # lost is one row
        value = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n
        new = new.select("id", "out", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved"))
        new = cut(new)  # each round is read three times by the next
        if tolerance is not None and new.agg(F.sum("moved")).first()[0] < n * tolerance:
            return new.select("id", "rank")
        rank = new.drop("moved")
    return rank.select("id", "rank")


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores z_<column>; zeros where nothing varies."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = {f"z_{c}": F.when(F.col(f"s_{c}") < 1e-10, 0.0).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).drop(*stats.columns)


def tiers(df: DataFrame, score: str, cuts: tuple[float, ...] = (0.85, 0.55, 0.20)) -> DataFrame:
    """tier 1 to 4 by exact linear percentiles of the score."""
    q = quantiles(df, score, cuts) or [0.0] * len(cuts)
    tier = F.when(F.col(score) >= q[0], 1).when(F.col(score) >= q[1], 2).when(F.col(score) >= q[2], 3).otherwise(4)
    return df.withColumn("tier", tier)


def centrality(edges_: DataFrame, rounds: int = 200, tolerance: float | None = 1e-6, digits: int = 9) -> DataFrame:
    """id, rank, degree, clustering, score (0.5, 0.3 and 0.2 of their z-scores), tier.

    Scores are rounded to so many digits, so that nodes of the same position in the graph are ties whatever the order of sums.
    """
    m = pagerank(edges_, rounds, tolerance=tolerance).join(degree(edges_), "id").join(clustering(edges_).drop("triangles"), "id")
    z = zscore(m, ["rank", "degree", "clustering"])
    score = F.round(0.5 * F.col("z_rank") + 0.3 * F.col("z_degree") + 0.2 * F.col("z_clustering"), digits)
    return tiers(cut(z.withColumn("score", score).drop("z_rank", "z_degree", "z_clustering")), "score")


def cycles(edges_: DataFrame, longest: int = 4) -> DataFrame:
    """nodes: simple cycles of up to `longest` edges, each once, from its least node.

    A cycle is found from its greatest node, hubs being greater than other nodes: paths out of it and into it, of half the
    length and through smaller nodes only, meet.  So no path leads through a hub from all of its neighbours to all others.
    """
    pairs = edges_.select("source", "target").where("source is not null and target is not null").repartition("source").distinct()  # joined by source below
    ranked = pairs.withColumns({"from": F.lit(0), "to": F.lit(0)})
    if longest > 2:
        d = degree(pairs)
        ends = d.agg(F.sum("degree").cast("double").alias("ends"))
        hubs = d.crossJoin(F.broadcast(ends)).where("cast(degree as double) * degree > ends").select("id", F.col("degree").alias("rank"))  # fewer than the root of all ends
        of = lambda end, to: F.broadcast(hubs.select(F.col("id").alias(end), F.col("rank").alias(to)))
        ranked = pairs.join(of("source", "from"), "source", "left").join(of("target", "to"), "target", "left").fillna(0, ["from", "to"])
    source, target = F.struct("from", "source"), F.struct("to", "target")
    out = ranked.where(target < source).select(F.col("source").alias("start"), F.col("from").alias("rank"), F.col("target").alias("f1"))
    into = ranked.where(source < target).select(F.col("target").alias("start"), F.col("to").alias("rank"), F.col("source").alias("b1"))
    found = pairs.where("source = target").select(F.array("source").alias("nodes"))
    below = F.struct("to", "next") < F.struct("rank", "start")
    for k in range(2, longest + 1):
        i, j = (k + 1) // 2, k // 2
        f, b = [f"f{n}" for n in range(1, i + 1)], [f"b{n}" for n in range(1, j + 1)]
        if k % 2:  # one edge more on the way out
            step = ranked.select(F.col("source").alias("at"), F.col("target").alias("next"), "to")
            out = out.join(step, F.col(f[-2]) == F.col("at")).where(below & ~F.col("next").isin(*map(F.col, f[:-1]))).select("start", "rank", *f[:-1], F.col("next").alias(f[-1]))
        elif k > 2:  # and on the way back
            step = ranked.select(F.col("target").alias("at"), F.col("source").alias("next"), F.col("from").alias("to"))
            into = into.join(step, F.col(b[-2]) == F.col("at")).where(below & ~F.col("next").isin(*map(F.col, b[:-1]))).select("start", "rank", *b[:-1], F.col("next").alias(b[-1]))
        met = out.drop("rank").join(into.drop("rank").withColumnRenamed(b[-1], f[-1]), ["start", f[-1]])
        for x in f[:-1]:
            for y in b[:-1]:
                met = met.where(F.col(x) != F.col(y))
        nodes = F.array("start", *f, *reversed(b[:-1]))
        least = F.array_position(nodes, F.array_min(nodes)).cast("int")
        found = found.unionByName(met.select(F.concat(F.slice(nodes, least, F.lit(k)), F.slice(nodes, F.lit(1), least - 1)).alias("nodes")))
    return found


def checks(edges_: DataFrame, longest: int = 2, shown: int = 20) -> DataFrame:
    """One row on a merged graph: nodes, edges, orphans (of degree at most 1) with the first ids, prerequisite cycles up to a length."""
    d = degree(edges_)
    n = d.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") <= 1).alias("orphans"))
    some = d.where("degree <= 1").orderBy("id").limit(shown).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    c = cycles(edges_.where("relation = 'prerequisite'"), longest).agg(F.count("*").alias("cycles"))
    return n.crossJoin(edges_.agg(F.count("*").alias("edges"))).crossJoin(some).crossJoin(c)  # one-row frames


def reachable(edges_: DataFrame, start: str, depth: int | None = None) -> DataFrame:
    """id, hops of nodes within reach (of `depth` hops), breadth first; ends when a level adds nothing."""
    pairs = edges_.select("source", "target").distinct()
    seen = edges_.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    front, k = seen, 0
    while depth is None or k < depth:
        k += 1
        front = front.join(pairs, front.id == pairs.source).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k))
        front = cut(front)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def out_edges(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target", "relation"))).alias("relations"))


def readable_subgraph(nodes_: DataFrame, edges_: DataFrame, seeds: int = 36, neighbours: int = 10, most: int = 180) -> DataFrame:
    """id, rank in selection order: a first-in-first-out breadth-first search from the nodes of highest degree.

    nodes_(id, pos), edges_(source, target, pos).  A level is ordered by (parent, rank of the neighbour); neighbours are
    ranked before visited ones are removed, as those take up places.
    """
    d = degree(edges_).join(nodes_, "id").withColumn("degree", F.col("degree").cast("long"))
    adjacent = edges_.select(F.col("source").alias("id"), F.col("target").alias("to"), "pos").unionByName(edges_.select(F.col("target").alias("id"), F.col("source").alias("to"), "pos"))
    by = Window.partitionBy("id").orderBy(F.desc("degree"), "epos")
    near = adjacent.withColumnRenamed("pos", "epos").join(d.select(F.col("id").alias("to"), "degree"), "to").withColumn("k", F.row_number().over(by)).where(F.col("k") <= neighbours).select("id", "to", "k")
    near = cut(near)
    level = d.orderBy(F.desc("degree"), "pos").limit(seeds).select("id", F.row_number().over(Window.orderBy(F.desc("degree"), "pos")).alias("rank"))
    seen, total = level, seeds
    while total < most:
        found = level.join(near, "id").groupBy("to").agg(F.min(F.struct("rank", "k")).alias("at")).withColumnRenamed("to", "id").join(seen, "id", "left_anti")
        found = found.orderBy("at").limit(most - total)  # at most `most` rows are ever ranked
        level = cut(found.select("id", (F.row_number().over(Window.orderBy("at")) + total).alias("rank")))
        n = level.count()
        if not n:
            break
        seen, total = cut(seen.unionByName(level)), total + n
    return seen


def induced(edges_: DataFrame, ids: DataFrame) -> DataFrame:
    s = ids.select(F.col("id").alias("source"))
    return edges_.join(s, "source", "left_semi").join(s.withColumnRenamed("source", "target"), "target", "left_semi")
