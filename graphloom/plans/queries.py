"""Registered queries: one for each operator, over all rows of the tables that it reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import noise as N
from graphloom.functions import text as T
from graphloom.operators import acyclic, engine, essence, export, feedback, graph, merge, retrieval, sections, triples
from graphloom.operators.models import offline
from graphloom.operators.state import cut, scratch
from graphloom.plans import fixtures as X
from graphloom.plans.fixtures import table
from graphloom.sources import readers, writers

QUERIES = {}
QUESTION = "with then that inthion of the ring"


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c):
    return F.round(c, 6)


def docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book_id"), F.coalesce("text", F.lit("")).alias("content"))


def ask(spark, text=QUESTION):
    return spark.createDataFrame([(0, text)], "query_id int, question string")


def joined(c):
    return F.array_join(c, ",")


# retrieval


@query
def bm25_topk(spark, d):
    hits = retrieval.top(retrieval.bm25(sections.kept_chunks(docs(spark, d)), ask(spark)), 10)
    return hits.select("chunk_id", r6("score").alias("score"), "rank")


@query
def corpus_term_stats(spark, d):
    return retrieval.idf(retrieval.statistics(docs(spark, d))).select("term", "df", r6("idf").alias("idf"))


@query
def vector_knn_l2(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.knn(v, q, 5).select("query_id", "vec_id", r6("distance").alias("distance"), "rank")


@query
def hybrid_search(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    text = docs(spark, d).join(v.select("chunk_id"), "chunk_id")
    q = v.where("chunk_id = 0").select(F.lit(0).alias("query_id"), "embedding")
    far = retrieval.all_distances(v.join(text.select("chunk_id"), "chunk_id"), q)
    return retrieval.fused(retrieval.bm25(text, ask(spark)), far, 5).select("chunk_id", r6("score").alias("score"))


@query
def engine_search(spark, d):
    """Built into tables, opened from them, asked three questions by keyword and vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    text = docs(spark, d).join(v.select("chunk_id"), "chunk_id").withColumn("path", F.concat(F.lit("books/"), "book_id", F.lit("/c_"), F.col("chunk_id").cast("string"), F.lit(".md")))
    asked = v.where("chunk_id in (0, 1, 2)").select(F.col("chunk_id").cast("int").alias("query_id"), F.lit(QUESTION).alias("question"), "embedding")
    hits = engine.Engine(spark, scratch(spark, "engine")).built_from(lambda: text, lambda: v.join(text.select("chunk_id"), "chunk_id")).search(asked, 5)
    return hits.select("query_id", "rank", "chunk_id", "path", r6("score").alias("score"))


@query
def rag_answer(spark, d):
    """Answers without a model: the fallback that cites the best hits."""
    text = docs(spark, d).withColumn("path", F.concat(F.lit("books/"), "book_id", F.lit("/c_"), F.col("chunk_id").cast("string"), F.lit("_x.md")))
    hits = retrieval.top(retrieval.bm25(text, ask(spark)), 5).join(text, "chunk_id").withColumn("content", T.snippet(F.col("content"))).withColumn("score", F.round("score", 9))
    told = engine.answers(engine.prompts(ask(spark), hits), offline)
    return told.select("answer", F.transform("citations", lambda c: F.concat_ws("|", c.source, c.chapter, c.page, c.score.cast("string"))).alias("cited")).withColumn("cited", joined("cited"))


@query
def minmax_norm(spark, d):
    return retrieval.minmax(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")), "x", "y").select("doc_id", r6("y").alias("y"))


@query
def zscore_norm(spark, d):
    return graph.zscore(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")), ["x"]).select("doc_id", r6("z_x").alias("z"))


@query
def percentile_tiers(spark, d):
    return graph.tiers(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")), "x").select("doc_id", "tier")


@query
def citations(spark, d):
    path = F.concat(F.lit("/books/"), "book_id", F.lit("/intro_"), F.col("chunk_id").cast("string"), F.lit("_x.md"))
    return retrieval.citations(docs(spark, d).withColumns({"path": path, "score": F.length("content") / 7000})).select("chunk_id", "source", "chapter", "page", "snippet", "score")


@query
def graph_query(spark, d):
    return retrieval.graph_query(X.nodes_p(spark, d), "red ring Brand#3").select("id", "score")


@query
def related_links(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    links = e.select(F.concat("source", F.lit(">"), "target").alias("pos"), "source", "target")
    matched = graph.degree(e).orderBy(F.desc("degree"), "id").limit(3)
    return retrieval.related_links(links, matched, 20)


@query
def compose_answer(spark, d):
    matched = retrieval.graph_query(X.nodes_p(spark, d), "ring", 1)
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    links = e.select(F.concat("source", F.lit(">"), "target").alias("pos"), "source", "target")
    return retrieval.answer("ring", matched, retrieval.related_links(links, matched.select(F.col("books")[0].alias("id")), 8))


@query
def kg_search_v1(spark, d):
    return retrieval.search_v1(X.nodes_p(spark, d), "red ring", 20).select("id", r6("score").alias("score"))


@query
def kg_search_v2(spark, d):
    return retrieval.search_v2(X.nodes_p(spark, d), "red ring，ECONOMY economy", 20).select("id", r6("score").alias("score"))


@query
def kg_search_v3(spark, d):
    return retrieval.search_v2(X.nodes_p(spark, d), "blue、ring", 20, with_books=False).select("id", r6("score").alias("score"))


@query
def snippet_choice(spark, d):
    n = X.nodes_p(spark, d).withColumn("essence", F.when(F.col("val") % 2 == 0, F.lit("语义相似度 1")).otherwise(F.col("essence"))).withColumn("reasoning", F.when(F.col("val") % 3 == 0, F.lit("")).otherwise(F.col("reasoning")))
    return n.select("id", retrieval.snippet_choice(F.col("essence"), F.col("reasoning"), F.col("books")).alias("snippet"))


@query
def ui_search(spark, d):
    return retrieval.ui_search(X.nodes_p(spark, d), "widget").select("id", r6("score").alias("score"))


@query
def ui_filter(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    n = graph.degree(e).select("id", F.col("id").alias("name"), F.lit("").alias("essence"), F.lit("").alias("reasoning"), F.array(F.lit("b")).alias("books"))
    return retrieval.ui_filter(n, e, ["application", "parallel"], "1")[1].select("source", "target", "relation")


# text


@query
def chunk_filter(spark, d):
    return sections.kept_chunks(docs(spark, d)).select("chunk_id", F.length("content").alias("chars"))


@query
def clean_text(spark, d):
    rows = X.documents(spark, d).select("i", F.concat(X.picked(X.DIRTY, F.col("i")), "body").alias("t"))
    return rows.select("i", F.md5(T.clean_text(F.col("t")).cast("binary")).alias("clean"))


@query
def clean_label(spark, d):
    return X.labels(spark, d).select("i", T.clean_label(F.col("t")).alias("label"))


@query
def noise_flags(spark, d):
    t = F.col("t")
    return X.labels(spark, d).select("i", N.BUILDER(t).alias("builder"), N.MERGER(t).alias("merger"), N.ESSENCE(t).alias("essence"), N.EXPORT(t).alias("export"))


@query
def valid_label(spark, d):
    return X.labels(spark, d).select("i", N.valid_concept(F.col("t")).alias("valid"))


@query
def noise_chunks(spark, d):
    return docs(spark, d).select("chunk_id", N.noise_chunk(F.lit("细胞膜的结构"), F.col("content")).alias("noise"))


@query
def letter_ratio(spark, d):
    return docs(spark, d).select("chunk_id", r6(T.letter_ratio(F.col("content"))).alias("ratio"))


@query
def markdown_table(spark, d):
    rows = F.array_sort(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.concat("n_name", F.lit("|x")))))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(T.markdown_table(rows).alias("md"))


@query
def natural_sort(spark, d):
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("_"), (F.col("s_suppkey") % 7).cast("string"))
    s = table(spark, d, "supplier").select("s_suppkey", T.natural_key(name).alias("k"))
    return s.select("s_suppkey", F.row_number().over(Window.partitionBy((F.col("s_suppkey") % 5).alias("g")).orderBy("k")).alias("pos"))


@query
def sentences(spark, d):
    return X.marks(spark, d).select("i", F.posexplode(T.sentences(F.col("t"))).alias("k", "sentence"))


@query
def heading_levels(spark, d):
    t = F.when(F.col("i") % 2 == 0, X.picked(X.HEADS, F.col("i"))).otherwise(F.concat(X.picked(X.HEADS, F.col("i")), F.lit(" "), "word"))
    size, largest = F.lit(9.0) + F.col("i") % 11, F.when(F.col("i") % 3 > 0, F.lit(18.0))
    return X.documents(spark, d).select("i", T.heading_level(t, size, F.lit(11.0), largest, F.col("i") % 5 == 0).alias("level"))


@query
def page_numbers(spark, d):
    return docs(spark, d).select("chunk_id", T.page_of(F.concat("book_id", F.lit("_0"), F.col("chunk_id").cast("string"), F.lit("_7"))).alias("page"))


@query
def display_labels(spark, d):
    return docs(spark, d).select("chunk_id", T.display_label(F.col("content")).alias("label"))


# sections and chunks


@query
def split_sections(spark, d):
    s = sections.split_sections(X.markdown(spark, d), ["conv_id"])
    return s.select("conv_id", "title", F.length("markdown").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("md5"), F.col("index").alias("idx"), "level")


@query
def section_manifest(spark, d):
    s = sections.split_sections(X.markdown(spark, d), ["conv_id"]).withColumns({"page_start": F.col("index") + 1, "page_end": F.col("index") + 1 + F.col("level")})
    return sections.manifest(s, "conv_id")


@query
def section_metadata(spark, d):
    s = sections.enrich(sections.split_sections(X.markdown(spark, d), ["conv_id"]), "conv_id")
    return s.select("conv_id", F.col("index").alias("idx"), F.col("metadata")["section_id"].alias("section_id"), F.col("metadata")["char_count"].alias("char_count"))


def marks(spark, d):
    return X.marks(spark, d).withColumnRenamed("t", "markdown")


@query
def chapter_chunks(spark, d):
    return sections.chapter_chunks(marks(spark, d), ["i"]).select("i", "part", "chapter", "section", F.length("content").alias("chars"))


@query
def chunk_last_wins(spark, d):
    c = sections.chapter_chunks(marks(spark, d), ["i"]).withColumn("section", F.substring("section", 1, 3))
    return sections.saved_chunks(c, ["i"]).select("i", "name", "overwritten", F.length("content").alias("chars"))


@query
def virtual_chunks(spark, d):
    return sections.virtual_chunks(marks(spark, d), ["i"]).select("i", "part", "title")


def book(spark, d):
    """Every document as a book of one chunk."""
    path = F.concat(F.lit("chunks/03_生理学/"), F.regexp_extract("t", X.WORD, 1), F.lit("_"), F.col("i").cast("string"), F.lit(".md"))
    return sections.chunk_identity(X.marks(spark, d).select(F.concat(F.lit("03_生理学 "), F.col("i").cast("string")).alias("book_id"), F.col("i").alias("chunk_pos"), path.alias("path"), F.col("t").alias("content")))


@query
def chunk_identity(spark, d):
    return book(spark, d).select("chunk_pos", "chapter", "section")


# triples


@query
def adjacent_parallel(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("book_id"), F.col("user_id").alias("chunk_pos"), F.lit("p").alias("path"), F.lit("c").alias("chapter"), F.lit("s").alias("section"), F.col("event_type").alias("heading"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"))
    return triples.parallel(e).select("book_id", "subject", "object", F.col("seq.idx").alias("idx"))


@query
def section_order_prereq(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("book_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("chunk_pos"), F.lit("p").alias("path"), F.lit("c").alias("chapter"), F.col("event_type").alias("section"))
    return triples.section_order(e).groupBy(F.col("subject").alias("source"), F.col("object").alias("target")).agg(F.count("*").alias("n"))


@query
def acyclic_prereqs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("book_id"), F.lag("event_type").over(w).alias("source"), F.col("event_type").alias("target"), F.col("event_id").alias("seq"))
    return acyclic.accept_acyclic(e.where("source is not null"))


@query
def containment_triples(spark, d):
    c = book(spark, d)
    return triples.containment(c, triples.subheadings(c)).select("book_id", "chapter", "section", "subject", "object", "confidence")


@query
def application_triples(spark, d):
    return triples.applications(book(spark, d)).select(F.col("seq.chunk_pos").alias("chunk_pos"), "subject", "object", "confidence")


@query
def extract_triples(spark, d):
    return triples.extract(book(spark, d)).groupBy("relation").agg(F.count("*").alias("n"))


@query
def dedup_triples(spark, d):
    return graph.dedup_triples(X.triples_a(spark, d)).groupBy("book_id", "relation").agg(F.count("*").alias("n"), r6(F.sum("confidence")).alias("confidence"))


@query
def validate_triples(spark, d):
    t = X.triples_a(spark, d).withColumn("relation", F.when(F.col("chapter") == "ch1", "unknown").otherwise(F.col("relation"))).withColumn("evidence", F.when(F.col("chapter") == "ch2", "").otherwise(F.col("evidence"))).withColumn("object", F.when(F.col("chapter") == "ch3", F.col("subject")).otherwise(F.col("object")))
    reason = graph.invalid_reason(*(F.col(c) for c in ("subject", "relation", "object", "evidence")))
    return t.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


# graphs


@query
def edges_first_wins(spark, d):
    return graph.edges(X.triples_a(spark, d)).select("book_id", "source", "target", "relation", "confidence", F.array_join("evidence", ";").alias("evidence"), "triples")


@query
def edges_last_wins(spark, d):
    return graph.edges(X.triples_a(spark, d), "last").select("book_id", "source", "target", "relation", "confidence", F.array_join("evidence", ";").alias("evidence"))


@query
def merged_edges(spark, d):
    return graph.merged_edges(graph.edges(X.triples_a(spark, d))).withColumn("books", joined("books"))


@query
def node_attrs(spark, d):
    return graph.nodes(X.triples_a(spark, d)).select("id", "book_id", joined("chapters").alias("chapters"))


@query
def relation_distribution(spark, d):
    return graph.relation_counts(graph.edges(X.triples_a(spark, d)))


@query
def graph_quality(spark, d):
    return graph.quality(X.triples_a(spark, d))


@query
def low_degree(spark, d):
    return graph.degree(X.edges_b(spark, d)).where("degree <= 30").select("id")


@query
def degree(spark, d):
    return graph.degree(X.edges_b(spark, d))


@query
def clustering(spark, d):
    return graph.clustering(X.edges_b(spark, d)).select("id", "triangles", r6("clustering").alias("clustering"))


@query
def pagerank_k(spark, d):
    return graph.pagerank(X.edges_b(spark, d), 6).select("id", r6("rank").alias("rank"))


@query
def centrality_tiers(spark, d):
    return graph.centrality(X.edges_b(spark, d), rounds=6, tolerance=None).select("id", r6("score").alias("score"), "tier")


@query
def bounded_cycles(spark, d):
    return graph.cycles(X.edges_b(spark, d, distinct=False), 3).groupBy(F.size("nodes").alias("length")).agg(F.count("*").alias("n"))


@query
def two_cycles(spark, d):
    return graph.cycles(X.edges_b(spark, d, distinct=False), 2).select(joined("nodes").alias("nodes"))


@query
def reachability(spark, d):
    return graph.reachable(X.edges_b(spark, d), "N1")


@query
def out_edges(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    return graph.out_edges(e).select("id", joined(F.transform("relations", lambda x: F.concat(x.target, F.lit(":"), x.relation))).alias("relations"))


@query
def readable_subgraph(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d))).withColumn("pos", F.concat("source", F.lit(">"), "target"))
    n = graph.degree(e).select("id", F.col("id").alias("pos"))
    return graph.readable_subgraph(n, e, seeds=5, neighbours=3, most=40)


# merging


@query
def exact_label_merge(spark, d):
    return merge.exact_matches(merge.book_nodes(X.triples_a(spark, d))).withColumn("books", joined("books"))


@query
def relation_conflicts(spark, d):
    return merge.conflicts(graph.edges(X.triples_a(spark, d)), compat=True).withColumn("books", joined("books"))


@query
def relation_conflicts_corrected(spark, d):
    return merge.conflicts(graph.edges(X.triples_a(spark, d))).select("source", "target", "relation")


@query
def complements(spark, d):
    return merge.complements(graph.edges(X.triples_a(spark, d)))


@query
def noise_stats(spark, d):
    t = X.triples_a(spark, d)
    return merge.noise_stats(t.withColumn("subject", F.when(F.col("subject") == "Brand#1", "12345").otherwise(F.col("subject"))))


@query
def semantic_candidates(spark, d):
    text = docs(spark, d)
    asked = text.select(F.col("chunk_id").alias("query_id"), "book_id", F.concat(F.lit("label"), F.col("chunk_id").cast("string")).alias("label"), F.regexp_extract("content", r"([A-Za-z]{6,})", 1).alias("question")).where("query_id % 100 = 0 and question <> ''")
    found = retrieval.top(retrieval.bm25(text, asked), 10)
    best = found.groupBy("query_id").agg(F.max("score").alias("most"))
    hits = found.join(best, "query_id").join(asked, "query_id").select("book_id", "label", "chunk_id", r6(F.col("score") / F.col("most")).alias("score")).join(text.select("chunk_id", "content"), "chunk_id")
    labels = docs(spark, d).select("book_id", F.lower(F.regexp_extract("content", r"^([A-Za-z]+)", 1)).alias("label")).where(F.length("label") >= 4).distinct()
    return merge.semantic_candidates(hits, labels).select("b1", "l1", "b2", "l2", "chunk_id")


def decisions(spark, d):
    t = X.triples_a(spark, d)
    e = cut(graph.edges(t).drop("evidence"))  # read three times
    exact = merge.exact_matches(merge.book_nodes(t)).select(F.array("label").alias("nodes"), "books", "confidence")
    against = merge.conflicts(e).select(F.array("source", "target").alias("nodes"), F.array_sort(F.array_distinct("books")).alias("books"), "confidence")
    more = merge.complements(e).select(F.array("source").alias("nodes"), F.array("book_id", "other").alias("books"), "confidence")
    return merge.decision_log(("merge", exact), ("conflict", against), ("complement", more))


@query
def decision_log(spark, d):
    return decisions(spark, d).select("decision_id", "type", joined("nodes").alias("nodes"), joined("books").alias("books"), "confidence")


@query
def merge_report(spark, d):
    e = graph.edges(X.triples_a(spark, d))
    return merge.merge_report(e, graph.merged_edges(e), decisions(spark, d))


@query
def label_in_chunk_topk(spark, d):
    labels = table(spark, d, "benchmark").select(F.regexp_extract("text", r"(\w+ \w+ \w+)", 1).alias("label")).distinct()
    words = labels.select(F.regexp_extract("label", r"(\w+)$", 1).alias("label")).distinct()
    return merge.label_in_chunk(words, docs(spark, d)).select("label", "chunk_id", r6("score").alias("score"), "rank")


@query
def dedup_representatives(spark, d):
    live = docs(spark, d).select(F.concat(F.lit("n"), F.col("chunk_id").cast("string")).alias("id"), F.length("content").alias("chars"), "chunk_id")
    groups = live.groupBy((F.col("chunk_id") % 50).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "id"))), lambda x: F.concat(F.lit("b::"), x.id)).alias("nodes"))
    made = groups.select(F.col("g").cast("string").alias("decision_id"), F.lit("merge").alias("type"), F.lit(0.95).alias("confidence"), "nodes")
    return merge.representatives(merge.relevant(made, live), live)


# essence


def compressible(spark, d):
    t = graph.tiers(docs(spark, d).withColumn("score", F.length("content").cast("double")), "score")
    label = F.concat(F.lit("node "), F.col("chunk_id").cast("string"))
    return t.select(F.col("chunk_id").alias("id"), label.alias("label"), "tier", "score", "content", essence.summary(F.col("content"), label).alias("summary"), essence.key_passages(F.col("content"), ("tion", "ment")).alias("passages"))


@query
def rule_summary(spark, d):
    return compressible(spark, d).select("id", "summary")


@query
def key_passages(spark, d):
    return compressible(spark, d).select("id", F.array_join("passages", "|").alias("passages"))


@query
def essence_render(spark, d):
    return essence.rendered(compressible(spark, d)).select("tier", "rank", "id", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("md5"))


@query
def strict_budget(spark, d):
    rows = docs(spark, d).select(F.col("chunk_id").alias("doc"), F.posexplode(F.split(F.regexp_replace("content", r"(?m)^(T)", "# T"), "\n")).alias("pos", "line"))
    return essence.strict_budget(rows, 400).select("doc", "pos", "used")


@query
def compression_stats(spark, d):
    n = compressible(spark, d).withColumns({"o": F.length("content"), "c": F.length("summary")})
    return essence.compression(n, "o", "c").withColumns({"core_coverage": r6("core_coverage"), "ratio": r6("ratio")})


@query
def tier_distribution(spark, d):
    return compressible(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query
def tier_samples(spark, d):
    return essence.tier_samples(compressible(spark, d))


# snapshot and feedback


@query
def snapshot_nodes(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    return export.snapshot_nodes(graph.degree(e), export.node_books(e), export.decision_index(decisions(spark, d))).withColumn("books", joined("books")).drop("decision_id")


@query
def snapshot_links(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    n = graph.degree(e).select("id", F.regexp_replace("id", "#0*", " ").alias("label"))
    return export.snapshot_links(export.readable_edges(e, n)).withColumn("books", joined("books"))


@query
def ranked_links(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    return export.ranked_links(e, graph.degree(e), 60)


@query
def cytoscape_elements(spark, d):
    e = X.edges_b(spark, d).withColumn("relation", F.lit("parallel"))
    return export.cytoscape(graph.degree(e), e, elements=True).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("json")).alias("chars"))


@query
def graph_summary(spark, d):
    e = graph.merged_edges(graph.edges(X.triples_a(spark, d)))
    n = graph.degree(e).select("id", F.regexp_replace("id", "#0*", " ").alias("label"))
    return export.summary(n, e, export.readable_edges(e, n))


def given(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("decision_id"), "ts", "event_id", F.col("props").alias("feedback"))


@query
def feedback_upsert(spark, d):
    made = table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderstatus").alias("type"))
    return feedback.updated(made, given(spark, d)).select("decision_id", "type", "teacher_feedback", "status", "resolved")


@query
def windowed_counts(spark, d):
    from graphloom.streaming.feedback import windowed_counts as counts

    return counts(table(spark, d, "events")).select(F.unix_timestamp("window_start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def cache_miss(spark, d):
    asked = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("head"))
    held = asked.where("doc_id % 3 = 0").select(T.cache_key(F.col("source"), F.col("head")).alias("key"))
    return feedback.misses(asked, held, "source", "head").select("doc_id", "key")


@query
def llm_json_parse(spark, d):
    rows = X.replies(spark, d).select("i", F.explode(T.json_objects(F.col("t"), "struct<subject:string,relation:string,object:string>")).alias("o"))
    return rows.select("i", "o.subject", "o.relation", "o.object")


@query
def llm_triples(spark, d):
    from graphloom.operators.models import valid_reply

    rows = X.replies(spark, d).select("i", F.explode(T.json_objects(F.col("t"), "struct<subject:string,relation:string,object:string,evidence:string>")).alias("o"))
    return valid_reply(rows.select("i", F.concat(F.lit("心肌细胞膜"), "o.subject").alias("subject"), "o.relation", F.concat("o.object", F.lit("血管内皮细胞")).alias("object"), F.lit("said").alias("evidence"))).select("i", "relation", "object")


@query
def verdict_parse(spark, d):
    return X.replies(spark, d).select("i", T.verdict(F.col("t")).alias("v")).select("i", "v.same", "v.confidence")


# sources and sinks


def sections_of(spark, d):
    s = sections.split_sections(X.markdown(spark, d), ["conv_id"])
    return s.select(F.concat(F.lit("book"), F.col("conv_id").cast("string")).alias("book_id"), "title", "markdown", "index")


@query
def markdown_files(spark, d):
    """Sections written as markdown files, a folder a book, and read back through the directory scan and the format router."""
    path = scratch(spark, "markdown")
    writers.write_markdown_files(sections_of(spark, d), path)
    got = readers.load_markdown(spark, path)
    return got.select("book_id", "source_type", F.length("markdown").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("md5"))


@query
def chunk_files(spark, d):
    """Every document as a markdown file in the folder of its book, read back by the chunk scan, which leaves out short ones."""
    path = scratch(spark, "chunks")
    writers.write_chunk_files(docs(spark, d).withColumn("name", F.concat(F.lit("c"), F.col("chunk_id").cast("string"))), path)
    return readers.chunks(spark, path).select(F.col("chunk_name").alias("name"), F.length("content").alias("chars"))


@query
def book_chunk_choice(spark, d):
    """Which books are chunked anew from their root text: those with few chunks, or small ones against it."""
    parts = docs(spark, d).select(F.concat(F.lit("b"), (F.col("chunk_id") % 97).cast("string")).alias("book_id"), "content")
    roots = table(spark, d, "pages").select(F.concat(F.lit("b"), F.col("page_id").cast("string")).alias("book_id"), F.coalesce("html", F.lit("")).alias("markdown"))
    return readers.book_chunks(parts, roots)


@query
def graph_files(spark, d):
    """A merged graph written as JSON and read back."""
    path = scratch(spark, "graph")
    writers.write_node_link(graph.merged_edges(graph.edges(X.triples_a(spark, d))), path)
    return readers.graph_edges(spark, path).select("source", "target", "relation", joined("books").alias("books"), "confidence")


@query
def triple_files(spark, d):
    """Triples written as JSON files of their books and read back, for one book."""
    path = scratch(spark, "triples")
    writers.write_triples(X.triples_a(spark, d), path)
    t = readers.triples(spark, path, ["AF", "RF"])
    return t.groupBy("book_id", "relation").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@query
def feedback_log(spark, d):
    """Feedback appended in two batches and read back; the last one of each decision."""
    path = scratch(spark, "feedback")
    for k in (0, 1):
        writers.append_feedback(given(spark, d).where(F.col("event_id") % 2 == k), path)
    return feedback.latest(readers.or_else(spark, path, lambda p: spark.read.schema("decision_id long, ts timestamp, event_id long, feedback string").json(p), "decision_id long"), at=("ts", "event_id")).select("decision_id", "event_id", "feedback")


@query
def merged_checks(spark, d):
    return graph.checks(graph.merged_edges(graph.edges(X.triples_a(spark, d)))).withColumn("examples", joined("examples"))


@query
def tier_coverage(spark, d):
    return essence.coverage(compressible(spark, d).withColumn("content", F.when(F.col("id") % 4 > 0, F.col("content"))))


@query
def induced_subgraph(spark, d):
    e = X.edges_b(spark, d)
    return graph.induced(e, graph.degree(e).where("degree >= 40").select("id"))


@query
def clean_text_script(spark, d):
    rows = X.documents(spark, d).select("i", F.concat(X.picked(X.DIRTY, F.col("i")), "body").alias("t"))
    return rows.select("i", F.md5(T.clean_text_script(F.col("t")).cast("binary")).alias("clean"))


@query
def script_headings(spark, d):
    t = F.concat(X.picked([*X.HEADS, "临床病例分析", "病例"], F.col("i")), F.lit(" "), "word")
    sizes = F.when(F.col("i") % 4 == 0, F.array(F.lit(18.0))).otherwise(F.array(F.lit(18.0), F.lit(15.0)))
    level, text = T.heading_level_script(t, F.lit(9.0) + F.col("i") % 11, F.lit(11.0), sizes)
    return X.documents(spark, d).select("i", level.alias("level"), text.alias("t"))


@query
def shown_sizes(spark, d):
    n = F.octet_length(F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select("page_id", T.size_text(n * F.pow(F.lit(10), F.col("page_id") % 5).cast("long")).alias("size"), T.percent((n % 1000) / 1000).alias("share"))


@query
def active_report(spark, d):
    """Reports by source; every other source has a strict one."""
    n = docs(spark, d).groupBy("book_id").agg(F.sum(F.length("content")).alias("original_chars"), F.sum(F.least(F.length("content"), F.lit(900))).alias("compressed_chars"), F.max("chunk_id").alias("last"))
    raw = n.withColumn("ratio", r6(F.col("compressed_chars") / F.col("original_chars")))
    strict = raw.where("last % 2 = 0").withColumn("compressed_chars", F.floor(F.col("compressed_chars") / 2)).withColumn("ratio", r6(F.col("compressed_chars") / F.col("original_chars")))
    return essence.active_report(raw, strict, "book_id")


@query
def node_preview(spark, d):
    return essence.preview(docs(spark, d).select("chunk_id", "content"))


@query
def summary_prompts(spark, d):
    """What a model is asked, and what stands in for its reply; every third node has one."""
    n = compressible(spark, d)
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" said "), F.col("content"), F.lit(" ")))
    ask, said = essence.summary_prompt(F.col("tier"), F.col("label"), F.col("content")), essence.model_summary(F.col("tier"), reply, F.col("label"), F.col("content"))
    return n.select("id", F.md5(ask.cast("binary")).alias("prompt"), said.alias("summary"))


@query
def chunk_sample(spark, d):
    from graphloom.operators import models

    return models.sample(docs(spark, d).withColumn("chunk_name", F.format_string("c%09d", "chunk_id"))).select("book_id", "chunk_name", F.length("chunk_text").alias("chars"))


@query
def hit_content(spark, d):
    """Search hits with the whole text of their chunks."""
    text = docs(spark, d).withColumn("path", F.concat(F.lit("b/"), F.col("chunk_id").cast("string")))
    hits = retrieval.top(retrieval.bm25(text, ask(spark)), 10).join(text.select("chunk_id", "path", F.substring("content", 1, 50).alias("content")), "chunk_id")
    return readers.with_content(hits, text).select("rank", "chunk_id", F.length("content").alias("chars"))


@query
def resolutions(spark, d):
    return feedback.latest(given(spark, d), at=("ts", "event_id")).select("decision_id", feedback.resolution(F.col("feedback"), F.col("ts")).alias("resolution"))
