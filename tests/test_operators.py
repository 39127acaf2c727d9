import io
import json
import math
import random
import zipfile
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from graphloom.functions import noise as N
from graphloom.functions import text as T
from graphloom.operators import acyclic, engine, essence, feedback, graph, merge, models, order, retrieval, sections, triples
from graphloom.plans.rebuild import rebuild
from graphloom.sources import config, office, readers, writers
from graphloom.streaming.feedback import SCHEMA, upsert_stream


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_sections(spark):
    md = "# Book\nIntro\n<!-- page: 4 -->\n## Chapter A\nAlpha\n## Empty\n### Chapter B\nBeta\n<!-- page: 5 -->"
    docs = spark.createDataFrame([("b", md), ("plain", "no headings here"), ("blank", " \n "), ("marks", "# only\n## heads")], "book_id string, markdown string")
    got = {(r.book_id, r["index"]): r for r in sections.split_sections(docs, ["book_id"], default_title=F.lit("whole")).collect()}
    assert [got["b", i].title for i in range(3)] == ["Book", "Chapter A", "Chapter B"]
    assert [(got["b", i].level, got["b", i].page_start, got["b", i].page_end) for i in range(3)] == [(1, 4, 4), (2, 4, 4), (3, 4, 5)]
    assert got["plain", 0].title == "whole" and got["marks", 0].markdown == "# only\n## heads" and not any(k[0] == "blank" for k in got)


def test_office_readers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Clinical Notes", "Heading1") + p("text") + f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "notes.docx").write_bytes(data.getvalue())
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="Vitals" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>BP</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>120/80</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {s}><sheetData/></worksheet>")
    (tmp_path / "tables.XLSX").write_bytes(data.getvalue())
    (tmp_path / "a.md").write_text("# A\nbody")
    (tmp_path / "ignore.txt").write_text("x")
    got = {r.book_id: r for r in readers.load_markdown(spark, str(tmp_path)).collect()}
    assert set(got) == {"notes", "tables", "a"}
    assert got["notes"].markdown == "# Clinical Notes\n\ntext\n\n| A | B |\n| --- | --- |\n| 1 |  |"
    assert got["tables"].markdown.startswith("## Vitals\n\n| BP |  | 120/80 |") and "Empty" not in got["tables"].markdown
    with pytest.raises(Exception, match="unsupported file"):
        readers.load_markdown(spark, str(tmp_path), every=True).collect()
    with pytest.raises(Exception):
        readers.load_markdown(spark, str(tmp_path / "missing")).collect()


def block(text, y, size, font="Serif", flags=0, x=50):
    return {"bbox": (x, y, x + 200, y + size), "spans": [{"text": text, "size": size, "font": font, "flags": flags}]}


PAGES = [
    {"height": 800, "blocks": [block("running head", 20, 9), block("Body text that is long enough to be the commonest size of all", 300, 11), block("第一章 总论", 100, 18), block("Topic in larger type", 200, 14.2), block("right column", 300, 11, x=300), block("more body", 400, 11)]},
    {"height": 800, "blocks": [block("  ", 100, 11), block("17", 780, 9)]},
    {"height": 800, "blocks": [block("病例 one.....", 90, 11), block("一、定义", 150, 11), block("A bold line", 200, 11.6, "Serif-Bold"), block("plain end", 300, 11)]},
]


def test_pdf_layout():
    assert office.layout(PAGES).split("\n\n") == [
        "<!-- page: 1 -->", "# 第一章 总论", "## Topic in larger type", "Body text that is long enough to be the commonest size of all", "right column", "more body",
        "<!-- page: 2 -->", "> no extractable text on this page", "<!-- page: 3 -->", "病例 one...", "### 一、定义", "### A bold line", "plain end",
    ]
    assert [x for x in office.layout_script(PAGES).split("\n") if x] == ["# 第一章 总论", "## Topic in larger type", "Body text that is long enough to be the commonest size of all", "right column", "more body", "### 💡 病例 one...", "### 一、定义", "A bold line", "plain end"]
    assert office.layout([]) == "" and office.layout_script([]) == ""


def test_env_and_status():
    values = config.env_values("# note\nA=1\n B = 'two words' \nbad line\nC=\n=x\nA2=\"q=r\"")
    into = {"A": "kept"}
    config.settle(values, into)
    assert values == {"A": "1", "B": "two words", "C": "", "A2": "q=r"} and into == {"A": "kept", "B": "two words", "C": "", "A2": "q=r"}


def test_links_and_decisions_as_written(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"edges": [{"source": {"id": "a", "name": "A"}, "target": "b", "relation": "parallel"}, {"source": {"name": "N"}, "target": "c"}, {"source": "x"}]}))
    assert {(r.source, r.target) for r in readers.graph_edges(spark, str(tmp_path / "g.json")).collect()} == {("a", "b"), ("N", "c")}
    (tmp_path / "d.json").write_text(json.dumps([{"decision_id": "D1", "type": "merge", "nodes": ["a"]}, {"type": "broken"}]))
    assert [r.decision_id for r in readers.decisions(spark, str(tmp_path / "d.json")).collect()] == ["D1"]
    assert readers.decisions(spark, str(tmp_path / "none.json")).count() == 0


def test_order_over_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1.5, 2.0, 3.25, None, rng.random() * 9]), rng.randrange(4)) for i in range(500)]
    d = spark.createDataFrame(rows, "id int, v double, w long")
    kept = [r for r in rows if r[1] is not None]
    got = {r.id: r.n for r in order.running(d.where("v is not null"), [F.col("v"), F.col("id")], "n").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in sorted(kept, key=lambda r: (r[1], r[0]))] and sorted(got.values()) == list(range(1, len(kept) + 1))
    total, want = 0, {}
    for i, v, w in sorted(kept, key=lambda r: (r[1], r[0])):
        total += w
        want[i] = total
    assert {r.id: r.n for r in order.running(d.where("v is not null"), [F.col("v"), F.col("id")], "n", F.col("w")).collect()} == want
    shares = (0.0, 0.2, 0.55, 0.85, 1.0)
    exact = d.agg(F.percentile("v", F.array(*(F.lit(s) for s in shares))).alias("q")).first().q
    assert order.quantiles(d, "v", shares) == exact and order.quantiles(d.where("id < 0"), "v", shares) == []
    plan = order.running(d, [F.col("v")], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1]  # the window over rows is dealt by range


def test_nearest_in_blocks_by_brute_force(spark):
    rng = random.Random(7)
    points = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(80)]
    v = spark.createDataFrame(points, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    want = {(j, r + 1): i for j, p in points[:9] for r, (_, i) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(p, o)), i) for i, o in points)[:6])}
    for block_ in (4, 1024):
        assert {(r.query_id, r["rank"]): r.vec_id for r in retrieval.knn(v, q, 6, block=block_).collect()} == want
    assert retrieval.knn(v, q.limit(0), 6).count() == 0 and retrieval.knn(v.limit(0), q, 6).count() == 0


def test_labels_in_chunks_by_brute_force(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abc心肌") for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(99, None)]
    labels = sorted({"".join(rng.choice("abc心肌1 ") for _ in range(rng.randrange(1, 5))) for _ in range(40)})
    hit = []
    for label in labels:
        needle = "".join(c for c in label if c not in "1 ")
        found = sorted((-(1 - t.find(needle) / len(t)), i) for i, t in texts if len(needle) >= 2 and t and needle in t)[:3]
        hit += [(label, i, round(-s, 9), k + 1) for k, (s, i) in enumerate(found)]
    d, l = spark.createDataFrame(texts, "chunk_id long, content string").repartition(3), spark.createDataFrame([(x,) for x in labels], "label string")  # noqa: E741
    for block_ in (10, 10**6):
        got = merge.label_in_chunk(l, d, block_chars=block_).collect()
        assert sorted((r.label, r.chunk_id, round(r.score, 9), r["rank"]) for r in got) == sorted(hit)


def test_pdf_needs_its_library():
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            office.pdf_markdown(b"%PDF")


def test_labels_and_noise(spark):
    assert one(spark, "## 一、心肌____细胞 ..... 12", T.clean_label) == "心肌 细胞"
    flags = lambda t: [one(spark, t, f) for f in (N.BUILDER, N.MERGER, N.ESSENCE, N.EXPORT)]
    assert flags("心电图") == [False, False, True, False] and flags("03_生理学") == [True, True, True, False] and flags("💡提示内容说明") == [False, False, True, True]
    assert one(spark, "心电图", N.valid_concept) and not one(spark, "主要", N.valid_concept) and not one(spark, "人民卫生出版社教材", N.valid_concept)
    assert [one(spark, t, T.natural_key) for t in ("a2", "a10")] == sorted(one(spark, t, T.natural_key) for t in ("a10", "a2"))
    assert one(spark, "心电图检查", T.terms) == ["心电", "电图", "图检", "检查"]


def chunk_rows(spark, texts):
    rows = [("03_生理学", i, f"chunks/03_生理学/{i:02d}_循环.md", t) for i, t in enumerate(texts)]
    return sections.chunk_identity(spark.createDataFrame(rows, "book_id string, chunk_pos long, path string, content string"))


def test_extraction(spark):
    texts = [f"# {a}\n## {b}的结构特征\n{b}可用于心律失常诊断的临床研究方法。\n## {b}的调节机制\n正文内容足够长的一句话。\n" for a, b in (("循环系统总论", "心肌细胞膜"), ("呼吸系统总论", "肺泡上皮层"), ("消化系统总论", "胃黏膜腺体"))]
    got = triples.extract(chunk_rows(spark, texts)).collect()
    kinds = Counter(r.relation for r in got)
    assert set(kinds) == {"containment", "parallel", "prerequisite", "application"} and all(r.evidence for r in got)
    both = {(r.subject, r.object) for r in got if r.relation == "parallel"}
    assert both == {(b, a) for a, b in both}
    before = [(r.subject, r.object) for r in got if r.relation == "prerequisite"]
    assert len(before) >= 2 and all(acyclic.greedy(before))
    assert all(r.confidence in (0.72, 0.62) for r in got if r.relation == "application")


def test_greedy_acyclic_by_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        pairs = [(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(25)]
        edges, want = [], []
        for u, v in pairs:
            seen, todo = {v}, [v]
            while todo:
                x = todo.pop()
                for a, b in edges:
                    if a == x and b not in seen:
                        seen.add(b)
                        todo.append(b)
            want.append(u != v and u not in seen)
            if want[-1]:
                edges.append((u, v))
        assert acyclic.greedy(pairs) == want


def test_bounded_search_by_brute_force(spark):
    rng = random.Random(2)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(90)})
    edges = [(a, b, i) for i, (a, b) in enumerate(pairs) if a != b]
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    degree = Counter(x for a, b, _ in edges for x in (a, b))
    near = {i: sorted(((b if a == i else a, k) for a, b, k in edges if i in (a, b)), key=lambda t: (-degree[t[0]], t[1]))[:4] for i in ids}
    seeds = sorted(ids, key=lambda i: (-degree[i], ids.index(i)))[:3]
    order, queue = list(seeds), deque(seeds)
    while queue and len(order) < 15:
        for j, _ in near[queue.popleft()]:
            if j not in order and len(order) < 15:
                order.append(j)
                queue.append(j)
    got = graph.readable_subgraph(spark.createDataFrame(list(zip(ids, range(len(ids)))), "id string, pos int"), spark.createDataFrame(edges, "source string, target string, pos int"), 3, 4, 15).orderBy("rank").collect()
    assert [r.id for r in got] == order


def test_pagerank_and_bm25_by_hand(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")]
    r = {k: 0.25 for k in "abcd"}
    for _ in range(30):
        lost = r["d"] / 4
        r = {k: 0.0375 + 0.85 * (lost + sum(r[u] / sum(x == u for x, _ in e) for u, v in e if v == k)) for k in "abcd"}
    got = {x.id: x["rank"] for x in graph.pagerank(spark.createDataFrame(e, "source string, target string"), 30).collect()}
    assert all(abs(got[k] - r[k]) < 1e-9 for k in r)
    texts = ["red fish blue fish", "red dog", "green bird", "one fish"]
    tokens = [t.split() for t in texts]
    idf = {w: math.log((4 - n + 0.5) / (n + 0.5)) for w in {w for t in tokens for w in t} for n in [sum(w in t for t in tokens)]}
    idf = {w: v if v >= 0 else 0.25 * sum(idf.values()) / len(idf) for w, v in idf.items()}
    mean = sum(map(len, tokens)) / 4
    want = {i: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ("red", "fish", "fish")) for i, t in enumerate(tokens)}
    scored = retrieval.bm25(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string"), spark.createDataFrame([(0, "red fish fish")], "query_id int, question string"))
    for x in scored.collect():
        assert abs(x.score - want[x.chunk_id]) < 1e-9


def test_merge_rules(spark):
    t = [("a", "x1", "parallel", "y1"), ("a", "y1", "parallel", "x1"), ("a", "p1", "prerequisite", "q1"), ("b", "q1", "prerequisite", "p1"), ("b", "x1", "containment", "z1"), ("b", "x1", "containment", "x1")]
    rows = spark.createDataFrame([(b, s, r, o, 0.5, "e", "ch", "p", i) for i, (b, s, r, o) in enumerate(t)], "book_id string, subject string, relation string, object string, confidence double, evidence string, chapter string, source_path string, seq int")
    e = graph.edges(rows)
    assert {(r.source, r.target) for r in merge.conflicts(e).collect()} == {("p1", "q1")}
    assert len(merge.conflicts(e, compat=True).collect()) == 5
    assert {r.label for r in merge.exact_matches(merge.book_nodes(rows)).collect()} == {"x1", "p1", "q1"}
    assert {(r.book_id, r.other, r.source, r.missing) for r in merge.complements(e).collect()} == {("a", "b", "x1", 1), ("a", "b", "p1", 1), ("b", "a", "x1", 2), ("b", "a", "q1", 1)}
    c = spark.createDataFrame([("a", "l", "b", "m", 0.9), ("a", "n", "b", "o", 0.75), ("a", "r", "b", "s", 0.75)], "b1 string, l1 string, b2 string, l2 string, score double")
    said = spark.createDataFrame([("a", "n", "o", False, 0.85)], "b1 string, l1 string, l2 string, same boolean, confidence double")
    got = {r.l1: (r.confidence, r.resolved) for r in merge.verdicts(c, replies=said).collect()}
    assert got == {"l": (0.9, True), "n": (0.35, True), "r": (0.75, False)}


def test_budget(spark):
    text = "# head\n> quote\nbody\n*关联: x\n- [link](y)\n\n- **item**: z\n" + "> long line of some length\n" * 80
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(text.split("\n"))], "doc string, pos int, line string")
    kept = essence.strict_budget(rows, 300).orderBy("pos").collect()
    assert [r.kept for r in kept[:4]] == ["# head", "> quote", "- [link](y)", ""] and sum(len(r.kept) + 1 for r in kept) < 300
    assert [one(spark, "x" * n, lambda c: essence.budget(F.length(c))) for n in (100, 10_000)] == [30, 3000]
    assert one(spark, "a<details>\nx\n</details>b", essence.without_details) == "ab"
    assert len(one(spark, "y" * 100, lambda c: essence.cut_to(c, F.lit(60)))) == 60


def test_models_and_feedback(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "book string, head string")
    cache = asked.where("book = 'a'").select(T.cache_key(F.col("book"), F.col("head")).alias("key"), F.lit("kept").alias("reply"))
    got = models.replies(asked, cache, ["book", "head"], "head", model=lambda p: [t.upper() for t in p]).collect()
    assert sorted(r.reply for r in got) == ["Y", "kept"]
    vectors = models.embed(asked.withColumnRenamed("head", "content"), lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert all(r.embedding == [1.0, 1.0] for r in vectors)
    said = spark.createDataFrame([(1, "d1", "first"), (2, "d1", "last")], "ts int, decision_id string, feedback string")
    up = {r.decision_id: r for r in feedback.updated(spark.createDataFrame([("d1",), ("d2",)], "decision_id string"), said).collect()}
    assert up["d1"].teacher_feedback == "last" and up["d1"].resolved and not up["d2"].resolved


def test_feedback_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"feedback_id": f, "ts": f"2024-01-01T00:0{i}:00", "decision_id": "d1", "feedback": x} for i, (f, x) in enumerate([("f1", "old"), ("f2", "new"), ("f1", "old")])]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    made, out = spark.createDataFrame([("d1",), ("d2",)], "decision_id string"), {}
    exported = []
    q = upsert_stream(spark.readStream.schema(SCHEMA).json(str(folder)), lambda: made, lambda df, i: out.update({i: {r.decision_id: r.teacher_feedback for r in df.collect()}}), str(tmp_path / "state"), export=exported.append)
    q.awaitTermination(120)
    assert any(v == {"d1": "new", "d2": None} for v in out.values()) and exported == sorted(out)


def test_rebuild(spark, tmp_path):
    texts = [f"# {a}\n## {b}的结构特征\n{b}可用于心律失常诊断的临床研究方法。\n## {b}的调节机制\n正文内容足够长的一句话。\n" for a, b in (("循环系统总论", "心肌细胞膜"), ("呼吸系统总论", "肺泡上皮层"))]
    rows = [(book, f"{i:02d}_x", f"{book}/{i:02d}_x.md", t) for book in ("一本教材", "二本教材") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "book_id string, chunk_name string, path string, content string")
    out = rebuild(spark, chunks, str(tmp_path / "out"), rounds=10)
    assert {r.type for r in out["decisions"].collect()} >= {"merge"}
    nodes = {r.id for r in out["snapshot_nodes"].collect()}
    assert nodes and all(r.source in nodes and r.target in nodes for r in out["snapshot_links"].collect())
    assert out["report"].first().nodes_after < out["report"].first().nodes_before and out["essence"].count() == len(nodes)
    index = engine.Engine(spark, str(tmp_path / "index"))
    assert not index.built() and index.built_from(lambda: chunks.withColumn("chunk_id", F.col("path"))).built()
    asked = spark.createDataFrame([(0, "心肌细胞膜"), (1, "nothing of it")], "query_id int, question string")
    hits = index.search(asked, 2)
    assert "心肌细胞膜" in hits.where("query_id = 0 and rank = 1").first().content
    told = {r.query_id: r for r in engine.answers(engine.prompts(asked, hits.where("query_id = 0")), lambda p: [t[-20:] for t in p]).collect()}
    assert told[0].answer.endswith("请回答：") and len(told[0].citations) == 2 and told[0].citations[0].source in ("一本教材", "二本教材") and told[1].answer == "针对「nothing of it」，在教材中未找到足够相关的内容。"
    (off,) = engine.answers(engine.prompts(asked.where("query_id = 0"), hits), models.offline).collect()
    assert off.answer.startswith("针对「心肌细胞膜」，检索到 2 条相关段落。")
    counts = {r.artifact: r.files for r in engine.status(spark, str(tmp_path), {"graphs": "out/merged", "search_index": "index/terms", "none": "missing"}).collect()}
    assert counts["graphs"] > 0 and counts["search_index"] > 0 and counts["none"] == 0


def test_semantic_candidates_inside_words(spark):
    hits = spark.createDataFrame([("a", "心肌细胞结构", 1, 0.9, "关于心肌细胞膜的结构"), ("a", "heart organ", 2, 0.8, "the cardiology of it"), ("a", "else", 3, 0.6, "none else")], "book_id string, label string, chunk_id long, score double, content string")
    labels = spark.createDataFrame([("b", "心肌细胞"), ("c", "cardio"), ("c", "none"), ("a", "心肌细胞膜")], "book_id string, label string")
    assert {(r.chunk_id, r.b2, r.l2) for r in merge.semantic_candidates(hits, labels).collect()} == {(1, "b", "心肌细胞"), (2, "c", "cardio")}


def test_semantic_candidates_over_chunks(spark):
    hits = spark.createDataFrame([("a", "node", 1, 0.9, "alpha beta"), ("a", "node", 2, 0.88, "alpha beta gamma"), ("a", "node", 3, 0.75, "delta"), ("a", "node", 4, 0.72, "delta gamma")], "book_id string, label string, chunk_id long, score double, content string")
    labels = spark.createDataFrame([("b", "alpha"), ("b", "beta"), ("c", "delta"), ("d", "gamma")], "book_id string, label string")
    assert {(r.chunk_id, r.b2, r.l2) for r in merge.semantic_candidates(hits, labels).collect()} == {(1, "b", "alpha"), (2, "b", "beta"), (3, "c", "delta")}


def test_bounded_evidence(spark):
    rows = [("b", "x", "parallel", "y", 0.1 * i, f"e{i}", i) for i in range(5)] + [("b", "x", "containment", "z", 0.5, "only", 9)]
    t = spark.createDataFrame(rows, "book_id string, subject string, relation string, object string, confidence double, evidence string, seq int")
    got = {r.target: (r.evidence, r.triples, r.confidence) for r in graph.edges(t, most=2).collect()}
    assert got == {"y": (["e0", "e1"], 5, 0.4), "z": (["only"], 1, 0.5)}


def test_many_small_files(spark, tmp_path):
    odd = ["a b", "p=q", "100%", "书"]
    rows = [(f"b{i}", 0, f"text {i} of more than twenty characters") for i in range(400)] + [(x, 0, f"text of {x}, of more than twenty characters") for x in odd] + [("none", 0, None)]
    made = spark.createDataFrame(rows, "book_id string, index int, markdown string")
    at = tmp_path / "files"
    writers.write_markdown_files(made, f"file://{at}")
    assert sorted(str(p.relative_to(at)) for p in at.rglob("*") if p.is_file()) == sorted(f"{b}/{b}.md" for b, _, _ in rows)
    assert (at / "none/none.md").read_bytes() == b"\n" and (at / "书/书.md").read_text() == "text of 书, of more than twenty characters\n"
    got = readers.chunks(spark, f"file://{at}")
    assert {r.content for r in got.collect()} == {t + "\n" for _, _, t in rows if t}
    assert got.rdd.getNumPartitions() <= 8  # 400 files of 4 MB by Spark's count would be 13 tasks
    writers.write_markdown_files(made.withColumn("markdown", F.lit("a text that is written over the one before")), f"file://{at}")
    assert {r.content for r in readers.chunks(spark, f"file://{at}").collect()} == {"a text that is written over the one before\n"}
    writers._write_moved(made.limit(3).select(F.col("book_id").alias("folder"), F.col("book_id").alias("name"), F.col("markdown").alias("value")), f"file://{tmp_path}/moved", ".md")
    assert {r.content for r in readers.chunks(spark, f"file://{tmp_path}/moved").collect()} == {rows[i][2] + "\n" for i in range(3)}


def test_many_small_files_by_the_router(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"b{i}").mkdir()
        (tmp_path / f"b{i}/b{i}.md").write_text(f"# Book {i}")
    got = readers.load_markdown(spark, str(tmp_path))
    assert {(r.book_id, r.source_type, r.markdown) for r in got.collect()} == {(f"b{i}", "md", f"# Book {i}") for i in range(400)}
    assert got.rdd.getNumPartitions() <= 8  # 400 files of 4 MB by Spark's count would be 13 tasks


def test_cycles_by_brute_force(spark):
    rng = random.Random(5)
    for n, m, longest in ((6, 30, 5), (12, 60, 4), (9, 20, 3), (40, 39, 3)):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("n0", "n0"), ("n1", None)]
        if n == 40:  # a hub
            pairs = [("n3", f"n{i}") for i in range(n)] + [(f"n{i}", "n3") for i in range(0, n, 2)] + pairs
        held, want = {p for p in pairs if None not in p}, []

        def walk(path):
            want.extend([list(path)] * ((path[-1], path[0]) in held))
            if len(path) < longest:
                for _, t in sorted(p for p in held if p[0] == path[-1] and p[1] > path[0] and p[1] not in path):
                    walk([*path, t])

        for v in sorted({p[0] for p in held}):
            walk([v])
        got = [r.nodes for r in graph.cycles(spark.createDataFrame(pairs, "source string, target string"), longest).collect()]
        assert sorted(got) == sorted(want)


def test_cycles_at_a_hub_make_no_pairs_of_its_neighbours(spark):
    n = 1000
    ends = spark.range(n).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("a"))
    star = ends.select(F.col("a").alias("source"), F.lit("h").alias("target")).unionByName(ends.select(F.lit("h").alias("source"), F.col("a").alias("target")))
    found = graph.cycles(star, 3)
    joined, held = [0], found.groupBy(F.size("nodes").alias("k")).count()
    assert {r.k: r["count"] for r in held.collect()} == {2: n}

    def rows(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return rows(plan.executedPlan())
        if "Join" in name:
            joined[0] = max(joined[0], plan.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStage"):
            return rows(plan.plan())
        for k in range(plan.children().size()):
            rows(plan.children().apply(k))

    rows(held._jdf.queryExecution().executedPlan())
    assert n <= joined[0] <= 4 * n


def test_chunk_files_share_the_folder_of_their_book(spark, tmp_path):
    made = spark.createDataFrame([(f"s{i % 3}", f"c{i}", f"chunk {i} of more than twenty characters") for i in range(30)], "book_id string, name string, content string")
    writers.write_chunk_files(made, f"file://{tmp_path}")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s0", "s1", "s2"]
    got = readers.chunks(spark, f"file://{tmp_path}").select("book_id", "chunk_name", "content").collect()
    assert {(r.book_id, r.chunk_name, r.content.strip()) for r in got} == {tuple(r) for r in made.collect()}
