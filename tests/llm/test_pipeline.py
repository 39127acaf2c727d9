import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import simhash, stages


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def groups(texts):
    """The least member of the group of each text, by the exact similarity of all pairs."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (not (texts[i] or "").split() and not (texts[j] or "").split() or jaccard(texts[i] or "", texts[j] or "") >= 0.8):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def near_corpus(seed, edits):
    rng = random.Random(seed)
    texts = []
    for g in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            w = list(base)
            for _ in range(rng.choice(edits)):
                w[rng.randrange(200)] = f"e{rng.randrange(4000)}"
            texts.append(" ".join(w))
    texts.append(" ".join(texts[0].split()[:60]) + " " + " ".join(["again and again it goes"] * 200))
    texts.append(" ".join(texts[1].split()[:60]) + " " + " ".join(["again and again it goes"] * 200))
    return texts


def test_one_of_each_group_stays(spark):
    texts = near_corpus(12, [1, 3, 5, 6, 7, 8, 10, 13])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    want = sorted(set(groups(texts)))
    for tile in (simhash.TILE, 2):
        got = simhash.representatives(docs, tile=tile)
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_rows_without_their_own_id(spark):
    texts = near_corpus(13, [1, 2, 3])[:60]
    other = [" ".join(f"z{i}x{k}" for k in range(60)) for i in range(8)]
    rows = list(enumerate(texts)) + [(7, other[0]), (7, other[1]), (7, other[0]), (None, other[2]), (None, other[3]), (None, other[3]), (None, texts[5]), (500, other[2]), (None, None), (None, ""), (501, other[4] + " "), (501, other[4])]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = simhash.representatives(docs).collect()
    root = groups([t for _, t in rows])
    assert len(got) == len(set(root))
    for r in set(root):
        members = [rows[k] for k in range(len(rows)) if root[k] == r]
        (one,) = [(g.doc_id, g.text) for g in got if (g.doc_id, g.text) in members]
        assert (one[0] is None, one[0] or 0) == min((i is None, i or 0) for i, _ in members)


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, "same text here for all of us")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (stages.toxicity, stages.line_dedup, stages.near_duplicates, stages.decontamination):
        docs = odd.withColumn("n_chars", F.length("text").cast("long"))
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        assert len(got) == (docs.count() if stage is not stages.near_duplicates else 9)
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert stages.packing(spark, odd, str(tmp_path)).select("doc_id").count() >= odd.count()


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "lo", "ti", "re", "mu"]) for _ in range(3)) + str(rng.randrange(90))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(30), text(8)
    rows = [(i, text(60) + "\n" + text(20), "en", "s", 0) for i in range(60)]
    toxic = [(100 + i, text(30) + f" grumbax{i % 3} " + text(30), "en", "s", 0) for i in range(40)]
    rows += toxic + [(200 + i, rows[i][1] + "\n" + line, "en", "s", 0) for i in range(5)]
    rows += [(300, text(20) + " " + passage + " " + text(20), "en", "s", 0), (301, None, "en", "s", 0), (302, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grumbax" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = stages.toxicity(spark, docs, sf).cache()
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t, *_ in rows if "grumbax" not in (t or "")}
    lines = {r.doc_id: r.text for r in stages.line_dedup(spark, clean, sf).collect()}
    assert all(line not in lines[200 + i] for i in range(4)) and line in lines[204] and len(lines) == clean.count() and lines[301] is None
    near = stages.near_duplicates(spark, clean, sf)
    kept = {r.doc_id for r in near.collect()}
    assert not kept & set(range(200, 205)) and set(range(60)) <= kept and len(kept & {301, 302}) == 1
    cut = {r.doc_id: r for r in stages.decontamination(spark, near, sf).collect()}
    assert passage not in cut[300].text and len(cut[300].text.split()) == 40 and cut[300].n_chars == len(cut[300].text)
    assert all(cut[i].text == rows[i][1] for i in range(60))
    got = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(cut) and sum(r.length for r in got) <= sum(len(r.text or "") for r in cut.values())
    assert len(pipeline.STAGES) == 5


def cut_by_brute_force(text, bench):
    """The text without what lies between the first and the last word of each run of words that a benchmark window covers."""
    from test_decontaminate import words

    windows = {tuple(w[i : i + 10]) for b in bench for w in [words(b)] for i in range(max(len(w) - 9, 1) if w else 0)}
    at = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
    w, hit = words(text), set()
    assert len(w) == len(at)
    for i in range(len(w)):
        for n in {len(x) for x in windows}:
            if tuple(w[i : i + n]) in windows and i + n <= len(w):
                hit |= set(range(i, i + n))
    for i in sorted(hit, reverse=True):
        a, b = at[i]
        text = text[:a] + text[at[i + 1][0] if i + 1 in hit else b :]
    return text


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage after the model's, one by one in Python, against the rows of run()."""
    from test_linededup import slow as without_repeated_lines

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ba", "lo", "ti", "re", "mu", "é", "漢"]) for _ in range(3)) + str(rng.randrange(90))
    text = lambda n: " ".join(word() for _ in range(n))
    bench, pool = [text(30), text(12), text(5)], [text(8) for _ in range(6)]
    rows: list[tuple[int, str]] = []
    for i in range(90):
        t = "\n".join([text(rng.randrange(20, 60))] + [rng.choice(pool) for _ in range(rng.randrange(3))] + [text(rng.randrange(5, 30))])
        if rng.random() < 0.3:
            b = rng.choice(bench)
            t += " " + b.upper() + rng.choice([", ", " "]) + rng.choice(bench) + " " + text(6)
        if rng.random() < 0.2:
            t = text(20) + " grumbax " + t
        if rows and rng.random() < 0.25:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        rows.append((i * 7 % 90, t))
    rows += [(200, None), (201, ""), (202, text(2500))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grumbax" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    clean = {r.doc_id for r in stages.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    left = [(i, t) for i, t in rows if i in clean]
    lines = without_repeated_lines(left)
    left = [(i, lines[i][2]) for i, _ in left]
    root = groups([t for _, t in left])
    least: dict[int, int] = {}
    for (i, _), r in zip(left, root):
        least[r] = min(least.get(r, i), i)
    left = [(i, cut_by_brute_force(t, bench)) for (i, t), r in zip(left, root) if least[r] == i]
    want = sorted((i, k, k * 8192, min(8192, len(t) - k * 8192)) for i, t in left for k in range(max(1, -(-len(t) // 8192))))
    got = pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    assert len(clean) < len(rows) and len(left) < len(clean) - 5 and any(n > 1 for n in map([i for i, *_ in want].count, {i for i, *_ in want}))
