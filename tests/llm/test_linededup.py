import random
from collections import defaultdict

from graphloom.llm import linededup as L

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def slow(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"{x} common line number {k} of the pool" for k, x in enumerate("ÀbÇdEfGhIJ")] + ["short", "", "  \t", "x" * 19, "y" * 20]
    rows = []
    for i in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(0, 9))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", " "]) for x in lines]
        rows.append((i * 7 % 80, "\n".join(lines)))
    return rows + [(500, None), (501, "Z" * 30000 + "\n" + pool[0])]


def test_matches_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, "x", 1, 2, "b") for r in rows], "doc_id long, text string, kept string, n_lines int, n_dropped int, body string")
    want = slow(rows)
    for size in (L.BATCH_BYTES, 5000):  # four batches, and more than twice FANOUT squared
        got = L.dedup_lines(docs, batch_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_lines, r.n_dropped, r.kept or "") == want[r.row.doc_id] and (r.kept is None) == (r.row.doc_id == 500)
            assert (r.row.kept, r.row.n_lines, r.row.n_dropped, r.row.body) == ("x", 1, 2, "b")


def batch(spark, b):
    docs = spark.createDataFrame([(100 - b * 10 - i, "a line that every document has\n" + f"a line of document {b * 10 + i} alone") for i in range(3)], "doc_id long, text string")
    return L.line_keys(docs)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_levelled_and_merged(spark):
    runs = L.LineRuns(spark)
    for b in range(7):
        runs.add(batch(spark, b))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    (r,) = runs.repeated(3).collect()
    assert (r.n_docs, r.holder) == (21, 100)
    assert sum(spark.table(n).count() for n in runs.runs()) == 22
    with L.sorted_scans(spark):
        again = runs.fresh(runs.batches[-1])
        assert again.count() == 0
        for df in (again, runs.merged(*runs.runs()[:2])):  # merge joins of sorted buckets
            assert "SortMergeJoin" in plan(df) and "Exchange" not in plan(df) and "Sort " not in plan(df)
    runs.close()


def test_anti_join_decides(spark, monkeypatch):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(L.LineRuns, "fresh", lambda self, batch: self.spark.table(batch))
    got = {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept or "") for r in L.dedup_lines(docs, batch_bytes=7000).collect()}
    assert got != slow(rows)


def test_odd_rows(spark, odd, none):
    got = L.dedup_lines(odd)
    assert got.select("row.*").columns == [c for c in odd.columns if c != "text"]
    got = got.collect()
    assert len(got) == odd.count()
    by = {r.row.doc_id: r for r in got}
    assert (by[0].n_lines, by[0].n_dropped, by[0].kept) == (1, 0, None) and by[3].n_lines == 3 and by[4].row.kept == "extra" and by[4].row.n_lines == 1
    assert L.dedup_lines(none).count() == 0
    same = spark.createDataFrame([(None, "the line that all of them hold"), (None, "the line that all of them hold"), (1, "the line that all of them hold"), (2, "the line that all of them hold")], "doc_id long, text string")
    for size in (L.BATCH_BYTES, 10):
        assert sorted((r.row.doc_id or 0, r.n_dropped) for r in L.dedup_lines(same, batch_bytes=size).collect()) == [(0, 1), (0, 1), (1, 1), (2, 0)]
