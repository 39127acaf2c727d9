import random
from collections import defaultdict

import numpy as np
import xxhash

from graphloom.llm import simhash as S


def slow_fingerprint(text):
    words = [w for w in text.encode().translate(S.FOLD).split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius=4):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, f in rows:
        by[f].append(d)
    fps = list(by)
    for i, f in enumerate(fps):
        for g in fps[i:]:
            if (f ^ g).bit_count() <= radius:
                for d in by[f] + by[g]:
                    a, b = sorted((find(by[f][0]), find(d)))
                    parent[b] = a
    return {d: min(x for x in {d for d, _ in rows} if find(x) == find(d)) for d, _ in rows}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 70, 500):
        t = " ".join(rng.choice(["Ab", "été", "x", "\tlong-word", "Q\n"]) for _ in range(n))
        assert S.fingerprint(t.encode()) == slow_fingerprint(t)


def test_forests_match_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for b in base:
        for _ in range(rng.integers(1, 12)):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    want = [[j for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4] for i in range(len(fps))]
    a, b = np.array([(i, j) for i, js in enumerate(want) for j in js]).T
    expect = S._forest(len(fps), a, b)
    assert (S._large_links(fps, 4, queries=7) == expect).all()
    assert (S._small_links(fps, np.array([0]), np.array([len(fps)]), 4) == expect).all()


def test_components(spark):
    rng = random.Random(5)
    rows = []
    for g in range(30):
        words = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(120)]
        for _ in range(rng.randrange(1, 5)):
            w = list(words)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.near_duplicates(docs).collect()
    fps = {d: slow_fingerprint(t or "") for d, t in rows}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == slow_components(list(fps.items()))


def test_tiles_lose_no_link(spark):
    fps = [(x, i) for i, x in enumerate(sorted({(1 << a) | (1 << b) for a in range(12) for b in range(12)}))]
    d = spark.createDataFrame(fps, "fp long, id long")
    from graphloom.llm.components import components

    roots = components(S.similar(d, tile=10), "a", "b").collect()
    assert {r.root for r in roots} == {0} and len(roots) == len(fps)


def test_odd_rows(spark, odd, none):
    got = S.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].fp == 0 and by[1].component_id == 0 and by[3].component_id == 0 and by[6].component_id == 5
    assert S.near_duplicates(none).count() == 0
