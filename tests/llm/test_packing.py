import random
from collections import defaultdict

from graphloom.llm import packing as P


def slow_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["left"] >= size and (s < 0 or s not in b["s"]) and c not in b["c"]]
        if fits:
            b = min(fits, key=lambda b: (b["left"], b["since"]))
        else:
            b = {"id": len(bins), "left": capacity, "s": set(), "c": set()}
            bins.append(b)
        b["left"] -= size
        b["s"].add(s)
        b["c"].add(c)
        b["since"] = len(out)
        out.append(b["id"])
    return out, [b["left"] for b in bins]


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(2)
    for _ in range(20):
        n = 200
        args = [rng.randrange(0, 60) for _ in range(n)], [rng.randrange(-1, 6) for _ in range(n)], [rng.randrange(0, 40) for _ in range(n)], 60
        assert P.best_fit(*args) == slow_best_fit(*args)


def test_pack(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(0, 90), rng.choice(["hot", "hot", "a", "b", None])) for i in range(400)] + [(1000, "long " * 1000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.pack(docs, capacity=512, shard=100).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for b in bins.values():
        assert sum(r.length for r in b) == 512 - b[0].residual >= 0
        assert len({r.cluster for r in b}) == len(b)
        named = [r.source for r in b if r.source]
        assert len(set(named)) == len(named)
        assert sorted(r.slot for r in b) == list(range(len(b)))
    for i, t, _ in rows:
        p = sorted(pieces[i], key=lambda r: r.piece)
        assert "".join(t[r.start : r.start + r.length] for r in p) == t and len(p) == max(1, -(-len(t) // 512))
    assert sum(r.length for r in P.pack(odd).collect()) == sum(len(r.text or "") for r in odd.collect())
    assert P.pack(none).count() == 0


def test_equal_rows_spread(spark):
    rows = [(1, "the same row again and again", "a")] * 60 + [(None, "no id", None)] * 40 + [(2, f"text {i}", "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [[(r.bin_id, r.slot, r.doc_id, r.length) for r in P.pack(docs.repartition(k), capacity=64, shard=10).collect()] for k in (2, 5)]
    assert sorted(got[0], key=str) == sorted(got[1], key=str) and len(got[0]) == 150
    shards = [b >> 32 for b, _, i, _ in got[0] if i == 1]
    assert max(map(shards.count, set(shards))) < 15
