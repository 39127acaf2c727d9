import random
import re

import numpy as np

from graphloom.llm import decontaminate as D


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(docs, bench):
    windows = {}
    for item, t in bench:
        w = words(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted(items))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["The", "of", "été", "W" + str(rng.randrange(30)), "x-y"]) for _ in range(n))
    bench = [(i, text(rng.choice([5, 9, 10, 11, 25, 40]))) for i in range(30)] + [(90, None), (91, ""), (92, "solo!"), (93, "...")]
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 80))
        if rng.random() < 0.5:
            b = rng.choice(bench)[1] or ""
            t += " / " + b.upper() + "! " + b[: rng.randrange(len(b) + 1)] + " " + text(8)
        docs.append((i, t))
    return [*docs, (900, None), (901, ""), (902, bench[0][1]), (903, (bench[4][1] + " ") * 400)], bench


def test_matches_brute_force(spark):
    docs, bench = corpus(1)
    # rows that share an id or have none, equal texts, repeated rows
    docs += [(7, docs[3][1]), (7, docs[9][1]), (7, docs[3][1]), (None, docs[11][1]), (None, docs[12][1]), (None, docs[12][1]), (905, docs[11][1])]
    d = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(docs)], "doc_id long, text string, items string, n_chars long").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = slow(list(enumerate(t for _, t in docs)), bench)
    expect = sorted(((i is None, i or 0), *want[k]) for k, (i, _) in enumerate(docs))
    for blocks in (D.BLOCK_CHARS, 900, 1):
        got = [((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r.items) for r in D.contamination(d, b, block_chars=blocks).collect()]
        assert sorted(got) == expect
        cut = D.removed(d, b, block_chars=blocks, chars="none").collect()
        assert len(cut) == len(docs)
        for r in cut:
            assert (r.doc_id, r.items) == (docs[r.n_chars][0], "x") and len(words(r.text)) == want[r.n_chars][0] - want[r.n_chars][1]


def test_collisions(spark, monkeypatch):
    real = D.hashed
    docs, bench = corpus(3)
    want = slow(docs, bench)
    for seed in range(4):  # document words that collide with benchmark words hit nothing
        block = D.block_of([(str(i), (t or "").encode()) for i, t in bench], seed)
        assert block is not None
        narrow = lambda w, s, seed=seed: np.array([x if x in real([b"the"], seed) else np.uint64(5) for x in real(w, s)], dtype=np.uint64)
        monkeypatch.setattr(D, "hashed", narrow)
        assert D.block_of([(str(i), (t or "").encode()) for i, t in bench], seed) is None
        monkeypatch.setattr(D, "hashed", real)
    few = [(1, "the of the of the")]
    block = D.block_of([("1", few[0][1].encode())], 0)
    crowd = lambda w, s: np.array([real([b"the"], 0)[0] if x == b"the" else real([b"of"], 0)[0] for x in w], dtype=np.uint64)
    monkeypatch.setattr(D, "hashed", crowd)
    known = np.sort(crowd([b"the", b"of"], 0))
    (hit, items), (none, _) = D.scan_shard([D.words_of(b"x the of the of the"), D.words_of(b"the if the on the")], lambda: [block], known, 0, 5)
    assert hit.tolist() == [False] + [True] * 5 and items == {"1"} and not none.any()


def test_index_finds_every_place():
    rng = np.random.default_rng(2)
    s = np.append(rng.integers(1, 5, 400), 0)
    index = D.FMIndex(s)
    for n in (1, 3, 6):
        patterns = np.array([s[i : i + n] for i in rng.integers(0, 400 - n, 20)])
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(400 - n + 1) if (s[i : i + n] == p).all()]


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "same text here for all of us")], "item_id long, text string")
    got = {r.doc_id: r for r in D.contamination(odd, b).collect()}
    assert got[5].n_hit == 7 and got[0].n_words == 0 and got[7].n_words == 5 and got[None].n_words == 4
    assert D.contamination(odd, b.limit(0)).count() == odd.count() and D.contamination(none, b).count() == 0
    cut = D.removed(odd, b)
    assert cut.columns == odd.columns
    cut = {r.doc_id: r for r in cut.collect()}
    assert cut[5].text == "" and cut[0].text is None and cut[10].text == "one" and cut[None].text == "no id at all" and cut[4].kept == "extra"
