import random
from collections import Counter

import numpy as np

from graphloom.llm import suffixdedup as S


def slow(texts):
    """Maximal removed runs of each text."""
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=np.int8)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        edge = np.diff(np.concatenate(([0], gone)))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "été", "x" * rng.randrange(1, 9), str(rng.randrange(10**6))])
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    out = [text(rng.randrange(5, 300)) for _ in range(12)]
    out += [text(30) + passage[rng.randrange(20) : len(passage) - rng.randrange(60)] + text(30) for _ in range(12)]
    for _ in range(6):  # edited copies
        t = list(out[rng.randrange(12)])
        for _ in range(rng.randrange(4)):
            if t:
                t[rng.randrange(len(t))] = "#"
        out.append("".join(t))
    out += ["a" * 350, "b" + "a" * 199 + "c", "ab" * 150, "a" * 199, "", text(100) * 2, passage[:200], "z" * 201]
    return out


def check(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(4)
    want = slow([(t or "").encode() for t in texts])
    for r in S.remove_repeats(docs, **how).collect():
        t = (texts[r.doc_id] or "").encode()
        assert [tuple(s) for s in r.spans] == want[r.doc_id]
        assert r.n_bytes == len(t) and r.n_removed == sum(b - a for a, b in want[r.doc_id])
        at, kept = 0, b""
        for a, b in want[r.doc_id]:
            kept += t[at:a]
            at = b
        assert bytes(r.kept) == kept + t[at:]


def test_matches_brute_force(spark):
    check(spark, [*corpus(1), None])


def test_hot_anchors_are_split_without_loss(spark):
    for hot in (0, 2):
        check(spark, [*corpus(2), None], hot=hot)


def test_sort_and_collisions(monkeypatch):
    rng = random.Random(3)
    buf = np.frombuffer("".join(rng.choice("ab") for _ in range(300)).encode() * 3 + b"q" * 500 + bytes(8), dtype=np.uint8)
    p = np.arange(0, len(buf) - 300, 3)
    h = S.Hashes(buf)
    got = S.merge_sort(h, buf, p, np.zeros(len(p)))
    assert [buf[x : x + 200].tobytes() for x in got] == sorted(buf[x : x + 200].tobytes() for x in p)
    seen = Counter(buf[x : x + 200].tobytes() for x in p)
    want = [seen[buf[x : x + 200].tobytes()] > 1 for x in p]
    assert S.repeats(buf, p, np.zeros(len(p), dtype=np.uint64)).tolist() == want
    monkeypatch.setattr(S, "VALUES", np.zeros(256, dtype=np.uint64))  # every hash collides
    assert S.repeats(buf, p, np.zeros(len(p), dtype=np.uint64)).tolist() == want


def test_nothing_wrong_goes_when_all_hashes_collide(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(6)]
    texts += [texts[2][100:450], "q" * 260 + texts[4][:210]]
    monkeypatch.setattr(S, "VALUES", np.zeros(256, dtype=np.uint64))
    check(spark, texts)


def test_odd_rows(spark, odd, none):
    got = S.remove_repeats(odd).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    assert next(r for r in got if r.doc_id == 4).n_removed == 5000
    assert S.remove_repeats(none).count() == 0
    twice = odd.where("doc_id = 8").unionByName(odd.where("doc_id = 8"))
    assert [r.n_removed for r in S.remove_repeats(twice).collect()] == [2100, 2100]
