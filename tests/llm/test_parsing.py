import hashlib
import random

import numpy as np

from graphloom.llm import parsing as P


def names(text, level):
    x = P.mix(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + P.ODD)
    doc = np.zeros(len(x), dtype=np.int32)
    for _ in range(level):
        x, doc = P.phrases(x, doc)
    return x.tolist()


def slow_phrases(x):
    """One level, symbol by symbol."""
    runs = []
    for v in x:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    one = lambda v: int(P.mix(np.array([v % 2**64], dtype=np.uint64))[0])
    x = [v if n == 1 else one(v + n * int(P.ODD)) for v, n in runs]
    label = x
    for _ in range(4):
        label = [P._toss(v, label[i - 1] if i else 0) for i, v in enumerate(label)]
    assert all(v < 6 for v in label[4:]) and all(a != b for a, b in zip(label, label[1:]))
    start = [i for i in range(len(x)) if i == 0 or label[i] > label[i - 1] and (i + 1 == len(x) or label[i] > label[i + 1])]
    out = []
    for a, b in zip(start, [*start[1:], len(x)]):
        assert b - a < 64
        out.append(one(sum(x[a + k] * int(P.POWERS[k]) for k in range(b - a)) + b - a))
    return out


def text(rng, n):
    return "".join(rng.choice("abcdefgh ijklmnopéü漢😀") for _ in range(n))


def test_levels_match_slow_parse():
    rng = random.Random(3)
    for n in (1, 2, 5, 300):
        t = text(rng, n) + "aaaa" * rng.randrange(3)
        x = P.mix(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + P.ODD).tolist()
        for level in (1, 2, 3):
            x = slow_phrases(x)
            assert names(t, level) == x


def test_equal_substrings_are_parsed_alike():
    rng = random.Random(4)
    common = text(rng, 2000)
    a, b = text(rng, 137) + common + text(rng, 50), text(rng, 1001) + common
    for level, lost in ((1, 20), (2, 20), (3, 20)):
        inner = names(common, level)[lost:-lost]
        joined = lambda t: ",".join(map(str, names(t, level)))  # noqa: E731, B023
        assert ",".join(map(str, inner)) in joined(a) and ",".join(map(str, inner)) in joined(b)


def test_batches_do_not_mix_documents():
    rng = random.Random(5)
    texts = [text(rng, n) for n in (0, 1, 7, 400, 0, 2500)] + [""]
    together = P.fingerprints(texts)
    for t, f in zip(texts, together):
        assert (P.fingerprints([t])[0] == f).all()


def test_contract(spark, odd, none):
    rng = random.Random(6)
    rows = [(i * 3 % 50, text(rng, rng.choice([0, 3, 80, 900]))) for i in range(50)]
    rows[7] = (rows[7][0], None)
    rows += [(900, rows[3][1] * 30), (899, rows[3][1] * 30), (-5, text(rng, 70_000))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in P.fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, t), (j, after) in zip(order, [*order[1:], order[0]]):
        t, after, r = t or "", after or "", got[i]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        f, g = P.fingerprints([t, e])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == f.tobytes().hex() and r.edited_fingerprint == g.tobytes().hex()
        assert r.near_next == P.likeness(f.tobytes(), bytes.fromhex(got[j].fingerprint)) and r.near_edited == P.likeness(f.tobytes(), g.tobytes())
    assert got[900].near_next == 1.0 and got[-5].near_edited > 0.2 > got[-5].near_next
    assert P.fingerprint_edits(odd).count() == odd.count() and P.fingerprint_edits(none).count() == 0
    (r,) = P.fingerprint_edits(docs.where("doc_id = 3")).collect()
    assert r.near_next == 1.0


def test_ties_are_split_and_keep_their_order(spark):
    import xxhash

    rng = random.Random(8)
    rows = [(5, text(rng, 60)) for _ in range(150)] + [(None, text(rng, 60)) for _ in range(80)] + [(None, "")] + [(i, text(rng, 60)) for i in range(20)] + [(7, "the same row")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i is None, i or 0, hashlib.sha256(e.encode()).hexdigest()))
    for size in (P.PART_BYTES, 500):
        got = P.fingerprint_edits(docs, part_bytes=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in got) == sorted(want)
    place = np.array([~r[0] if r[0] is not None else 2**63 - 1 for r in order], dtype=np.int64)
    hashes = np.array([signed(t) for _, t in order], dtype=np.int64)
    ranges = P.Ranges(np.quantile(place, np.arange(1, 20) / 20, method="lower").tolist())
    of = ranges.of(place, hashes)
    assert (np.diff(of) >= 0).all() and np.bincount(of).max() < 40  # 150 rows of one id lie in many ranges


def slow_minima(text):
    """Sampled minima, name by name: the least of each slot, an empty slot taking the next one's, told apart by the distance."""
    found = [int(P.mix(np.array([v], dtype=np.uint64) + np.uint64(k))[0]) for k in P.FEATURES for v in names(text, k)]
    one = lambda v: int(P.mix(np.array([v % 2**64], dtype=np.uint64))[0])
    least = [min((v for v in found if one(v) % P.SLOTS == s), default=None) for s in range(P.SLOTS)]
    out = []
    for s in range(P.SLOTS):
        shift = next((k for k in range(P.SLOTS) if least[(s + k) % P.SLOTS] is not None), None)
        if shift is None:
            return bytes(P.SLOTS)
        v = least[(s + shift) % P.SLOTS]
        if shift:
            v = one(v + shift * int(P.ODD))
        out.append(one(v) >> 56)
    return bytes(out)


def test_minima_and_likeness_by_brute_force():
    rng = random.Random(9)
    for n in (0, 1, 9, 200, 3000):
        t = text(rng, n)
        assert P.fingerprints([t])[0].tobytes() == slow_minima(t)
    a, b = bytes(range(128)), bytes(range(64)) + bytes(64)
    assert P.likeness(a, a) == 1.0 and abs(P.likeness(a, b) - (0.5 - 1 / 256) / (1 - 1 / 256)) < 1e-12
    # the share of equal slots estimates the share of common names
    x = text(rng, 30_000)
    y = x[:20_000] + text(rng, 10_000)
    p, q = (set(names(t, 2)) | set(names(t, 3)) for t in (x, y))
    f, g = P.fingerprints([x, y])
    assert abs(P.likeness(f.tobytes(), g.tobytes()) - len(p & q) / len(p | q)) < 0.15
