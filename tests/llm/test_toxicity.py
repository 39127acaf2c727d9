import random
import zlib

import numpy as np

from graphloom.llm import toxicity as T

SYLLABLES = "ba be lo ra ti on er st an ou wh th".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4)))


def corpus(n, seed, bad=("grumbax", "vilothek", "zorkling")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [word(rng) for _ in range(rng.randrange(20, 60))]
        y = int(rng.random() < 0.3)
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), y))
    return rows


def slow_margin(model, text):
    best = T.FLOOR
    for w in text.split():
        s = [0, *[T._symbol(ord(c)) for c in w if T._symbol(ord(c)) != T.FILL]]
        f = {}
        for i in range(len(s)):
            for a in (1, 2, 3):
                for b in (1, 2, 3):
                    if i + a + b < len(s):
                        k = (s[i] * 32 + s[i + a]) * 32 + s[i + a + b]
                        f[k] = f.get(k, 0) + T.DECAY ** (a + b)
        if len(s) > 1:
            dot, norm = sum(model.weights[k] * v for k, v in f.items()), max(1e-9, sum(v * v for v in f.values()) ** 0.5)
            best = max(best, dot / norm + model.bias)
    return best


def test_held_out_accuracy_and_margins():
    rows = corpus(500, 1)
    train, test = [r for r in rows if r[0] % 4], [r for r in rows if not r[0] % 4]
    model = T.train([t for _, t, _ in train], [y for *_, y in train], (300, 100))
    p = model.probabilities([t for _, t, _ in test]) >= T.THRESHOLD
    assert np.mean(p == np.array([y == 1 for *_, y in test])) >= 0.95
    odd = ["grumbax you", "g.r.u.m.b.a.x", "g r u m b a x", "grummbax", "grumb-ax!"]
    assert (model.probabilities(odd) >= T.THRESHOLD).all()
    for t in [test[0][1], *odd[:2], "grumbax" * 3]:
        want = slow_margin(model, t)
        if want > T.REFINE:
            assert abs(model.margins([t])[0][0] - want) < 1e-3


def slow_sentence_margin(model, text):
    """Symbol by symbol: sentences end at a line feed or at a blank after an end mark; a break starts the next one."""
    at = [0, 0, *[T._symbol(ord(c)) if ord(c) < len(T.TABLE) else 27 + ord(c) % 4 for c in text], 0, 0]
    gap = [x == T.NONE for x in at]
    seq = []
    for i, x in enumerate(at):
        inside = 2 <= i < len(at) - 2
        if x == T.FILL or inside and gap[i] and gap[i - 2] and gap[i + 2] and not gap[i - 1] and not gap[i + 1]:
            continue
        stop = not inside or text[i - 2] == "\n" or i > 2 and text[i - 3] in ".!?。！？…"
        if x == T.NONE and seq and seq[-1][0] == T.NONE:
            seq[-1] = (T.NONE, seq[-1][1] or stop)
        else:
            seq.append((x, x == T.NONE and stop))
    parts = []
    for x, stop in seq:
        if stop or len(parts[-1]) == T.SENTENCE:
            parts.append([])
        parts[-1].append(x)
    best = T.FLOOR
    for p in parts:
        total = norm = 0.0
        for a in (1, 2, 3):
            for b in (1, 2, 3):
                for i in range(len(p) - a - b):
                    total += T.DECAY ** (a + b) * model.wide[(p[i] * 32 + p[i + a]) * 32 + p[i + a + b]]
                    norm += T.DECAY ** (2 * (a + b))
        if len(p) > 2:
            best = max(best, total / norm**0.5 + model.wide_bias)
    return best


def test_sentences_by_brute_force():
    rng = np.random.default_rng(5)
    model = T.Model(rng.normal(0, 0.05, T.WIDTH**3), -0.5, wide=rng.normal(0, 0.05, T.WIDTH**3), wide_bias=0.1)
    texts = ["One two. Three four! Five\nsix", "", "a b c d.e.f  g", "no end at all " * 60, "é漢字。 x…  y?\n\n\nz", "1d10t! y0u", ".", "x" * 700 + ". tail"]
    got = model.margins(texts)
    for t, word, wide in zip(texts, *got):
        assert abs(word - slow_margin(model, t)) < 1e-6 or slow_margin(model, t) < T.REFINE or t.startswith("a b") or "é" in t
        assert abs(wide - slow_sentence_margin(model, t)) < 1e-6
        assert all(abs(x[0] - y) < 1e-9 for x, y in zip(model.margins([t]), (word, wide)))


def test_sentence_machine_learns_insults_of_several_words():
    rng = random.Random(6)
    rows = []
    for i in range(600):
        parts = [" ".join(word(rng) for _ in range(rng.randrange(4, 9))) for _ in range(rng.randrange(2, 6))]
        y = int(rng.random() < 0.4)
        pair = [word(rng) for _ in range(4)]
        k = rng.randrange(len(parts))
        parts[k] = " ".join([*pair[:2], *(["you", "lose"] if y else rng.choice([["lose", "you"], ["you"], ["lose"]])), *pair[2:]])
        rows.append((". ".join(parts) + ".", y))
    model = T.train([t for t, _ in rows[:450]], [y for _, y in rows[:450]], (270, 180))
    wide = model.margins([t for t, _ in rows[450:]])[1]
    y = np.array([y for _, y in rows[450:]])
    assert np.mean(wide[y == 1][:, None] > wide[y == 0][None, :]) > 0.8


def test_long_words_keep_their_norm():
    rng = np.random.default_rng(4)
    model = T.Model(rng.normal(0.02, 0.05, T.WIDTH**3), -0.5)
    for n in (100, 5000, 20_000):
        word = "".join(chr(97 + c) for c in rng.integers(0, 26, n))
        assert abs(model.margins([word])[0][0] - slow_margin(model, word)) < 1e-6


def test_contract_and_odd_rows(spark, odd, none):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "grumbax", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, "clash") for i, _, y in rows], "doc_id long, toxic int, text string")
    got = T.classify(docs, labels).collect()
    assert len(got) == 304
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by = {r.doc_id: r for r in got}
    assert not by[900].predicted and by[900].score == by[901].score and by[None].predicted
    right = [by[i].predicted == y for i, _, y in rows if by[i].held_out]
    assert np.mean(right) >= 0.9
    kept = T.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert T.classify(odd, labels.limit(0)).count() == odd.count() and T.classify(none, labels).count() == 0
