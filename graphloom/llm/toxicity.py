"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of three symbols with up to GAP - 1 other characters between neighbours, each
discounted by DECAY per character spanned, so insults with gaps or inserted characters keep most of their weight.  Symbols
are letters folded for case, accents and look-alike digits; letters spelled out one by one are read as one word.

Two machines share this kernel.  One is over whole sentences, across the breaks between their words, with sentences as
landmarks; the other is over the words of a sentence, so that one insult in a long sentence is not drowned by the rest.

Training reads a bounded, documented sample of labelled rows: SAMPLE_ROWS of each class, none longer than SAMPLE_CHARS.
Labels belong to documents, so each toxic document gets a witness: of its words the most telling one, chosen first by document
frequencies and then by the machine itself, with any words that tell beyond chance; of its sentences the one with the worst
word, then the one that the sentence machine finds worst.  Words and sentences of clean documents are negative.  Landmarks come
from both sides; a machine works in the landmarks' Nystroem space and is folded into one weight per subsequence, so scoring
is a table look-up over whole texts.  A document's margins are those of its worst word and its worst sentence; both together are
turned into a probability on documents that the machines were not fitted on.

Defined results: null and empty texts get the probability of the lowest margin; without both classes to learn from, every
score is the share of toxic rows (0 without rows); a null id is never held out; repeated rows score alike.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, DECAY, LANDMARKS, THRESHOLD = 3, 0.7, 240, 0.3
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 100_000
#: Distinct words that the machine is fitted on, and characters that are scored at once.
FIT_WORDS, BLOCK_CHARS = 24_000, 1_000_000
FLOOR = -4.0
#: Words whose margin would exceed this without adding up repeated subsequences get their exact norm.
REFINE = -0.6
#: Fits of words and of sentences, each with the witnesses and the hard negatives of the one before.
ROUNDS, SENTENCE_ROUNDS = 4, 2
#: Symbols of a sentence, beyond which it is cut; clean sentences that the machine is fitted on, and its landmarks.
SENTENCE, FIT_SENTENCES, SENTENCE_LANDMARKS = 240, 2000, 120

#: Symbols: 0 a break, 1-26 letters, 27-30 other letters and digits by code, 31 anything that is passed over.
NONE, FILL, WIDTH = 0, 31, 32
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _symbol(code: int) -> int:
    c = chr(code)
    if c.isspace():
        return NONE
    c = LOOKALIKE.get(c, c)
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + code % 4 if c.isalnum() else FILL


TABLE = np.array([_symbol(i) for i in range(0x2100)], dtype=np.int32)
STEPS = [(a, b, DECAY ** (a + b)) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]


def distinct_norm(n: np.ndarray) -> np.ndarray:
    """Length of the feature vector of a word of n symbols whose subsequences all differ."""
    return np.sqrt(np.maximum(1e-18, sum(w * w * np.maximum(0, n - a - b) for a, b, w in STEPS)))


ENDS = np.array([ord(c) for c in ".!?。！？…"], dtype=np.uint32)


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text with one break before, between and after its words, and which breaks end a sentence.

    Filling, and breaks between single characters, are left out.
    """
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.zeros(len(code) + 4, dtype=np.int32)
    s[2:-2] = np.where(code < len(TABLE), TABLE[np.minimum(code, len(TABLE) - 1)], 27 + code % 4)
    gap = s == NONE
    stop = np.ones(len(s), dtype=bool)
    stop[2:-2] = code == 10
    stop[3:-2] |= np.isin(code[:-1], ENDS)
    single = gap[2:-2] & gap[:-4] & gap[4:] & ~gap[1:-3] & ~gap[3:-1]
    s[2:-2][single] = FILL
    s, stop = s[s != FILL], stop[s != FILL]
    gap = s == NONE
    at = np.flatnonzero(gap)
    run = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    first = at[run]
    keep = ~gap
    keep[first] = True
    ends = np.zeros(len(s), dtype=bool)
    ends[first] = np.logical_or.reduceat(stop[at], run)
    return s[keep], ends[keep]


def words_in(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the word at each symbol, starts and lengths of the words.

    The break before a word is its first symbol, so that beginnings of words are told from their other parts.
    """
    inside = np.diff(np.concatenate(([0], (s != NONE).astype(np.int8), [0])))
    start, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    word = np.full(len(s), -1, dtype=np.int32)
    word[s != NONE] = np.repeat(np.arange(len(start), dtype=np.int32), end - start)
    word[start - 1] = np.arange(len(start))
    return word, start, end - start + 1


def sentences_in(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the sentence at each symbol, starts and lengths; the break that ends a sentence is the first symbol of the next."""
    at = np.arange(len(ends))
    first = np.maximum.accumulate(np.where(ends, at, 0))
    start = np.flatnonzero((at - first) % SENTENCE == 0)
    length = np.diff(np.append(start, len(ends)))
    return np.repeat(np.arange(len(start), dtype=np.int32), length), start, length


def subsequences(s: np.ndarray):
    """For each gap pattern: how far it reaches, the subsequence at each place, weight."""
    for a, b, w in STEPS:
        n = len(s) - a - b
        if n > 0:
            yield a + b, (s[:n] * WIDTH + s[a : a + n]) * WIDTH + s[a + b :], w


def features(s: np.ndarray, word: np.ndarray):
    """For each gap pattern: word, subsequence and weight of every place that it fits into."""
    for a, b, w in STEPS:
        n = len(s) - a - b
        if n <= 0:
            continue
        at = np.flatnonzero((word[:n] >= 0) & (word[:n] == word[a + b :]))
        yield word[at], (s[at] * WIDTH + s[at + a]) * WIDTH + s[at + a + b], w


def dense(words: list[str]) -> np.ndarray:
    """Normalised feature vectors of single words."""
    out = np.zeros((len(words), WIDTH**3), dtype=np.float32)
    for i, w in enumerate(words):
        s, _ = symbols(w)
        word, _, _ = words_in(s)
        for _, f, weight in features(s, word):
            np.add.at(out[i], f, weight)
        out[i] /= max(1e-9, np.sqrt(out[i] @ out[i]))
    return out


def norms(of: np.ndarray, f: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """Length of each word's feature vector, repeated subsequences added up first."""
    key = of.astype(np.int64) * WIDTH**3 + f
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    if not len(key):
        return np.full(count, 1e-9)
    total = np.add.reduceat(weight, first)
    return np.sqrt(np.maximum(1e-18, np.bincount(key[first] // WIDTH**3, weights=total * total, minlength=count)))


def packed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many words, breaks between them, and the number of the word that each symbol is of."""
    code = np.frombuffer(" ".join(["", *words]).encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.where(code < len(TABLE), TABLE[np.minimum(code, len(TABLE) - 1)], 27 + code % 4).astype(np.int32)
    owner = np.cumsum(code == 32) - 1
    return s[s != FILL], owner[s != FILL]


def kernel_rows(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark (feature vectors as rows)."""
    s, owner = packed(words)
    word, start, _ = words_in(s)
    owner = owner[start]
    of, f, weight = (np.concatenate(x) for x in zip(*((owner[o], f, np.full(len(f), w)) for o, f, w in features(s, word)), strict=True))
    out = np.stack([np.bincount(of, weights=m[f] * weight, minlength=len(words)) for m in landmarks], axis=1)
    return out / norms(of, f, weight, len(words))[:, None]


def unlike(words: list[str], count: int, most: float = 0.6, pool: int = 400) -> list[str]:
    """Up to count words in the order given, none with a kernel above `most` with one before it."""
    x = dense(words[:pool])
    like, out = x @ x.T, []
    for i in range(len(x)):
        if len(out) < count and (not out or like[i, out].max() <= most):
            out.append(i)
    return [words[i] for i in out]


def sentence_rows(parts: list[np.ndarray]) -> np.ndarray:
    """Feature vectors of sentences, given as symbols, over the length that they have if no subsequence repeats."""
    s = np.concatenate(parts)
    size = np.array([len(p) for p in parts])
    unit = np.repeat(np.arange(len(parts)), size)
    places = [(of.astype(np.int64) * WIDTH**3 + f, np.full(len(f), w)) for of, f, w in features(s, unit)]
    at, weight = (np.concatenate(x) for x in zip(*places, strict=True)) if places else (np.zeros(0, dtype=np.int64), np.zeros(0))
    out = np.bincount(at, weights=weight, minlength=len(parts) * WIDTH**3).astype(np.float32)
    return out.reshape(len(parts), -1) / distinct_norm(size)[:, None].astype(np.float32)


class Model:
    """Weights of subsequences in words and in sentences, biases, and the calibration of both margins to probabilities."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, slope: float = 0.0, offset: float = -50.0, wide: np.ndarray | None = None, wide_bias: float = 0.0, wide_slope: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset
        self.wide, self.wide_bias, self.wide_slope = wide, wide_bias, wide_slope

    def _word_margins(self, s: np.ndarray, word: np.ndarray, start: np.ndarray, length: np.ndarray, held: list | None = None) -> np.ndarray:
        total = np.zeros(len(start))
        for span, f, weight in held or subsequences(s):
            own = word[: len(f)]
            at = np.flatnonzero((own >= 0) & (own == word[span:]))
            total += weight * np.bincount(own[at], weights=self.weights[f[at]], minlength=len(start))
        margin = total / distinct_norm(length) + self.bias
        near = np.flatnonzero(margin > REFINE)
        if len(near):  # adding up repeats can only lower a margin above the bias, so only these matter
            number = np.full(len(start) + 1, -1)
            number[near] = np.arange(len(near))
            some = np.where(number[word] >= 0, word, -1)
            of, f, weight = (np.concatenate(x) for x in zip(*((number[o], f, np.full(len(f), w)) for o, f, w in features(s, some)), strict=True))
            margin[near] = total[near] / norms(of, f, weight, len(near)) + self.bias
        return np.maximum(margin, FLOOR)

    def _sentence_margins(self, s: np.ndarray, unit: np.ndarray, length: np.ndarray, held: list | None = None) -> np.ndarray:
        total = np.zeros(len(length))
        for span, f, weight in held or subsequences(s):
            own = unit[: len(f)]
            total += weight * np.bincount(own, weights=self.wide[f] * (own == unit[span:]), minlength=len(length))
        return np.where(length > 2, np.maximum(total / distinct_norm(length) + self.wide_bias, FLOOR), FLOOR)  # two symbols have no subsequence

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The largest margins of a word and of a sentence in each text."""
        word_out, wide_out = np.full(len(texts), FLOOR), np.full(len(texts), FLOOR)
        parts = [symbols(t) for t in texts]
        if not parts or self.weights is None:
            return word_out, wide_out
        s, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
        last = np.cumsum([len(p) for p, _ in parts])
        held = list(subsequences(s))
        word, start, length = words_in(s)
        if len(start):
            np.maximum.at(word_out, np.searchsorted(last, start, side="right"), self._word_margins(s, word, start, length, held))
        if self.wide is not None:
            unit, start, length = sentences_in(stop)
            np.maximum.at(wide_out, np.searchsorted(last, start, side="right"), self._sentence_margins(s, unit, length, held))
        return word_out, wide_out

    def of_words(self, words: list[str], block: int = 50_000) -> np.ndarray:
        out = []
        for k in range(0, len(words), block):
            s, owner = packed(words[k : k + block])
            word, start, length = words_in(s)
            worst = np.full(len(words[k : k + block]), FLOOR)
            if len(start):
                np.maximum.at(worst, owner[start], self._word_margins(s, word, start, length))
            out.append(worst)
        return np.concatenate(out) if out else np.zeros(0)

    def of_sentences(self, parts: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(p) for p in parts])
        return self._sentence_margins(np.concatenate(parts), np.repeat(np.arange(len(parts)), size), size)

    def plain(self) -> tuple:
        """What a broadcast carries: nothing that a worker would have to import."""
        return self.weights, self.bias, self.slope, self.offset, self.wide, self.wide_bias, self.wide_slope

    def probabilities(self, texts: list[str]) -> np.ndarray:
        word, wide = self.margins(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * word + self.wide_slope * wide + self.offset, -50, 50)))


def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear support vector machine by damped Newton steps; the bias is the last coordinate."""
    x = np.hstack((z, np.ones((len(z), 1))))
    w = np.zeros(x.shape[1])

    def loss(w):
        return ridge / 2 * w @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() / 2

    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w))
        active = slack > 0
        a = x[active] * weight[active, None]
        step = np.linalg.solve(a.T @ x[active] + ridge * np.eye(len(w)), a.T @ (y * slack)[active] - ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Platt's scaling of several margins (columns) with smoothed targets: a slope for each, none negative, and the offset.

    Slopes are held back a little, so that margins which say the same share what they say.
    """
    pos, neg = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    k = margins.shape[1]
    free = np.ones(k, dtype=bool)
    while True:
        x = np.hstack((margins[:, free], np.ones((len(y), 1))))
        p, hold = np.append(np.ones(free.sum()), 0.0), np.append(np.full(free.sum(), 1e-2), 1e-3)
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
            g = x.T @ (weight * (q - t)) + hold * p
            h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.diag(hold)
            step = np.linalg.solve(h, g)
            p = p - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-8:
                break
        if free.sum() <= 1 or (p[:-1] >= 0).all():
            out = np.zeros(k + 1)
            out[:-1][free] = np.maximum(p[:-1], 1e-3)
            out[-1] = p[-1]
            return out
        free[np.flatnonzero(free)[np.argmin(p[:-1])]] = False


def _bag(text: str) -> set[str]:
    return {w for w in text.lower().split() if len(w) >= 3}


def train(texts: list[str], toxic: list[int], totals: tuple[int, int]) -> Model:
    """Fit on documents; totals are the numbers of clean and toxic rows that they stand for."""
    y = np.array(toxic, dtype=int)
    if not len(y) or y.min() == y.max():
        share = totals[1] / max(1, sum(totals))
        return Model(None, 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        mine = order[y[order] == c]
        held[mine[: len(mine) // 4 if len(mine) > 3 else 0]] = True
    vocabulary: dict[str, int] = {}
    bags = [np.array(sorted(vocabulary.setdefault(w, len(vocabulary)) for w in sorted(_bag(texts[i]))), dtype=np.int32) for i in np.flatnonzero(~held)]
    words, of = list(vocabulary), y[~held]
    del vocabulary
    count = np.stack([np.bincount(np.concatenate([b for b, c in zip(bags, of, strict=True) if c == k]), minlength=len(words)) for k in (0, 1)])
    n0, n1 = int((of == 0).sum()), int((of == 1).sum())
    strength = np.where(count[1] > 0, np.log((count[1] + 0.5) / (n1 + 1)) - np.log((count[0] + 0.5) / (n0 + 1)), -np.inf)
    # a word that only toxic documents hold tells by itself once chance would hardly have it among so many words
    rarity = np.log(len(of) / max(1, n1))
    telling = (count[1] > 0) & (count[0] <= 0.03 * count[1]) & (count[1] * rarity > np.log(max(2, len(words))) + 2)
    clean_at = np.flatnonzero(count[0])
    clean_at = clean_at[np.argsort(np.array([words[i] for i in clean_at], dtype=object), kind="stable")]
    usual = [words[i] for i in clean_at[np.argsort(-count[0][clean_at], kind="stable")[: FIT_WORDS // 4]]]
    negative = sorted({*usual, *(words[i] for i in rng.permutation(clean_at)[: FIT_WORDS // 2])})
    clean = [words[i] for i in clean_at]
    evident = np.flatnonzero(count[1])
    model, hard = None, []
    toxic_bags = [b for b, c in zip(bags, of, strict=True) if c]
    del bags
    for _ in range(ROUNDS):
        witness: dict[str, int] = {}
        score = strength.copy()
        if model is not None:
            score[evident] += 2 * model.of_words([words[i] for i in evident])
        for b in toxic_bags:
            if len(b):
                for i in {int(b[np.argmax(score[b])]), *b[telling[b]].tolist()}:
                    witness[words[i]] = witness.get(words[i], 0) + 1
        positive = sorted(witness, key=lambda w: (-witness[w], w))[: FIT_WORDS // 4]
        marks = unlike(positive, LANDMARKS // 3)
        marks += unlike([w for w in [*hard, *(negative[i] for i in rng.permutation(len(negative))[:LANDMARKS])] if w not in marks], LANDMARKS // 2)
        marks += [w for w in usual if w not in marks][: LANDMARKS - len(marks)]
        basis = dense(marks)
        values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        to_space = vectors[:, keep] / np.sqrt(values[keep])
        fit = positive + negative + hard
        labels = np.array([1.0] * len(positive) + [-1.0] * (len(fit) - len(positive)))
        weight = np.array([float(witness[w]) ** 0.5 for w in positive] + [1.0] * (len(fit) - len(positive)))
        weight[: len(positive)] *= len(fit) / 4 / max(1.0, weight[: len(positive)].sum())
        w, bias = squared_hinge(kernel_rows(fit, basis) @ to_space, labels, weight)
        model = Model(basis.T @ (to_space @ w), bias)
        margin = model.of_words(clean)
        hard = list(dict.fromkeys([*hard, *(clean[i] for i in np.argsort(-margin)[: FIT_WORDS // 12] if margin[i] > -1)]))
    learn_sentences(model, [texts[i] for i in np.flatnonzero(~held)], of, rng)
    at = held if held.any() and 0 < y[held].sum() < held.sum() else np.ones(len(y), dtype=bool)
    margin = np.concatenate([np.stack(model.margins([texts[i]]), axis=1) for i in np.flatnonzero(at)])
    stands = np.where(y[at] > 0, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    model.slope, model.wide_slope, model.offset = map(float, calibrate(margin, y[at], stands / stands.mean()))
    model.weights, model.wide = model.weights.astype(np.float32), model.wide.astype(np.float32)
    return model


def learn_sentences(model: Model, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> None:
    """Fit the sentence machine of a model whose word machine is fitted."""
    bags: list[list[np.ndarray]] = []
    clean: list[np.ndarray] = []
    worst: list[int] = []
    for text, c in zip(texts, y, strict=True):
        s, stop = symbols(text)
        unit, start, length = sentences_in(stop)
        parts = [s[a : a + n].astype(np.int32) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
        if c:
            word, first, size = words_in(s)
            told = np.full(len(parts), FLOOR)
            if len(first):
                np.maximum.at(told, unit[first], model._word_margins(s, word, first, size))
            bags.append(parts)
            worst.append(int(np.argmax(told)))
        else:
            parts = [p for p in parts if len(p) > 2]
            clean += [parts[k] for k in rng.permutation(len(parts))[: max(4, 4 * FIT_SENTENCES // max(1, len(texts)))]]
    pool = [clean[k] for k in rng.permutation(len(clean))[: 4 * FIT_SENTENCES]] or [np.zeros(1, dtype=np.int32)]
    negative, hard = pool[:FIT_SENTENCES], []
    flat = [p for b in bags for p in b]
    ends = np.cumsum([len(b) for b in bags])
    for _ in range(SENTENCE_ROUNDS):
        positive = list({bags[k][w].tobytes(): bags[k][w] for k, w in enumerate(worst)}.values())[:FIT_SENTENCES]
        marks = positive[: SENTENCE_LANDMARKS // 2] + (hard + negative)[: SENTENCE_LANDMARKS // 2]
        basis = sentence_rows(marks)
        values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        to_space = vectors[:, keep] / np.sqrt(values[keep])
        fit = positive + negative + hard
        z = np.concatenate([sentence_rows(fit[k : k + 256]) @ basis.T for k in range(0, len(fit), 256)]) @ to_space
        labels = np.array([1.0] * len(positive) + [-1.0] * (len(fit) - len(positive)))
        weight = np.ones(len(fit))
        weight[: len(positive)] *= len(fit) / 4 / max(1, len(positive))
        w, model.wide_bias = squared_hinge(z, labels, weight)
        model.wide = basis.T @ (to_space @ w)
        margin = model.of_sentences(flat)
        worst = [int(np.argmax(margin[e - len(b) : e])) for b, e in zip(bags, ends.tolist(), strict=True)]
        margin = model.of_sentences(pool)
        hard = [pool[k] for k in np.argsort(-margin)[: FIT_SENTENCES // 4] if margin[k] > -1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most `rows` labelled rows of each class, those with the smallest hashes, outside the held-out part."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * rows ids at most
    texts = docs.where(F.length("text") <= chars).select("doc_id", "text").join(sample, "doc_id").orderBy("doc_id", "text").limit(2 * rows)
    totals = (counts.get(0, 0), counts.get(1, 0))

    def learn(batches):
        got = [(t, c) for batch in batches for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        m = train([t for t, _ in got], [c for _, c in got], totals)
        tables = [None if w is None else w.astype(np.float32).tobytes() for w in (m.weights, m.wide)]
        numbers = (m.bias, m.slope, m.offset, m.wide_bias, m.wide_slope)
        yield pa.RecordBatch.from_arrays([*(pa.array([t], pa.binary()) for t in tables), *(pa.array([float(x)]) for x in numbers)], names=["weights", "wide", "bias", "slope", "offset", "wide_bias", "wide_slope"])

    # one task learns from the bounded sample, so the driver only sees the weights
    r = texts.select("text", "toxic").repartition(1).mapInArrow(learn, "weights binary, wide binary, bias double, slope double, offset double, wide_bias double, wide_slope double").first()
    if r is None:
        return train([], [], totals)
    weights, wide = (None if w is None else np.frombuffer(bytes(w), dtype=np.float32) for w in (r.weights, r.wide))
    return Model(weights, r.bias, r.slope, r.offset, wide, r.wide_bias, r.wide_slope)


def score(docs: DataFrame, model: Model, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, score of every row, from its whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches):
        judge = Model(*held.value)
        for batch in batches:
            texts, out, part, size = batch.column(1), [], [], 0
            for t in texts:
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size >= BLOCK_CHARS:
                    out.append(judge.probabilities(part))
                    part, size = [], 0
            out.append(judge.probabilities(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).plain())
    names = docs.columns

    def run(batches):
        judge = Model(*held.value)
        for batch in batches:
            texts, keep, part, size = batch.column(names.index(text)), [], [], 0
            for t in texts:
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size >= BLOCK_CHARS:
                    keep.append(judge.probabilities(part) < THRESHOLD)
                    part, size = [], 0
            keep.append(judge.probabilities(part) < THRESHOLD)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
