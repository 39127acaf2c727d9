"""Secret scan in DataFrame functions: fixed forms, and a randomness test battery with false-discovery control.

Base kinds follow their patterns alone.  Beyond them every token of 16 or more characters is a candidate.  Its encoding is
inferred from its characters; over that alphabet three tests ask whether it looks random - chi-squared uniformity of the
symbols, runs above and below the middle of the alphabet, serial correlation of neighbours - and Fisher's method combines
their p-values into one of the battery.

A discovery is a token that ordinary text does not explain.  The likelihood ratio of a token under random symbols and under
letter frequencies has expectation 1 under ordinary text; weighted by twice the battery's p-value, whose expectation under
randomness is a half, it still has (change of measure), so its inverse is a valid p-value (Markov's inequality).  A token must
thus be unlike text and pass the battery, in one number that shrinks with length.  Benjamini-Hochberg at FDR, with weights in
proportion to length, keeps the share of false finds per document in check.  Patterns that are neither text nor random - the
battery's p-value is below RANDOM_LEVEL - are no discoveries, however unlike text they are.

Nulls and empty texts have no spans; every row, repeated or with a null id, returns a row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.spans import apart, listed, located, tagged

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+([A-Za-z0-9+/_.=-]++)"""
#: Base kinds in listing order; shorter runs than the least length could only be dropped, so they are not matched.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
RANDOM_LEVEL, FDR = 0.001, 0.01

#: Alphabets in the order in which they are tried.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Letter frequencies of ordinary text, per mille, a to z.
LETTERS = [80, 15, 30, 40, 120, 22, 20, 50, 70, 3, 8, 40, 25, 70, 75, 20, 3, 60, 63, 90, 28, 10, 20, 3, 20, 3]
UPPER_SHARE, DIGIT, OTHER = 0.05, 0.006, 0.004


def text_log_probability(code: int) -> float:
    c = chr(code)
    p = LETTERS[code - 97] / 1000 if "a" <= c <= "z" else LETTERS[code - 65] / 1000 * UPPER_SHARE if "A" <= c <= "Z" else DIGIT if "0" <= c <= "9" else OTHER
    return math.log(p)


def encoding(plain: Column) -> Column:
    """Name of the first alphabet that holds all characters; decimal numbers are no secrets."""
    out = F.when(F.translate(plain, ALPHABETS["decimal"], "") == "", "decimal")
    for k, a in list(ALPHABETS.items())[1:]:
        out = out.when(F.translate(plain, a, "") == "", k)
    return out.otherwise("mixed")


def alphabet(name: Column) -> Column:
    every = "".join(dict.fromkeys("".join(ALPHABETS.values())))
    return F.coalesce(*(F.when(name == k, a) for k, a in ALPHABETS.items()), F.lit(every))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail, by the logistic fit of the distribution function (error below 2e-4)."""
    a = F.abs(z)
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def upper_tail(z: Column) -> Column:
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def measure(s: Column) -> Column:
    """Start, end, length, encoding and symbol values of a candidate."""
    plain = F.rtrim(s.m, F.lit("="))
    name = encoding(plain)
    symbols = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.struct((F.position(c, alphabet(name)) - 1).cast("double").alias("v"), F.ascii(c).alias("code")))
    return F.struct(s.start.alias("start"), s.end.alias("end"), F.length(plain).cast("double").alias("n"), name.alias("encoding"), F.length(alphabet(name)).cast("double").alias("k"), symbols.alias("symbols"))


def moments(s: Column) -> Column:
    """Sums that the tests need: squared symbol counts, mean, runs, halves, lagged products, text log-likelihood."""
    v = F.transform(s.symbols, lambda x: x.v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / s.n
    table = F.array(*(F.lit(text_log_probability(c)) for c in range(128)))
    squares = F.aggregate(F.array_sort(v), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda a, x: F.struct(x.alias("last"), F.when(a.last == x, a.run + 1).otherwise(F.lit(1.0)).alias("run"), (a.sum + F.when(a.last == x, 2 * a.run + 1).otherwise(F.lit(1.0))).alias("sum")), lambda a: a.sum)
    high = lambda x, k: F.when(x * 2 > k - 1, 1.0).otherwise(0.0)
    pairs = F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.struct(
        s.start.alias("start"), s.end.alias("end"), s.n.alias("n"), s.encoding.alias("encoding"), s.k.alias("k"),
        squares.alias("squares"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + high(x, s.k)).alias("high"),
        F.aggregate(pairs, F.lit(1.0), lambda a, p: a + F.when(high(p.a, s.k) != high(p.b, s.k), 1.0).otherwise(0.0)).alias("runs"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("vv"),
        F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p.a * p.b).alias("lag"),
        F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p.a + p.b).alias("ends"),
        mean.alias("mean"),
        F.aggregate(s.symbols, F.lit(0.0), lambda a, x: a + F.get(table, x.code)).alias("text"),
    )


def judged(s: Column) -> Column:
    """The three p-values under randomness, Fisher's combination of them, and the p-value under ordinary text that it enters."""
    df = s.k - 1
    chi = s.k / s.n * s.squares - s.n
    p_chi = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    low, n = s.n - s.high, s.n
    expect = 1 + 2 * s.high * low / n
    var = (expect - 1) * (expect - 2) / (n - 1)
    p_runs = F.when(var > 0, two_sided((s.runs - expect) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
    spread = s.vv - n * s.mean * s.mean
    lag = s.lag - s.mean * s.ends + (n - 1) * s.mean * s.mean
    p_serial = F.when(spread > 0, two_sided((lag / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(0.0)
    ratio = s.text + n * F.log(s.k)  # minus the logarithm of the likelihood ratio
    return F.struct(s.start.alias("start"), s.end.alias("end"), n.alias("n"), s.encoding.alias("encoding"), p_chi.alias("p_chi"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), ratio.alias("ratio"))


def combined(s: Column) -> Column:
    half = -F.log(F.greatest(s.p_chi * s.p_runs * s.p_serial, F.lit(1e-300)))  # half of Fisher's statistic
    battery = F.least(F.lit(1.0), F.exp(-half) * (1 + half + half * half / 2))  # tail of chi-squared with six degrees
    p = F.least(F.lit(1.0), F.exp(F.least(s.ratio - F.log(2 * battery), F.lit(0.0))))
    return F.struct(*(s[c].alias(c) for c in ("start", "end", "n", "encoding", "p_chi", "p_runs", "p_serial")), battery.alias("p_battery"), p.alias("p"))


def discoveries(c: Column) -> Column:
    """Weighted Benjamini-Hochberg: p-values divided by relative length; the largest rank under its line decides."""
    m = F.size(c)
    mean = F.aggregate(c, F.lit(0.0), lambda a, s: a + s.n) / m
    q = F.array_sort(F.transform(c, lambda s: s.p * mean / s.n))
    cut = F.aggregate(F.transform(q, lambda p, i: F.when(p <= FDR * (i + 1) / m, p).otherwise(-1.0)), F.lit(-1.0), lambda a, p: F.greatest(a, p))
    return F.filter(c, lambda s: (s.p * mean / s.n <= cut) & (s.p_battery >= RANDOM_LEVEL) & ~s.encoding.isin("decimal", "mixed"))


def find(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, base (sorted spans: start, order, kind, end), extra (random tokens apart from them), n_<kind>, candidates (with p-values)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    gates = {"assign": t.rlike("[:=]"), "access": t.contains("AKIA"), "hex": t.rlike("[0-9a-f]{24}"), "token": t.rlike("[A-Za-z0-9+/_-]{16}")}
    found = located(rows, "t", {k: (p, gates[k]) for k, p in (BASE | {"token": TOKEN}).items()}).drop("t")
    found = found.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s.m, ASSIGN, 1)) >= 6))
    base = F.array_sort(F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(BASE))))
    found = found.select("doc_id", base.alias("base"), "token", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE))
    found = found.withColumn("token", apart(F.col("token"), F.col("base")))
    for step in (measure, moments, judged, combined):
        found = found.withColumn("token", F.transform("token", step))
    extra = tagged(discoveries(F.col("token")), lambda s: F.concat(F.lit("random_"), s.encoding), len(BASE))
    return found.select("doc_id", "base", F.array_sort(extra).alias("extra"), *(f"n_{k}" for k in BASE), F.col("token").alias("candidates"))
