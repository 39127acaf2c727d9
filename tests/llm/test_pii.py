import hashlib
import re

from graphloom.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow(text):
    out = []
    for order, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and max(map(int, m[0].split("."))) > 255 or k == "card" and not (14 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), order, k, m.end()))
    return sorted(out)


CASES = [
    "a@b.c@d.e x_y%z@q-r.s..t@u.v", "@x.y a@b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.00000255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
    "4111111111111111 22 33", "+1 (212) 555-0100 +49-30-1234 +1+2 3 4567890123", "é😀 mail é@x.y 漢 10.0.0.1😀+12 345 678 901", "1" * 3000, "1 " * 30, "a@b.c," * 700,
    "+" + "1.2.3.4 " * 50, "x" * 20000 + "@" + "y.z", "0000 0000 0000 00", None, "", "...@...a@-.-",
]


def test_base_spans(spark, odd):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(CASES)], "doc_id long, text string, n_email int")
    for r in P.find(docs).collect():
        want = slow(CASES[r.doc_id])
        assert [tuple(s) for s in r.base] == want, CASES[r.doc_id]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in want) for k in PATTERNS]
    for r in P.digest(P.find(docs)).collect():
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in slow(CASES[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert P.find(odd).count() == odd.count()
    assert P.find(docs.limit(0)).count() == 0


def test_scores_add_spans(spark):
    texts = ["account GB82 WEST 1234 5698 7654 32 is", "GB82 WEST 1234 5698 7654 33", "his social security number 078-05-1120", "part 078-05-1120", "call 212-555-0100 now", "invoice order 212-555-0100", "bob [at] example [dot] com", "card 4222222222222", "4111.1111.1111.1111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.extra] for r in P.find(docs).collect()}
    assert got == {
        0: [("iban", "GB82 WEST 1234 5698 7654 32")], 1: [], 2: [("ssn", "078-05-1120")], 3: [], 4: [("phone", "212-555-0100")], 5: [],
        6: [("email", "bob [at] example [dot] com")], 7: [("card", "4222222222222")], 8: [("card", "4111.1111.1111.1111")],
    }


def iban_ok(m):
    plain = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def slow_weak(text):
    """Spans that the scores add: proposals from left to right, each judged by its shape, checksum and the words around it."""
    found = list(re.finditer(P.WEAK, text))
    base = slow(text)
    out = []
    for k, m in enumerate(found):
        s = m[0]
        near = (text[found[k - 1].end() if k else 0 : m.start()][-48:] + " " + text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][:48]).lower()
        d = re.sub("[^0-9]", "", s)
        if "at" in s:
            kind, score = "email", 0.7
        elif s[0].isalpha():
            kind, score = "iban", 0.2 + 0.5 if iban_ok(s) else -9
        elif re.match("[0-9]{3}-[0-9]{2}-", s):
            kind, score = "ssn", -9 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 0.3
        elif len(d) == 13 or re.match(r"[0-9]{4}\.", s):
            kind, score = "card", 0.2 + 0.5 if luhn(d) else -9
        else:
            kind, score = "phone", 0.3
        score += 0.35 * any(w in near for w in P.FOR[kind].split("|"))
        score -= 0.4 * bool(re.search(r"\b(invoice|order|isbn|serial|version|part|ticket|page)\b", near))
        if score >= 0.6 - 1e-12 and not any(a < m.end() and m.start() < b for a, _, _, b in base):
            out.append((m.start(), len(PATTERNS), kind, m.end()))
    return out


def test_scores_by_brute_force(spark):
    import random

    rng = random.Random(12)

    def iban():
        body = "WEST" + "".join(rng.choice("0123456789") for _ in range(14))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        s = f"GB{check if rng.random() < 0.7 else (check + 1) % 97:02d}{body}"
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        n = number(15 if rng.random() < 0.5 else 12)
        n = next(n + c for c in "0123456789" if luhn(n + c) or rng.random() < 0.05)
        return n if len(n) == 13 else ".".join(n[k : k + 4] for k in range(0, 16, 4))

    forms = [iban, card, lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)} {number(3)} {number(4)}", lambda: "bob.s [at] mail (dot) example [dot] com"]
    words = "account bank ssn taxpayer visa karte phone tel call contact write invoice order part page pages the of and été 😀".split()
    texts = [" ".join(rng.choice(forms)() if rng.random() < 0.25 else rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    got = {r.doc_id: [tuple(s) for s in r.extra] for r in P.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: slow_weak(t) for i, t in enumerate(texts)}
    assert got == want and {k for x in want.values() for _, _, k, _ in x} == set(P.PRIOR)
