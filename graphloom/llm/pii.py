"""PII detection in DataFrame functions: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds follow their patterns and checks alone.  A second pattern proposes weaker forms - IBANs, social security
numbers, national phone numbers, cards with dots or 13 digits, spelled-out mail addresses - which start from a prior, gain
from a passed checksum (Luhn, mod 97) and from words such as "phone" nearby, lose from words such as "invoice", and count
from THRESHOLD upwards.  They never replace a base span and are left out where they overlap one.

Nulls and empty texts have no spans; every row, repeated or with a null id, returns a row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.spans import apart, listed, located, tagged

#: Base kinds in listing order.  A possessive form of the given patterns: a look-behind skips starts that cannot be leftmost.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Weaker forms, told apart by their shape: an IBAN, a social security number, a dotted or 13-digit card, a phone number, a spelled-out address.
WEAK = (
    r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])"
    r"|[0-9]{13}(?![0-9])"
    r"|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|[A-Za-z0-9._-]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(]dot[\])] ?[A-Za-z]{2,20})++)"
)
#: Prior of each weak kind, the gain of a passed checksum and of a context word, the loss of a contrary word.
PRIOR = {"iban": 0.2, "ssn": 0.3, "card": 0.2, "phone": 0.3, "email": 0.7}
CHECKSUM, CONTEXT, CONTRARY, THRESHOLD = 0.5, 0.35, 0.4, 0.6
FOR = {
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
    "card": "card|visa|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "email": "mail|contact|write",
}
AGAINST = r"\b(?:invoice|order|isbn|serial|version|part|ticket|page)\b"


def ip_parts(m: Column) -> Column:
    """Every part is at most 255, leading zeros aside."""
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(m: Column) -> Column:
    """An IBAN's check: country and check digits last, letters as 10 to 35, remainder 1."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def weak_kind(m: Column) -> Column:
    return (
        F.when(m.contains("at"), "email").when(m.rlike("^[A-Z]"), "iban").when(m.rlike(r"^[0-9]{3}-[0-9]{2}-"), "ssn")
        .when(m.rlike(r"^(?:[0-9]{13}$|[0-9]{4}\.)"), "card").otherwise("phone")
    )


def weak_score(s: Column) -> Column:
    kind, near = weak_kind(s.m), F.lower(F.concat(s.before, F.lit(" "), s.after))
    by = lambda values: F.coalesce(*(F.when(kind == k, v) for k, v in values.items()))
    passed = by({"iban": mod97(s.m), "card": F.call_function("luhn_check", digits(s.m)), "ssn": ~s.m.rlike(r"^(?:000|666|9)|-00-|-0000$"), "phone": F.lit(True), "email": F.lit(True)})
    gain = by({"iban": F.lit(CHECKSUM), "card": F.lit(CHECKSUM)} | {k: F.lit(0.0) for k in ("ssn", "phone", "email")})
    context = by({k: near.rlike(w) for k, w in FOR.items()})
    return F.when(passed, by({k: F.lit(v) for k, v in PRIOR.items()}) + gain + F.when(context, CONTEXT).otherwise(0.0) - F.when(near.rlike(AGAINST), CONTRARY).otherwise(0.0)).otherwise(0.0)


def find(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, base (sorted spans: start, order, kind, end), extra (likewise, what the scores add), n_<kind> of the base kinds."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    digit = t.rlike("[0-9]")
    gates = {"email": t.contains("@"), "ip": digit, "card": digit, "phone": t.contains("+"), "weak": digit | F.lower(t).contains("dot")}
    found = located(rows, "t", {k: (p, gates[k]) for k, p in (BASE | {"weak": WEAK}).items()}).drop("t")
    found = found.withColumns({
        "ip": F.filter("ip", lambda s: ip_parts(s.m)),
        "card": F.filter("card", lambda s: F.length(digits(s.m)).between(14, 19) & F.call_function("luhn_check", digits(s.m))),
        "phone": F.filter("phone", lambda s: F.length(digits(s.m)).between(10, 15)),
        "weak": F.filter("weak", lambda s: weak_score(s) >= THRESHOLD),
    })
    base = F.array_sort(F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(BASE))))
    counts = {f"n_{k}": F.size(k).cast("long") for k in BASE}
    found = found.select("doc_id", base.alias("base"), "weak", *(c.alias(n) for n, c in counts.items()))
    extra = tagged(apart(F.col("weak"), F.col("base")), lambda s: weak_kind(s.m), len(BASE))
    return found.select("doc_id", "base", F.array_sort(extra).alias("extra"), *counts)


def digest(found: DataFrame, *counts: str) -> DataFrame:
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "extra"))).alias("spans"))
