"""Regex matches with positions, in DataFrame functions only.

Spark returns the matches of a pattern and the pieces between them, but no positions; start and end in code points are the
running sums of both lengths.  Patterns must be possessive or linear and never match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose positions are summed one by one; longer lists are summed in chunks, so that cost stays near linear.
CHUNK = 128
#: Code points of text kept on either side of a match.
AROUND = 48


def located(df: DataFrame, text: str, kinds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add for each kind an array of (start, end, m, before, after), the leftmost non-overlapping matches of its pattern.

    kinds: name -> (pattern, cheap condition that any text with a match meets).  Each layer is a projection of its own, so
    that no regex runs twice.
    """
    empty = F.array().cast("array<string>")
    df = df.withColumns({f"__m_{k}": F.when(gate, F.regexp_extract_all(text, F.lit(p), 0)).otherwise(empty) for k, (p, gate) in kinds.items()})
    df = df.withColumns({f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(text, p, -1)).otherwise(empty) for k, (p, _) in kinds.items()})

    def steps(k: str) -> Column:
        m, p = F.col(f"__m_{k}"), F.col(f"__p_{k}")
        after = F.slice(p, 2, F.size(m))
        return F.zip_with(F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len"), b.alias("m"), F.substring(a, -AROUND, AROUND).alias("before"))), after, lambda s, a: F.struct(s.gap.alias("gap"), s.len.alias("len"), s.m.alias("m"), s.before.alias("before"), F.substring(a, 1, AROUND).alias("after")))

    df = df.withColumns({f"__s_{k}": F.when(F.size(f"__m_{k}") > 0, steps(k)) for k in kinds})

    def chunks(k: str) -> Column:
        s = F.col(f"__s_{k}")
        return F.transform(F.sequence(F.lit(0), ((F.size(s) - 1) / CHUNK).cast("int")), lambda c: F.slice(s, c * CHUNK + 1, CHUNK))

    df = df.withColumns({f"__c_{k}": F.when(F.size(f"__m_{k}") > 0, chunks(k)) for k in kinds})
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x.gap + x.len)
    df = df.withColumns({f"__t_{k}": F.transform(f"__c_{k}", total) for k in kinds})

    def spans(k: str) -> Column:
        c, t = F.col(f"__c_{k}"), F.col(f"__t_{k}")
        base = F.transform(t, lambda _, i: F.aggregate(F.slice(t, F.lit(1), i), F.lit(0), lambda a, x: a + x))
        none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

        def walk(chunk: Column, at: Column) -> Column:
            one = lambda acc, x: F.struct((acc.at + x.gap + x.len).alias("at"), F.concat(acc.out, F.array(F.struct((acc.at + x.gap).alias("start"), (acc.at + x.gap + x.len).alias("end"), x.m.alias("m"), x.before.alias("before"), x.after.alias("after")))).alias("out"))
            return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), one, lambda acc: acc.out)

        return F.when(F.size(f"__m_{k}") > 0, F.flatten(F.zip_with(c, base, walk))).otherwise(none)

    df = df.withColumns({k: spans(k) for k in kinds})
    return df.drop(*(f"__{x}_{k}" for x in "mpsct" for k in kinds))


def tagged(spans: Column, kind: str | Callable[[Column], Column], order: int) -> Column:
    """Spans as (start, order, kind, end), which sort as they are to be listed."""
    name = kind if callable(kind) else lambda _: F.lit(kind)
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("order"), name(s).alias("kind"), s.end.alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted tagged spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def apart(spans: Column, from_: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(from_, lambda o: (o.start < s.end) & (s.start < o.end)))
