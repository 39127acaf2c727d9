"""Greedy acyclic insertion: an edge is accepted unless its end already reaches its start through accepted edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy(pairs: list[tuple[str, str]]) -> list[bool]:
    """Which edges are accepted, one after another.

    A topological order of the accepted edges is kept: an edge that agrees with it is accepted at once; else only nodes placed
    between its ends are searched, and reordered if no path leads back.
    """
    place: dict[str, int] = {}
    after: dict[str, set[str]] = {}
    before: dict[str, set[str]] = {}

    def within(start: str, step: dict[str, set[str]], low: int, high: int, avoid: str | None) -> set[str] | None:
        """Nodes reached from start through places from low to high; None if `avoid` is among them."""
        seen, todo = {start}, [start]
        while todo:
            for w in step.get(todo.pop(), ()):
                if w == avoid:
                    return None
                if w not in seen and low <= place[w] <= high:
                    seen.add(w)
                    todo.append(w)
        return seen

    out = []
    for u, v in pairs:
        place.setdefault(u, len(place))
        place.setdefault(v, len(place))
        ok = u != v
        if ok and place[u] > place[v]:
            low, high = place[v], place[u]
            ahead = within(v, after, low, high, u)
            ok = ahead is not None
            if ok:
                moved = sorted(within(u, before, low, high, None), key=place.get) + sorted(ahead, key=place.get)
                for x, k in zip(moved, sorted(place[x] for x in moved), strict=True):
                    place[x] = k
        if ok:
            after.setdefault(u, set()).add(v)
            before.setdefault(v, set()).add(u)
        out.append(ok)
    return out


def accept_acyclic(candidates: DataFrame, book: str = "book_id") -> DataFrame:
    """candidates(book, source, target, seq ...) with accepted; order decides, so a book is one group - books, not corpora, bound its size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__order", kind="stable").drop(columns="__order")
        return pdf.assign(accepted=greedy(list(zip(pdf.source, pdf.target, strict=True))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    ordered = candidates.withColumn("__order", F.row_number().over(Window.partitionBy(book).orderBy("seq")))
    return ordered.groupBy(book).applyInPandas(run, schema + ", accepted boolean")
