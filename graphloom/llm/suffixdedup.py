"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of WINDOW bytes that starts in two places must be found wherever it is, so candidates come from anchors: of the
grams in a window the one with the least hash is its anchor, the same in every copy of the window.  An anchor occurrence
stands for a stretch of starts and the text around it (its context).  Anchors that occur once cannot repeat.  A context is
named by a keyed BLAKE2b digest of its bytes, whose key is drawn anew for each run, so that polynomial hashes decide nothing
there; contexts of one name under one anchor settle all their starts at once.  What is left - the rims of repeated passages -
goes to the suffix sort: contexts of one anchor meet in a task, and the suffixes at their starts are merge-sorted.  Two
suffixes are compared by the length of their common extension, found by binary search over prefix polynomial hashes;
neighbours that agree over WINDOW bytes are repeats, after their bytes have been compared.  So a collision of polynomial
hashes cannot remove anything.

Contexts of anchors with more than HOT distinct ones are cut down to single windows, named by 128-bit digests: windows of one
name settle each other as contexts do, counted in each task before anything is shuffled.  So a group of the sort has at most HOT
contexts, and a passage with any number of copies burdens no task.  Documents cross the network packed, joined once for contexts and once for
the result.

Defined results: a null text is empty; texts under WINDOW bytes keep all; equal rows are copies of each other; rows of one id
with other texts are told apart; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, join_counted, written

WINDOW, GRAM = 200, 32
#: Distinct contexts of an anchor that are sorted together.
HOT = 4096
#: Bytes of text that are hashed at once, and bytes of contexts that are sorted at once.
BLOCK, SORT_BLOCK = 500_000, 300_000
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


#: What each byte counts for.
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    """0th to n-th powers modulo 2**64."""
    if of not in _powers or len(_powers[of]) <= n:
        out = np.full(max(n + 1, 1 << 16), of, dtype=np.uint64)
        out[0] = 1
        _powers[of] = np.multiply.accumulate(out)
    return _powers[of]


class Hashes:
    """Prefix polynomial hashes of a buffer; the hash of a substring does not depend on where it starts."""

    def __init__(self, buf: np.ndarray):
        self.n = len(buf)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(VALUES[buf] * powers(BASE, len(buf))[: len(buf)], out=self.sums[1:])
        self.inverse = powers(INVERSE, len(buf))

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def names(buf: bytes, first: np.ndarray, length: np.ndarray, place: np.ndarray, salt: bytes) -> np.ndarray:
    """Digest of each context and of its anchor's place in it."""
    digest, ends = hashlib.blake2b, [bytes([k]) for k in range(WINDOW)]
    rows = zip(first.tolist(), (first + length).tolist(), place.tolist(), strict=True)
    return np.frombuffer(b"".join([digest(buf[a:b] + ends[k], digest_size=8, salt=salt).digest() for a, b, k in rows]), dtype=np.uint64)


def anchors(texts: list[bytes], salt: bytes = b"") -> dict[str, np.ndarray]:
    """Anchor occurrences: doc (number in the list), key, context, first and last start, last start of the context, place of the anchor in it.

    Neighbouring occurrences of one anchor with equal contexts, as in runs of one byte, are one row with a count.
    """
    long = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    none = {k: np.empty(0, dtype=np.int64) for k in ("doc", "key", "context", "first", "last", "until", "place", "n")}
    if not long:
        return none
    size = np.array([len(texts[i]) for i in long])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    whole = b"".join(texts[i] for i in long)
    buf = np.frombuffer(whole, dtype=np.uint8)
    h = Hashes(buf)
    n = len(buf) - GRAM + 1
    gram = mix((h.sums[GRAM:] - h.sums[:-GRAM]) * h.inverse[:n])
    width = WINDOW - GRAM + 1
    # the least of each window by 38 hash bits, then the leftmost: block-wise prefix and suffix minima
    bits = np.uint64(int(n).bit_length())
    packed = ((gram >> bits) << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = packed
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    at = (np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts]) & ((ONE << bits) - ONE)).astype(np.int64)
    valid = np.zeros(starts, dtype=bool)
    for b, s in zip(begin.tolist(), size.tolist(), strict=True):
        valid[b : b + s - WINDOW + 1] = True
    new = np.empty(starts, dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    close = np.append(new[1:] | ~valid[1:], True)
    last = np.flatnonzero(close & valid)
    at = at[first]
    length = last - first + WINDOW
    key, place = gram[at], at - first
    context = names(whole, first, length, place, salt)
    run = np.ones(len(first), dtype=bool)
    run[1:] = (context[1:] != context[:-1]) | (key[1:] != key[:-1]) | (first[1:] != last[:-1] + 1) | (first[1:] != last[1:])
    head = np.flatnonzero(run)
    tail = np.append(head[1:], len(first)) - 1
    doc = np.searchsorted(begin, first[head], side="right") - 1
    return {
        "doc": np.array(long)[doc], "key": key[head].view(np.int64), "context": context[head].view(np.int64),
        "first": first[head] - begin[doc], "last": last[tail] - begin[doc], "until": last[head] - begin[doc], "place": place[head], "n": tail - head + 1,
    }


def common(h: Hashes, a: np.ndarray, b: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, up to `most`: binary search over hashes of prefixes."""
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), most, dtype=np.int64)
    sa, sb, ia, ib = h.sums[a], h.sums[b], h.inverse[a], h.inverse[b]
    mid = high.copy()  # whole windows first: most comparisons are within repeats
    for _ in range(most.bit_length() + 1):
        same = (h.sums[a + mid] - sa) * ia == (h.sums[b + mid] - sb) * ib
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
        if (low >= high).all():
            break
        mid = (low + high + 1) // 2
    return low


def compare(h: Hashes, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the first WINDOW bytes at a are less than, equal to or greater than those at b."""
    k = common(h, a, b)
    x, y = buf[np.minimum(a + k, len(buf) - 1)], buf[np.minimum(b + k, len(buf) - 1)]
    return np.where(k >= WINDOW, 0, np.where(x < y, -1, 1))


def merge_sort(h: Hashes, buf: np.ndarray, p: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Suffixes p, grouped by bucket, sorted within each bucket: all runs of a width are merged at once, each suffix finding its rank in the other run by binary search."""
    p = p.copy()
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(start, len(p)))
    base, many = np.repeat(start, size), np.repeat(size, size)
    rank = np.arange(len(p)) - base
    width = 1
    while width < size.max(initial=0):
        e = np.flatnonzero(many > width)
        r, b, m = rank[e], base[e], many[e]
        run = r // width
        right = run % 2 == 1
        other = (run ^ 1) * width
        low0 = np.minimum(other, m)
        low, high = low0.copy(), np.minimum(other + width, m)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) // 2
            c = compare(h, buf, p[b[live] + mid], p[e[live]])
            ahead = np.where(right[live], c <= 0, c < 0)  # equal suffixes of the left run stay before those of the right
            low[live] = np.where(ahead, mid + 1, low[live])
            high[live] = np.where(ahead, high[live], mid)
        to = b + (run // 2) * 2 * width + (r - run * width) + (low - low0)
        q = p.copy()
        q[to] = p[e]
        p = q
        width *= 2
    return p


def repeats(buf: np.ndarray, p: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether the window at p occurs at another p of its group."""
    out = np.zeros(len(p), dtype=bool)
    if len(p) < 2:
        return out
    words = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,))
    key = mix(group ^ mix(words[p]))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    some = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order, key = order[some], key[some]
    if not len(order):
        return out
    h = Hashes(buf)
    back = np.full(len(buf), -1, dtype=np.int64)
    back[p] = np.arange(len(p))
    q = merge_sort(h, buf, p[order], key)
    a, b = np.flatnonzero(key[1:] == key[:-1]), None
    a = a[common(h, q[a], q[a + 1]) >= WINDOW]
    b = a + 1
    equal = np.ones(len(a), dtype=bool)
    for j in [*range(0, WINDOW - 7, 8), WINDOW - 8]:  # collision verification: the bytes themselves
        equal &= words[q[a] + j] == words[q[b] + j]
    out[back[q[a[equal]]]] = True
    out[back[q[b[equal]]]] = True
    for bad in np.unique(key[a[~equal]]):  # hashes collided: this bucket is settled by its bytes
        seen: dict[bytes, list[int]] = {}
        for x in q[key == bad].tolist():
            seen.setdefault(buf[x : x + WINDOW].tobytes(), []).append(x)
        for x in q[key == bad].tolist():
            out[back[x]] = len(seen[buf[x : x + WINDOW].tobytes()]) > 1
    return out


ROW = {"id": pa.int64(), "body": pa.int64()}
FOUND = ROW | {"key": pa.int64(), "context": pa.int64(), "first": pa.int32(), "last": pa.int32(), "until": pa.int32(), "place": pa.int32(), "n": pa.int32()}


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) for k, kind in kinds.items()], names=list(kinds))


def _anchors(salt: bytes):
    def run(batches):
        for batch in batches:
            ids, bodies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part, size, at = [], 0, 0
            for i, t in enumerate(batch.column(2)):
                part.append(t.as_buffer().to_pybytes())
                size += len(part[-1])
                if size >= BLOCK or i + 1 == batch.num_rows:
                    found = anchors(part, salt)
                    doc = found.pop("doc") + at
                    yield _batch({"id": ids[doc], "body": bodies[doc], **found}, FOUND)
                    part, size, at = [], 0, i + 1

    return run


def _pack(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(t.as_buffer()) if len(t.as_buffer()) else b"" for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "body", "packed"])


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


CONTEXT = ROW | {"group": pa.int64(), "first": pa.int32(), "place": pa.int32(), "low": pa.int32(), "high": pa.int32(), "need": pa.bool_(), "text": pa.binary()}
PIECE = CONTEXT | {"name": pa.binary()}
PIECES = "id long, body long, `group` long, first int, place int, low int, high int, need boolean, text binary, name binary"


def _pieces(salt: bytes, hot: int):
    """Packed documents with their anchors -> contexts by anchor; of hot anchors single windows by name, without their bytes."""

    def run(batches):
        digest = hashlib.blake2b
        for batch in batches:
            rows: list[tuple] = []
            t = batch.to_pydict()
            for i, body, packed, places in zip(t["id"], t["body"], t["packed"], t["places"], strict=True):
                text = _unpack(packed)
                for a in places:
                    first, until, place, need = a["first"], a["until"], a["place"], a["need"]
                    if a["kinds"] <= hot:
                        least = place - (until - first)  # the anchor's distance from the last start
                        rows.append((i, body, a["key"], first, place, least, place, need, text[first : until + WINDOW], None))
                    else:
                        rows += [(i, body, None, k, None, None, None, need, None, digest(text[k : k + WINDOW], digest_size=16, salt=salt).digest()) for k in range(first, until + 1)]
            yield _batch({k: [r[c] for r in rows] for c, k in enumerate(PIECE)}, PIECE)

    return run


def _named_ranges(windows: DataFrame) -> DataFrame:
    """Starts of windows(id, body, first, need, name) whose name occurs again; a window of a context with copies counts twice, as it stands for all."""
    often = windows.groupBy("name").agg(F.sum(F.when(F.col("need"), 1).otherwise(2)).alias("n")).where("n > 1")
    hit = join_counted(windows.where("need"), often, ["name"], "n", windows.count())
    return hit.select("id", "body", "first", F.col("first").alias("last"))


RANGE = ROW | {"first": pa.int32(), "last": pa.int32()}


def _ranges(batches):
    """Contexts sorted by group -> ranges of repeated starts of those that need them."""

    def solve(rows: list[tuple]):
        buf = np.frombuffer(b"".join(r[-1] for r in rows) + bytes(8), dtype=np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(r[-1]) for r in rows])[:-1]))
        place, low, high = (np.array([r[k] for r in rows], dtype=np.int64) for k in (4, 5, 6))
        count = high - low + 1
        row = np.repeat(np.arange(len(rows)), count)
        p = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        distance = place[row] - (p - begin[row])
        group = np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64)
        hit = repeats(buf, p, mix(group[row] + distance.astype(np.uint64)))
        hit &= np.array([r[7] for r in rows])[row]
        edge = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & np.concatenate(([False], row[1:] == row[:-1]))))
        stop = np.flatnonzero(hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((row[1:] == row[:-1], [False]))))
        own, first = row[edge], np.array([r[3] for r in rows], dtype=np.int64)
        shift = first[own] - begin[own]
        return _batch({"id": [rows[i][0] for i in own], "body": [rows[i][1] for i in own], "first": p[edge] + shift, "last": p[stop] + shift}, RANGE)

    rows, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] != last and size >= SORT_BLOCK:
                yield solve(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[-1])
            last = row[2]
    if rows:
        yield solve(rows)


def removed_spans(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes in windows that start in the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["last"] + WINDOW) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept": pa.binary()}


def _cut(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in RESULT}
        t = batch.to_pydict()
        for i, packed, ranges in zip(t["doc_id"], t["packed"], t["ranges"], strict=True):
            text, spans, at, kept = _unpack(packed), removed_spans(ranges), 0, []
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            row = (i, len(text), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, text[at:]]))
            for k, v in zip(RESULT, row, strict=True):
                out[k].append(v)
        yield _batch(out, RESULT)


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte offsets of what goes), kept (the remaining bytes) of every row."""
    t = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(t).alias("body"), t.alias("t"))
    found = written(rows.mapInArrow(_anchors(secrets.token_bytes(16)), "id long, body long, key long, context long, first int, last int, until int, place int, n int"), "anchors")
    total = found.count()
    shared = written(found.groupBy("key").agg(F.sum("n").alias("seen"), F.count("*").alias("rows")).where("seen > 1"), "shared")
    every, found = found, written(join_counted(found, shared.select("key", "rows"), ["key"], "rows", total).drop("rows"), "candidates")
    dropped(every, shared)
    one = F.struct("id", "body", "first")
    kinds = found.groupBy("key", "context").agg(F.sum("n").alias("copies"), F.count("*").alias("rows"), F.min(one).alias("one"))
    spread = kinds.groupBy("key").agg(F.count("*").alias("kinds"))
    kinds = written(join_counted(kinds, spread, ["key"], "kinds", total), "contexts")
    joined = join_counted(found, kinds, ["key", "context"], "rows", total, deal=True)
    settled = joined.where("copies > 1").select("id", "body", "first", "last")
    open_ = joined.where((F.col("kinds") > 1) & ((F.col("copies") == 1) | (one == F.col("one"))))
    packed = rows.mapInArrow(_pack, "id long, body long, packed binary")

    places = open_.groupBy("id", "body").agg(F.collect_list(F.struct("key", "first", "until", "place", "kinds", (F.col("copies") == 1).alias("need"))).alias("places"))
    # equal rows settle each other, so one of them stands for all here
    sources = packed.join(places, ["id", "body"]).dropDuplicates(["id", "body"]).select("id", "body", "packed", "places")
    pieces = written(sources.mapInArrow(_pieces(secrets.token_bytes(16), hot), PIECES), "pieces")
    sorted_ = pieces.where("name is null").drop("name").repartition("group").sortWithinPartitions("group")
    rims = sorted_.mapInArrow(_ranges, "id long, body long, first int, last int")
    windows = _named_ranges(pieces.where("name is not null").select("id", "body", "first", "need", "name"))
    every = settled.unionByName(rims).unionByName(windows)
    ranges = written(every.groupBy("id", "body").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges")
    dropped(found, kinds, pieces)
    whole = packed.join(ranges, ["id", "body"], "left")
    result = whole.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "packed", "ranges")
    return result.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
