"""Document fingerprints by locally consistent parsing.

Every level is a sequence of names, at first of code points.  Runs of one name become one name; deterministic coin tossing
then shrinks names to labels under 6 that differ from their neighbours - each round looks at the lowest bit in which a label
differs from its left neighbour - and local maxima of the labels start phrases, which are named by a hash of what they hold.
A phrase boundary depends on a handful of names around it only, so equal substrings are parsed alike away from their ends,
whatever their offset.  The names of levels FEATURES are sampled into SLOTS minima, of which a fingerprint keeps a byte each;
the likeness of two fingerprints estimates the share of phrases that their texts have in common.

Defined results: a null or empty text has the fingerprint of zeros, alike to itself only; the next document goes by descending
id, nulls last, rows of one id by their text's hash; a sole row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import shuffle_partitions

FEATURES, SLOTS = (2, 3), 128
#: Code points that are parsed at once.
BLOCK_CHARS = 500_000
#: Bytes of text in a partition, where that makes more of them than the session's shuffle partitions.
PART_BYTES = 128_000_000
NO_ID = -(2**63)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _toss(label: int, left: int) -> int:
    low = (label ^ left) & -(label ^ left)
    bit = low.bit_length() - 1 if low else 0
    return 2 * bit + (label >> bit & 1)


#: Coin tossing between labels under 128, by label and left neighbour.
TOSS = np.array([[_toss(a, b) for b in range(128)] for a in range(128)], dtype=np.uint8).ravel()
POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def squeeze(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name within a document as one name."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    if new.all():
        return x, doc
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(x)))
    x, doc = x[start], doc[start]
    run = length > 1
    x[run] = mix(x[run] + length[run].astype(np.uint64) * ODD)
    return x, doc


def labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 6, unlike their left neighbours; a document's first symbol compares with 0."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = 0
    differ = x ^ left
    low = differ & (~differ + np.uint64(1))
    bit = np.bitwise_count(low - np.uint64(1)).astype(np.uint64) & np.uint64(63)
    out = (np.uint64(2) * bit + ((x >> bit) & np.uint64(1))).astype(np.uint8)
    for _ in range(3):
        left = np.empty(len(out), dtype=np.uint8)
        left[1:] = out[:-1]
        left[first] = 0
        out = TOSS[out.astype(np.int16) * 128 + left]
    return out


def phrases(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names and documents of the phrases."""
    x, doc = squeeze(x, doc)
    first = np.ones(len(x), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    label = labels(x, np.flatnonzero(first))
    up = np.ones(len(x), dtype=bool)
    up[1:] = label[1:] > label[:-1]
    down = np.ones(len(x), dtype=bool)
    down[:-1] = (label[:-1] > label[1:]) | first[1:]
    start = np.flatnonzero((up & down) | first)
    length = np.diff(np.append(start, len(x)))
    place = np.arange(len(x)) - np.repeat(start, length)
    total = np.add.reduceat(x * POWERS[place & 63] + (place >> 6).astype(np.uint64), start)
    return mix(total + length.astype(np.uint64)), doc[start]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text."""
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    code = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    size = np.array([len(c) for c in code])
    if not size.sum():
        return out
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    x = mix(np.concatenate(code).astype(np.uint64) + ODD)
    names, docs = [], []
    for level in range(1, max(FEATURES) + 1):
        x, doc = phrases(x, doc)
        if level in FEATURES:
            names.append(mix(x + np.uint64(level)))
            docs.append(doc)
    name, doc = np.concatenate(names), np.concatenate(docs)
    order = np.argsort(name)[::-1]  # the smallest is written last
    least = np.zeros(len(texts) * SLOTS, dtype=np.uint64)
    slot = doc.astype(np.int64) * SLOTS + (mix(name) & np.uint64(SLOTS - 1)).astype(np.int64)
    least[slot[order]] = name[order]
    least = least.reshape(-1, SLOTS)
    filled = least != 0
    full, have = least.copy(), filled.copy()
    for shift in range(1, SLOTS):  # an empty slot borrows from the next that has a minimum, told apart by the distance
        if have[filled.any(axis=1)].all():
            break
        take = ~have & np.roll(filled, -shift, axis=1)
        full[take] = mix(np.roll(least, -shift, axis=1)[take] + ODD * np.array(shift, dtype=np.uint64))
        have |= take
    return np.where(have, (mix(full) >> np.uint64(56)).astype(np.uint8), 0).astype(np.uint8)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots, less what chance gives; 1 for equal fingerprints."""
    same = sum(x == y for x, y in zip(a, b, strict=True)) / SLOTS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


class Ranges:
    """Ranges of the order of documents - by falling id (nulls last), then by the text's hash - with about as many rows each.

    An id that holds several ranges' worth of rows is split by the hash.  place is the complement of the id, so it ascends.
    """

    def __init__(self, quantiles: list[int]):
        self.cuts, self.times = np.unique(np.array(quantiles or [], dtype=np.int64), return_counts=True)
        self.before = np.concatenate(([0], np.cumsum(self.times)))

    def of(self, place: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        if not len(self.cuts):
            return np.zeros(len(place), dtype=np.int32)
        at = np.searchsorted(self.cuts, place, side="right")
        out = self.before[at]
        own = np.maximum(at - 1, 0)
        tied = (at > 0) & (self.cuts[own] == place) & (self.times[own] > 1)
        high = (hash_[tied].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        out[tied] = self.before[own[tied]] + 1 + ((high * self.times[own[tied]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        return out.astype(np.int32)


def _ranges(rows: DataFrame, parts: int) -> tuple[Ranges, dict[tuple[int, int], int]]:
    """The ranges, and for each range's first row the range that needs it besides its own: the one before.

    Both have at most as many entries as there are partitions.
    """
    quantiles = rows.agg(F.percentile_approx("place", [k / parts for k in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    ranges = Ranges(quantiles)

    def run(batches):
        for batch in batches:
            place, hash_ = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(place, hash_)), *batch.columns], names=["bucket", "place", "hash"])

    first = rows.select("place", "hash").mapInArrow(run, "bucket int, place long, hash long").groupBy("bucket").agg(F.min(F.struct("place", "hash")).alias("row"))
    heads = sorted((r.bucket, r.row.place, r.row.hash) for r in first.collect())
    return ranges, {(place, hash_): heads[i - 1][0] for i, (_, place, hash_) in enumerate(heads)}


def _deal(ranges: Ranges, also: dict[tuple[int, int], int]):
    """Rows by range with their fingerprint and packed text; the first row of a range also goes to the range before it."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            places, hashes = (c.to_numpy() for c in batch.columns[:2])
            buckets, rows, part, size, at = ranges.of(places, hashes).tolist(), [], [], 0, 0

            def flush(part, at):
                for j, (t, f) in enumerate(zip(part, fingerprints(part), strict=True)):
                    key = (int(places[at + j]), int(hashes[at + j]))  # noqa: B023
                    row = (*key, press.compress(t.encode("utf-8")), f.tobytes())
                    rows.append((buckets[at + j], False, *row))  # noqa: B023
                    if key in also:
                        rows.append((also[key], True, *row))  # noqa: B023

            for i, t in enumerate(batch.column(2)):
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size >= BLOCK_CHARS:
                    flush(part, at)
                    part, size, at = [], 0, i + 1
            flush(part, at)
            if rows:
                kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "ghost", "place", "hash", "packed", "print"])

    return run


RESULT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _compare(batches):
    """Rows of a range in order, then the ghosts: each row against the next one."""
    unpack = zstandard.ZstdDecompressor()
    held, ready, size = None, [], 0  # held: the row that waits for its next

    def flush(ready):
        prints = fingerprints([e for *_, e in ready])
        rows = []
        for (place, n, print_, next_print, e), f in zip(ready, prints, strict=True):
            f = f.tobytes()
            rows.append((None if ~place == NO_ID else ~place, n, hashlib.sha256(e.encode()).hexdigest(), print_.hex(), f.hex(), likeness(print_, f), likeness(print_, next_print)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), RESULT.values(), strict=True)], names=list(RESULT))

    for batch in batches:
        for bucket, ghost, place, _, packed, print_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack.decompress(packed).decode() if packed else ""
            if held and held[0] == bucket:
                ready.append((held[1], len(held[2]), held[3], print_, edited(held[2], text)))
                size += len(held[2])
            held = None if ghost else (bucket, place, text, print_)
            if size >= BLOCK_CHARS:
                yield flush(ready)
                ready, size = [], 0
    if ready:
        yield flush(ready)


def fingerprint_edits(docs: DataFrame, doc_id="doc_id", text="text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses (see the query's contract).

    Texts cross the network once, packed; ranges of the order keep each next document in the same partition.
    """
    t = F.col(text).cast("string")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(t)), F.lit(0))).first()[0]
    parts = max(1, shuffle_partitions(docs.sparkSession), -(-size // part_bytes))
    place = F.bitwise_not(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)))
    rows = docs.select(place.alias("place"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("hash"), t.alias("text"))
    dealt = rows.mapInArrow(_deal(*_ranges(rows, parts)), "bucket int, ghost boolean, place long, hash long, packed binary, print binary")
    dealt = dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "ghost", "place", "hash")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compare, kinds)
