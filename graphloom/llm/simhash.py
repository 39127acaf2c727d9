"""SimHash near-dedup with bit-sliced comparison.

Documents become 64-bit fingerprints; equal ones collapse to one row.  Fingerprints that differ in at most RADIUS bits
agree on at least n - RADIUS of n bit blocks, so they meet in the bucket of one choice of so many blocks: the search is exact,
without all pairs.  More blocks make smaller buckets, so n grows with the number of distinct fingerprints.  Within a bucket, bit planes are stored vertically: one word holds one bit of 64 fingerprints,
carry-save counters add up 64 distances at a time, and a word is abandoned once all its distances exceed the radius.
Buckets beyond TILE members are split into tiles, two parts against each other, so no task gets one whole.

Each bucket returns a spanning forest of its links, never its pairs; components follow from alternating stars.

Defined results: a null, empty or blank text has no words and fingerprint zero, which links like any other; rows with a
null id get a fingerprint and the component of the other rows with a linked fingerprint, else null; repeated rows are one
document; empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, written
from graphloom.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Members of a bucket that one task compares at once.
TILE = 4096
#: Buckets up to this size are compared together, pair by pair; larger ones as blocks of queries against all planes.
SMALL = 24

#: For documents alike to 0.8: words in a shingle, fingerprints side by side, bits that may differ for a pair to be proposed (pairs
#: at that similarity were measured at 56 or fewer), bins of minima and bands of them that propose pairs.
NEAR_WORDS, NEAR_SIMILARITY, WIDE, NEAR_RADIUS, BINS, BANDS = 5, 0.8, 4, 64, 100, 20
TURNS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words than a shingle has are one shingle."""
    ws = text.translate(FOLD).split()
    if not ws:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(ws)
    end = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1)).tolist()
    end = end[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start, end, strict=False)], dtype=np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """Bits that more than half of the hashes have; 0 without hashes."""
    if not len(h):
        return np.uint64(0)
    lanes = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 64:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0)
    else:
        counts = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ BITS for j in range(8)])
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    return int(majority(shingle_hashes(text, words)))


def turned(h: np.ndarray, turn: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(turn)


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """WIDE fingerprints side by side, of shingle hashes turned anew for each; signed."""
    return [int(np.int64(majority(h if not k else turned(h, TURNS[k - 1])).view(np.int64))) for k in range(WIDE)]


def bands(h: np.ndarray) -> np.ndarray:
    """Keys that two documents share with near certainty if their shingles are alike: bands of the least hash in each of BINS bins."""
    odd = np.uint64(TURNS[0])
    m = turned(turned(h, TURNS[1]), TURNS[2])
    least = np.zeros(BINS, dtype=np.uint64)
    if len(m):
        of = ((m >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(m)[::-1]  # the least is written last
        filled = np.zeros(BINS, dtype=bool)
        filled[of] = True
        least[of[order]] = m[order]
        have = np.flatnonzero(filled)
        take = np.searchsorted(have, np.arange(BINS)) % len(have)  # an empty bin borrows from the next that is not
        least = least[have[take]] + ((have[take] - np.arange(BINS)) % BINS).astype(np.uint64) * odd
    rows = least.reshape(BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * odd
    for k in range(rows.shape[1]):
        key = turned(key + rows[:, k], TURNS[k % 3])
    return key.view(np.int64)


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (signed long with the bits of the fingerprint) of every row."""

    def run(batches):
        for batch in batches:
            out = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words): bit j of word w of plane b is bit b of fingerprint 64 w + j; the last word is filled up with zeros."""
    fps = fps.reshape(len(fps), -1)
    n = -(-len(fps) // 64) * 64
    full = np.zeros((n, fps.shape[1]), dtype=np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(diff, cells: int, radius: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Cells (words of 64 lanes) with a distance of at most radius, and the lanes that have it.

    diff(plane, cells) gives the differing bits of the listed cells.  Counter words and an overflow word count up 64
    distances at once; cells whose lanes have all exceeded the radius are left out from then on.
    """
    at = np.arange(cells)
    limit = radius + 1  # lanes whose counter is limit or more have exceeded
    c = [np.zeros(cells, dtype=np.uint64) for _ in range(limit.bit_length())]
    over = np.zeros(cells, dtype=np.uint64)
    every = ~np.uint64(0)
    for plane in range(bits):
        carry = diff(plane, at)
        for k in range(len(c)):
            c[k], carry = c[k] ^ carry, c[k] & carry
        over |= carry
        if plane % 8 == 7:
            over |= _at_least(c, limit)
            live = over != every
            if not live.all():
                at, over, c = at[live], over[live], [x[live] for x in c]
            if not len(at):
                break
    return at, ~over


def _at_least(c: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter is at least limit, compared from the highest bit down."""
    more, equal = np.zeros_like(c[0]), np.full_like(c[0], ~np.uint64(0))
    for k in range(len(c) - 1, -1, -1):
        if limit >> k & 1:
            equal &= c[k]
        else:
            more |= equal & c[k]
            equal &= ~c[k]
    return more | equal


def lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component, for links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _small_links(fps: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int) -> np.ndarray:
    """Forest of many small buckets of consecutive members: pairs at each distance within a bucket, 64 to a word."""
    left = np.repeat(start + size, size) - np.repeat(start, size) - (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)) - 1
    member = np.repeat(start, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    a_all, b_all = [], []
    for d in range(1, int(size.max(initial=1))):
        a = member[left >= d]
        x = planes(fps[a] ^ fps[a + d])
        cell, hit = within(lambda p, at, x=x: x[p][at], x.shape[1], radius, len(x))
        w, lane = lanes_of(hit)
        k = cell[w] * 64 + lane
        k = k[k < len(a)]
        a_all.append(a[k])
        b_all.append(a[k] + d)
    if not a_all:
        return np.arange(len(fps))
    return _forest(len(fps), np.concatenate(a_all), np.concatenate(b_all))


def _large_links(fps: np.ndarray, radius: int, queries: int = 64) -> np.ndarray:
    """Forest of one large bucket: blocks of queries against the planes of all members."""
    n, table = len(fps), planes(fps)
    width = table.shape[1]
    flat = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    sign = np.where(flat, ~np.uint64(0), np.uint64(0))
    root = np.arange(n)
    for q in range(0, n, queries):
        rows = sign[q : q + queries]
        cell, hit = within(lambda p, at, rows=rows: table[p][at % width] ^ rows[at // width, p], len(rows) * width, radius, len(table))
        w, lane = lanes_of(hit)
        a, b = q + cell[w] // width, cell[w] % width * 64 + lane
        a, b = a[b < n], b[b < n]
        if np.any(root[a] != root[b]):
            root = root[_forest(n, np.concatenate((np.arange(n), root[a])), np.concatenate((root, root[b])))]
    return root


def bucket_links(radius: int = RADIUS):
    """Arrow batches of (bucket, id, fp, ...), all of a bucket together -> (a, b) ids, a spanning forest of each bucket's links."""

    def links(bucket, fps, ids):
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.append(start, len(bucket)))
        root = np.arange(len(fps))
        some = (size > 1) & (size <= SMALL)
        if some.any():
            root = _small_links(fps, start[some], size[some], radius)
        for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            root[s : s + n] = s + _large_links(fps[s : s + n], radius)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            bucket = new[0]
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0  # the last bucket may go on
            if cut:
                yield links(bucket[:cut], np.stack(new[2:], axis=1)[:cut].view(np.uint64), new[1][:cut])
            held = [x[cut:] for x in new]
        if held is not None and len(held[0]):
            yield links(held[0], np.stack(held[2:], axis=1).view(np.uint64), held[1])

    return run


def _buckets(radius: int, blocks: int) -> list:
    """One bucket key for each choice of blocks that must agree."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)) for i in range(blocks)]
    return [F.xxhash64(F.lit(k), *(part[i] for i in pick)) for k, pick in enumerate(combinations(range(blocks), blocks - radius))]


def blocks_for(count: int, radius: int = RADIUS, bucket: int = 32) -> int:
    """Bit blocks with which buckets of as many random fingerprints have about `bucket` members or fewer: 6 up to 2**24 or so."""
    n = radius + 2
    while n < 64 and (64 * (n - radius) // n) < math.log2(max(count, 1) / bucket):
        n += 1
    return n


def similar(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Of distinct (fp, id): the links a, b between ids whose fingerprints are within the radius, as forests of the buckets."""
    return _linked(prints, ["fp"], F.array(*_buckets(radius, blocks or blocks_for(prints.count(), radius))), radius, tile)


def _linked(prints: DataFrame, words: list[str], buckets, radius: int, tile: int) -> DataFrame:
    rows = prints.select("id", *words, F.explode(buckets).alias("bucket"))
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    kept = rows.join(sizes, "bucket")  # short rows; adaptive execution splits a hot bucket
    parts = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    whole = kept.where(F.col("n") <= tile).select("bucket", "id", *words)
    split = kept.where(F.col("n") > tile).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    split = split.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "id", *words)
    dealt = whole.unionByName(split).repartition("bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(bucket_links(radius), "a long, b long")


def _alike(sets: list[bytes], similarity: float) -> np.ndarray:
    """The least member of each member's component, for links of a Jaccard similarity of at least that.

    A member is compared with every later one that is not yet in its component, so no link that matters is left out.
    """
    n = len(sets)
    size = np.array([len(s) // 8 for s in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    tokens, token = np.unique(np.frombuffer(b"".join(sets), dtype=np.uint64), return_inverse=True)
    root, mark = np.arange(n), np.zeros(len(tokens), dtype=bool)
    for q in range(n - 1):
        least, most = np.minimum(size, size[q]), np.maximum(size, size[q])
        rows = q + 1 + np.flatnonzero((root[q + 1 :] != root[q]) & (least[q + 1 :] >= similarity * most[q + 1 :] - 1e-9) & (size[q + 1 :] > 0))
        if not len(rows) or not size[q]:
            continue
        own = token[start[q] : start[q + 1]]
        mark[own] = True
        at = np.concatenate(([0], np.cumsum(size[rows])))
        common = np.add.reduceat(mark[token[np.arange(at[-1]) + np.repeat(start[rows] - at[:-1], size[rows])]].astype(np.int64), at[:-1])
        mark[own] = False
        for r in np.unique(root[rows[common >= similarity * (size[q] + size[rows] - common) - 1e-9]]):
            low, high = sorted((int(r), int(root[q])))
            root[root == high] = low
    return root


def confirmed_links(similarity: float):
    """Arrow batches of (bucket, id, shingles), all of a bucket together -> (a, b) ids, a spanning forest of each bucket's links."""

    def links(ids, sets):
        root = _alike(sets, similarity)
        at = np.flatnonzero(root != np.arange(len(root)))
        ids = np.array(ids, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"])

    def run(batches):
        now, ids, sets = None, [], []
        for batch in batches:
            for bucket, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    now, ids, sets = bucket, [], []
                ids.append(i)
                sets.append(s)
        if len(ids) > 1:
            yield links(ids, sets)

    return run


def _row_hash(docs: DataFrame) -> list:
    """Two hashes of a whole row: equal rows have equal ones, all others are told apart."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(F.lit(k), F.to_json(F.struct(*every)) if any(f.dataType.typeName() == "map" for f in docs.schema) else F.struct(*every)).alias(f"h{k}") for k in (1, 2)]


def _confirmed(texts: DataFrame, members: DataFrame, words: int, similarity: float, tile: int) -> DataFrame:
    """Of texts (h1, h2, body), each once, and members of proposed groups (h1, h2, node, root): the links of that similarity, as forests of the groups.

    Groups beyond a tile are split into two parts against each other, as hot buckets are.
    """

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2), batch.column(3)], names=["id", "shingles", "root", "n"])

    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    members = written(members.join(sizes, "root"), "proposed")
    rows = texts.join(members, ["h1", "h2"]).select("node", "body", "root", "n").mapInArrow(run, "id long, shingles binary, root long, n long")
    parts = F.ceil(F.col("n") / tile).cast("int")
    split = rows.withColumn("mine", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    split = split.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "id", "shingles")
    dealt = split.repartition("bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(confirmed_links(similarity), "a long, b long")


def representatives(docs: DataFrame, doc_id="doc_id", text="text", words: int = NEAR_WORDS, radius: int = NEAR_RADIUS, similarity: float = NEAR_SIMILARITY, tile: int = TILE) -> DataFrame:
    """The rows of docs, all columns, of which one stays of each group linked by word shingles alike to the similarity or more.

    Five-word shingles of NEAR_SIMILARITY agree on about 85 % of SimHash bits, too few for an exact search by blocks of bits.  So
    groups are proposed: by bands of the least shingle hashes, of which two documents at the similarity share one with probability
    0.9996, and by the bit-sliced distance of WIDE fingerprints side by side.  Within a group the exact Jaccard similarity of the
    shingle sets decides.  Texts with the same set are one node from the start; those without words are alike.

    Rows are told apart by all their columns, not by their ids: the row with the smallest id stays, a null counts as larger than
    all, rows of one id go by a hash of the row; of equal rows one is left.
    """
    names = [f"fp{k}" for k in range(WIDE)]
    same = ["set0", "set1"]

    def run(batches):
        for batch in batches:
            hashes = [np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words)) for t in batch.column(3)]
            columns = zip(*map(wide_fingerprint, hashes), strict=True) if hashes else [[]] * WIDE
            sets = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in hashes), dtype=np.int64).reshape(-1, 2)
            keys = pa.array([bands(h) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns), *map(pa.array, sets.T.copy()), keys], names=["doc_id", "h1", "h2", *names, *same, "bands"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *_row_hash(docs), F.col(text).cast("binary").alias("body"))
    prints = written(source.mapInArrow(run, "doc_id long, h1 long, h2 long, " + ", ".join(f"{n} long" for n in names + same) + ", bands array<long>"), "wide")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    sets = prints.groupBy(*same, *names).agg(F.min(row).alias("row"), F.min_by("bands", row).alias("bands"))
    # numbers are read from the written table only, so a task that is run again cannot change them
    distinct = written(sets.withColumn("id", F.monotonically_increasing_id()), "distinct")
    proposed = components(_linked(distinct, names, F.col("bands"), radius, tile), "a", "b")
    members = distinct.select(F.col("id").alias("node"), "row.h1", "row.h2").join(proposed, "node")
    once = source.select("h1", "h2", "body").dropDuplicates(["h1", "h2"])
    roots = components(_confirmed(once, members, words, similarity, tile), "a", "b")
    grouped = distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("row").alias("row"))
    stay = grouped.select(F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_row_hash(docs)).dropDuplicates(["h1", "h2"])
    return rows.join(stay, ["h1", "h2"], "left_semi").select("row.*")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = written(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "distinct")
    roots = components(similar(distinct.select("fp", "id"), radius), "a", "b")
    rooted = distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"), "n")
    # an id that holds several fingerprints links them, as it is one document
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("fp").alias("k")).where("k > 1")
    if not several.isEmpty():
        through = prints.join(several, "doc_id").join(rooted, "fp").select("doc_id", "component_id")
        first = through.groupBy("doc_id").agg(F.min("component_id").alias("to"))
        more = components(through.join(first, "doc_id"), "component_id", "to")
        rooted = rooted.join(more.withColumnRenamed("node", "component_id"), "component_id", "left").select("fp", F.coalesce("root", "component_id").alias("component_id"), "n")
    rooted = written(rooted, "rooted")
    return join_counted(prints.where("doc_id is not null"), rooted, ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id").unionByName(
        prints.where("doc_id is null").join(rooted.drop("n"), "fp", "left").select("doc_id", "fp", "component_id")
    )
