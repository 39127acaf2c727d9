"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents.  Its words become symbols; words that no benchmark item uses are breaks, and stretches
shorter than the shortest window cannot hold a match, so the index covers only the rest and loses nothing.  The benchmark
comes in blocks of bounded size, all of which are searched one after another on the one index of a shard: the windows of a
block go backwards together through the ranks of a wavelet matrix, matches are located by walking to the nearest sampled
suffix, and the covered words merge into removal spans.

Words are compared by 64-bit hashes, under a seed with which the words of each block have no collision; a document word that
collides with a benchmark word is found out where windows are located, as their words themselves are compared.

Rows are never joined to their results: a task returns every row it gets, in order.  Nulls and empty texts have no words and
no hits; rows that share an id, or have none, are judged each by its own text; repeated rows each return a row; an empty
benchmark or document table gives no hits or no rows; other columns are carried along (removed) or ignored (contamination).
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a window.
WINDOW = 10
#: Characters of benchmark text in a block, which is what the driver and a task hold of it at once.
BLOCK_CHARS = 4_000_000
#: Distinct benchmark words up to which they are broadcast (8 bytes each) to break texts; beyond, every word is indexed.
KNOWN_WORDS = 8_000_000
#: Words in a shard, and bytes of text and other columns that a shard gathers at most before its last row.
SHARD_WORDS, SHARD_BYTES = 1_000_000, 16_000_000
#: Every so many text positions keep their suffix position.
SAMPLE = 8

WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
SEEDS = 64

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def hashed(words: list[bytes], seed: int) -> np.ndarray:
    """A number from 2 upwards for each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), dtype=np.uint64, count=len(words)) | np.uint64(2)


def block_of(items: list[tuple[str, bytes]], seed: int, size: int = WINDOW) -> dict | None:
    """The distinct windows of some items as plain arrays; None if two of their words collide.

    by_length: for each window length the window numbers and their words' hashes; owner_at, owners: the items of each window;
    first: item and word where a window is first found, to compare its words themselves.
    """
    words = [words_of(t) for _, t in items]
    every = {w for ws in words for w in ws}
    if len(np.unique(hashed(list(every), seed))) < len(every):
        return None
    owner, place, by_length, count = [], [], [], 0
    for n in sorted({min(len(ws), size) for ws in words} - {0}):
        mine = [i for i, ws in enumerate(words) if min(len(ws), size) == n]
        h = [hashed(words[i], seed) for i in mine]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, n) for x in h])
        item = np.repeat(mine, [len(x) - n + 1 for x in h])
        at = np.concatenate([np.arange(len(x) - n + 1) for x in h])
        _, first, same = np.unique(np.ascontiguousarray(rows).view([("", np.uint64)] * n).ravel(), return_index=True, return_inverse=True)
        by_length.append((count + np.arange(len(first)), rows[first]))
        pairs = np.unique(np.stack((same.ravel() + count, item)), axis=1)
        owner.append(pairs)
        place.append(np.stack((item[first], at[first])))
        count += len(first)
    if not count:
        return {"items": [], "texts": [], "by_length": [], "owner_at": np.zeros(1, dtype=np.int64), "owners": np.zeros(0, dtype=np.int64), "first": np.zeros((2, 0), dtype=np.int64)}
    pairs = np.concatenate(owner, axis=1)
    return {"items": [i for i, _ in items], "texts": [t for _, t in items], "by_length": by_length, "owner_at": np.searchsorted(pairs[0], np.arange(count + 1)), "owners": pairs[1], "first": np.concatenate(place, axis=1)}


class FMIndex:
    """Index of a symbol sequence that ends in its only 0."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        n = len(s)
        sa = self._suffixes(s)
        bwt = s[sa - 1]  # the row of suffix 0 gets the terminator
        self.n, self.bits = n, max(1, int(s.max()).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=(1 << self.bits)))))
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(n - ones[-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.sampled = np.where(sa % sample == 0, sa, -1)

    @staticmethod
    def _suffixes(s: np.ndarray) -> np.ndarray:
        """Suffix array by doubling the length that is known to be sorted."""
        rank, k, n = np.unique(s, return_inverse=True)[1].astype(np.int64), 1, len(s)
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            step = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                return order
            k *= 2

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before row i of the last column."""
        low = np.zeros_like(i)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, up = self.ones[level], (symbol >> b) & 1 == 1
            oi, ol = ones[i], ones[low]
            i = np.where(up, self.zeros[level] + oi, i - oi)
            low = np.where(up, self.zeros[level] + ol, low - ol)
        return i - low

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        symbol, i = np.zeros_like(row), row
        for level in range(self.bits):
            ones = self.ones[level]
            up = ones[i + 1] > ones[i]
            symbol = symbol * 2 + up
            i = np.where(up, self.zeros[level] + ones[i], i - ones[i])
        return self.first[symbol] + self.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns of one length, all searched backwards together."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.flatnonzero(np.all(patterns < (1 << self.bits), axis=1))
        hi[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, row: np.ndarray) -> np.ndarray:
        found, walk, at, steps = np.empty(len(row), dtype=np.int64), row.copy(), np.arange(len(row)), 0
        while len(at):
            known = self.sampled[walk]
            done = known >= 0
            found[at[done]] = known[done] + steps
            at, walk = at[~done], self.step(walk[~done])
            steps += 1
        return found


def found_in(value: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, value), max(len(table) - 1, 0))
    return at, table[at] == value if len(table) else np.zeros(value.shape, dtype=bool)


def scan_shard(docs: list[list[bytes]], blocks, known: np.ndarray | None, seed: int, least: int) -> list[tuple[np.ndarray, set[str]]]:
    """For each document, given as its words: which words are hit, and the items whose windows hit them.

    blocks yields the blocks of the benchmark; known are the sorted hashes of its words, None if any word may be one; least is
    the length of its shortest window.
    """
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a break after each document
    cover, found = np.zeros(int(starts[-1]) + 1, dtype=np.int64), [set() for _ in docs]
    word = np.zeros(int(starts[-1]), dtype=np.uint64)
    for d, a in zip(docs, starts.tolist(), strict=False):
        word[a : a + len(d)] = hashed(d, seed)
    if known is not None:
        word[~found_in(word, known)[1]] = 0
    inside = np.diff(np.concatenate(([0], (word != 0).astype(np.int8), [0])))
    begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    keep = end - begin >= least
    begin, end = begin[keep], end[keep]
    if least and len(begin):
        size = end - begin + 1  # with the separator 1
        offset = np.cumsum(size) - size
        origin = np.repeat(begin - offset, size) + np.arange(int(size.sum()))
        inner = np.ones(len(origin), dtype=bool)
        inner[offset + size - 1] = False
        table, rank = np.unique(word[origin[inner]], return_inverse=True)
        s = np.ones(len(origin) + 1, dtype=np.int64)
        s[:-1][inner] = rank.ravel() + 2
        s[-1] = 0
        index = FMIndex(s)
        for block in blocks():
            told: dict[int, list[bytes]] = {}
            for numbers, patterns in block["by_length"]:
                at, there = found_in(patterns, table)
                some = there.all(axis=1)
                lo, hi = index.search(at[some] + 2)
                count = hi - lo
                rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                at, window, n = origin[index.locate(rows)], np.repeat(numbers[some], count), patterns.shape[1]
                doc = np.searchsorted(starts, at, side="right") - 1
                true = np.zeros(len(at), dtype=bool)
                for k, (p, w, d) in enumerate(zip(at.tolist(), window.tolist(), doc.tolist(), strict=True)):
                    item, i = block["first"][:, w].tolist()
                    if item not in told:
                        told[item] = words_of(block["texts"][item])
                    p -= int(starts[d])
                    true[k] = docs[d][p : p + n] == told[item][i : i + n]
                np.add.at(cover, at[true], 1)
                np.add.at(cover, at[true] + n, -1)
                for d, w in set(zip(doc[true].tolist(), window[true].tolist(), strict=True)):
                    found[d].update(block["items"][o] for o in block["owners"][block["owner_at"][w] : block["owner_at"][w + 1]])
    hit = np.cumsum(cover)[:-1] > 0
    return [(hit[a : a + n], f) for a, n, f in zip(starts.tolist(), sizes.tolist(), found, strict=False)]


def hit_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Merged removal spans, as byte offsets: each goes from its first to its last hit word."""
    at = np.array([m.span() for m in WORD.finditer(text.translate(WORD_TABLE))])
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [{"start": int(at[a, 0]), "end": int(at[b - 1, 1])} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _shards(batches, column: int):
    """Arrow batches gathered into shards: (batches, texts as bytes, None where null)."""
    held, texts, size, words = [], [], 0, 0
    for batch in batches:
        begin = 0
        for i, t in enumerate(batch.column(column)):
            body = t.as_buffer().to_pybytes() if t.is_valid else None
            texts.append(body)
            size += len(body or b"")
            words += (body or b"").count(b" ") + 1
            if words >= SHARD_WORDS or size >= SHARD_BYTES:
                yield [*held, batch.slice(begin, i + 1 - begin)], texts
                held, texts, size, words, begin = [], [], 0, 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if texts:
        yield held, texts


def _benchmark(spark, benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> dict:
    """Broadcasts of the benchmark: its blocks one by one, and its known words."""
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("body")).where("item is not null and body is not null")
    bench = bench.select("item", "body", F.octet_length("body").alias("size"))
    for seed in range(SEEDS):
        blocks, known, lengths, part, size = [], [np.zeros(0, dtype=np.uint64)], set(), [], 0

        def flush(part, seed=seed, blocks=blocks, known=known, lengths=lengths):
            block = block_of(part, seed)
            if block is None:
                return False
            blocks.append(spark.sparkContext.broadcast(block))
            lengths.update(p.shape[1] for _, p in block["by_length"])
            if known[0] is not None:
                known[0] = np.union1d(known[0], np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(p.ravel() for _, p in block["by_length"])])))
                if len(known[0]) > KNOWN_WORDS:
                    known[0] = None
            return True

        fine = True
        for r in bench.toLocalIterator():
            part.append((r.item, bytes(r.body)))
            size += r.size
            if size >= block_chars:
                fine, part, size = flush(part), [], 0
                if not fine:
                    break
        fine = fine and (not part or flush(part))
        if fine:
            return {"blocks": blocks, "known": spark.sparkContext.broadcast(known[0]), "seed": seed, "least": min(lengths, default=0)}
        for b in blocks:
            b.destroy()
    raise RuntimeError(f"benchmark words collide under each of {SEEDS} seeds")


def _search(held: dict):
    """texts -> words and (hit, items) of each; what is broadcast is read in the task."""
    blocks, known, seed, least = held["blocks"], held["known"], held["seed"], held["least"]

    def one_by_one():
        for b in blocks:
            yield b.value
            if len(blocks) > 1:
                b.__dict__.pop("_value", None)  # so that a task holds one block at a time

    def run(texts):
        docs = [words_of(t) if t else [] for t in texts]
        return list(zip(docs, scan_shard(docs, one_by_one, known.value, seed, least), strict=True))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", block_chars=BLOCK_CHARS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted ids as strings), spans (byte offsets of the UTF-8 text)."""
    search = _search(_benchmark(docs.sparkSession, benchmark, item_id, item_text, block_chars))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches):
        for held, texts in _shards(batches, 1):
            ids = [i for b in held for i in b.column(0).to_pylist()]
            rows = []
            for i, t, (words, (hit, items)) in zip(ids, texts, search(texts), strict=True):
                n = int(hit.sum())
                rows.append((i, len(words), n, sorted(items), hit_spans(t, hit) if n else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, SCHEMA)


def removed(docs: DataFrame, benchmark: DataFrame, text="text", chars="n_chars", item_id="item_id", item_text="text", block_chars=BLOCK_CHARS) -> DataFrame:
    """docs, all rows and columns, with what occurs in the benchmark cut out of the texts; the column `chars`, if there is one, follows."""
    search = _search(_benchmark(docs.sparkSession, benchmark, item_id, item_text, block_chars))
    names = docs.columns
    at = names.index(text)
    count = names.index(chars) if chars in names else None

    def run(batches):
        for held, texts in _shards(batches, at):
            cut: list[str | None] = []
            for t, (_, (hit, _items)) in zip(texts, search(texts), strict=True):
                if hit.any():
                    parts, begin = [], 0
                    for s in hit_spans(t, hit):
                        parts.append(t[begin : s["start"]])
                        begin = s["end"]
                    t = b"".join([*parts, t[begin:]])
                    cut.append(t.decode())
                else:
                    cut.append(None)
            begin = 0
            for batch in held:
                some = cut[begin : begin + batch.num_rows]
                begin += batch.num_rows
                if any(c is not None for c in some):
                    columns = list(batch.columns)
                    columns[at] = pa.array([t.as_py() if c is None else c for t, c in zip(columns[at], some, strict=True)], columns[at].type)
                    if count is not None:
                        columns[count] = pa.array([n.as_py() if c is None else len(c) for n, c in zip(columns[count], some, strict=True)], columns[count].type)
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    return docs.mapInArrow(run, docs.schema)
