"""Benchmark passages in documents, by greedy string tiling with running Karp-Rabin matches.

The benchmark is the stated query set: it is read in blocks of bounded size, and each block goes to all
documents, where shared seeds (windows of tokens) say which items are tiled at all.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

#: Shortest tile, and the share of an item's tokens that its tiles must cover.
LEAST, COVERAGE = 5, 0.5
#: Tokens of benchmark items in a block, which is what a broadcast holds at most (besides one item).
BLOCK = 1_000_000
tokens = re.compile(r"\w+").findall
#: Odd, so that it has an inverse modulo 2^64.
BASE = 1_000_003


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin value of each window, modulo 2^64, rolled on from prefix to prefix: one pass for any size."""
    n = max(0, len(ids) - size + 1)
    if not n or not size:
        return np.zeros(n, np.uint64)
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(ids) - 1, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64)))
    before = np.append(np.uint64(0), np.cumsum(ids.astype(np.uint64) * up))
    return (before[size:] - before[:-size]) * down[:n]


def _windows(free: list[bool], size: int) -> list[int]:
    """Starts of the windows that lie wholly in unmarked tokens."""
    marked = np.append(0, np.cumsum(~np.array(free, bool)))
    return np.flatnonzero(marked[size:] == marked[:-size]).tolist() if len(free) >= size else []


def tile(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length), longest first, then by place; the longest match of unmarked tokens is marked, again and again.

    Search lengths fall from the item's length to `least`.  For each, windows of unmarked text tokens are
    hashed, windows of the item look theirs up, and matches are compared and extended; they wait in a queue, longest
    first.  What marks have left of one returns to the queue at its own length.
    """
    free_p, free_t = [True] * len(item), [x >= 0 for x in text]
    hashed = np.array(item, np.int64) + 1, np.array(text, np.int64) + 1
    tiles, size = [], max(least, min(len(item), 32))
    while True:
        where = defaultdict(list)
        values = rolling(hashed[1], size)
        for t in _windows(free_t, size):
            where[int(values[t])].append(t)
        queue = []
        values = rolling(hashed[0], size)
        for p in _windows(free_p, size) if where else ():
            for t in where.get(int(values[p]), ()):
                if p and t and item[p - 1] == text[t - 1] and free_p[p - 1] and free_t[t - 1]:
                    continue  # part of the match that begins before
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_p[p + n] and free_t[t + n]:
                    n += 1
                if n >= size:
                    queue.append((-n, p, t))
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            free = [free_p[p + k] and free_t[t + k] for k in range(-n)]
            if all(free):
                free_p[p : p - n] = free_t[t : t - n] = [False] * -n
                tiles.append((p, t, -n))
                continue
            k = 0
            for ok, run in itertools.groupby(free):
                run = len(list(run))
                if ok and run >= size:
                    heapq.heappush(queue, (-run, p + k, t + k))
                k += run
        if size == least:
            return tiles
        size = max(least, size // 2)


class Items:
    """A block of items: words by number, and which items have a seed."""

    def __init__(self, rows: list[tuple[object, str]], least: int):
        self.least, self.word, self.items = least, {}, []
        seeds = defaultdict(set)
        for key, text in rows:
            ids = [self.word.setdefault(w, len(self.word)) for w in tokens(text.lower())]
            if ids:
                self.items.append((key, ids))
                size = min(least, len(ids))
                for v in rolling(np.array(ids), size).tolist():
                    seeds[size, v].add(len(self.items) - 1)
        self.seeds = {size: {v: sorted(s) for (k, v), s in seeds.items() if k == size} for size in {k for k, _ in seeds}}
        self.sorted = {size: np.array(sorted(s), np.uint64) for size, s in self.seeds.items()}

    def covered(self, texts: list[str | None], coverage: float):
        """(row, item key, item tokens, matched tokens) of the pairs whose coverage suffices."""
        get, flat, start = self.word.get, [], [0]
        for t in texts:
            flat += [get(w, -1) for w in tokens(t.lower())] if t else []
            flat.append(-1)
            start.append(len(flat))
        ids = np.array(flat, np.int64)
        known = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, seeds in self.sorted.items():
            at = np.flatnonzero(known[size:] == known[:-size]) if len(ids) >= size else np.zeros(0, int)
            values = rolling(ids, size)[at]
            hit = np.searchsorted(seeds, values)
            ok = seeds[np.minimum(hit, len(seeds) - 1)] == values
            pairs = defaultdict(list)
            rows = np.searchsorted(start, at[ok], "right") - 1
            for row, place, v in zip(rows.tolist(), at[ok].tolist(), values[ok].tolist(), strict=True):
                for i in self.seeds[size][v]:
                    pairs[row, i].append(place)
            for (row, i), places in pairs.items():
                key, item = self.items[i]
                text, end = [], -1  # every tile lies where seeds follow each other
                for p in places:
                    if p > end:
                        text.append(-1)
                    text += flat[max(p, end) : p + size]
                    end = p + size
                n = sum(x[2] for x in tile(item, text, size)) if len(places) * size >= coverage * len(item) or len(places) + size - 1 >= coverage * len(item) else 0
                if n >= coverage * len(item) and n:
                    yield row, key, len(item), n


def blocks(benchmark: DataFrame, key: str, text: str, least: int = LEAST, most: int = BLOCK):
    """The benchmark's items in blocks; the driver holds one block at a time."""
    rows, held = [], 0
    for k, t in benchmark.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        rows.append((k, t))
        held += len(tokens(t))
        if held >= most:
            yield Items(rows, least)
            rows, held = [], 0
    if rows:
        yield Items(rows, least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, n_tokens, n_matched, coverage of each document and item whose tiles cover enough of the item.

    Case and punctuation don't count.  Null and empty texts match nothing; an item shorter than `least` tokens must
    occur whole.  Repeated rows give repeated results; a null key stays null.  An empty benchmark gives no rows.
    """
    import pyarrow as pa

    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, n_tokens long, n_matched long, coverage double"
    out = None
    for block in blocks(benchmark, "item_id", "text", least):
        sent = sc.broadcast(block)

        def run(batches, sent=sent):
            for b in slices(batches):
                ids = b.column(key).to_pylist()
                rows = [(ids[r], k, n, m, m / n) for r, k, n, m in sent.value.covered(b.column(text).to_pylist(), coverage)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_tokens", "n_matched", "coverage"])

        part = docs.select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, rows with a null text stay.  No shuffle."""
    import pyarrow as pa

    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark, "item_id", "text", least):
        sent = sc.broadcast(block)

        def run(batches, sent=sent):
            for b in slices(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in sent.value.covered(b.column(text).to_pylist(), coverage)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
