"""Evaluation passages inside training documents, by greedy string tiling.

The held-out items are a small query set, processed in blocks of bounded size:
each block's token grams are broadcast, so the corpus is scanned where it lies
and never shuffled.  In each document, runs of words that all occur in the
block are probed with a rolling hash for seeds of ``min_tile`` words; a
document and an item that share a seed are tiled: the longest match between
words not yet marked is marked first, again and again, until no match of
``min_tile`` is left.  Tiles may come in any order, so reordered passages count:
an item has leaked if one tile is long enough or if all tiles together cover
enough of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")
_JOINER = re.compile(r"['’­]")
#: Largest number of item words in one broadcast block.
BLOCK_WORDS = 2_000_000
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    """Lower-case words; punctuation separates, apostrophes and soft hyphens join."""
    return _WORD.findall(_JOINER.sub("", (text or "").lower()))


def rolling_hashes(ids: list[int], width: int) -> list[int]:
    """Karp-Rabin fingerprints of all windows of ``width`` ids."""
    if len(ids) < width:
        return []
    h, top, out = 0, pow(_BASE, width - 1, _MOD), []
    for x in ids[:width]:
        h = (h * _BASE + x) % _MOD
    out.append(h)
    for i in range(width, len(ids)):
        h = ((h - ids[i - width] * top) * _BASE + ids[i]) % _MOD
        out.append(h)
    return out


def greedy_tiles(a: list[int], b: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """Non-overlapping (start in a, start in b, words) matches, longest first; ties by start.

    Matches that lose words to an earlier tile come back shortened, so the result
    is the same as scanning for the longest unmarked match again after each tile.
    """
    where: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(rolling_hashes(b, min_words)):
        where[h].append(j)
    matches: list[tuple[int, int, int]] = []
    for i, h in enumerate(rolling_hashes(a, min_words)):
        for j in where.get(h, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # inside a match that began earlier
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= min_words:
                matches.append((i, j, n))
    used_a, used_b, tiles = [False] * len(a), [False] * len(b), []
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, j, n in matches:
        buckets[n].append((i, j))
    size = max(buckets, default=0)
    while size >= min_words:
        for i, j in sorted(buckets.pop(size, ())):
            free = [not (used_a[i + k] or used_b[j + k]) for k in range(size)]
            if all(free):
                used_a[i : i + size] = [True] * size
                used_b[j : j + size] = [True] * size
                tiles.append((i, j, size))
                continue
            k = 0
            while k < size:
                if not free[k]:
                    k += 1
                    continue
                e = k
                while e < size and free[e]:
                    e += 1
                if e - k >= min_words:
                    buckets[e - k].append((i + k, j + k))
                k = e
        size = max(buckets, default=0)
    return tiles


class _Block:
    """Word ids, seed fingerprints and token lists of one block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.items = {k: [self.ids.setdefault(w, len(self.ids) + 1) for w in ws] for k, ws in items}
        self.seeds: dict[int, set[int]] = defaultdict(set)
        for k, tokens in self.items.items():
            for h in rolling_hashes(tokens, min_words):
                self.seeds[h].add(k)

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, leaked words, longest tile, tiles) of each item that leaked into the text."""
        get, m = self.ids.get, self.min_words
        tokens = [get(w, 0) for w in words_of(text)]
        found: set[int] = set()
        start, n = 0, len(tokens)
        while start < n:
            if not tokens[start]:
                start += 1
                continue
            end = start
            while end < n and tokens[end]:
                end += 1
            if end - start >= m:
                for h in rolling_hashes(tokens[start:end], m):
                    found |= self.seeds.get(h, frozenset())
            start = end
        out = []
        for k in sorted(found):
            # Words foreign to the block match nothing: make each differ from 0.
            tiles = greedy_tiles(self.items[k], [t or -1 for t in tokens], m)
            if tiles:
                out.append((k, sum(t[2] for t in tiles), max(t[2] for t in tiles), len(tiles)))
        return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    min_words: int = 12,
    block_words: int = BLOCK_WORDS,
    min_tile: int | None = None,
    min_share: float | None = None,
) -> DataFrame:
    """One row (doc key, item key, leaked_words, longest_passage, passages, item_share) per leak.

    A leak is a passage of at least ``min_words`` consecutive words that the
    document has in common with the item, or, with ``min_share``, tiles of at
    least ``min_tile`` words (``min_words`` if none is given) that cover that
    part of the item's words, in whatever order.  ``item_share`` is the part of
    the item's words covered by tiles.  Null and short texts leak nothing; repeated
    item keys keep one text (the smallest), repeated rows of ``docs`` give one
    result each.  Items are streamed to the driver and packed into blocks of at
    most ``block_words`` words (one item may exceed it alone), each block scans
    ``docs`` once.
    """
    tile = min_words if min_tile is None else min(min_tile, min_words)
    schema = T.StructType(
        [
            T.StructField(doc_key, docs.schema[doc_key].dataType),
            T.StructField(item_key, items.schema[item_key].dataType),
            T.StructField("leaked_words", T.LongType()),
            T.StructField("longest_passage", T.LongType()),
            T.StructField("passages", T.LongType()),
            T.StructField("item_share", T.DoubleType()),
        ]
    )
    rows = (
        items.select(F.col(item_key).alias("k"), F.col(text).alias("t"))
        .filter("k is not null and t is not null")
        .groupBy("k")
        .agg(F.min("t").alias("t"))
        .orderBy("k")
        .toLocalIterator()
    )
    source = docs.select(F.col(doc_key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")
    sc = docs.sparkSession.sparkContext

    def scan(block: list[tuple[int, list[str]]]) -> DataFrame:
        shared = sc.broadcast(block)
        sizes = {k: len(ws) for k, ws in block}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _Block(shared.value, tile)
            for pdf in batches:
                hits = [
                    (d, k, words, longest, tiles, words / sizes[k])
                    for d, t in zip(pdf["_key"], pdf["_text"])
                    for k, words, longest, tiles in index.search(t)
                    if longest >= min_words or (min_share is not None and words >= min_share * sizes[k])
                ]
                yield pd.DataFrame(hits, columns=schema.names)

        return source.mapInPandas(run, schema)

    result, block, size = None, [], 0
    for row in rows:
        ws = words_of(row["t"])
        if block and size + len(ws) > block_words:
            part = scan(block)
            result, block, size = (part if result is None else result.unionByName(part)), [], 0
        block.append((row["k"], ws))
        size += len(ws)
    part = scan(block)
    return part if result is None else result.unionByName(part)


def leaked_items(leaks: DataFrame, item_key: str = "item_id") -> DataFrame:
    """Per leaked item: documents it leaked into and the largest share found."""
    return leaks.groupBy(item_key).agg(
        F.count(F.lit(1)).alias("documents"),
        F.max("item_share").alias("max_item_share"),
        F.max("longest_passage").alias("longest_passage"),
    )
