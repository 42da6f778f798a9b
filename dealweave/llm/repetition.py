"""Repetition inside a single document, from a word-level suffix array.

Every batch of documents is laid out as one array of word ids that are private
to their document, so one prefix-doubling pass sorts the suffixes of the whole
batch and suffixes of different documents never compare equal.  Once suffixes
are ranked by their first ``min_words`` words, only positions that share their
rank can start a repeated passage; the doubling goes on for those alone until
they are in full order.  Neighbours get their longest common prefix from the
ranks of each level.  A passage that repeats an earlier one is then the longest
prefix that a position shares with an earlier position of its prefix interval:
positions leave the suffix order from the last to the first, and what is left
beside one when it leaves is earlier.  The union of these spans is the repeated
part of a document, the longest of them its longest repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\w+")
#: Characters of text handled at once; a longer single text forms a batch of its own.
CHUNK_CHARS = 4_000_000


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order-preserving ranks of the keys from 0, and the count of each rank."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.empty(len(s), dtype=bool)
    first[:1] = True
    np.not_equal(s[1:], s[:-1], out=first[1:])
    group = np.cumsum(first) - 1
    rank = np.empty(len(s), dtype=np.int64)
    rank[order] = group
    return rank, np.bincount(group)


def _measure(texts: list[str], min_words: int) -> list[tuple[int, int, float, int]]:
    """(words, repeated words, share, longest repeat in words) of each text."""
    ids: dict[str, int] = {}
    words = [_WORD.findall(t.lower()) for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    n = int(lengths.sum())
    covered = np.zeros(len(texts), dtype=np.int64)
    longest = np.zeros(len(texts), dtype=np.int64)
    if n:
        flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), dtype=np.int64, count=n)
        doc = np.repeat(np.arange(len(texts)), lengths)
        starts, sizes = repeated_spans(doc * len(ids) + flat, min_words)
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes, -1)
        covered = np.bincount(doc[np.cumsum(edge[:n]) > 0], minlength=len(texts))
        np.maximum.at(longest, doc[starts], sizes)
    shares = covered / np.maximum(lengths, 1)
    return list(zip(lengths.tolist(), covered.tolist(), shares.tolist(), longest.tolist()))


def repeated_spans(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each position's longest passage of at least ``least`` keys that also starts earlier."""
    n = len(keys)
    word, counts = _dense(keys)
    # Rank by the first ``least`` keys; the last step may overlap.  Past the end nothing is equal.
    ranks, width = word, 1
    while width < least:
        step = min(width, least - width)
        onward = np.full(n, -1, dtype=np.int64)
        onward[: max(n - step, 0)] = ranks[step:]
        ranks, counts = _dense(ranks * (n + 1) + onward + 1)
        width += step
    live = np.flatnonzero(counts[ranks] > 1)
    # The same number at the end of the text stands for "no more keys", which two positions never share.
    live = live[live + least <= n]
    if not len(live):
        return live, live
    # A rank is the place of the first suffix of its group, so that refined ranks stay comparable with all others.
    rank = (np.cumsum(counts) - counts)[ranks]
    ladder, active, step = [(least, rank)], live, least
    while True:
        onward = np.where(active + step < n, rank[np.minimum(active + step, n - 1)], -1)
        order = np.lexsort((onward, rank[active]))
        active, onward = active[order], onward[order]
        old = rank[active]
        group = np.ones(len(active), dtype=bool)
        group[1:] = old[1:] != old[:-1]
        part = group.copy()
        part[1:] |= onward[1:] != onward[:-1]
        index = np.arange(len(active))
        head = np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        rank = rank.copy()
        rank[active] = old + head
        alone = part & np.append(part[1:], True)
        active = active[~alone]
        if not len(active):
            break
        step *= 2
        ladder.append((step, rank))
    order = live[np.argsort(rank[live])]
    prefix = np.zeros(len(order) + 1, dtype=np.int64)
    prefix[1:-1] = _common_prefix(order[:-1], order[1:], ladder, word, least)
    size = _longest_earlier(order, prefix)
    return order[size >= least], size[size >= least]


def _common_prefix(a: np.ndarray, b: np.ndarray, ladder: list[tuple[int, np.ndarray]], word: np.ndarray, least: int) -> np.ndarray:
    """Keys that the suffixes at a and b share, 0 if fewer than ``least``."""
    n = len(word)
    length = np.zeros(len(a), dtype=np.int64)
    for width, rank in ladder[::-1]:
        pa, pb = a + length, b + length
        inside = np.maximum(pa, pb) < n
        same = inside & (rank[np.minimum(pa, n - 1)] == rank[np.minimum(pb, n - 1)])
        length[same] += width
    for _ in range(least - 1):
        pa, pb = a + length, b + length
        same = (length > 0) & (np.maximum(pa, pb) < n) & (word[np.minimum(pa, n - 1)] == word[np.minimum(pb, n - 1)])
        if not same.any():
            break
        length[same] += 1
    return length


def _longest_earlier(order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Longest prefix each suffix shares with one at an earlier position; ``prefix[k]`` is that of order[k - 1] and order[k]."""
    n = len(order)
    size = np.zeros(n, dtype=np.int64)
    # Most intervals hold two suffixes: the later one repeats the earlier.
    ends = prefix == 0
    pair = np.flatnonzero(ends[:-1] & ~np.append(ends[1:-1], True) & np.append(ends[2:], [True, True])[:n])
    later = np.where(order[pair] > order[np.minimum(pair + 1, n - 1)], pair, pair + 1)
    size[later] = prefix[pair + 1]
    done = np.zeros(n, dtype=bool)
    done[pair] = done[pair + 1] = True
    rest = np.flatnonzero(~done)
    if not len(rest):
        return size
    # The others leave one by one, the last position first.
    common = np.append(prefix[rest], 0).tolist()
    before, after = list(range(-1, len(rest))), list(range(1, len(rest) + 2))
    found = [0] * len(rest)
    for k in np.argsort(-order[rest], kind="stable").tolist():
        p, q = before[k], after[k]
        x, y = common[k], common[q]
        found[k] = x if x > y else y
        common[q] = x if x < y else y
        before[q] = p
        if p >= 0:
            after[p] = q
    size[rest] = found
    return size


def measure_texts(texts: list[str | None], min_words: int = 8) -> list[tuple[int, int, float, int]]:
    """Measure texts in chunks of bounded size; a null text has no words."""
    out: list[tuple[int, int, float, int]] = []
    chunk: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if chunk and size + len(t) > CHUNK_CHARS:
            out += _measure(chunk, min_words)
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    return out + (_measure(chunk, min_words) if chunk else [])


def repetition_profile(df: DataFrame, key: str, text: str, min_words: int = 8) -> DataFrame:
    """One row (key, n_words, repeated_words, repeated_share, longest_repeat) per input row.

    ``repeated_words`` counts the words that lie in passages of at least
    ``min_words`` words which already occurred earlier in the same text; case
    and punctuation are ignored, and ``longest_repeat`` is the longest such
    passage (0 if there is none).  Null, empty and word-free texts give 0 in all
    columns.  Repeated keys give one row each; other columns are not read.
    """
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("repeated_words", T.LongType()),
            T.StructField("repeated_share", T.DoubleType()),
            T.StructField("longest_repeat", T.LongType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = measure_texts(pdf["_text"].tolist(), min_words)
            yield pd.DataFrame(
                {
                    key: pdf["_key"],
                    "n_words": [r[0] for r in rows],
                    "repeated_words": [r[1] for r in rows],
                    "repeated_share": [r[2] for r in rows],
                    "longest_repeat": [r[3] for r in rows],
                }
            )

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, schema)


def repeated_documents(df: DataFrame, key: str, text: str, min_share: float = 0.3, min_words: int = 8, max_repeat: int | None = None) -> DataFrame:
    """Profiles of the documents beyond a limit: ``min_share`` of the words repeated, or one repeat of over ``max_repeat`` words (None: no such limit)."""
    beyond = F.col("repeated_share") >= min_share
    if max_repeat is not None:
        beyond = beyond | (F.col("longest_repeat") > max_repeat)
    return repetition_profile(df, key, text, min_words).filter((F.col("n_words") > 0) & beyond)
