"""Abusive, hateful or sexual language: character n-grams scaled by naive Bayes ratios.

Text is reduced to a small alphabet in numpy: case, accents, look-alike digits,
symbols and letters of other scripts fold into letters, runs of one character
close up, dots and dashes inside words vanish; other letters keep a symbol of
their own.  Hashed n-grams of the reduced text are the features, each scaled by
its naive Bayes log-count ratio, and a linear classifier weighs them (NB-SVM
with logistic loss).  Labels belong to documents but abuse may be one sentence,
so training alternates between fitting and picking the sentences of abusive
documents that carry the label.  A document's score is that of its worst
sentence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.samples import fit_in_task

#: Most labelled documents without and with abuse in the training sample (those with the smallest hashes).
TRAIN_PER_CLASS = (1500, 1000)
#: Longer texts are left out of the training sample, so that its size is bounded; they are scored like all others.
TRAIN_CHARS = 50_000
GRAMS = (3, 4, 5)
BITS = 18
_MASK = (1 << BITS) - 1
_STRIDE = 2048  # characters after which an overlong sentence is cut at the next blank
_SHORTEST = min(GRAMS)

# Letters of other scripts, digits and symbols that look like a Latin letter, and that letter.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l",
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "Ј": "j", "К": "k", "М": "m", "О": "o", "Р": "p", "Ѕ": "s", "Т": "t", "У": "y", "Х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
    "ß": "s", "ø": "o", "Ø": "o", "đ": "d", "ł": "l", "ı": "i", "æ": "a", "œ": "o", "ſ": "s",
}
_OWN = 32  # first symbol of letters without a Latin look-alike


def _alphabet() -> np.ndarray:
    """Symbol of each code point below 0x600: 0 space, 1-26 letters, 27 star, 28 digit, 29 other, 30 apostrophe, from 32 letters of other scripts."""
    table = np.full(0x600, 29, dtype=np.uint8)
    for point in range(0x80, len(table)):
        if chr(point).isalpha():
            table[point] = _own_symbol(point)
    for c in range(26):
        table[ord("a") + c] = table[ord("A") + c] = c + 1
    for point in range(len(table)):
        if chr(point).isspace():
            table[point] = 0
    for c in "26789":
        table[ord(c)] = 28
    for seen, meant in LOOKALIKES.items():
        if ord(seen) < len(table):
            table[ord(seen)] = ord(meant) - 96
    table[ord("*")] = 27
    table[ord("'")] = 30
    return table


def _own_symbol(points):
    return _OWN + points % 220


def plain_form(text: str) -> str:
    """Compatibility form without accents, zero-width marks and typographic apostrophes."""
    if text.isascii():
        return text
    out = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))
    return out.replace("’", "'").replace("‘", "'")


_TABLE = _alphabet()


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced symbols of all texts in one array, sentence starts in it, and the text of each sentence."""
    if not texts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "\x01" + "\x01".join(plain_form(t).replace("\x01", " ") for t in texts)
    if joined.isascii():
        data = np.frombuffer(joined.encode("ascii"), dtype=np.uint8)
        sym = _TABLE[data]
    else:
        data = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        sym = _TABLE[np.minimum(data, len(_TABLE) - 1)]
        high = data >= len(_TABLE)
        sym[high] = _own_symbol(data[high]).astype(np.uint8)
    head = data == 1
    letter = (sym > 0) & (sym < 28) | (sym >= _OWN)
    # Sentences end at a stop followed by white space, and at line ends.
    blank = sym == 0
    stop = (data == ord(".")) | (data == ord("!")) | (data == ord("?"))
    ends = np.zeros(len(data), dtype=bool)
    ends[1:] = (blank[1:] & stop[:-1]) | (data[1:] == 10)
    # A stop before white space is punctuation, not a letter.
    tail = np.zeros(len(data), dtype=bool)
    tail[:-1] = stop[:-1] & (blank[1:] | head[1:])
    tail[-1:] = stop[-1:]
    sym[tail] = 29
    drop = np.zeros(len(data), dtype=bool)
    joins = (data == ord(".")) | (data == ord("-")) | (data == ord("_"))
    drop[1:-1] = joins[1:-1] & letter[:-2] & letter[2:]
    sym[head] = 0
    doc = np.cumsum(head) - 1
    keep = np.flatnonzero(~drop)
    s, e, d = sym[keep], ends[keep], doc[keep]
    # Close up runs of one symbol.
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | e[1:]
    s, e, d = s[first], e[first], d[first]
    cut = e.copy()
    cut[:1] = True
    cut[1:] |= d[1:] != d[:-1]
    starts = np.flatnonzero(cut)
    # Overlong sentences are cut at the blank that follows every so many symbols.
    size = np.diff(np.append(starts, len(s)))
    if (size > _STRIDE).any():
        offset = np.arange(len(s)) - np.repeat(starts, size)
        due = np.flatnonzero((offset % _STRIDE == 0) & (offset > 0))
        gaps = np.flatnonzero(s == 0)
        at = np.searchsorted(gaps, due)
        cut[gaps[at[at < len(gaps)]]] = True
        starts = np.flatnonzero(cut)
    return s, starts, d[starts]


def _rows(s: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, gram) of the kept sentences, each once, sentences in order."""
    sent = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
    parts = []
    for n_gram, g in zip(GRAMS, gram_ids(s)):
        whole = keep[sent]
        whole[_crossing(starts, len(s), n_gram)] = False
        parts.append(np.unique(sent[whole] * (1 << BITS) + g[whole]))
    keys = np.unique(np.concatenate(parts))
    return (keys >> BITS).astype(np.int32), (keys & _MASK).astype(np.int32)


def _crossing(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Positions whose n-gram would run over the end of their sentence."""
    ends = np.append(starts[1:], size)
    return np.concatenate([np.maximum(ends - k, starts) for k in range(1, n)])


def gram_ids(s: np.ndarray) -> Iterator[np.ndarray]:
    """Hash of the n-gram that begins at each position, for every n (shorter at the end of the array)."""
    h = np.zeros(len(s), dtype=np.uint32)
    code = s.astype(np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h[: len(s) - n + 1] = h[: len(s) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            yield ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


class AbuseModel:
    """Weights of hashed n-grams, bias and threshold."""

    def __init__(self, weight: np.ndarray | None = None, bias: float = -5.0):
        self.weight = np.zeros(1 << BITS, dtype=np.float32) if weight is None else weight
        self.bias = bias

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], rounds: int = 3, alpha: float = 0.3) -> AbuseModel:
        """Model of labelled texts; with labels of one class only, one that finds nothing."""
        y_doc = np.array(labels, dtype=float)
        if not texts or y_doc.min() == y_doc.max():
            return cls()
        s, starts, owner = symbols(texts)
        bounds = np.append(starts, len(s))
        size = np.diff(bounds)
        from_abusive = y_doc[owner] > 0
        keep = size >= _SHORTEST
        # Equal sentences of documents without abuse count as one of that weight.
        times = np.ones(len(starts))
        met: dict[bytes, int] = {}
        for k in np.flatnonzero(keep & ~from_abusive).tolist():
            first = met.setdefault(s[bounds[k] : bounds[k + 1]].tobytes(), k)
            if first != k:
                times[first] += 1
                keep[k] = False
        del met
        row, col = _rows(s, starts, keep)
        n = len(starts)
        counts = np.bincount(row, minlength=n)
        clean = keep & ~from_abusive
        suspect = from_abusive & keep
        # At first all sentences of abusive documents carry the label, but for those
        # that hold next to nothing that the others do not.
        target = suspect.astype(float)
        in_clean = np.bincount(col[clean[row]], minlength=1 << BITS)
        novel = np.bincount(row, (in_clean[col] == 0).astype(float), n) / np.maximum(counts, 1)
        target[suspect & (novel < 0.08)] = 0
        for step in range(rounds):
            pos, neg = target > 0, clean
            p = np.bincount(col[pos[row]], minlength=1 << BITS) + alpha
            q = np.bincount(col[neg[row]], times[row[neg[row]]], minlength=1 << BITS) + alpha
            ratio = np.log(p / p.sum()) - np.log(q / q.sum())
            # Grams seen in neither class say nothing.
            ratio[(p == alpha) & (q == alpha)] = 0
            w, b = cls._separate(row, col, ratio, target, pos | neg, counts, times)
            value = np.bincount(row, (ratio * w)[col], n) / np.sqrt(np.maximum(counts, 1)) + b
            fresh = np.zeros(n)
            fresh[suspect & (value > 0)] = 1
            # An abusive document has at least its worst sentence.
            order = np.lexsort((value, owner))
            order = order[suspect[order]]
            worst = order[np.flatnonzero(np.append(np.diff(owner[order]) != 0, True))] if len(order) else order
            # Only where something in it is not usual in clean documents, so labels in error do not spread.
            fresh[worst[(novel[worst] >= 0.02) | (value[worst] > 0)]] = 1
            if step and (fresh == target).all():
                break
            target = fresh
        return cls((ratio * w).astype(np.float32), float(b))

    @staticmethod
    def _separate(
        row: np.ndarray, col: np.ndarray, ratio: np.ndarray, target: np.ndarray, used: np.ndarray, counts: np.ndarray, times: np.ndarray
    ) -> tuple[np.ndarray, float]:
        """Logistic regression on the scaled features by full-batch Adagrad, classes balanced by root."""
        take = used[row]
        index = np.full(len(used), -1, dtype=np.int32)
        index[np.flatnonzero(used)] = np.arange(used.sum())
        r, c = index[row[take]], col[take]
        y = (target[used] > 0).astype(float)
        scale = 1 / np.sqrt(np.maximum(counts[used], 1))
        value = (ratio[c] * scale[r]).astype(np.float32)
        mass = times[used]
        cw = np.where(y > 0, np.sqrt(mass.sum() / max(mass[y > 0].sum(), 1)), 1.0) * mass
        w, b = np.full(1 << BITS, 0.3), -1.0
        acc_w, acc_b = np.full(1 << BITS, 1e-6), 1e-6
        heads = np.flatnonzero(np.diff(r, prepend=-1))
        filled = r[heads]
        z = np.zeros(len(y))
        for _ in range(20):
            part = w.astype(np.float32)[c]
            part *= value
            z[filled] = np.add.reduceat(part, heads)
            err = cw * (1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - y)
            np.multiply(value, err.astype(np.float32)[r], out=part)
            g = np.bincount(c, part, 1 << BITS) + 1e-3 * w
            acc_w += g * g
            w -= 0.3 * g / np.sqrt(acc_w)
            gb = err.sum()
            acc_b += gb * gb
            b -= 0.3 * gb / np.sqrt(acc_b)
        return w, b

    def score(self, texts: list[str]) -> np.ndarray:
        """Log odds of the worst sentence of each text; -20 for texts without one."""
        out = np.full(len(texts), -20.0)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 2_000_000):
                size += len(texts[end])
                end += 1
            s, starts, owner = symbols(texts[at:end])
            if len(s):
                total = np.zeros(len(s), dtype=np.float32)
                for n_gram, g in zip(GRAMS, gram_ids(s)):
                    part = self.weight[g]
                    part[_crossing(starts, len(s), n_gram)] = 0
                    total += part
                length = np.diff(np.append(starts, len(s)))
                value = np.add.reduceat(total.astype(np.float64), starts) / np.sqrt(np.maximum(length * len(GRAMS), 1)) + self.bias
                value[length < _SHORTEST] = -20
                np.maximum.at(out, at + owner, value)
            at = end
        return out


def train_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "abusive", per_class: tuple[int, int] = TRAIN_PER_CLASS) -> AbuseModel:
    """Fit on at most ``per_class`` labelled documents (without, with abuse), those with the smallest hashes.

    A document with contradicting labels counts as abusive; null labels and texts
    are left out, and so are texts of over ``TRAIN_CHARS`` characters.  One task
    reads the sample and fits; only the weights reach the driver.  With labels
    of one class only, nothing is found.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class[y])
        picked = part if picked is None else picked.unionByName(part)
    # At most per_class keys are broadcast.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") <= TRAIN_CHARS).join(F.broadcast(picked), "k")
    return fit_in_task(rows.select("k", "t", "y"), lambda sample: AbuseModel.fit(sample["t"].tolist(), sample["y"].astype(int).tolist()))


def abuse_scores(docs: DataFrame, model: AbuseModel, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row (key, kept columns, score, abusive) per input row.

    ``score`` is the probability that the worst sentence is abusive; ``abusive``
    is a score of one half or more.  Null, empty and very short texts score 0.
    """
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)) + ", score double, abusive boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            odds = m.score([t or "" for t in pdf["_text"]])
            score = np.where(odds <= -20, 0.0, 1 / (1 + np.exp(-odds)))
            yield pd.DataFrame({**{c: pdf[c] for c in (key, *keep)}, "score": score, "abusive": score >= 0.5})

    return docs.select(key, *keep, F.col(text).alias("_text")).mapInPandas(run, schema)


def abuse_rates(scores: DataFrame, source: str = "source") -> DataFrame:
    """Per source: documents, abusive documents, their rate and the mean score."""
    return scores.groupBy(source).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("abusive").alias("abusive_documents"),
        F.avg(F.col("abusive").cast("double")).alias("abusive_rate"),
        F.avg("score").alias("mean_score"),
    )
