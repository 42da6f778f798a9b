"""Noise in text from scanned pages: furniture, cut words and misread characters.

Lines are labelled by a hidden Markov model (body, running header, page number,
break) whose parameters are re-estimated from its own Viterbi labels on a
bounded sample.  Words are judged against the counts of all words of the corpus:
a word is misread if undoing a usual confusion gives a word that is clearly more
frequent, and a hyphen at a line end is a cut if the closed word is more
frequent than the hyphenated one.  Both tests run on distinct words by joins
with the count table.  A list of the most frequent words, of fixed size, is
broadcast to leave them out of the search; it changes the work, not the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.samples import fit_in_task, hashed_sample
from dealweave.session import cut_lineage

#: Most texts in the sample on which the line model is fitted.
TRAIN_TEXTS = 1500
#: Longer texts are left out of that sample, so that its size is bounded; they are searched like all others.
TRAIN_CHARS = 200_000
#: Words in the broadcast list of frequent words, which spares looking them up.
FREQUENT_WORDS = 10_000
#: Occurrences from which a word that nothing speaks against is never judged by its text alone.
ESTABLISHED = 5
#: Words above this length are compared by skeleton instead of by all ways to undo confusions.
LONG_WORD = 40

# What is read -> what stood on the page.
CONFUSIONS = (
    ("c", "e"), ("!", "i"), ("+", "t"), ("0", "o"), ("5", "s"), ("@", "a"), ("1", "l"), ("9", "g"), ("8", "b"), ("|", "i"),
    ("cl", "d"), ("ii", "u"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("\ufb01", "fi"), ("\ufb02", "fl"),
)
_SYMBOLS, _LETTERS = "!+05@198|", "itosalgbi"
_SYMBOL_MAP = str.maketrans(_SYMBOLS, _LETTERS)

_TOKEN = re.compile(r"[\w!+@|]+(?:['’][\w!+@|]+)*(?:-[\w!+@|]+)*")
# The look-behinds keep a long run from being tried again at each of its characters.
_CUT = re.compile(r"(?<![\w!+@|])([\w!+@|]+)-[ \t]*$")
_CUT_PAIR = re.compile(r"(?<![\w!+@|-])[\w!+@|-]+-[ \t]*\n\s*[\w!+@|-]+")
_FIRST = re.compile(r"^\s*([\w!+@|]+)")
_PAGE = re.compile(
    r"^\s*(?:[\[(]\s*\d{1,4}\s*[\])]|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}|[A-Z]-\d{1,4}|[ivxlc!1]{1,7}|p[a@][g9][ec]\s+\d{1,4}(?:\s*(?:[o0]f|/)\s*\d{1,4})?)\s*$",
    re.IGNORECASE,
)
_MARKER = re.compile(r"\s*(?:confidential\b|(?:exhibit|annex|schedule|appendix)\s+[\w.-]+\s*$)")
_MARKED = ("(continu", "execution copy")
#: Letters, then a symbol that stands for a letter, inside or at an edge of a word.
_INSIDE = re.compile(r"[^\W\d_][!+0@1589|][^\W\d_]|^[!+@|][^\W\d_]{2}|[^\W\d_]{2}[+@]$")

BODY, HEADER, PAGE, BREAK = range(4)
LABELS = ("body", "header", "page", "break")


def undo(word: str, most: int = 2) -> list[str]:
    """The words that may have been read as this lower-case word, up to ``most`` letter confusions undone.

    Symbols and digits that stand for letters are always undone, all at once.
    Words below 7 letters have one letter confusion at most.
    """
    plain = word.translate(_SYMBOL_MAP) if any(c in _SYMBOLS for c in word) else word
    out = [] if plain == word else [plain]
    sites = [(m.start(), seen, meant) for seen, meant in CONFUSIONS if seen.isalpha() for m in re.finditer(f"(?={seen})", plain)]
    for k in range(1, most + 1):
        if k > 1 and len(word) < 7:
            break
        for chosen in combinations(sorted(sites), k):
            text, shift, last = plain, 0, -1
            for at, seen, meant in chosen:
                if at < last:
                    break
                text = text[: at + shift] + meant + text[at + shift + len(seen) :]
                shift += len(meant) - len(seen)
                last = at + len(seen)
            else:
                out.append(text)
    return out


def clean_token(token: str) -> str:
    """Lower-case token; exclamation marks at its end are punctuation."""
    return token.lower().rstrip("!").strip("_")


def skeleton(line: str) -> str:
    """A line with confusable characters made equal, so that misread copies of it agree."""
    s = line.strip().lower().translate(_SYMBOL_MAP)
    for seen, meant in (("\ufb01", "fi"), ("\ufb02", "fl"), ("li", "h"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("vv", "w")):
        s = s.replace(seen, meant)
    return " ".join(s.replace("c", "e").split())


# ---------------------------------------------------------------- line model

_SIZES = (3, 2, 2, 3, 2, 2, 2, 2, 2)
#: Characters that a line of a printed page seldom exceeds.
_PAGE_WIDTH = 120


def line_features(lines: list[str]) -> np.ndarray:
    """Categorical layout features of each line."""
    n = len(lines)
    out = np.zeros((n, len(_SIZES)), dtype=np.int8)
    solid = [k for k, x in enumerate(lines) if x and not x.isspace()]
    if len(solid) < n:
        out[:, 0] = 2
        out[solid, 0] = 0
    pages = [k for k in solid if _PAGE.match(lines[k])]
    lengths = [len(x) for x in lines]
    width = max(lengths, default=0)
    order = {k: i for i, k in enumerate(solid)}
    for k in pages:
        out[k, 0] = 1
        for step in (-1, 1):
            i = order[k] + step
            if 0 <= i < len(solid):
                out[solid[i], 2] = 1
    # A text that holds more than a few lines wider than a page was not laid out in pages.
    if solid and sorted(lengths[k] for k in solid)[9 * len(solid) // 10] > _PAGE_WIDTH:
        out[:, 8] = 1
    bones = {k: skeleton(lines[k]) for k in solid}
    seen = Counter(bones.values())
    for k in solid:
        x = lines[k]
        if seen[bones[k]] > 1:
            out[k, 1] = 1
        low = x.lower()
        if _MARKED[0] in low or _MARKED[1] in low or _MARKER.match(low):
            out[k, 3] = 1
        elif x.isupper() and lengths[k] > 8:
            out[k, 3] = 2
        out[k, 4] = x.lstrip()[:1].islower()
        out[k, 5] = lengths[k] < 0.75 * width
        out[k, 7] = x.rstrip()[-1] in ".;:"
    if solid:
        out[solid[0], 6] = 1
    return out


class LineModel:
    """Hidden Markov model over line features, fitted by Viterbi training."""

    def __init__(self):
        # Pseudo-counts that say what the states mean; estimates are added to them.
        self.prior_emit = [
            np.array([[98, 1, 0.01], [98, 1, 0.01], [1, 98, 0.01], [0.01, 0.01, 98]]),  # shape
            np.array([[99, 1], [4, 96], [50, 50], [50, 50]]),  # repeated in the text
            np.array([[96, 4], [4, 96], [50, 50], [50, 50]]),  # next to a page number
            np.array([[97.5, 1, 1.5], [34, 33, 33], [98, 1, 1], [98, 1, 1]]),  # marker, capitals
            np.array([[50, 50], [95, 5], [50, 50], [99, 1]]),  # starts in lower case
            np.array([[80, 20], [40, 60], [1, 99], [1, 99]]),  # short
            np.array([[98, 2], [75, 25], [90, 10], [90, 10]]),  # first line
            np.array([[75, 25], [95, 5], [99, 1], [99, 1]]),  # ends a sentence
            np.array([[60, 40], [99.9, 0.1], [90, 10], [60, 40]]),  # in a text wider than pages
        ]
        self.prior_move = np.array([[80, 6, 4, 10], [50, 1, 30, 19], [50, 25, 1, 24], [60, 15, 15, 10]], dtype=float)
        self.prior_start = np.array([60, 25, 5, 10], dtype=float)
        self._set([np.zeros_like(p) for p in self.prior_emit], np.zeros((4, 4)), np.zeros(4))

    def _set(self, emit: list[np.ndarray], move: np.ndarray, start: np.ndarray) -> None:
        # Counted lines weigh at most as much as ten times the prior, so states keep their meaning.
        def mix(prior: np.ndarray, seen: np.ndarray) -> np.ndarray:
            total = seen.sum(-1, keepdims=True)
            scaled = seen * np.minimum(1.0, 10 * prior.sum(-1, keepdims=True) / np.maximum(total, 1))
            p = prior + scaled
            return np.log(p / p.sum(-1, keepdims=True))

        self.emit = [mix(p, s) for p, s in zip(self.prior_emit, emit)]
        self.move, self.start = mix(self.prior_move, move), mix(self.prior_start, start)

    def fit(self, texts: list[list[str]], rounds: int = 4) -> LineModel:
        feats = [line_features(t) for t in texts]
        for _ in range(rounds):
            emit = [np.zeros_like(p) for p in self.prior_emit]
            move, start = np.zeros((4, 4)), np.zeros(4)
            for f, path in zip(feats, self.decode(feats)):
                for j, e in enumerate(emit):
                    np.add.at(e, (path, f[:, j]), 1)
                np.add.at(move, (path[:-1], path[1:]), 1)
                start[path[0]] += 1
            self._set(emit, move, start)
        return self

    def decode(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """Most probable labels of each text; texts of like length are decoded side by side."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(feats)
        order = sorted((k for k in range(len(feats)) if len(feats[k])), key=lambda k: len(feats[k]))
        at = 0
        while at < len(order):
            longest = len(feats[order[at]])
            group = []
            while at < len(order) and (len(group) < 512 and len(feats[order[at]]) <= 2 * longest + 8):
                group.append(order[at])
                at += 1
            size = max(len(feats[k]) for k in group)
            score = np.zeros((len(group), size, 4))
            for i, k in enumerate(group):
                f = feats[k]
                score[i, : len(f)] = sum(e[:, f[:, j]].T for j, e in enumerate(self.emit))
            lens = np.array([len(feats[k]) for k in group])
            best = self.start + score[:, 0]
            back = np.zeros((len(group), size, 4), dtype=np.int8)
            final = best.copy()
            for t in range(1, size):
                step = best[:, :, None] + self.move[None]
                back[:, t] = step.argmax(1)
                best = step.max(1) + score[:, t]
                ends = lens == t + 1
                final[ends] = best[ends]
            for i, k in enumerate(group):
                path = np.zeros(lens[i], dtype=np.int64)
                state = int(final[i].argmax())
                for t in range(lens[i] - 1, -1, -1):
                    path[t] = state
                    state = int(back[i, t, state])
                out[k] = path
        return out


# ---------------------------------------------------------------- corpus words


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): occurrences of every word and compound of all texts, words cut at line ends aside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for t in pdf["_text"]:
                tokens = _TOKEN.findall(_CUT_PAIR.sub(" ", t).lower())
                counts.update(tokens)
            if len(counts) > 300_000:
                yield _drain(counts)
        yield _drain(counts)

    return (
        texts.select(F.col(text).alias("_text"))
        .filter("_text is not null")
        .mapInPandas(run, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _drain(counts: Counter) -> pd.DataFrame:
    """Counts by clean word, the parts of compounds included; empties the counter."""
    out: Counter = Counter()
    for token, n in counts.items():
        word = clean_token(token)
        if word:
            out[word] += n
            if "-" in word:
                for part in word.split("-"):
                    out[part] += n
    counts.clear()
    return pd.DataFrame({"word": list(out.keys()), "n": list(out.values())})


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for word, n in zip(pdf["word"], pdf["n"]):
            if any(c.isalpha() for c in word):
                rows += [(word, n, c) for c in dict.fromkeys(undo(word)) if c != word]
        yield pd.DataFrame(rows, columns=["word", "n", "meant"])


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(bones=[skeleton(w) for w in pdf["word"]])


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, meant): words that undo to a word at least three times as frequent.

    A word with a symbol or digit among its letters is misread whatever its
    reading; without a known reading, the symbols alone are undone.  Words of
    over ``LONG_WORD`` characters meet those that are equal once everything
    confusable is made equal.
    """
    worded = counts.filter((F.length("word") >= 3) & ~F.col("word").rlike("(?U)^\\d+$"))
    short = worded.filter(F.length("word") <= LONG_WORD).mapInPandas(_suspects, "word string, n bigint, meant string")
    bones = worded.filter(F.length("word") > LONG_WORD).select("word", "n").mapInPandas(_skeletons, "word string, n bigint, bones string")
    bones = bones.withColumn("bones", F.sha2("bones", 256))
    long = bones.join(bones.select("bones", F.col("word").alias("meant")), "bones").filter("word <> meant").select("word", "n", "meant")
    odd_long = bones.select("word", "n", F.translate("word", _SYMBOLS, _LETTERS).alias("meant")).filter("word <> meant")
    pairs = short.unionByName(long).unionByName(odd_long).distinct()
    known = counts.select(F.col("word").alias("meant"), F.col("n").alias("m"))
    shape = r"[^\W\d_][!+0@1589|][^\W\d_]|^[!+@|][^\W\d_]{2}|[^\W\d_]{2}[+@]$"
    odd = F.col("word").rlike("(?U)" + shape)
    judged = pairs.join(known.hint("merge"), "meant", "left").withColumn("odd", odd)
    good = (F.col("m") >= 2) & (F.col("m") >= 3 * F.col("n"))
    edge = F.col("word").rlike(r"^[058][a-z]{3}|[a-z]{3}[01589]$") & (F.col("m") >= 3)
    plain = F.translate("word", _SYMBOLS, _LETTERS)
    kept = judged.filter(good | edge | F.col("odd"))
    return kept.groupBy("word").agg(
        F.coalesce(F.max_by("meant", F.when(good | edge, F.struct("m", "meant"))), F.min(plain)).alias("meant")
    )


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for a, b in zip(pdf["a"], pdf["b"]):
            for own, whole in ((False, a + b), (True, f"{a}-{b}")):
                # A word too long to be undone is read as it stands.
                read = dict.fromkeys([whole, *(undo(whole, 1) if len(whole) <= LONG_WORD else ())])
                rows += [(a, b, own, k > 0, w) for k, w in enumerate(read)]
        yield pd.DataFrame(rows, columns=["a", "b", "own", "undone", "word"])


def cut_words(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, joined, cut, misread) for each pair of word halves at a line end.

    ``cut``: the hyphen is not the word's own, because the closed word is more
    frequent than the compound; where both are unknown, it is a cut unless both
    halves are words of their own.  Halves may hold misread characters: then the
    readings of the whole word are compared, and ``misread`` tells so.
    """
    base = pairs.select("a", "b").distinct()
    read = base.mapInPandas(_readings, "a string, b string, own boolean, undone boolean, word string").join(counts.hint("merge"), "word")
    # The word as read counts before any other reading unless that is three times as frequent.
    weight = F.when(F.col("undone"), F.when(F.col("n") >= 3, F.col("n"))).otherwise(3 * F.col("n"))
    best = read.withColumn("w", weight).groupBy("a", "b").agg(F.max_by(F.struct("own", "undone", "word"), F.struct("w", "word")).alias("best"))
    out = base.join(best.hint("merge"), ["a", "b"], "left")
    for side in ("a", "b"):
        out = out.join(counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")).hint("merge"), side, "left").fillna(0, [f"n_{side}"])
    words = (F.col("n_a") >= 20) & (F.col("n_b") >= 20)
    return out.select(
        "a",
        "b",
        F.coalesce(F.col("best.word"), F.concat("a", "b")).alias("joined"),
        F.coalesce(~F.col("best.own"), ~words).alias("cut"),
        F.coalesce(F.col("best.undone"), F.lit(False)).alias("misread"),
    )


# ---------------------------------------------------------------- findings


def _sample_model(texts: DataFrame, key: str, text: str, limit: int) -> LineModel:
    rows = hashed_sample(texts.filter(F.length(text) <= TRAIN_CHARS), [key], limit).select(F.col(text).alias("t"))

    def fit(sample: pd.DataFrame) -> LineModel:
        docs = [t.split("\n") for t in sample["t"]]
        return LineModel().fit(docs) if docs else LineModel()

    return fit_in_task(rows, fit)


def scan_findings(texts: DataFrame, key: str, text: str, train_texts: int = TRAIN_TEXTS, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """One row (key, line_no, kind, token, fix) per disturbed line and cause.

    ``kind`` is header, page, cut (``token`` is the first half, ``fix`` the whole
    word) or misread (``token`` as read, ``fix`` as meant).  Lines count from 0
    after splitting at ``\\n``.  Null and empty texts have no rows; texts without
    noise neither.  Every text is searched, whatever its stated quality.
    """
    counts = cut_lineage(word_counts(texts, text))
    bad = cut_lineage(misread_words(counts))
    settled = counts.filter(F.col("n") >= ESTABLISHED).join(bad.hint("merge"), "word", "left_anti")
    frequent = settled.orderBy(F.desc("n"), "word").limit(frequent_words).select("word").toPandas()["word"]
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((_sample_model(texts, key, text, train_texts), frozenset(frequent)))
    key_type = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, line_no bigint, kind string, a string, b string, next_line bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, common = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                docs = [t.split("\n") for t in part["_text"]]
                rows: list[tuple] = []
                for k, lines, path in zip(part["_key"], docs, model.decode([line_features(d) for d in docs])):
                    rows += [(k, *r) for r in _text_findings(lines, path, common)]
                yield pd.DataFrame(rows, columns=[key, "line_no", "kind", "a", "b", "next_line"])

    raw = cut_lineage(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null").mapInPandas(run, schema))
    sure = raw.filter("kind in ('header', 'page', 'misread')").select(key, "line_no", "kind", F.col("a").alias("token"), F.col("b").alias("fix"))
    words = raw.filter("kind = 'word'").select(key, "line_no", F.col("a").alias("word"))
    misread = words.join(bad.hint("merge"), "word").select(key, "line_no", F.lit("misread").alias("kind"), F.col("word").alias("token"), F.col("meant").alias("fix"))
    # A reading that its own text prefers counts for words that are not established in the corpus.
    local = raw.filter("kind = 'local'").select(key, "line_no", F.col("a").alias("word"), F.col("b").alias("meant"))
    local = local.join(counts.filter(F.col("n") >= ESTABLISHED).select("word").hint("merge"), "word", "left_anti")
    misread = misread.unionByName(local.select(key, "line_no", F.lit("misread").alias("kind"), F.col("word").alias("token"), F.col("meant").alias("fix")))
    halves = raw.filter("kind = 'half'").select(key, "line_no", "a", "b", "next_line")
    judged = halves.join(cut_words(halves, counts).hint("merge"), ["a", "b"])
    cut = judged.filter("cut").select(key, "line_no", F.lit("cut").alias("kind"), F.col("a").alias("token"), F.col("joined").alias("fix"))
    # A misread half: the second if the word meant begins with the first as read.
    second = F.startswith(F.regexp_replace("joined", "-", ""), F.col("a"))
    half = judged.filter("misread").select(
        key,
        F.when(second, F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"),
        F.lit("misread").alias("kind"),
        F.when(second, F.col("b")).otherwise(F.col("a")).alias("token"),
        F.when(second, F.expr("substring(regexp_replace(joined, '-', ''), length(a) + 1)")).alias("fix"),
    )
    return sure.unionByName(misread).unionByName(cut).unionByName(half).distinct()


def _text_findings(lines: list[str], path: np.ndarray, common: frozenset[str]) -> list[tuple[int, str, str | None, str | None, int | None]]:
    """Findings of one text: (line, kind, a, b); kinds word, local and half are settled by the corpus.

    Words in ``common`` are established and have no better reading, so nothing
    is said of them.
    """
    out: list[tuple[int, str, str | None, str | None, int | None]] = []
    rare: list[tuple[int, str]] = []
    here: Counter = Counter()
    body = [k for k in range(len(lines)) if path[k] == BODY]
    follow = {k: n for k, n in zip(body, body[1:])}
    halves: set[tuple[int, str]] = set()
    for k, line in enumerate(lines):
        if path[k] == BREAK:
            continue
        if path[k] in (HEADER, PAGE):
            out.append((k, LABELS[path[k]], None, None, None))
        elif line.rstrip(" \t").endswith("-") and (m := _CUT.search(line)) and k in follow and (b := _FIRST.match(lines[follow[k]])) and b.group(1)[:1].islower() | (b.group(1)[:1] in "!|+@058"):
            first, second = m.group(1).lower(), b.group(1).lower()
            out.append((k, "half", first, second, follow[k]))
            halves |= {(k, first), (follow[k], second)}
        tokens = _TOKEN.findall(line.lower())
        here.update(tokens)
        for token in tokens:
            if token in common:
                continue
            word = clean_token(token)
            if len(word) >= 3 and word not in common and not word.isdigit():
                parts = word.split("-") if "-" in word else [word]
                rare += [(k, w) for w in parts if len(w) >= 3 and w not in common]
                if len(parts) > 1:
                    rare.append((k, word))
    if not rare:
        return out
    # Occurrences in this text by clean word, parts of compounds included.
    count = here
    for token in [t for t in here if not t.isalnum()]:
        n = count.pop(token)
        for w in clean_token(token).split("-"):
            count[w] += n
    bones: dict[str, list[str]] = {}
    for w in count:
        if len(w) > LONG_WORD:
            bones.setdefault(skeleton(w), []).append(w)
    better: dict[str, str | None] = {}
    for k, w in rare:
        if (k, w) in halves:
            if _INSIDE.search(w):
                out.append((k, "misread", w, w.translate(_SYMBOL_MAP), None))
            continue
        out.append((k, "word", w, None, None))
        # A name that only this text has: misread if another reading is more frequent here.
        if w not in better:
            read = sorted(bones.get(skeleton(w), ())) if len(w) > LONG_WORD else undo(w, 1) if any(c.isalpha() for c in w) else ()
            better[w] = next((meant for meant in read if count.get(meant, 0) > count[w]), None)
        if better[w] is not None:
            out.append((k, "local", w, better[w], None))
    return out


def repaired_texts(texts: DataFrame, key: str, text: str, **options: int) -> DataFrame:
    """One row (key, paragraphs, removed_lines, joined_words, corrected_words, repaired) per non-null text.

    ``repaired`` holds one paragraph per line of output: furniture removed, cut
    words joined, misread words corrected, lines of a paragraph joined by
    spaces.  Keys must be unique.
    """
    found = scan_findings(texts, key, text, **options)
    noted = found.groupBy(key).agg(F.collect_list(F.struct("line_no", "kind", "token", "fix")).alias("_notes"))
    source = texts.select(key, F.col(text).alias("_text")).filter("_text is not null").join(noted, key, "left")
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, paragraphs bigint, removed_lines bigint, joined_words bigint, corrected_words bigint, repaired string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, notes in zip(pdf[key], pdf["_text"], pdf["_notes"]):
                rows.append((k, *repair_text(t, list(notes) if notes is not None else [])))
            yield pd.DataFrame(rows, columns=[key, "paragraphs", "removed_lines", "joined_words", "corrected_words", "repaired"])

    return source.mapInPandas(run, schema)


def repair_text(text: str, notes: list) -> tuple[int, int, int, int, str]:
    """Apply findings to a text: (paragraphs, removed, joined, corrected, repaired text)."""
    by_line: dict[int, list] = {}
    for note in notes:
        by_line.setdefault(int(note["line_no"]), []).append(note)
    paragraphs: list[str] = []
    current, removed, joined, corrected, broke, glue = "", 0, 0, 0, False, False
    for k, line in enumerate(text.split("\n")):
        kinds = by_line.get(k, [])
        if any(n["kind"] in ("header", "page") for n in kinds):
            removed += 1
            continue
        if not line.strip():
            # A blank line ends a paragraph only after the end of a sentence.
            broke = True
            continue
        for n in kinds:
            if n["kind"] == "misread" and n["token"] and n["fix"]:
                line, hits = re.subn(rf"(?<![\w!+@|]){re.escape(n['token'])}(?![\w+@|])", lambda m, fix=n["fix"]: fix.capitalize() if m.group(0)[:1].isupper() else fix, line, flags=re.IGNORECASE)
                corrected += hits
        line = line.strip()
        if broke and current and not glue and (current[-1] in ".!?:;\"”" or line[:1].isupper()):
            paragraphs.append(current)
            current = ""
        broke = False
        current = current + line if glue or not current else f"{current} {line}"
        glue = False
        if line.endswith("-"):
            glue = True
            if any(n["kind"] == "cut" for n in kinds):
                current = current[:-1]
                joined += 1
    if current:
        paragraphs.append(current)
    return len(paragraphs), removed, joined, corrected, "\n".join(paragraphs)
