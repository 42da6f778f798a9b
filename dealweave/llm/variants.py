"""Variant spellings of one name, from a symmetric-delete index and token alignment.

Distinct names become word lists.  Every distinct word of a field is entered
under all strings that arise from it by a deletion; words that meet under one
entry are near, so near words are found by an equi-join instead of comparisons
of all pairs.  Two deletions are used where the remaining words of the two names
begin with the same letters: unrelated words within two edits of each other
multiply with the square of the names, those beside like words hardly.  A name
is anchored at its rarest word, rarity being counted over the word and everything
near it, so a mistyped common word is not mistaken for a rare one.  Names whose
anchors are equal or near are candidates;
an optimal assignment of their words, which lets initials, nicknames,
abbreviations and closed-up initials stand for words, decides.  Each form joins
the closest of the better supported ones, and what is joined is one entity; a
name that is only initials or a first word joins the entity that goes by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.lexicon import ABBREVIATIONS, LEGAL_FORMS, NICKNAMES, fold, name_tokens, osa_within, strip_legal
from dealweave.operators.graph import connected_components
from dealweave.session import cut_lineage, release, wide_parallelism

#: Forms under one anchor that meet in one task; more are split by salt.
ANCHOR_BLOCK = 512


@lru_cache(maxsize=200_000)
def words_of_name(name: str) -> tuple[str, ...]:
    """Words that count: without legal form and ``&``, abbreviations written out."""
    core = strip_legal(name_tokens(name))
    return tuple(ABBREVIATIONS.get(w, w) for w in core if w != "&")


def anchor_words(name: str) -> tuple[list[str], list[str]]:
    """Words that may anchor a name, and those typed in capitals inside a name that is not.

    Such words are often closed-up initials (``LFG``), rare but not telling, so
    they never stand in for the rarest of the others; single letters anchor only
    names made of nothing else.
    """
    words = words_of_name(name)
    text = fold(name)
    letters = [c for c in text if c.isalpha()]
    shouted = bool(letters) and sum(c.isupper() for c in letters) > 0.8 * len(letters) and len(words) > 1
    capitals = set() if shouted else {w.lower() for w in re.findall(r"\b[A-Z]{2,}\b", text)}
    long = [w for w in words if len(w) > 1]
    plain = [w for w in long if w not in capitals]
    return sorted(set(plain or long or words)), (sorted(set(long) - set(plain)) if plain else [])


def brief_keys(name: str) -> list[str]:
    """Short forms a full name may go by: initials (with or without legal form) and its first word."""
    words = name_tokens(name)
    core = [w for w in strip_legal(words) if w != "&"]
    kept = [w for w in words if w != "&" and (w not in LEGAL_FORMS or w in ("company", "co"))]
    if len(core) < 2:
        return []
    keys = {"".join(w[0] for w in x) for x in (core, kept)}
    form = "".join(w for w in words if w in LEGAL_FORMS and w not in ("company", "co"))
    return sorted({f"i:{k}" for k in keys if len(k) > 1} | {f"l:{k}|{form}" for k in keys if form} | {f"w:{core[0]}"})


def brief_probe(name: str) -> list[str]:
    """Keys under which a one-word name looks for its entity."""
    words = words_of_name(name)
    if not words:
        return []
    word = "".join(w for w in strip_legal(name_tokens(name)) if w != "&")
    typed = fold(name).strip()
    keys = []
    if typed[: len(word)].isupper():
        form = "".join(w for w in name_tokens(name) if w in LEGAL_FORMS and w not in ("company", "co"))
        keys = [f"i:{word}"] + ([f"l:{word}|{form}"] if form else [])
    # Up to five capitals are read as initials only, more may be a shouted first word as well.
    return keys if keys and len(word) <= 5 else [*keys, f"w:{word}"]


def _once(word: str, v: str) -> str:
    """SQL: the strings left after one deletion from a word of two or more characters."""
    return f"transform(sequence(1, length({word})), {v} -> concat(substring({word}, 1, {v} - 1), substring({word}, {v} + 1)))"


def entries_sql(word: str, depth: int) -> str:
    """SQL: the word and what is left after up to ``depth`` deletions (one below 7 characters, none below 4).

    Of two long words within two edits, the first or the last 16 characters are
    within one edit, so those two ends stand for a word of over 32 characters;
    words just below that bound answer to their ends as well.
    """
    one = f"concat(array({word}), {_once(word, 'i')})"
    both = f"concat({one}, flatten(transform({_once(word, 'i')}, x -> {_once('x', 'j')})))"
    ends = []
    for mark, end in (("<", f"substring({word}, 1, 16)"), (">", f"substring({word}, -16, 16)")):
        ends.append(f"transform(concat(array({end}), {_once(end, 'k')}), y -> concat('{mark}', y))")
    ends = f"concat({', '.join(ends)})"
    near = f"case when length({word}) < 4 then array({word}) when length({word}) < 7 then {one} else {both if depth > 1 else one} end"
    return f"array_distinct(case when length({word}) > 32 then {ends} when length({word}) > 30 then concat({near}, {ends}) else {near} end)"


def near_words(words: DataFrame, by: list[str], depth: int) -> DataFrame:
    """(by, word, other): distinct words (two or more characters) within the edits allowed, inside equal ``by``.

    Found through a symmetric-delete index of ``depth`` deletions: two words
    that need more on either side to meet are not found.
    """
    known = words.filter(F.length("word") > 1)
    index = known.select(F.explode(F.expr(entries_sql("word", depth))).alias("entry"), *by, "word").select(F.xxhash64(*by, "entry").alias("entry"), *by, "word")
    # Joined to itself under two names, so that both sides are one exchange; a join that sorts keeps it off the driver.
    same = " and ".join(f"a.{c} = b.{c}" for c in ("entry", *by))
    met = index.alias("a").hint("merge").join(index.alias("b"), F.expr(f"{same} and a.word < b.word"))
    met = met.select(*[f"a.{c}" for c in (*by, "word")], F.col("b.word").alias("other"))
    schema = ", ".join(f"{c} string" for c in (*by, "word", "other"))
    one = met.select(*by, "word", "other").distinct().mapInPandas(_near, schema)
    ways = F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))
    return one.select(*by, F.inline(ways))


def edits_allowed(a: str, b: str) -> int:
    n = max(len(a), len(b))
    return 2 if n >= 7 else 1 if n >= 4 else 0


def _given(word: str) -> str:
    return NICKNAMES.get(word, word)


@lru_cache(maxsize=500_000)
def word_cost(a: str, b: str) -> float | None:
    """Cost of letting one word stand for the other; None if it cannot. A blank stands for any single letter."""
    if a == b:
        return 0.0
    if not b:
        return 0.0 if len(a) == 1 else None
    if _given(a) == _given(b):
        return 0.25
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return 0.5 if long.startswith(short) or _given(long).startswith(short) else None
    if len(short) >= 3 and long.startswith(short) and len(long) > len(short) + 1:
        return 0.5
    limit = 3 if len(long) >= 9 else edits_allowed(a, b)
    d = osa_within(a, b, limit)
    if d <= min(limit, 1):
        return float(d)
    if 2 <= len(short) <= 6 and len(long) >= len(short) + 2 and short[0] == long[0]:
        it = iter(long)
        if all(c in it for c in short):
            return 0.75 if len(short) > 2 else 1.5
    if d <= limit:
        return float(d)
    for x, y in ((_given(a), b), (a, _given(b))):
        if (x, y) != (a, b) and osa_within(x, y, edits_allowed(x, y)) <= edits_allowed(x, y):
            return 1.25
    return None


def _assign(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
    """Least cost of pairing every word of ``a`` with a different word of ``b`` (same number of words, blanks included)."""
    # No budget is above 3 and words that differ cost 0.25 at least.
    if len(a) > 12 and (Counter(a) - Counter(b)).total() - b.count("") > 12:
        return None
    table = [[word_cost(x, y) for y in b] for x in a]
    if any(all(c is None for c in row) for row in table):
        return None
    least = assignment([[_NEVER if c is None else c for c in row] for row in table])
    return least if least < _NEVER else None


_NEVER = 1e6


def assignment(cost: list[list[float]]) -> float:
    """Least total of a square cost table with one cell in every row and column, by shortest augmenting paths."""
    n = len(cost)
    row_price, col_price = [0.0] * (n + 1), [0.0] * (n + 1)
    owner = [0] * (n + 1)  # row that holds each column; column 0 is where a new row starts
    for row in range(1, n + 1):
        owner[0], at = row, 0
        slack, came, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            done[at] = True
            r, step, best = owner[at], float("inf"), 0
            for col in range(1, n + 1):
                if done[col]:
                    continue
                over = cost[r - 1][col - 1] - row_price[r] - col_price[col]
                if over < slack[col]:
                    slack[col], came[col] = over, at
                if slack[col] < step:
                    step, best = slack[col], col
            for col in range(n + 1):
                if done[col]:
                    row_price[owner[col]] += step
                    col_price[col] -= step
                else:
                    slack[col] -= step
            at = best
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    return sum(cost[owner[col] - 1][col - 1] for col in range(1, n + 1))


def is_formal(name: str) -> bool:
    """Whether the name states its legal form, as names typed with care do."""
    words = name_tokens(name)
    return len(strip_legal(words)) < len(words) and words[-1] in LEGAL_FORMS and words[-1] not in ("company", "co")


def align_cost(a: tuple[str, ...], b: tuple[str, ...], formal: bool = False) -> float | None:
    """Cost of reading two word lists as one name, None if they name different entities.

    One-word lists are one name only if they are equal.

    Two formal names may differ by less: they are seldom both mistyped.

    All words must be paired; a middle initial may be missing on one side, and
    one word may be the initials of a run of words on the other.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(b) < 2:
        return 0.0 if a == b else None
    budget = 1.5 if formal else 2.5 if len(b) == 2 else 3.0
    if len(a) == len(b):
        cost = _assign(a, b)
        return cost if cost is not None and cost <= budget else None
    # Words of a that are single letters may be left out: they may take one of the blank columns.
    extra = len(a) - len(b)
    if sum(len(w) == 1 for w in a) >= extra:
        cost = _assign(a, (*b, *[""] * extra))
        if cost is not None and cost <= budget:
            return cost + 0.25
    # One word of b may be the initials of extra + 1 words of a.
    run = extra + 1
    for j, w in enumerate(b):
        if len(w) in (run, run + 1) and w[0] != "&":
            for i in range(len(a) - run + 1):
                # Company, a legal form, may still be counted among the initials.
                if "".join(x[0] for x in a[i : i + run]) in (w, w[:-1] if w[-1] == "c" and i + run == len(a) else w):
                    cost = _assign(a[:i] + a[i + run :], b[:j] + b[j + 1 :])
                    if cost is not None and cost <= 1.0:
                        return cost + 0.5
    # A glued pair of words on one side.
    if extra == 1:
        for i in range(len(a) - 1):
            cost = _assign(a[:i] + (a[i] + a[i + 1],) + a[i + 2 :], b)
            if cost is not None and cost <= 1.0:
                return cost + 0.25
    return None


def aligned(a: tuple[str, ...], b: tuple[str, ...], formal: bool = False) -> bool:
    """Whether two word lists name the same entity."""
    return align_cost(a, b, formal) is not None


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        anchors = [anchor_words(n) for n in pdf["name"]]
        yield pd.DataFrame(
            {
                "field": pdf["field"],
                "name": pdf["name"],
                "words": [list(words_of_name(n)) for n in pdf["name"]],
                "formal": [is_formal(n) for n in pdf["name"]],
                "keys": [brief_keys(n) for n in pdf["name"]],
                "probes": [brief_probe(n) if len(words_of_name(n)) == 1 else [] for n in pdf["name"]],
                "anchors": [a for a, _ in anchors],
                "capitals": [c for _, c in anchors],
            }
        )


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [osa_within(a, b, edits_allowed(a, b)) <= edits_allowed(a, b) for a, b in zip(pdf["word"], pdf["other"])]
        yield pdf[keep]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cost = [align_cost(tuple(a), tuple(b), f) for a, b, f in zip(pdf["words_a"], pdf["words_b"], pdf["formal"])]
        out = pdf[["src", "dst"]].assign(cost=pd.Series(cost, index=pdf.index, dtype="float64"))
        yield out[out["cost"].notna()]


def link_variants(names: DataFrame, field: str = "field", name: str = "name") -> DataFrame:
    """One row (field, name, entity) per distinct non-null name of each field.

    The entity is the smallest name (by code point) of the variants.  Empty
    names and names without letters or digits stay alone.  Other columns are
    not read.
    """
    parts = wide_parallelism(names.sparkSession)
    distinct = names.select(F.col(field).alias("field"), F.col(name).alias("name")).filter("field is not null and name is not null").distinct()
    feats = typed = cut_lineage(
        distinct.repartition(parts, F.xxhash64("name", "field")).mapInPandas(_features, "field string, name string, words array<string>, formal boolean, keys array<string>, probes array<string>, anchors array<string>, capitals array<string>")
    )
    # Names of the same words in any order are one form; (field, form) in one string is a
    # node, fields never hold the separator.  Names without words are forms of their own.
    form = F.when(F.size("words") > 0, F.array_join(F.array_sort("words"), " ")).otherwise(F.concat(F.lit("\x02"), "name"))
    feats = feats.withColumn("node", F.concat_ws("\x01", "field", form))
    orders = feats.groupBy("node", "field", "words").agg(
        F.count(F.lit(1)).alias("k"),
        F.min(F.col("formal").cast("int")).alias("formal"),
        F.flatten(F.collect_set("anchors")).alias("anchors"),
        F.flatten(F.collect_set("capitals")).alias("capitals"),
    )
    forms = cut_lineage(
        orders.groupBy("node", "field").agg(
            F.max_by("words", F.struct("k", "words")).alias("words"),
            F.sum("k").alias("support"),
            (F.min("formal") == 1).alias("formal"),
            F.array_distinct(F.flatten(F.collect_set("anchors"))).alias("anchors"),
            F.array_distinct(F.flatten(F.collect_set("capitals"))).alias("capitals"),
        )
    )
    full = forms.filter(F.size("words") >= 1)

    # Near words per field.
    worded = full.select("field", "node", "support", F.explode("anchors").alias("word"))
    counts = worded.groupBy("field", "word").agg(F.sum("support").alias("n"))
    capitals = full.select("field", F.explode("capitals").alias("word")).distinct().join(counts, ["field", "word"], "left_anti")
    # Words turn into many entries each, so the tables they come from are written by all cores, to be read by all.
    spread = lambda df, *by: df.repartition(parts, F.xxhash64(*by))
    vocabulary = cut_lineage(spread(counts.unionByName(capitals.withColumn("n", F.lit(0).cast("bigint"))), "word"))
    near = cut_lineage(near_words(vocabulary, ["field"], 1))
    around = (
        near.join(vocabulary.select("field", F.col("word").alias("other"), F.col("n").alias("m")), ["field", "other"])
        .groupBy("field", "word")
        .agg(F.sum("m").alias("around"))
    )
    rarity = vocabulary.join(around, ["field", "word"], "left").select("field", "word", (F.col("n") + F.coalesce("around", F.lit(0))).alias("rarity"))

    # First anchor of each name: its rarest word.  Further anchors: words of whose names
    # at least a sixth have one and the same first anchor, so that their names make at
    # most 36 times the pairs that the first anchors make already, and words in capitals.
    ranked = cut_lineage(worded.join(rarity, ["field", "word"]))
    first = ranked.groupBy("field", "node").agg(F.min_by("word", F.struct("rarity", "word")).alias("first"))
    together = ranked.join(first, ["field", "node"]).groupBy("field", "word", "first").agg(F.sum("support").alias("k"))
    close = (
        together.groupBy("field", "word")
        .agg(F.max("k").alias("k"), F.sum("k").alias("n"))
        .filter(F.col("k") * 6 >= F.col("n"))
        .select("field", "word")
    )
    anchored = (
        ranked.join(close, ["field", "word"], "left_semi")
        .select("field", "node", F.col("word").alias("anchor"))
        .unionByName(full.select("field", "node", F.explode("capitals").alias("anchor")))
        .distinct()
        .withColumn("beside", F.lit(""))
    )
    # The first anchor also meets words within two edits beside words of the same first letters.
    rest = F.array_sort(F.transform(F.filter("words", lambda w: w != F.col("first")), lambda w: F.substring(w, 1, 1)))
    leading = first.join(full.select("node", "words"), "node").select("field", "node", F.col("first").alias("anchor"), F.concat(F.lit("~"), F.array_join(rest, "")).alias("beside"))
    leading = cut_lineage(spread(leading, "node"))
    far = leading.filter("length(anchor) >= 5 and beside <> '~'").select("field", "beside", F.col("anchor").alias("word"))
    far = near_words(far, ["field", "beside"], 2)
    anchored = anchored.unionByName(leading.select("field", "node", "anchor", F.lit("").alias("beside"))).distinct()
    anchored = cut_lineage(anchored.unionByName(leading.filter("beside <> '~'")).join(full.select("node", "words", "formal"), "node"))

    # Candidates: equal or near anchors, each unordered pair once.  An anchor of many forms
    # is split by salt: its forms come once for each block of those they are compared with.
    blocks = anchored.groupBy("field", "beside", "anchor").agg(F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK).cast("int").alias("blocks"))
    blocks = blocks.select("field", "beside", F.col("anchor").alias("other"), "blocks")
    reach = near.unionByName(vocabulary.select("field", "word", F.col("word").alias("other"))).withColumn("beside", F.lit(""))
    reach = reach.select("field", "beside", "word", "other").unionByName(far.select("field", "beside", "word", "other"))
    reach = reach.join(blocks, ["field", "beside", "other"])
    columns = ("node", "words", "formal")
    left = anchored.select("field", "beside", F.col("anchor").alias("word"), *[F.col(c).alias(f"{c}_a") for c in columns])
    left = left.join(reach, ["field", "beside", "word"]).withColumn("salt", F.pmod(F.xxhash64("node_a"), "blocks")).drop("word", "blocks")
    right = anchored.select("field", "beside", F.col("anchor").alias("other"), *[F.col(c).alias(f"{c}_b") for c in columns])
    right = right.join(blocks, ["field", "beside", "other"]).withColumn("salt", F.explode(F.expr("sequence(0L, blocks - 1L)"))).drop("blocks")
    meet = ["field", "beside", "other", "salt"]
    pairs = left.repartition(parts, *meet).join(right.repartition(parts, *meet).hint("merge"), meet).filter("node_a < node_b")
    pairs = pairs.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), "words_a", "words_b", (F.col("formal_a") & F.col("formal_b")).alias("formal"))
    links = pairs.mapInPandas(_verify, "src string, dst string, cost double")
    links = cut_lineage(links.groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    release(vocabulary, near, ranked, leading, anchored)

    # Each form joins its closest one of at least its own support, and its closest of more
    # than that, so that a mistyped form seldom bridges two entities; two forms typed in three or more ways each are both
    # established and stay apart if they differ by letters, unless one is four times the other.
    support = forms.select("node", "support")
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    both = both.join(support.select(F.col("node").alias("src"), F.col("support").alias("own")), "src")
    both = both.join(support.select(F.col("node").alias("dst"), F.col("support").alias("theirs")), "dst")
    fits = (F.col("theirs") >= F.col("own")) & ((F.col("cost") < 1) | (F.col("own") <= 2) | (F.col("theirs") >= 4 * F.col("own")))
    closest = F.struct(F.floor("cost"), -F.col("theirs"), "cost", "dst")
    chosen = both.filter(fits).groupBy("src").agg(
        F.min_by("dst", closest).alias("one"), F.min_by("dst", F.when(F.col("theirs") > F.col("own"), closest)).alias("two")
    )
    chosen = chosen.select("src", F.explode(F.array("one", "two")).alias("dst")).filter("dst is not null")
    grouped = connected_components(forms.select("node"), chosen)
    comps = cut_lineage(grouped.join(feats.select("node", "field", "name", "keys", "probes"), "node"))
    release(typed, forms, links)

    # Entities of one-word names only (initials, first words, names that are one word)
    # join the entity that most of the names with their key belong to, if it has three
    # quarters of them; under a near key only one at least three times their own size.
    sizes = comps.groupBy("component").agg(F.max(F.size("keys")).alias("full"), F.count(F.lit(1)).alias("own"))
    single = F.filter("probes", lambda k: k.startswith("w:"))
    owners = (
        comps.withColumn("key", F.explode(F.array_distinct(F.concat("keys", single))))
        .groupBy("field", "key", "component")
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy("field", "key")
        .agg(F.max_by("component", F.struct("k", "component")).alias("owner"), F.max("k").alias("k"), F.sum("k").alias("n"))
        .filter(F.col("k") * 4 >= F.col("n") * 3)
        .select("field", "key", "owner", "k")
    )
    probes = comps.filter(F.size("probes") > 0).select("component", "field", F.explode("probes").alias("key")).distinct()
    probes = probes.join(sizes.filter("full = 0").select("component", "own"), "component")
    word = probes.filter("key like 'w:%'").select("component", "field", "own", F.expr("substring(key, 3)").alias("word"))
    # Names of one word are few, and so are first words of three names or more: they meet within two edits.
    brief = word.select("field", "word").unionByName(owners.filter("key like 'w:%' and k >= 3").select("field", F.expr("substring(key, 3)").alias("word")))
    fuzzy = word.join(near_words(brief.distinct(), ["field"], 2), ["field", "word"]).select("component", "field", F.concat(F.lit("w:"), "other").alias("key"), "own")
    hits = (
        probes.withColumn("exact", F.when(F.col("key").startswith("l:"), 2).otherwise(1))
        .unionByName(fuzzy.withColumn("exact", F.lit(0)))
        .join(owners, ["field", "key"])
        .filter((F.col("owner") != F.col("component")) & ((F.col("exact") > 0) | (F.col("k") >= 3 * F.col("own"))))
        .groupBy("component")
        .agg(F.max_by("owner", F.struct("exact", "k", "owner")).alias("owner"))
    )
    hits = cut_lineage(hits)
    onward = hits.select(F.col("component").alias("owner"), F.col("owner").alias("beyond"))
    hits = hits.join(onward, "owner", "left").select("component", F.coalesce("beyond", "owner").alias("owner"))
    placed = comps.join(hits, "component", "left").select("field", "name", F.coalesce("owner", "component").alias("e"))
    least = placed.groupBy("e").agg(F.min("name").alias("entity"))
    return placed.join(least, "e").select("field", "name", "entity")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """All pairs (field_name, name_a, name_b) of different names of one entity, name_a first by code point."""
    a = linked.select("field", "entity", F.col("name").alias("name_a"))
    b = linked.select("field", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["field", "entity"]).filter("name_a < name_b").select(F.col("field").alias("field_name"), "name_a", "name_b")
