"""Bank names to the bank list: exact, then alias, then similar, on distinct names."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.functions import text as X
from dealweave.functions.fuzzy import similar_pairs

#: Most reference spellings compared at once.
BLOCK = 5_000


def resolve_exact(names: DataFrame, column: str, banks: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, bank_id, confidence, method) per distinct name: 1.0 by name, 0.95 by alias, else null.

    Of several banks or aliases with one spelling the smallest id counts.
    """
    raw = names.select(F.col(column).alias("raw")).filter("raw is not null").distinct().withColumn("k", X.cut_bank_endings(F.col("raw")))
    by_name = banks.groupBy(X.cut_bank_endings(F.col("name")).alias("k")).agg(F.min("id").alias("name_id"))
    by_alias = aliases.filter("bank_id is not null").groupBy(X.cut_bank_endings(F.col("alias")).alias("k")).agg(F.min("bank_id").alias("alias_id"))
    j = raw.join(by_name, "k", "left").join(by_alias, "k", "left")
    return j.select(
        "raw",
        F.coalesce("name_id", "alias_id").alias("bank_id"),
        F.when(F.col("name_id").isNotNull(), 1.0).when(F.col("alias_id").isNotNull(), 0.95).alias("confidence"),
        F.when(F.col("name_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias").alias("method"),
    )


def resolve_banks(names: DataFrame, column: str, banks: DataFrame, aliases: DataFrame, least: float = 92.0, block: int = BLOCK) -> DataFrame:
    """As ``resolve_exact``, with similar spellings for the rest (confidence similarity / 100).

    Shared bigrams rule out most pairs before they are compared, without loss.
    The reference spellings are streamed in blocks of ``block``; each block is
    broadcast to the distinct unresolved names.
    """
    first = resolve_exact(names, column, banks, aliases)
    rest = first.filter("bank_id is null").select("raw", X.cut_bank_endings(F.col("raw")).alias("k"))
    listed = banks.select(X.cut_bank_endings(F.col("name")).alias("k"), F.col("id").alias("bank_id")).unionByName(
        aliases.filter("bank_id is not null").select(X.cut_bank_endings(F.col("alias")).alias("k"), "bank_id")
    )
    source = iter((r["k"], r["bank_id"]) for r in listed.groupBy("k").agg(F.min("bank_id").alias("bank_id")).orderBy("k").toLocalIterator())
    sc, hits = names.sparkSession.sparkContext, None
    while spelled := list(islice(source, block)):
        shared = sc.broadcast(spelled)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            spellings, owner = [x for x, _ in shared.value], [x for _, x in shared.value]
            for pdf in batches:
                best: dict[int, tuple[float, int]] = {}
                for i, j, r in similar_pairs(pdf["k"].tolist(), spellings, least):
                    best[i] = max(best.get(i, (0.0, 0)), (r, -owner[j]))
                out = [(pdf["raw"].iloc[i], -b, r) for i, (r, b) in best.items()]
                yield pd.DataFrame(out, columns=["raw", "bank_id", "score"])

        part = rest.mapInPandas(run, "raw string, bank_id bigint, score double")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return first
    best = hits.groupBy("raw").agg(F.max_by("bank_id", F.struct("score", -F.col("bank_id"))).alias("fuzzy_id"), F.max("score").alias("score"))
    j = first.join(best, "raw", "left")
    return j.select(
        "raw",
        F.coalesce("bank_id", "fuzzy_id").alias("bank_id"),
        F.coalesce("confidence", F.col("score") / 100).alias("confidence"),
        F.coalesce("method", F.when(F.col("fuzzy_id").isNotNull(), "similar")).alias("method"),
    )


def unlisted_banks(resolved: DataFrame) -> DataFrame:
    """New bank rows (name, name_normalized) for names that resolved to nothing, one per normalised name."""
    x = resolved.filter("bank_id is null").select("raw", X.cut_bank_endings(F.col("raw")).alias("name_normalized")).filter("name_normalized <> ''")
    return x.groupBy("name_normalized").agg(F.min("raw").alias("name")).select("name", "name_normalized")


def link_banks(resolved: DataFrame) -> DataFrame:
    """(raw, bank_key): every name with its bank, listed ones by id, the others by a key that their normalised name makes.

    The key of a new bank does not depend on what else arrives, so linking again
    gives the same keys.
    """
    made = F.nullif(X.cut_bank_endings(F.col("raw")), F.lit(""))
    return resolved.select("raw", F.coalesce(F.col("bank_id").cast("string"), F.concat(F.lit("new:"), made)).alias("bank_key"))


def seed_banks(banks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds (name, short_name) not listed yet, one per normalised name; seeding twice adds nothing."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[,.]", ""), r"(?U)^\s+|\s+$", "")
    once = seeds.filter("name is not null").groupBy(plain("name").alias("name_normalized")).agg(F.min_by(F.struct("name", "short_name"), "name").alias("s"))
    known = banks.select(plain("name").alias("name_normalized")).filter("name_normalized is not null").distinct()
    return once.join(known, "name_normalized", "left_anti").select("s.name", "s.short_name", "name_normalized")
