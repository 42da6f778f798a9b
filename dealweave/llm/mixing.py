"""Mixing sources to target weights by weighted sampling without replacement.

Every record has an exponential key scaled by its quality weight
(Efraimidis-Spirakis), so taking records of a source in key order is weighted
sampling.  A source whose share asks for more tokens than it has is used in
whole epochs first, never more than its cap, and the rest of its budget is a
fractional selection: the records whose running token count in key order stays
within it.  Records are range-partitioned by source and key, so a source with a
third of all records lies in many partitions of like size whatever its weights,
and running counts come from the sums of the partitions before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealweave.session import cut_lineage, release, wide_parallelism

#: Records aimed at in one range partition.
PARTITION_ROWS = 250_000


@lru_cache(maxsize=4)
def _encoder(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, tokenizer: str) -> int:
    """Tokens of a whole text."""
    return len(_encoder(tokenizer).encode_ordinary(text))


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary that comes with the public tokenizer files."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str, keep: list[str]) -> DataFrame:
    """The key, the kept columns and ``n_tokens`` of each row; null texts have 0 tokens."""
    schema = T.StructType([docs.schema[c] for c in (key, *keep)] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="_text")
            out["n_tokens"] = [count_tokens(t, tokenizer) if t else 0 for t in pdf["_text"]]
            yield out

    return docs.select(key, *keep, F.col(text).alias("_text")).mapInPandas(run, schema)


def text_quality(text: Column) -> Column:
    """Weight between 0 and 1: the share of letters and blanks, times how far the different words are as many as in prose.

    n ** 0.8 different words among n count in full, so length alone costs little.  Tables of numbers, markup and repeated wording weigh less;
    texts without words weigh 0.
    """
    letters = F.length(F.regexp_replace(text, r"[^\p{L} \n]+", "")) / F.length(text)
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    different = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.pow(F.size(words), F.lit(0.8)))
    return F.when((F.length(text) > 0) & (F.size(words) > 0), letters * different).otherwise(F.lit(0.0))


def _uniform(key: str, seed: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def exponential_key(key: str, weight: Column, seed: int) -> Column:
    """(last, k): -ln(u) / weight with u drawn from the record's hash; smallest first is weighted sampling.

    Records of null, zero or negative weight come last, in hash order.
    """
    u = _uniform(key, seed)
    return F.struct((~F.coalesce(weight > 0, F.lit(False))).alias("last"), F.when(weight > 0, -F.log(u) / weight).otherwise(u).alias("k"))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: Column | None = None,
    tokenizer: str | None = None,
    seed: int = 17,
    partition_rows: int = PARTITION_ROWS,
) -> DataFrame:
    """Selected records: (key, source, n_tokens, copies), ``copies`` at least 1.

    ``targets`` has (source, target_share, max_repeats).  ``total_tokens`` is the
    size of the mixture; if none is given, it is the largest that every source
    can serve within its cap.  With a larger total, a source at its cap gives
    all it has and the report shows its smaller share.  ``quality`` is the weight
    of a record (``text_quality`` of its text if none is given).  Documents with
    null or unlisted source, null key or no tokens are not selected; targets with
    null or zero share or cap take none; repeated targets of a source add their
    shares.  Repeated rows of a document are separate records.
    """
    spark = docs.sparkSession
    plan = (
        targets.groupBy(F.col(source).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
        .filter("source is not null and share > 0 and cap > 0")
    )
    weight = text_quality(F.col(text)) if quality is None else quality
    listed = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), F.col(text).alias("_text"), weight.cast("double").alias("_w"))
    listed = listed.filter("_id is not null").join(plan.select("source"), "source", "left_semi")
    counted = token_counts(listed, "_id", "_text", tokenizer or default_tokenizer(), ["source", "_w"]).filter("n_tokens > 0")
    drawn = cut_lineage(counted.withColumn("_k", exponential_key("_id", F.col("_w"), seed)).drop("_w"))
    parts = max(wide_parallelism(spark), -(-drawn.count() // partition_rows))
    # Written once, so that the number of a partition stays that of its rows.
    keyed = cut_lineage(drawn.repartitionByRange(parts, "source", "_k").withColumn("_b", F.spark_partition_id()))
    release(drawn)

    sums = keyed.groupBy("source", "_b").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before).select("source", "_b", "_before")
    have = sums.groupBy("source").agg(F.sum("t").alias("have")).join(plan, "source")
    shares = F.sum("share").over(Window.partitionBy())
    have = have.withColumn("share", F.col("share") / shares)
    if total_tokens is None:
        budget = F.floor(F.col("share") * F.min(F.col("have") * F.col("cap") / F.col("share")).over(Window.partitionBy()))
    else:
        budget = F.floor(F.col("share") * F.lit(total_tokens))
    have = have.withColumn("budget", F.least(budget, F.col("have") * F.col("cap")).cast("bigint"))
    have = have.withColumn("epochs", F.floor(F.col("budget") / F.col("have")).cast("bigint"))
    have = have.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))

    inside = Window.partitionBy("source", "_b").orderBy("_k", "_id").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.join(starts, ["source", "_b"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
    chosen = run.join(have.select("source", "epochs", "rest"), "source")
    copies = F.col("epochs") + F.when(F.col("_upto") <= F.col("rest"), 1).otherwise(0)
    return chosen.select(F.col("_id").alias(key), F.col("source").alias(source), "n_tokens", copies.cast("bigint").alias("copies")).filter("copies > 0")


def mixture_report(mixture: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per listed source: target share, actual share in tokens, tokens, records, most copies of a record."""
    used = mixture.groupBy(source).agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
        F.count(F.lit(1)).alias("records"),
        F.max("copies").alias("most_copies"),
    )
    plan = targets.groupBy(source).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter(F.col(source).isNotNull())
    out = plan.join(used, source, "left").fillna(0, ["tokens", "records", "most_copies"])
    return out.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))
