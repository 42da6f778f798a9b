"""Queries of the training-data operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.llm import abuse, canonical, leakage, mainbody, mixing, repetition, scanclean, survivors, variants
from dealweave.session import read_table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Survivor of every transaction with several deals records."""
    return survivors.survivor_ids(read_table(spark, root, "deals")).select("deal_id").distinct()


def p1_survivors(spark: SparkSession, root: str) -> DataFrame:
    """Survivors with the fields that truth discovery chose."""
    return survivors.surviving_deals(read_table(spark, root, "deals")).drop("transaction")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Exhibits of whose words 30 % or more repeat an earlier passage."""
    found = repetition.repeated_documents(read_table(spark, root, "exhibits"), "id", "visual_text")
    return found.select(F.col("id").alias("exhibit_id")).distinct()


def p2_profile(spark: SparkSession, root: str) -> DataFrame:
    """Repetition figures of every exhibit."""
    return repetition.repetition_profile(read_table(spark, root, "exhibits"), "id", "visual_text")


def _typed_names(spark: SparkSession, root: str) -> DataFrame:
    participants, deals = read_table(spark, root, "financing_participants"), read_table(spark, root, "deals")

    def part(df: DataFrame, table: str, column: str) -> DataFrame:
        return df.select(F.lit(f"{table}.{column}").alias("field"), F.col(column).alias("name"))

    return (
        part(participants, "financing_participants", "bank_name_raw")
        .unionByName(part(deals, "deals", "sponsor_name_raw"))
        .unionByName(part(deals, "deals", "target_name_raw"))
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of spellings of one bank, sponsor or target."""
    return variants.variant_pairs(variants.link_variants(_typed_names(spark, root)))


def p4_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entity of every typed name."""
    return variants.link_variants(_typed_names(spark, root))


def _pages(spark: SparkSession, root: str) -> DataFrame:
    filings, exhibits = read_table(spark, root, "filings"), read_table(spark, root, "exhibits")
    one = filings.select(F.lit("filings").alias("record_table"), F.col("id").alias("record_id"), F.col("raw_html").alias("markup"))
    two = exhibits.select(F.lit("exhibits").alias("record_table"), F.col("id").alias("record_id"), F.col("raw_content").alias("markup"))
    return one.unionByName(two)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of stored pages that hold visible text of the body."""
    pages = _pages(spark, root)
    model = mainbody.train_model(pages, ["record_table", "record_id"], "markup")
    return mainbody.body_lines(pages, ["record_table", "record_id"], "markup", model)


def p5_bodies(spark: SparkSession, root: str) -> DataFrame:
    """Body text of stored pages."""
    pages = _pages(spark, root)
    model = mainbody.train_model(pages, ["record_table", "record_id"], "markup")
    return mainbody.body_text(pages, ["record_table", "record_id"], "markup", model)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Typed roles, aliases and bank names with their canonical entries."""
    participants, aliases = read_table(spark, root, "financing_participants"), read_table(spark, root, "bank_aliases")
    roles, banks = read_table(spark, root, "canonical_roles"), read_table(spark, root, "banks")

    def part(df: DataFrame, field: str) -> DataFrame:
        return df.select(F.lit(field).alias("field_name"), "raw_value", "canonical_id")

    return (
        part(canonical.map_roles(participants, roles), "financing_participants.role")
        .unionByName(part(canonical.map_banks(aliases, banks, "alias"), "bank_aliases.alias"))
        .unionByName(part(canonical.map_banks(participants, banks, "bank_name_raw"), "financing_participants.bank_name_raw"))
    )


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of exhibits that are page furniture, end in a cut word or hold a misread character."""
    found = scanclean.scan_findings(read_table(spark, root, "exhibits"), "id", "visual_text")
    return found.select(F.col("id").alias("exhibit_id"), "line_no").distinct()


def p7_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Exhibit texts as continuous paragraphs."""
    return scanclean.repaired_texts(read_table(spark, root, "exhibits"), "id", "visual_text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    leaks = leakage.find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))
    return leaks.select("doc_id", "item_id").distinct()


def p8_reordered(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold an item in a long passage or, in whatever order, half of it in passages of five words or more."""
    leaks = leakage.find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"), min_tile=5, min_share=0.5)
    return leaks.select("doc_id", "item_id", "leaked_words", "longest_passage", "item_share")


def p8_leaked_items(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents and the largest share."""
    return leakage.leaked_items(leakage.find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items")))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    """Records of the mixture with their copies."""
    return mixing.mix_sources(read_table(spark, root, "documents"), read_table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Shares the mixture reaches."""
    targets = read_table(spark, root, "mix_targets")
    return mixing.mixture_report(mixing.mix_sources(read_table(spark, root, "documents"), targets), targets)


def _scores(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    model = abuse.train_model(docs, read_table(spark, root, "review_labels"))
    return abuse.abuse_scores(docs, model, keep=["source"])


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return _scores(spark, root).filter("abusive").select("doc_id").distinct()


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score of every document."""
    return _scores(spark, root)


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """Rate of abusive documents per source."""
    return abuse.abuse_rates(_scores(spark, root))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
