"""Headers, role and bank columns and bank-role pairs of table grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.functions import patterns as P

_TABLE = ["key", "table_no"]


def _has_role(c: Column) -> Column:
    return F.lower(c).rlike("|".join(P.TABLE_ROLES))


def _is_bank(c: Column) -> Column:
    return c.rlike(P.TABLE_BANKS) | (c.rlike(P.TABLE_BANK_SUFFIX) & ~c.rlike(r"^[\d,.$%\s]+$"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(key, table_no, row_no) of header rows: of the first three those of header cells only, and a first row of short labels."""
    filled = F.col("text") != ""
    rows = cells.filter("row_no < 3").groupBy(*_TABLE, "row_no").agg(
        F.bool_and(~filled | F.col("is_header")).alias("all_th"),
        F.max(F.length("text")).alias("longest"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda s: s["text"]), " ")).alias("joined"),
    )
    labels = (F.col("row_no") == 0) & (F.col("longest") < 30) & F.col("joined").rlike("|".join(P.TABLE_HEADER_WORDS))
    return rows.filter(F.col("all_th") | labels).select(*_TABLE, "row_no")


def column_kinds(cells: DataFrame) -> DataFrame:
    """(key, table_no, col_no, role_share, bank_share, is_role, is_bank): role is the first column above 0.3, bank all above 0.2."""
    data = cells.join(header_rows(cells), [*_TABLE, "row_no"], "left_anti")
    share = data.groupBy(*_TABLE, "col_no").agg(
        F.avg(_has_role(F.col("text")).cast("double")).alias("role_share"),
        F.avg(F.col("text").rlike(P.TABLE_BANKS).cast("double")).alias("bank_share"),
    )
    first = F.min(F.when(F.col("role_share") > 0.3, F.col("col_no"))).over(Window.partitionBy(*_TABLE))
    return share.withColumn("is_role", F.coalesce(F.col("col_no") == first, F.lit(False))).withColumn("is_bank", F.col("bank_share") > 0.2)


def bank_roles(cells: DataFrame) -> DataFrame:
    """(key, table_no, row_no, col_no, bank, role): per data row the first bank cell and its role.

    The role is the cell in the role column, else the first other cell with a
    role word, else what the header says; rows without both are left out.
    """
    heads = header_rows(cells)
    head_text = cells.join(heads, [*_TABLE, "row_no"], "left_semi").groupBy(*_TABLE).agg(F.lower(F.concat_ws(" ", F.collect_list("text"))).alias("h"))
    h = F.col("h")
    head_role = (
        F.when(h.contains("underwriter"), "underwriter").when(h.contains("lender"), "lender").when(h.contains("arranger"), "arranger")
        .when(h.contains("bank") | h.contains("institution"), "participant")
    )
    kinds = column_kinds(cells).filter("is_role").select(*_TABLE, F.col("col_no").alias("role_col"))
    data = cells.join(heads, [*_TABLE, "row_no"], "left_anti").filter("text <> ''")
    row = [*_TABLE, "row_no"]
    banks = data.filter(_is_bank(F.col("text"))).groupBy(*row).agg(F.min_by(F.struct("col_no", "text"), "col_no").alias("b"))
    x = data.join(banks, row).join(kinds, _TABLE, "left")
    roles = x.groupBy(*row, "b").agg(
        F.max(F.when(F.col("col_no") == F.col("role_col"), F.col("text"))).alias("by_col"),
        F.min_by("text", F.when((F.col("col_no") != F.col("b.col_no")) & _has_role(F.col("text")), F.col("col_no"))).alias("by_word"),
    )
    out = roles.join(head_text, _TABLE, "left").select(*row, F.col("b.col_no").alias("col_no"), F.col("b.text").alias("bank"), F.coalesce("by_col", "by_word", head_role).alias("role"))
    return out.filter("role is not null")


def plain_bank_rows(cells: DataFrame) -> DataFrame:
    """(key, table_no, row_no, bank, role) of every row with a bank, as in tables without a header.

    The last cell with a bank's name or suffix and the last with a role word
    count; a row without a role word is of role ``unknown``.
    """
    c = F.col("text")
    filled = cells.filter("text <> ''")
    rows = filled.groupBy(*_TABLE, "row_no").agg(
        F.max_by("text", F.when(_is_bank(c), F.col("col_no"))).alias("bank"), F.max_by("text", F.when(_has_role(c), F.col("col_no"))).alias("role")
    )
    return rows.filter("bank is not null").withColumn("role", F.coalesce("role", F.lit("unknown")))
