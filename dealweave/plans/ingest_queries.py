"""Ingest and stream operators over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.functions import patterns as P
from dealweave.session import read_table
from dealweave.sources import edgar
from dealweave.streaming import windows


def s2_request_rates(spark: SparkSession, root: str) -> DataFrame:
    """Highest number of events of a user within an hour that ends with one of them."""
    rates = windows.rate_in_window(read_table(spark, root, "events").select("user_id", "ts"), "ts", "user_id", 3_600_000_000)
    return rates.groupBy("user_id").agg(F.max("in_window").alias("peak"))


def s7_filing_urls(spark: SparkSession, root: str) -> DataFrame:
    f = read_table(spark, root, "filings").filter("cik is not null and accession_number is not null")
    return f.select("id", edgar.padded_cik(F.col("cik")).alias("cik"), edgar.index_url(F.col("cik"), F.col("accession_number")).alias("url"))


def s9_new_filings(spark: SparkSession, root: str) -> DataFrame:
    return edgar.new_filings(read_table(spark, root, "filings")).select("id", "accession_number")


def s10_exhibit_flags(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "exhibits")
    return e.select("id", edgar.is_pdf(F.col("filename")).alias("pdf"), edgar.is_material(F.col("description")).alias("material"))


def w1_alert_hours(spark: SparkSession, root: str) -> DataFrame:
    """Events per type and hour."""
    return windows.tumbling_counts(read_table(spark, root, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


def w2_user_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of users with pauses below half an hour."""
    out = windows.session_counts(read_table(spark, root, "events"), "ts", "user_id")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "finish": F.col("finish").cast("timestamp_ntz")})


QUERIES = {f.__name__: f for f in (s2_request_rates, s7_filing_urls, s9_new_filings, s10_exhibit_flags, w1_alert_hours, w2_user_sessions)}
SQL = {
    "s2_request_rates": """select user_id, max(c) as peak from (select user_id, count(*) over (partition by user_id order by epoch_us(ts)
        range between 3599999999 preceding and current row) as c from events) group by 1""",
    "s7_filing_urls": """select id, case when length(cik) >= 10 then cik else lpad(cik, 10, '0') end as cik,
        'https://www.sec.gov/Archives/edgar/data/' || coalesce(nullif(ltrim(cik, '0'), ''), '0') || '/' || replace(accession_number, '-', '') || '/' || accession_number || '-index.htm' as url
        from filings where cik is not null and accession_number is not null""",
    "s9_new_filings": "select min(id) as id, accession_number from filings where accession_number is not null group by 2",
    "s10_exhibit_flags": f"select id, coalesce(ends_with(lower(filename), '.pdf'), false) as pdf, coalesce(regexp_matches(lower(description), '{P.MATERIAL_EXHIBIT}'), false) as material from exhibits",
    "w1_alert_hours": "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2",
    "w2_user_sessions": """with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minutes then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
        select min(ts) as start, max(ts) + interval 30 minutes as finish, user_id, count(*) as n from s group by user_id, k""",
}
