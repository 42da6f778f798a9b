"""Scans of a filings site: polite fetching, list, index and document parsing.

Nothing here opens a connection by itself: the caller hands over a function that
gets a URL, so the same readers run against a site, a mirror or a folder.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.functions import patterns as P

# Forms of merger filings.
MERGER_FORMS = ("8-K", "8-K/A", "S-4", "S-4/A", "DEFM14A", "PREM14A", "SC TO-T", "SC TO-T/A", "SC 14D9", "425")


class RateLimitError(Exception):
    """The site asked to slow down (429)."""


class BlockedError(Exception):
    """The site refused (403); not tried again."""


class RateLimiter:
    """At most ``most`` calls in any ``window`` seconds; waits until the oldest has left the window."""

    def __init__(self, most: int = 10, window: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.window, self.clock, self.sleep = most, window, clock, sleep
        self.calls: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= self.window:
            self.calls.popleft()
        if len(self.calls) >= self.most:
            self.sleep(self.window - (now - self.calls[0]))
            return self.wait()
        self.calls.append(now)
        return None


class Fetcher:
    """Fetches through ``get`` with a limiter, a cache of limited age, and retries with growing pauses.

    ``get`` returns (status, text).  429 and TimeoutError are tried again, up to
    ``attempts`` times with pauses from ``first`` to ``longest`` seconds; 403 and
    other failures are raised at once.
    """

    def __init__(
        self,
        get: Callable[[str], tuple[int, str]],
        base: str = "",
        limiter: RateLimiter | None = None,
        max_age: float = 3600,
        attempts: int = 5,
        first: float = 2,
        longest: float = 60,
        clock: Callable[[], float] = time.monotonic,
        sleep: Callable[[float], None] = time.sleep,
    ):
        self.get, self.base, self.limiter = get, base.rstrip("/"), limiter or RateLimiter(clock=clock, sleep=sleep)
        self.max_age, self.attempts, self.first, self.longest, self.clock, self.sleep = max_age, attempts, first, longest, clock, sleep
        self.cache: dict[str, tuple[float, str]] = {}

    def fetch(self, url: str, use_cache: bool = True) -> str:
        if "://" not in url:
            url = f"{self.base}/{url.lstrip('/')}"
        key = hashlib.md5(url.encode()).hexdigest()
        if use_cache and key in self.cache and self.clock() - self.cache[key][0] < self.max_age:
            return self.cache[key][1]
        for attempt in range(self.attempts):
            self.limiter.wait()
            try:
                status, text = self.get(url)
                if status == 403:
                    raise BlockedError(url)
                if status == 429:
                    raise RateLimitError(url)
                if status >= 400:
                    raise OSError(f"{status} for {url}")
                self.cache[key] = (self.clock(), text)
                return text
            except (RateLimitError, TimeoutError):
                if attempt + 1 == self.attempts:
                    raise
                self.sleep(min(self.longest, self.first * 2**attempt))
        raise AssertionError("unreachable")


def padded_cik(c: Column) -> Column:
    """CIK with zeros in front up to ten places; longer ones stay."""
    return F.when(F.length(c) >= 10, c).otherwise(F.lpad(c, 10, "0"))


def index_url(cik: Column, accession: Column, base: str = "https://www.sec.gov/Archives/edgar/data") -> Column:
    return F.concat(F.lit(f"{base}/"), F.regexp_replace(cik, "^0+(?=.)", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.htm"))


_RECENT = ("accessionNumber", "form", "filingDate", "primaryDocument", "primaryDocDescription")


def filing_list(spark: SparkSession, path: str, forms: tuple[str, ...] = MERGER_FORMS, start: str | None = None, end: str | None = None) -> DataFrame:
    """Filings of submission lists stored as JSON files, of some forms and dates (inclusive)."""
    return listed_filings(spark.read.text(path, wholetext=True), "value", forms, start, end)


def listed_filings(lists: DataFrame, column: str, forms: tuple[str, ...] = MERGER_FORMS, start: str | None = None, end: str | None = None) -> DataFrame:
    """Filings of submission lists in a column of JSON (five parallel arrays), of some forms and dates (inclusive)."""
    arrays = ", ".join(f"{c}: array<string>" for c in _RECENT)
    parsed = lists.select(F.from_json(column, f"cik string, filings struct<recent: struct<{arrays}>>").alias("j"))
    zipped = F.arrays_zip(*[F.col(f"j.filings.recent.{c}").alias(c) for c in _RECENT])
    x = parsed.select("j.cik", F.explode(zipped).alias("f")).select("cik", "f.*").filter(F.col("form").isin(*forms))
    if start:
        x = x.filter(F.col("filingDate") >= start)
    return x.filter(F.col("filingDate") <= end) if end else x


def company_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select("cik", "name", "sic", "tickers", "exchanges")


class _IndexRows(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.rows[-1].append({"text": "", "href": None})
        elif tag == "a" and self.rows and self.rows[-1]:
            self.rows[-1][-1]["href"] = dict(attrs).get("href")

    def handle_data(self, data: str) -> None:
        if self.rows and self.rows[-1]:
            self.rows[-1][-1]["text"] += data


def index_exhibits(markup: str | None) -> list[tuple[str, str, str | None, str | None]]:
    """(exhibit_type, description, filename, url) of the exhibit rows of an index page."""
    parser = _IndexRows()
    parser.feed(markup or "")
    out = []
    for row in parser.rows:
        if len(row) >= 3 and row[2]["href"]:
            description = row[1]["text"].strip()
            if "EX-" in description.upper() or "EXHIBIT" in description.upper():
                m = re.search(r"EX-(\d+\.?\d*)", description, re.IGNORECASE)
                out.append((f"EX-{m.group(1)}" if m else "UNKNOWN", description, row[2]["text"].strip(), row[2]["href"]))
    return out


def scan_indexes(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Exhibit rows of stored index pages, with whether each is a PDF and material."""
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, exhibit_type string, description string, filename string, url string"

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pd.DataFrame([(k, *e) for k, m in zip(pdf["_k"], pdf["_m"]) for e in index_exhibits(m)], columns=[key, "exhibit_type", "description", "filename", "url"])

    found = pages.select(F.col(key).alias("_k"), F.col(markup).alias("_m")).mapInPandas(run, schema)
    return found.withColumns({"is_pdf": is_pdf(F.col("filename")), "is_material": is_material(F.col("description"))})


def is_pdf(filename: Column) -> Column:
    return F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False))


def is_material(description: Column) -> Column:
    return F.coalesce(F.lower(description).rlike(P.MATERIAL_EXHIBIT), F.lit(False))


def new_filings(arrived: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Arrived filings not yet known by accession number; of several copies the smallest id stays."""
    once = arrived.filter("accession_number is not null").groupBy("accession_number").agg(F.min("id").alias("id"))
    if known is not None:
        once = once.join(known.select("accession_number").filter("accession_number is not null"), "accession_number", "left_anti")
    return arrived.join(once.select("id"), "id", "left_semi")
