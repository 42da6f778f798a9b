"""Files: full submissions, seed lists, extracted PDF text, layer writes."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.functions import text as X


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Documents of full submissions stored as files, one row each; see ``parse_submissions``."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_submissions(raw, "path", "value")


def parse_submissions(raw: DataFrame, key: str, value: str) -> DataFrame:
    """One row (key, accession_number, form_type, sequence, doc_type, filename, text) per document of full submissions."""
    head = raw.select(
        key,
        X.first_group(F.col(value), r"ACCESSION NUMBER:\s*(\S+)").alias("accession_number"),
        X.first_group(F.col(value), r"CONFORMED SUBMISSION TYPE:\s*([^\r\n]+)").alias("form_type"),
        F.posexplode(F.split(value, "<DOCUMENT>")).alias("place", "d"),
    ).filter("place > 0")
    tag = lambda t: F.trim(X.first_group(F.col("d"), rf"<{t}>([^\r\n<]*)"))
    return head.select(
        key, "accession_number", F.trim("form_type").alias("form_type"), tag("SEQUENCE").cast("int").alias("sequence"), tag("TYPE").alias("doc_type"), tag("FILENAME").alias("filename"),
        X.first_group(F.col("d"), r"(?s)<TEXT>\s*(.*?)\s*</TEXT>").alias("text"),
    )


def read_seed_deals(spark: SparkSession, path: str) -> DataFrame:
    """Seed deals of a JSON file with a list ``seed_deals``."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("seed_deals").alias("d")).select("d.*")


def grade_pdf_text(df: DataFrame, text: str) -> DataFrame:
    """Extracted PDF text with its quality: failed, poor or good."""
    return df.withColumn("extraction_quality", X.quality(F.col(text)))


def write_layer(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replace a derived layer; partitions of the layer that the rows don't touch stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


@dataclass(frozen=True)
class Settings:
    """Who fetches: both are required, so a misconfigured job ends at once."""

    app_name: str
    contact: str

    def __post_init__(self) -> None:
        import re

        if not self.app_name.strip():
            raise ValueError("app_name must not be empty")
        if not re.fullmatch(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", self.contact):
            raise ValueError("contact must be an e-mail address")

    @property
    def user_agent(self) -> str:
        return f"{self.app_name} {self.contact}"


def load_config(path: str, required: tuple[str, ...]) -> dict:
    """JSON configuration with its required fields; anything missing is an error."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path) as f:
        config = json.load(f)
    if missing := [k for k in required if k not in config]:
        raise ValueError(f"missing in {path}: {', '.join(missing)}")
    return config
