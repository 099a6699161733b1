"""Filing indexes: ticker table and submissions, as published in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.schema import SUBMISSIONS, TICKERS


class UnknownTicker(LookupError):
    """A requested ticker is not in the index."""


def ticker_index(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON objects of {cik_str, ticker, title} to rows: upper-case ticker, 10-digit CIK, title.

    A ticker listed more than once keeps its last entry, by place in its object."""
    entries = bodies.select(F.posexplode(F.from_json(body, TICKERS)).alias("_at", "_key", "entry"))
    cik = F.coalesce("entry.cik_str", F.lit(""))
    rows = entries.select(
        "_at",
        F.upper(strip(F.coalesce("entry.ticker", F.lit("")))).alias("ticker"),
        F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik).alias("cik"),
        F.coalesce("entry.title", F.lit("")).alias("title"),
    )
    last = rows.groupBy("ticker").agg(F.max(F.struct("_at", "cik", "title")).alias("last"))
    return last.select("ticker", "last.cik", "last.title")


def lookup_tickers(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requested tickers with CIK and title; null for the unknown ones."""
    wanted = requests.withColumn("ticker", F.upper(strip(F.col("ticker"))))
    return wanted.join(index, "ticker", "left")


def unknown_tickers(requests: DataFrame, index: DataFrame) -> DataFrame:
    wanted = requests.select(F.upper(strip(F.col("ticker"))).alias("ticker"))
    return wanted.join(index, "ticker", "left_anti").distinct()


def require_ticker(ticker: str, index: DataFrame) -> str:
    """CIK of one ticker, or ``UnknownTicker``."""
    name = ticker.strip().upper()
    found = index.where(F.col("ticker") == name).select("cik").first()
    if found is None:
        raise UnknownTicker(f"Ticker '{name}' is not listed in the company index.")
    return found["cik"]


def filing_index(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Submissions JSON with parallel arrays to one row per filing, in index order.

    The form array sets the length; a shorter array yields the empty string.
    """
    parsed = bodies.withColumn("_doc", F.from_json(body, SUBMISSIONS))
    recent = F.col("_doc.filings.recent")
    rows = F.posexplode(
        F.slice(
            F.arrays_zip(
                recent["form"].alias("form"),
                F.coalesce(recent["filingDate"], F.array()).alias("filing_date"),
                F.coalesce(recent["reportDate"], F.array()).alias("report_date"),
                F.coalesce(recent["accessionNumber"], F.array()).alias("accession"),
                F.coalesce(recent["primaryDocument"], F.array()).alias("primary_document"),
            ),
            F.lit(1),
            F.size(recent["form"]),
        )
    )
    others = [c for c in bodies.columns if c != body]
    exploded = parsed.select(*others, F.col("_doc.cik").alias("cik"), rows.alias("position", "f"))

    def text(field: str):
        return F.coalesce(f"f.{field}", F.lit("")).alias(field)

    fields = ("form", "filing_date", "report_date", "accession", "primary_document")
    return exploded.select(*others, "cik", "position", *[text(f) for f in fields])
