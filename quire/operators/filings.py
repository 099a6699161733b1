"""Choose filings from an index and name their targets."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip, suffix


def select_filings(
    filings: DataFrame,
    form_type: str = "10-K",
    year: int | None = None,
    start_date: date | str | None = None,
    end_date: date | str | None = None,
    limit: int = 1,
) -> DataFrame:
    """First ``limit`` matching filings per ticker in index order (``position``).

    Dates compare as text, inclusive; ``year`` is a prefix of the filing or the report date. The rank limit prunes
    before the shuffle, so a ticker with very many filings sends only ``limit`` rows per task.
    """
    rows = filings.where(F.upper(strip(F.col("form"))) == form_type.strip().upper())
    if year:
        rows = rows.where(F.col("filing_date").startswith(str(year)) | F.col("report_date").startswith(str(year)))
    if start_date:
        rows = rows.where(F.col("filing_date") >= str(start_date))
    if end_date:
        rows = rows.where(F.col("filing_date") <= str(end_date))
    order = Window.partitionBy("ticker").orderBy("position")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def filing_targets(filings: DataFrame) -> DataFrame:
    """Add ``document_url`` and ``target_filename``."""
    extension = suffix(F.col("primary_document"))
    cik = F.ltrim(F.col("cik"), F.lit("0"))
    return filings.withColumns(
        {
            # The public archive's address form and the target name form.
            "document_url": F.concat(
                F.lit("https://www.sec.gov/Archives/edgar/data/"),
                F.when(cik == "", "0").otherwise(cik),
                F.lit("/"),
                F.translate("accession", "-", ""),
                F.lit("/"),
                F.col("primary_document"),
            ),
            "target_filename": F.concat(
                F.col("ticker"),
                F.lit("_"),
                F.translate("form", "/", "-"),
                F.lit("_"),
                F.translate("filing_date", "-", ""),
                F.when(extension == "", ".htm").otherwise(extension),
            ),
        }
    )


def date_presets(as_of: date) -> dict[str, tuple[date, date]]:
    """Start and end dates of the named ranges, as of a day."""
    return {
        "Trailing 12M": (as_of - timedelta(days=365), as_of),
        "Year to Date (YTD)": (date(as_of.year, 1, 1), as_of),
        "Fiscal 2024": (date(2024, 1, 1), date(2024, 12, 31)),
    }


def with_presets(rows: DataFrame, day: str) -> DataFrame:
    """The same ranges as columns, for a date column."""
    return rows.withColumns(
        {
            "trailing_start": F.date_sub(day, 365),
            "ytd_start": F.to_date(F.trunc(day, "year")),
            "fiscal_2024": F.col(day).between(F.lit(date(2024, 1, 1)), F.lit(date(2024, 12, 31))),
        }
    )
