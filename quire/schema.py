"""Record layouts and fixed values of the lake."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names and types of stored records, here and below up to the profiles.
LAKE = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("source_filename", T.StringType(), False),
        T.StructField("form_type", T.StringType(), False),
        T.StructField("filing_date", T.DateType(), True),
        T.StructField("section", T.StringType(), False),
        T.StructField("is_table", T.BooleanType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
        T.StructField("metadata_json", T.StringType(), False),
        T.StructField("domain", T.StringType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("month", T.IntegerType(), False),
        T.StructField("day", T.IntegerType(), False),
    ]
)
PARTITIONS = ("domain", "year", "month", "day")

SIDECAR = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source_filename", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("form_type", T.StringType()),
        T.StructField("filing_date", T.DateType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("total_pages", T.IntegerType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_filename", T.StringType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("stack_trace", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("chunk_count", T.LongType()),
        T.StructField("token_total", T.LongType()),
        T.StructField("parquet_paths", T.ArrayType(T.StringType())),
        T.StructField("error_message", T.StringType()),
    ]
)

TICKERS = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("cik_str", T.StringType()),
            T.StructField("ticker", T.StringType()),
            T.StructField("title", T.StringType()),
        ]
    ),
)

_STRINGS = T.ArrayType(T.StringType())
SUBMISSIONS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField(
            "filings",
            T.StructType(
                [
                    T.StructField(
                        "recent",
                        T.StructType(
                            [
                                T.StructField("form", _STRINGS),
                                T.StructField("filingDate", _STRINGS),
                                T.StructField("reportDate", _STRINGS),
                                T.StructField("accessionNumber", _STRINGS),
                                T.StructField("primaryDocument", _STRINGS),
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)

# The corpus profiles and their vector sizes.
DEFAULT_PROFILE = "finance"


@dataclass(frozen=True)
class Profile:
    """An embedding profile; ``batch_size`` is the model batch."""

    name: str
    model_name: str
    dimension: int
    batch_size: int
    max_sequence_length: int = 512
    normalize_embeddings: bool = True


PROFILES = (
    Profile("finance", "BAAI/bge-small-en-v1.5", 384, 32),
    Profile("literature", "sentence-transformers/all-mpnet-base-v2", 768, 16),
    Profile("general", "BAAI/bge-large-en-v1.5", 1024, 16),
)

# Section titles by filing item number.
ITEM_TITLES = {
    "1": "Item 1 - Business",
    "1A": "Item 1A - Risk Factors",
    "1B": "Item 1B - Unresolved Staff Comments",
    "2": "Item 2 - Properties",
    "3": "Item 3 - Legal Proceedings",
    "4": "Item 4 - Mine Safety Disclosures",
    "5": "Item 5 - Market for Registrant's Common Equity",
    "6": "Item 6 - [Reserved]",
    "7": "Item 7 - Management's Discussion and Analysis",
    "7A": "Item 7A - Quantitative and Qualitative Disclosures",
    "8": "Item 8 - Financial Statements",
    "9": "Item 9 - Changes in and Disagreements with Accountants",
    "9A": "Item 9A - Controls and Procedures",
    "9B": "Item 9B - Other Information",
    "9C": "Item 9C - Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "10": "Item 10 - Directors, Executive Officers and Corporate Governance",
    "11": "Item 11 - Executive Compensation",
    "12": "Item 12 - Security Ownership of Certain Beneficial Owners",
    "13": "Item 13 - Certain Relationships and Related Transactions",
    "14": "Item 14 - Principal Accountant Fees and Services",
    "15": "Item 15 - Exhibits and Financial Statement Schedules",
    "16": "Item 16 - Form 10-K Summary",
}

# File name rules of the intake.
DOCUMENT_SUFFIXES = (".pdf", ".htm", ".html", ".json", ".txt")
SIDECAR_SUFFIX = ".meta.json"
ERROR_SUFFIX = ".error.json"
UNFINISHED_SUFFIXES = (".tmp", ".crdownload", ".part", ".lock", ".temp")
UNLISTED_SUFFIXES = (".meta.json", ".error.json", ".tmp", ".crdownload", ".part")

# Chunk bounds and the split delimiters, coarse to fine.
MAX_TOKENS = 512
OVERLAP_TOKENS = 64
MAX_CHARACTERS = 2000
PROSE_DELIMITERS = ("\n\n", "\n", ". ", " ")
TABLE_DELIMITERS = ("</tr>\n", "</tr>", "\n\n", "\n", ". ", " ")
