"""A question answered from the lake."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.embedding import embed_question
from quire.operators.presentation import grounded_digest
from quire.operators.retrieval import search, search_stored
from quire.schema import DEFAULT_PROFILE


MAX_TOP_K = 100
NO_QUESTION = "question must not be empty"
BAD_TOP_K = "top_k must be between 1 and 100"
BAD_THRESHOLD = "similarity_threshold must be between -1 and 1"


@dataclass(frozen=True)
class Request:
    """A search request; invalid values raise ValueError before any job starts."""

    question: str
    domain: str | None = DEFAULT_PROFILE
    top_k: int = 5
    form_type: str | None = None
    start_date: date | None = None
    end_date: date | None = None
    is_table_only: bool = False
    similarity_threshold: float = 0.0

    def __post_init__(self) -> None:
        if not self.question:
            raise ValueError(NO_QUESTION)
        if not 1 <= self.top_k <= MAX_TOP_K:
            raise ValueError(BAD_TOP_K)
        if not -1.0 <= self.similarity_threshold <= 1.0:
            raise ValueError(BAD_THRESHOLD)


def request_error(question: Column, top_k: Column, threshold: Column) -> Column:
    """The same checks for a table of requests: the first violated rule, or null."""
    return (
        F.when(F.coalesce(question, F.lit("")) == "", NO_QUESTION)
        .when(~top_k.between(1, MAX_TOP_K), BAD_TOP_K)
        .when(~threshold.between(-1.0, 1.0), BAD_THRESHOLD)
    )


def ask(lake: DataFrame, request: Request, dimension: int | None = None, stored: bool = False) -> DataFrame:
    """Ranked hits for a request, embedded by its domain's profile; ``stored`` for a lake scan, to read less text."""
    vector = embed_question(request.question, request.domain or DEFAULT_PROFILE, dimension)
    find = search_stored if stored else search
    return find(
        lake,
        vector,
        domain=request.domain,
        form_type=request.form_type,
        start_date=request.start_date,
        end_date=request.end_date,
        is_table_only=request.is_table_only,
        k=request.top_k,
        similarity_threshold=request.similarity_threshold,
    )


def answer(hits: DataFrame, request: Request) -> DataFrame:
    """The digest of one request's hits, as one row."""
    one = F.lit(0).cast("bigint").alias("query_id")
    order = F.struct((-F.col("similarity_score")).alias("score"), F.col("chunk_id"))
    ranked = hits.select(one, order.alias("rank"), "source_filename", "section", "similarity_score", "text")
    requests = hits.sparkSession.range(1).select(one)
    return grounded_digest(ranked, requests, request.domain or DEFAULT_PROFILE)
