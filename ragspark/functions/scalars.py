"""Small scalar rules: limits, scores, formats and derived fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions.text import filled, strip


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def book_top_k(k: Column) -> Column:
    """Not a whole number or below 1: the default; above 100: 100."""
    n = k.try_cast("int")
    return F.when(n.isNull() | (n < 1), F.lit(fv.DEFAULT_TOP_K)).otherwise(F.least(n, F.lit(fv.MAX_TOP_K)))


def clamped_top_k(k: Column, upper: int = fv.MAX_PAPER_TOP_K) -> Column:
    return F.greatest(F.lit(1), F.least(k.cast("int"), F.lit(upper)))


def confidence(rerank: Column, similarity: Column) -> Column:
    zero = F.lit(0.0)
    blend = fv.RERANK_WEIGHT * F.coalesce(rerank, zero) + fv.SIMILARITY_WEIGHT * F.coalesce(similarity, zero)
    return F.round(blend, 3)


def similarity_from_distance(distance: Column) -> Column:
    return F.when(distance.isNull(), F.lit(0.0)).otherwise(1 - distance)


def percent(share: Column) -> Column:
    return F.round(share * 100, 2)


def stage_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def form_encode(text: Column) -> Column:
    """Form encoding that leaves ``~`` as it is and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_url(pdf: Column, doi: Column, title: Column) -> Column:
    link, ident, name = filled(pdf), filled(doi), filled(title)
    return (
        F.when(link.isNotNull(), link)
        .when(ident.rlike("^https?://"), ident)
        .when(ident.startswith("10."), F.concat(F.lit("https://doi.org/"), form_encode(ident)))
        .when(ident.isNotNull(), F.concat(F.lit("https://www.semanticscholar.org/paper/"), form_encode(ident)))
        .when(name.isNotNull(), F.concat(F.lit("https://scholar.google.com/scholar?q="), form_encode(name)))
        .otherwise(F.lit(""))
    )


def query_check(query: Column) -> Column:
    """``struct(valid, sanitized, message, unusual)`` for a recommendation query."""
    text = strip(query)
    message = (
        F.when(query.isNull(), "Query cannot be None")
        .when(F.length(text) == 0, "Query cannot be empty or contain only whitespace")
        .when(F.length(text) < fv.MIN_QUERY_CHARS,
              f"Query too short. Minimum {fv.MIN_QUERY_CHARS} characters required")
        .when(F.length(text) > fv.MAX_QUERY_CHARS,
              f"Query too long. Maximum {fv.MAX_QUERY_CHARS} characters allowed")
        .when(~text.rlike("[a-zA-Z0-9]"), "Query must contain at least one letter or number")
    )
    return F.struct(
        message.isNull().alias("valid"),
        F.when(message.isNull(), text).otherwise(F.lit("")).alias("sanitized"),
        message.alias("message"),
        (message.isNull() & text.rlike(r"[<>{}\[\]\\|`~^]")).alias("unusual"),
    )
