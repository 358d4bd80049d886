"""Tokens: maximal runs of ASCII letters and digits, case kept; everything else separates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[0-9A-Za-z]+"


def tokens(text: Column) -> Column:
    """All tokens in order; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_terms(text: Column) -> Column:
    """Distinct tokens by first occurrence."""
    return F.array_distinct(tokens(text))


def terms_of(query: str) -> list[str]:
    """query_terms of a Python string."""
    return list(dict.fromkeys(re.findall(TOKEN, query)))
