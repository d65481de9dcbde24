"""What has no built-in function: Unicode normalisation and HTML entities, in Arrow batches.

Rows that can't change are kept away from Python by a filter, not by a condition around the
function: a condition would still send every row.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qatlam.functions.text import STABLE_UNDER_NFKC


def _mapped(f: Callable[[str], str]) -> Callable:
    @F.pandas_udf("string")
    def g(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return g


def _where_needed(df: DataFrame, column: str, needed: Column, f: Callable[[str], str]) -> DataFrame:
    """``df`` with ``f`` over ``column`` in the rows where it is needed; null needs nothing."""
    need = F.coalesce(needed, F.lit(False))
    return df.where(~need).unionByName(df.where(need).withColumn(column, _mapped(f)(F.col(column))))


def nfkc(df: DataFrame, column: str) -> DataFrame:
    return _where_needed(df, column, ~F.col(column).rlike(STABLE_UNDER_NFKC), lambda s: unicodedata.normalize("NFKC", s))


def nfc(df: DataFrame, column: str) -> DataFrame:
    return _where_needed(df, column, ~F.col(column).rlike(STABLE_UNDER_NFKC), lambda s: unicodedata.normalize("NFC", s))


def unescape_html(df: DataFrame, column: str) -> DataFrame:
    return _where_needed(df, column, F.col(column).contains("&"), html.unescape)
