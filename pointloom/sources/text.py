"""Text helpers of class names and prompts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\x0B\\f\\r]+", " "))


def basic_clean(c: Column) -> Column:
    """HTML references replaced, also those that were escaped twice, and white space collapsed; null stays null."""

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(html.unescape(t)) if isinstance(t, str) else None)

    return collapse_space(unescape(c))
