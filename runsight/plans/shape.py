"""Small helper for query outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round fractional columns (once) so that the order of summation does not show."""
    frac = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c in frac}) if frac else df
