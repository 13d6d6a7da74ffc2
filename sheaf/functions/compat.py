"""Folding that needs Unicode tables, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("string")
def fold_compat(texts: pd.Series) -> pd.Series:
    """Fold C: compatibility decomposition without combining marks, the stroke of d off; case is kept, null stays null."""

    def fold(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).replace("đ", "d").replace("Đ", "D")

    return texts.map(fold)
