"""Name key: the one scalar that needs Unicode tables Spark does not have."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _unicode_name_key(names: pd.Series) -> pd.Series:
    plain = names.fillna("").str.strip().str.normalize("NFKC").str.casefold()
    return plain.str.replace(r"[\W_]+", "", regex=True)


def name_key(c: Column | str, ascii_only: bool = False) -> Column:
    """Trim, NFKC, casefold, letters and digits only.

    ASCII names are keyed in the JVM and reach Python as nulls; ``ascii_only`` promises that there are no others
    and leaves Python out of the plan.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = F.coalesce(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "")), F.lit(""))
    if ascii_only:
        return plain
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _unicode_name_key(F.when(other, c))).otherwise(plain)
