"""Unicode identity of keywords and repair of titles that were decoded with the wrong code page."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Letters that broken titles are full of, pairs that weigh more, and the least gain of a repair.
MARKERS, PAIRS, GAIN, STRONG = "ÃÂâåæçäéèðþ", ("â€", "Ã", "Â", "å°", "ä¸", "æ–"), 3, 5


@F.pandas_udf(StringType())
def normal(values: pd.Series) -> pd.Series:
    """Compatibility form (NFKC) without white space around it; null becomes empty."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v or "").strip())


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """Identity of a keyword: NFKC, trimmed, case folded."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v or "").strip().casefold())


def distinct_keywords(rows: DataFrame, group: str, word: str, order: str) -> DataFrame:
    """group, order, the normal form and whether it is skipped: all but the first of an identity in its group; empty ones go.

    One minimum a group and identity, combined before the shuffle, instead of a sort of the group.
    """
    named = rows.select(F.col(group).alias("group"), F.col(order).alias("order"), normal(F.col(word)).alias("keyword"), folded(F.col(word)).alias("identity")).where("keyword <> ''")
    first = named.groupBy("group", "identity").agg(F.min("order").alias("first"))
    joined = named.alias("n").join(first.alias("f"), F.col("n.group").eqNullSafe(F.col("f.group")) & (F.col("n.identity") == F.col("f.identity")))
    w = Window.partitionBy("n.group", "n.identity", "n.order").orderBy("n.keyword")
    again = (F.col("n.order") != F.col("f.first")) | (F.row_number().over(w) > 1)
    return joined.select(F.col("n.group").alias(group), F.col("n.order").alias(order), F.col("n.keyword").alias("keyword"), F.col("n.identity").alias("identity"), again.alias("skipped"))


def suspicion(value: str) -> int:
    """How much a text looks as if it had been decoded wrongly."""
    return sum(4 for c in value if 0x80 <= ord(c) <= 0x9F) + sum(c in MARKERS for c in value) + 8 * value.count("�") + sum(2 * value.count(p) for p in PAIRS)


def repair(value: str | None) -> tuple[str | None, str | None]:
    """The text that was meant and the code page it had been read with; (None, None) unless the round trip loses nothing and gains enough."""
    best: tuple = (0, None, None)
    if value and "�" not in value:
        han = lambda t: sum("㐀" <= c <= "鿿" for c in t)
        before = suspicion(value)
        for page in ("latin-1", "cp1252"):
            try:
                meant = value.encode(page).decode("utf-8")
            except UnicodeError:
                continue
            gain, more = before - suspicion(meant), han(meant) - han(value)
            if meant != value and gain >= GAIN and (more > 0 or before >= STRONG) and gain + more > best[0]:
                best = (gain + more, meant, page)
    return best[1:]


@F.pandas_udf(StructType([StructField("repaired", StringType()), StructField("page", StringType())]))
def repaired(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(v) for v in values], columns=["repaired", "page"])
