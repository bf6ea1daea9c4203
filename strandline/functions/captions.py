"""Text of caption tracks."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Starts of lines that hold no speech, and what ends a line.
HEADERS = "^(?i:WEBVTT|NOTE|STYLE|REGION|KIND:|LANGUAGE:)"
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
AROUND = r"^[\p{Z}\s]+|[\p{Z}\s]+$"


@F.pandas_udf(ArrayType(StringType()))
def unescaped(lines: pd.Series) -> pd.Series:
    """Lines with their character references decoded and no white space around them."""
    return lines.map(lambda row: [html.unescape(s).strip() for s in row])


def vtt(track: Column) -> Column:
    """Spoken lines of a WebVTT track joined by spaces, without headers, numbers, times and tags; a line equal to the last one kept is left out.

    Null and empty tracks: empty.
    """
    lines = F.transform(F.split(F.coalesce(track, F.lit("")), BREAKS), lambda s: F.regexp_replace(s, AROUND, ""))
    kept = F.filter(lines, lambda s: (s != "") & ~s.rlike(HEADERS) & ~F.contains(s, F.lit("-->")) & ~s.rlike(r"^\p{Nd}+$"))
    said = F.filter(unescaped(F.transform(kept, lambda s: F.regexp_replace(s, "<[^>]+>", ""))), lambda s: s != "")
    pairs = F.arrays_zip(said.alias("s"), F.concat(F.array(F.lit("")), said).alias("b"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["s"] != p["b"]), lambda p: p["s"]), " ")


def json3(track: Column) -> Column:
    """Segments of a JSON track's events joined by spaces; broken JSON, nulls and other shapes: empty."""
    shape = "array<struct<segs: array<struct<utf8: string>>>>"
    events = F.coalesce(F.from_json(track, f"struct<events: {shape}>")["events"], F.from_json(track, shape))
    parts = F.flatten(F.transform(events, lambda e: F.coalesce(e["segs"], F.array().cast("array<struct<utf8: string>>"))))
    texts = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.coalesce(p["utf8"], F.lit("")), AROUND, "")), lambda s: s != "")
    return F.coalesce(F.array_join(texts, " "), F.lit(""))
