"""Search: user input as an AND of phrases over an inverted index with positions, or as a substring."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much of an input counts, and the characters that are operators elsewhere and are taken out of its terms.
INPUT_CHARS, TERMS, TERM_CHARS, OPERATORS = 200, 20, 64, r"*^:()[]{}\-"

#: Letters with marks and the plain letters that index and phrases have for them, by decomposition.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1}


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without marks on Latin letters."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrases(given: Column) -> Column:
    """The terms of an input, each to be matched as a phrase: at most 20 of 64 characters from the first 200, without operators."""
    blank = r"^\s+|\s+$"
    raw = F.substring(F.regexp_replace(F.coalesce(given, F.lit("")), blank, ""), 1, INPUT_CHARS)
    clean = lambda t: F.substring(F.translate(t, OPERATORS, ""), 1, TERM_CHARS)
    return F.filter(F.transform(F.slice(F.filter(F.split(raw, r"\s+"), lambda t: t != ""), 1, TERMS), clean), lambda t: t != "")


def expression(given: Column) -> Column:
    """The match expression of an input, quoted; null where nothing can be searched for."""
    terms = phrases(given)
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(terms) > 0, F.array_join(quoted, " AND "))


def index(rows: DataFrame, fields: Sequence[str], id_: str = "id") -> DataFrame:
    """(token, id, field, at): a row for every token of every field."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("text")) for n, c in enumerate(fields)]))
    return rows.select(F.col(id_).alias("id"), each.alias("f")).select("id", "f.field", F.posexplode(tokens(F.col("f.text"))).alias("at", "token")).select("token", "id", "field", "at")


def matches(postings: DataFrame, queries: Sequence[str]) -> DataFrame:
    """(query, id): rows that hold every phrase of a query, each in some field with its tokens side by side.

    Postings meet the queries' tokens in one join and are counted by where a phrase would begin, so that no text is read.
    An input without terms, or with a term that has no letter or digit, matches nothing.
    """
    spark = postings.sparkSession
    given = spark.createDataFrame([(n, q) for n, q in enumerate(queries)], "query int, given string")
    terms = given.select("query", F.posexplode(phrases(F.col("given"))).alias("term", "phrase"))
    needed = terms.groupBy("query").agg(F.count("*").alias("n_terms"))
    asked = terms.select("query", "term", F.size(tokens(F.col("phrase"))).alias("n"), F.posexplode(tokens(F.col("phrase"))).alias("offset", "token"))
    met = postings.join(F.broadcast(asked), "token").groupBy("query", "term", "n", "id", "field", (F.col("at") - F.col("offset")).alias("start")).agg(F.count("*").alias("k"))
    found = met.where("k = n").select("query", "term", "id").distinct().groupBy("query", "id").agg(F.count("*").alias("n_found"))
    return found.join(F.broadcast(needed), "query").where("n_found = n_terms").select("query", "id")


def substrings(rows: DataFrame, fields: Sequence[str], queries: Sequence[str], id_: str = "id") -> DataFrame:
    """(query, id): rows one of whose fields has an input as it stands, without regard to case."""
    given = [(n, q.strip().lower()) for n, q in enumerate(queries) if q and q.strip()]
    if not given:
        return rows.select(F.lit(0).alias("query"), F.col(id_).alias("id")).limit(0)
    low = rows.select(F.col(id_).alias("id"), *[F.lower(F.coalesce(c, F.lit(""))).alias(f"f{k}") for k, c in enumerate(fields)])
    test = lambda q: F.exists(F.array(*[F.col(f"f{k}").contains(q) for k in range(len(fields))]), lambda x: x)
    return low.select("id", F.explode(F.array_compact(F.array(*[F.when(test(q), F.lit(n)) for n, q in given]))).alias("query")).select("query", "id")


def search(rows: DataFrame, fields: Sequence[str], queries: Sequence[str], id_: str = "id", postings: DataFrame | None = None) -> DataFrame:
    """(query, id): rows that match a query's phrases or hold it as a substring. queries is a list that the caller gives, in plan."""
    return matches(index(rows, fields, id_) if postings is None else postings, queries).unionByName(substrings(rows, fields, queries, id_)).distinct()
