"""Column functions of the rule score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import paragraphs

# Star scores, authority bonus, dimension weights, selection thresholds.
STARS = {1: 4.0, 2: 6.5, 3: 8.5}
BONUS = {"official": 1.0, "wire": 0.5}
WEIGHTS = {"salience": 0.30, "reach": 0.25, "authority": 0.25, "depth": 0.20}


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def authority(stars: Column, kind: Column) -> Column:
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STARS.items() for x in p]), stars), F.lit(4.0))
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in BONUS.items() for x in p]), kind), F.lit(0.0))
    return clamp(base + bonus, 0.0, 10.0)


def depth(body: Column) -> Column:
    """Paragraphs, digits and quotes, up to 8."""
    return F.least(F.lit(4.0), 0.8 * paragraphs(body)) + F.least(F.lit(4.0), 0.15 * F.regexp_count(body, F.lit("[0-9]")) + 0.4 * F.regexp_count(body, F.lit('"')))


def article_score(salience: Column, reach: Column, authority_: Column, depth_: Column) -> Column:
    """Weighted dimensions on a scale of 100."""
    return F.round(10 * (WEIGHTS["salience"] * salience + WEIGHTS["reach"] * reach + WEIGHTS["authority"] * authority_ + WEIGHTS["depth"] * depth_), 2)


def selection(score: Column) -> Column:
    return F.when(score >= 70, "selected").when(score >= 55, "candidate").otherwise("rejected")


def momentum(n: Column, recent: Column) -> Column:
    return F.least(F.lit(10.0), 2.5 * F.log2(1.0 + n) + F.least(F.lit(2.0), 0.5 * recent))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
