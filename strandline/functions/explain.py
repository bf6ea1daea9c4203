"""Why an item has its rule score: terms found, caps that took effect, what each dimension adds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v
from .rules import has

# Weights of the dimensions, most terms told of a list, of the entities and of an event's terms.
WEIGHTS = {"salience": 0.30, "reach": 0.25, "authority": 0.25, "depth": 0.20}
TERMS, ENTITIES, EVENT_TERMS = 12, 20, 5
SIGNALS = {"commerce": v.COMMERCE, "narrow": v.NARROW, "exempt": v.EXEMPT}


def found(head: Column, terms: Sequence[str], most: int) -> Column:
    """The first `most` terms of a list that a text in small letters holds, joined by bars."""
    return F.array_join(F.slice(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(head, t)), 1, most), "|")


def entities() -> list[str]:
    """Terms of all tiers in their order, as tier:term."""
    return [f"{tier}:{term}" for tier, terms in v.TIERS.items() for term in terms]


def entity_hits(head: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.array(*[F.lit(t) for t in entities()]), lambda t: F.contains(head, F.substring(t, 3, 1000))), 1, ENTITIES), "|")


def event_hits(head: Column) -> Column:
    """Event types that are met, each with its bonus and first terms."""
    told = [F.when(has(head, terms), F.concat(F.lit(f"{name}+{bonus}="), found(head, terms, EVENT_TERMS))) for name, (bonus, terms) in v.EVENTS.items()]
    return F.array_join(F.array_compact(F.array(*told)), ";")


def reach_level(low: Column, head: Column) -> Column:
    spread = has(head, v.DISASTERS) & has(low, v.SEVERAL_PLACES)
    out = F.when(spread & has(low, v.CASUALTIES), "systemic").when(spread, "sector")
    for level in ("systemic", "sector", "local"):
        out = out.when(has(head, v.REACH[level]), level)
    return out.otherwise("entity")


def caps_applied(scope: Column) -> Column:
    """Dimensions that a cap lowered, with the cap: columns of the dimensions and what they were before."""
    told = [F.when((scope == name) & (F.col(d) < F.col(f"{d}_before")), f"{d}<={cap}") for name, caps in v.CAPS.items() for d, cap in caps.items()]
    return F.array_join(F.array_compact(F.array(*told)), "|")


def weighted(dimension: str) -> Column:
    return F.round(F.col(dimension) * WEIGHTS[dimension], 3)
