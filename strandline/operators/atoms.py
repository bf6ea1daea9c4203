"""Upkeep of extracted statements (atoms): upsert of an extraction, and a fold of ordered reconcile operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

MISSING, IGNORED, CONTRADICTED = "missing_in_latest_extraction", "reconcile_ignored", "has_contradiction"
OPS = ("ADD", "MERGE", "SUPERSEDE", "CONTRADICT", "IGNORE")


def upserted(stored: DataFrame, extracted: DataFrame) -> DataFrame:
    """The stored atoms behind an extraction: content, sentence, type, payload, verified, status, latest, flags, and what happened.

    An atom is known by content, sentence and type. Known ones are updated and become active again (a verified one stays
    verified), new ones are inserted, active ones that an extraction of their content no longer has are put into the shadow
    unless verified; contents that were not extracted anew stay untouched. One outer join on the identity.
    An extraction that says an atom twice counts once, with its greatest payload.
    """
    key = ["content", "sentence", "type"]
    new = extracted.groupBy(*key).agg(F.max("payload").alias("new_payload"), F.max(F.coalesce("verified", F.lit(False))).alias("new_verified")).withColumn("here", F.lit(True))
    again = extracted.select("content").distinct().withColumn("again", F.lit(True))
    old = stored.select(*key, "payload", F.coalesce("verified", F.lit(False)).alias("verified"), "status", "latest", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.lit(True).alias("known"))
    j = old.join(new, key, "full").join(again, "content", "left")
    here, known, again = (F.coalesce(c, F.lit(False)) for c in ("here", "known", "again"))
    shadow = known & ~here & again & ~F.col("verified") & (F.col("status") == "active")
    outcome = F.when(here & ~known, "inserted").when(here & (F.col("status") != "active"), "reactivated").when(here, "updated").when(shadow, "shadowed").otherwise("kept")
    flags = F.when(here & ~known, F.array().cast("array<string>")).when(here, F.array_remove("flags", MISSING)).when(shadow, F.array_union("flags", F.array(F.lit(MISSING)))).otherwise(F.col("flags"))
    return j.select(
        *key, F.when(here, F.col("new_payload")).otherwise(F.col("payload")).alias("payload"), (F.coalesce("verified", F.lit(False)) | (here & F.coalesce("new_verified", F.lit(False)))).alias("verified"),
        F.when(here, "active").when(shadow, "shadow").otherwise(F.col("status")).alias("status"), F.when(here, True).when(shadow, False).otherwise(F.col("latest")).alias("latest"), flags.alias("flags"), outcome.alias("outcome"),
    )


class Ledger:
    """Atoms that operations have touched, with status, chain, group, evidence and flags; and relations found on the way."""

    def __init__(self, known: dict[str, int]):
        self.atoms = {a: {"status": "active", "latest": True, "supersedes": None, "superseded_by": None, "group": None, "evidence": n, "flags": []} for a, n in known.items()}
        self.relations: dict[tuple[str, str], str] = {}

    def _flag(self, atom: str, flag: str) -> None:
        if flag not in self.atoms[atom]["flags"]:
            self.atoms[atom]["flags"].append(flag)

    def apply(self, seq: int, op: str, atom: str, target: str | None) -> str:
        """Carries out one operation and says which it became; a target that is not there turns all but IGNORE into ADD."""
        if op not in OPS:
            return "unknown_op"
        if atom not in self.atoms:
            return "new_atom_not_found"
        new, other = self.atoms[atom], self.atoms.get(target) if target else None
        if op == "IGNORE":
            new["status"], new["latest"] = "shadow", False
            self._flag(atom, IGNORED)
            return op
        if op == "CONTRADICT" and other is not None:
            self._flag(atom, CONTRADICTED)
            self._flag(target, CONTRADICTED)
            pair = (target, atom) if (target, atom) in self.relations else (atom, target)
            self.relations[pair] = "contradiction"
            return op
        new["status"], new["latest"] = "active", True
        if op == "ADD" or other is None:
            return "ADD"
        new["group"] = group = new["group"] or other["group"] or f"grp-{seq}"
        other["group"], other["latest"] = group, False
        if op == "MERGE":
            new["evidence"] += other["evidence"]
            other["status"] = "shadow"
            self._flag(target, f"merged_into_{atom}")
        else:
            new["supersedes"], other["superseded_by"], other["status"] = target, atom, "superseded"
        return op


OUTPUT = "what string, seq long, atom string, other string, status string, latest boolean, supersedes string, superseded_by string, grp string, evidence long, flags string, outcome string"


def reconciled(atoms: DataFrame, ops: DataFrame) -> DataFrame:
    """Atoms (what = atom), relations (relation: atom, other) and operations (operation: outcome) behind ops in order of seq.

    atoms has atom and evidence, ops have seq, op, atom and target. Operations that touch the same atoms are folded together
    by one task; atoms without an operation come through as they are.
    """
    edges = ops.select(F.concat(F.lit("o:"), F.col("seq").cast("string")).alias("a"), F.explode(F.array_compact(F.array("atom", "target"))).alias("b")).select("a", F.concat(F.lit("a:"), F.col("b")).alias("b"))
    parts = graph.connected(edges)
    of_atom = parts.where("node like 'a:%'").select(F.expr("substring(node, 3)").alias("atom"), "component")
    of_op = parts.where("node like 'o:%'").select(F.expr("cast(substring(node, 3) as bigint)").alias("seq"), "component")
    base = atoms.select("atom", F.coalesce("evidence", F.lit(1)).cast("long").alias("evidence")).join(of_atom, "atom", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("a:"), F.col("atom"))))
    todo = ops.join(of_op, "seq", "left").select(F.coalesce("component", F.concat(F.lit("o:"), F.col("seq").cast("string"))).alias("component"), "seq", "op", F.col("atom").alias("about"), "target")

    def folded(known: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        ledger = Ledger(dict(zip(known["atom"], known["evidence"], strict=True)))
        empty = (None,) * 8
        out = []
        for o in listed.sort_values("seq").to_dict("records"):
            target = o["target"] if isinstance(o["target"], str) else None
            out.append(("operation", o["seq"], o["about"], target, *empty[:7], ledger.apply(o["seq"], o["op"], o["about"], target)))
        for a, x in ledger.atoms.items():
            out.append(("atom", None, a, None, x["status"], x["latest"], x["supersedes"], x["superseded_by"], x["group"], x["evidence"], ",".join(sorted(x["flags"])), None))
        out += [("relation", None, a, b, *empty[:7], kind) for (a, b), kind in ledger.relations.items()]
        frame = pd.DataFrame(out, columns=[p.split()[0] for p in OUTPUT.split(", ")])
        return frame.astype({"seq": "Int64", "evidence": "Int64", "latest": "boolean"})

    return base.groupBy("component").cogroup(todo.groupBy("component")).applyInPandas(folded, OUTPUT)
