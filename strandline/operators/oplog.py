"""Replay of an operation log over events and their members: merge, split, close, reopen and revert, to any point of the log.

Operations that touch the same events are one component and are folded in order by one task; components are independent.
Every operation that is carried out keeps what it needs to be taken back, so that a reverted operation leaves no trace.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

ENDED = ("merged", "split")
OUTPUT = "what string, op long, event string, content string, status string, redirect string, outcome string, rollback string"


def part_id(op: int, number: int) -> str:
    """Id of the event made of one group of a split."""
    return "s" + hashlib.sha1(f"{op}:{number}".encode()).hexdigest()[:23]


class Replay:
    """Statuses, redirects and active members of the events of one component."""

    def __init__(self, events: dict[str, str], members: dict[str, set[str]]):
        self.status, self.redirect = dict(events), {}
        self.members = {e: set(members.get(e, ())) for e in events}
        self.undo: dict[int, dict] = {}

    def merge(self, op: int, event: str, others: list[str]) -> str:
        sources = sorted(set(others) - {event})
        if event not in self.status or any(x not in self.status for x in sources):
            return "unknown_event"
        if any(self.status[x] in ENDED for x in sources):
            return "already_ended"
        if not sources:
            return "nothing_to_merge"
        self.undo[op] = {"kind": "merge", "before": {x: [self.status[x], self.redirect.get(x)] for x in [event, *sources]}, "moved": {x: sorted(self.members[x]) for x in sources}, "new": {}}
        for x in sources:
            self.undo[op]["new"][x] = sorted(self.members[x] - self.members[event])
            self.members[event] |= self.members[x]
            self.members[x], self.status[x], self.redirect[x] = set(), "merged", event
        self.status[event] = "active"
        return "done"

    def split(self, op: int, event: str, groups: list[list[str]]) -> str:
        if event not in self.status:
            return "unknown_event"
        flat = [c for g in groups for c in g]
        if len(groups) < 2 or len(flat) != len(set(flat)) or set(flat) != self.members[event]:
            return "no_partition"
        made = {part_id(op, n): sorted(g) for n, g in enumerate(groups)}
        self.undo[op] = {"kind": "split", "event": event, "status": self.status[event], "made": made}
        for name, group in made.items():
            self.status[name], self.members[name] = "active", set(group)
        self.members[event], self.status[event] = set(), "split"
        return "done"

    def turn(self, op: int, event: str, status: str) -> str:
        if event not in self.status:
            return "unknown_event"
        self.undo[op] = {"kind": status, "event": event, "status": self.status[event]}
        self.status[event] = status
        return "done"

    def revert(self, target: int) -> str:
        old = self.undo.pop(target, None)
        if old is None:
            return "nothing_to_revert"
        if old["kind"] == "merge":
            first = next(iter(old["before"]))
            for x, (status, redirect) in old["before"].items():
                self.status[x] = status
                self.redirect.pop(x, None)
                if redirect is not None:
                    self.redirect[x] = redirect
            for x, moved in old["moved"].items():
                self.members[x] = set(moved)
                self.members[first] -= set(old["new"][x])
        elif old["kind"] == "split":
            event = old["event"]
            for name, group in old["made"].items():
                self.members[event] |= set(group)
                self.members[name], self.status[name], self.redirect[name] = set(), "merged", event
            self.status[event] = old["status"]
        else:
            self.status[old["event"]] = old["status"]
        return "done"


def replay(events: DataFrame, members: DataFrame, log: DataFrame, upto: int | None = None) -> DataFrame:
    """Events (what = event: status, redirect), active members (member: event, content) and operations (operation: outcome, rollback).

    events has event and status, members has event and content, the log has op, kind, event, others (array), groups (array of
    arrays of contents) and target (the op to revert). Operations beyond `upto` are left out. One that can't be carried out
    changes nothing and says why: unknown_event, already_ended, nothing_to_merge, no_partition, nothing_to_revert.
    """
    log = log if upto is None else log.where(F.col("op") <= upto)
    ids = F.array_union(F.array("event"), F.coalesce("others", F.array().cast("array<string>")))
    made = F.transform(F.sequence(F.lit(0), F.size("groups") - 1), lambda n: F.concat(F.lit("s"), F.substring(F.sha1(F.concat_ws(":", F.col("op").cast("string"), n.cast("string")).cast("binary")), 1, 23)))
    touched = log.select("op", "target", "kind", F.array_union(ids, F.when((F.col("kind") == "split") & (F.size("groups") > 0), made).otherwise(F.array().cast("array<string>"))).alias("ids"))
    own = touched.where("kind <> 'revert'").select("op", F.explode("ids").alias("event"))
    back = touched.where("kind = 'revert'").select("op", F.col("target").alias("of")).join(own.withColumnRenamed("op", "of"), "of").select("op", "event")
    edges = own.unionByName(back).where("event is not null").select(F.concat(F.lit("op:"), F.col("op").cast("string")).alias("a"), F.concat(F.lit("e:"), F.col("event")).alias("b"))
    parts = graph.connected(edges)
    of_event = parts.where("node like 'e:%'").select(F.expr("substring(node, 3)").alias("event"), "component")
    of_op = parts.where("node like 'op:%'").select(F.expr("cast(substring(node, 4) as bigint)").alias("op"), "component")
    placed = lambda df: df.join(of_event, "event", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("e:"), F.col("event"))))
    base = placed(events.select("event", "status", F.lit(None).cast("string").alias("content"))).unionByName(placed(members.select("event", F.lit(None).cast("string").alias("status"), "content")))
    ops = log.join(of_op, "op", "left").select(F.coalesce("component", F.concat(F.lit("op:"), F.col("op").cast("string"))).alias("component"), "op", "kind", F.col("event").alias("about"), F.to_json("others").alias("others"), F.to_json("groups").alias("groups"), "target")

    def folded(rows: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        named, held = {}, {}
        for event, status, content in zip(rows["event"], rows["status"], rows["content"], strict=True):
            if isinstance(content, str):
                held.setdefault(event, set()).add(content)
            else:
                named[event] = status
        r, out = Replay({**{e: "active" for e in held}, **named}, held), []
        for o in todo.sort_values("op").to_dict("records"):
            listed = lambda k, o=o: json.loads(o[k]) if isinstance(o[k], str) else []
            if o["kind"] == "merge":
                outcome = r.merge(o["op"], o["about"], listed("others"))
            elif o["kind"] == "split":
                outcome = r.split(o["op"], o["about"], listed("groups"))
            elif o["kind"] in ("close", "reopen"):
                outcome = r.turn(o["op"], o["about"], {"close": "closed", "reopen": "reopened"}[o["kind"]])
            elif o["kind"] == "revert":
                outcome = r.revert(int(o["target"])) if o["target"] == o["target"] and o["target"] is not None else "nothing_to_revert"
            else:
                outcome = "unknown_kind"
            out.append(("operation", o["op"], o["about"], None, None, None, outcome, json.dumps(r.undo[o["op"]], sort_keys=True) if o["op"] in r.undo else None))
        out += [("event", None, e, None, s, r.redirect.get(e), None, None) for e, s in r.status.items()]
        out += [("member", None, e, c, None, None, None, None) for e, cs in r.members.items() for c in sorted(cs)]
        frame = pd.DataFrame(out, columns=[p.split()[0] for p in OUTPUT.split(", ")])
        frame["op"] = frame["op"].astype("Int64")
        return frame

    return base.groupBy("component").cogroup(ops.groupBy("component")).applyInPandas(folded, OUTPUT)


def resolved(refs: DataFrame, events: DataFrame) -> DataFrame:
    """ref, kind (canonical, redirect, split or null) and event of each reference, by the replayed events (event, status, redirect), one redirect deep."""
    e = events.select(F.col("event").alias("ref"), "status", "redirect")
    kind = F.when(F.col("status") == "merged", "redirect").when(F.col("status") == "split", "split").when(F.col("status").isNotNull(), "canonical")
    return refs.select("ref").distinct().join(e, "ref", "left").select("ref", kind.alias("kind"), F.when(kind == "redirect", F.col("redirect")).when(kind.isNotNull(), F.col("ref")).alias("event"))
