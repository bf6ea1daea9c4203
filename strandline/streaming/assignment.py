"""Online assignment of items to events with keyed state, the same for one batch and for a stream.

Items come by block, which is a store of its own: its state holds its open events, the OPEN_EVENTS that changed last, each
with its tokens, signature, members and dispersion, and the event of the items it has seen, so that a replayed item is told
its event again and changes nothing. Items of different blocks never meet; within one they are taken in order of time and
id, by one task, as each decision hangs on all before it. A batch streams through that task.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.functions import signatures as s

# Weights of the score, thresholds of recall and of refreshed events.
SEMANTIC, STRUCTURE, TEMPORAL, DUPLICATE, ALIAS, LEXICAL = 0.45, 0.25, 0.15, 0.10, 0.05, 0.12
OPEN_EVENTS, CANDIDATES, TOKENS, TAU_DAYS, FAR_DAYS = 1500, 50, 500, 7.0, 45.0
INDEPENDENT, LOW_IMPORTANCE, LOW_ROLES = 1.8, 20.0, frozenset(("aggregator", "reprint", "unknown"))

FIELDS = ("tokens", "entities", "identifiers", "versions", "dates", "action", "polarity", "modality", "place")
OUTPUT = "id long, event_id string, decision string, relation string, score double, threshold double, candidates int, conflicts string, version int, event_state string, size int, dispersion double"


def _jaccard(a: set, b: set) -> float:
    n = len(a & b) if a and b else 0
    return n / (len(a) + len(b) - n) if n else 0.0


def _conflicts(a: dict, b: dict) -> list[str]:
    """Facts of which both sides name different ones."""
    apart = lambda k: bool(a[k] and b[k]) and not {x.lower() for x in a[k]} & {x.lower() for x in b[k]}
    tested = (
        ("different_canonical_identifier", apart("identifiers")), ("different_location", bool(a["place"] and b["place"]) and a["place"] != b["place"]), ("different_version", apart("versions")),
        ("incompatible_time", abs(a["time"] - b["time"]) > FAR_DAYS), ("opposite_action", bool(a["action"] and b["action"]) and a["action"] != b["action"] and {a["polarity"], b["polarity"]} == {"positive", "negative"}),
    )
    return [name for name, holds in tested if holds]


def _threshold(event: dict, duplicate: bool, alias: bool) -> float:
    out = s.ATTACH + min(s.SIZE_MOST, max(0, len(event["members"]) - 5) * s.SIZE_STEP) + min(s.DISPERSION_MOST, max(0.0, event["dispersion"]) * 0.2)
    out += s.STATE.get(event["status"], 0.0) - s.DUPLICATE_BONUS * duplicate - s.ALIAS_BONUS * alias
    return round(max(s.LOWEST, min(s.HIGHEST, out)), 3)


def view(facts: dict, tokens: list) -> dict:
    """Sets of an item or of an event's signature and tokens, which comparisons look at."""
    return {"tokens": set(tokens), "entities": set(facts["entities"]), "known": {v.lower() for v in (*facts["identifiers"], *facts["versions"])}}


def _viewed(event: dict, views: dict) -> dict:
    """An event's sets and those of its members' tokens, kept beside the state while its block is folded."""
    out = views.get(event["id"])
    if out is None:
        out = views[event["id"]] = {**view(event["signature"], event["tokens"]), "members": [set(m["tokens"]) for m in event["members"]]}
    return out


def compared(item: dict, event: dict, mine: dict | None = None, theirs: dict | None = None) -> dict | None:
    """How an item stands to an event, by their sets: None if nothing recalls the event, else score, relation, threshold, conflicts."""
    sig = event["signature"]
    mine, theirs = mine or view(item, item["tokens"]), theirs or view(sig, event["tokens"])
    duplicate = bool(item["duplicate_group"]) and item["duplicate_group"] in event["groups"]
    alias = bool(item["alias"]) and item["alias"] in event["aliases"]
    entities, others = mine["entities"], theirs["entities"]
    same_id = bool(mine["known"] & theirs["known"])
    same_action = bool(item["action"]) and item["action"] == sig["action"]
    lexical = _jaccard(mine["tokens"], theirs["tokens"])
    if not (duplicate or alias or entities & others or same_id or same_action or lexical >= LEXICAL):
        return None
    if event["status"] in ("closed", "archived") and not (duplicate or alias or same_id):
        return None
    overlap = len(entities & others) / max(1, len(entities | others))
    third = lambda x: x["entities"][2] if len(x["entities"]) > 2 else ""
    structure = 0.65 * overlap + 0.25 * same_action + 0.10 * (third(item) != "" and third(item) == third(sig))
    conflicts = _conflicts(item, sig)
    raw = (
        SEMANTIC * max(lexical, 0.65 * overlap + 0.35 * same_id) + STRUCTURE * structure + TEMPORAL * math.exp(-abs(item["time"] - sig["time"]) / TAU_DAYS) + DUPLICATE * duplicate + ALIAS * alias - min(0.8, 0.4 * len(conflicts))
    )
    threshold = _threshold(event, duplicate, alias)
    if conflicts:
        relation = "unrelated"
    elif item["role"] == "commentary":
        relation = "commentary"
    elif duplicate:
        relation = "duplicate"
    elif item["modality"] != sig["modality"]:
        relation = "event_update"
    else:
        relation = "same_event" if raw >= threshold else "related_context" if raw >= s.REVIEW else "unrelated"
    recall = duplicate + alias + same_id + 0.5 * bool(entities & others) + lexical
    return {"event": event, "score": round(max(0.0, min(1.0, raw)), 4), "relation": relation, "threshold": threshold, "conflicts": conflicts, "recall": recall}


class Index:
    """A block's open events by what recalls them: a row of bits a term, a bit an event; tells the events an item has to be compared with.

    Which events are recalled, and which of them are the CANDIDATES, is exact; scores are worked out nearly, and those that may be the best are left to compared().
    """

    def __init__(self, state: dict, views: dict):
        self.state, self.views, self.width = state, views, OPEN_EVENTS // 8 + 1
        n = self.width * 8
        self.bits, self.rows, self.uses, self.unused = np.zeros((1024, self.width), np.uint8), {}, {}, list(range(1024))
        self.slots, self.names, self.terms, self.free = {}, [""] * n, [frozenset()] * n, list(range(n))
        self.live, self.closed = np.zeros(n, bool), np.zeros(n, bool)
        self.number = {k: np.zeros(n) for k in ("tokens", "entities", "identifiers", "versions", "time", "changed")}
        self.code = {k: np.zeros(n, np.int64) for k in ("action", "place", "polarity")}
        self.codes: dict = {"": 0, "positive": 1, "negative": -1}
        for event in state["events"].values():
            self.put(event)

    def _coded(self, value: str) -> int:
        return self.codes.setdefault(value, len(self.codes) + 1)

    def put(self, event: dict) -> None:
        """Takes an event in, or what has changed of it."""
        name, sig, sets = event["id"], event["signature"], _viewed(event, self.views)
        if name not in self.slots:
            self.slots[name] = self.free.pop()
        at = self.slots[name]
        terms = {f"t{x}" for x in sets["tokens"]} | {f"e{x}" for x in sets["entities"]} | {f"k{x}" for x in sets["known"]} | {f"i{x.lower()}" for x in sig["identifiers"]} | {f"v{x.lower()}" for x in sig["versions"]}
        terms |= {f"a{sig['action']}"} | {f"g{x}" for x in event["groups"]} | {f"l{x}" for x in event["aliases"]} | {f"3{x}" for x in sig["entities"][2:3]}
        self._mark(at, terms)
        self.names[at], self.live[at], self.closed[at] = name, True, event["status"] in ("closed", "archived")
        for k, value in (("tokens", len(sets["tokens"])), ("entities", len(sets["entities"])), ("identifiers", len(sig["identifiers"])), ("versions", len(sig["versions"])), ("time", sig["time"]), ("changed", event["changed"])):
            self.number[k][at] = value
        for k in self.code:
            self.code[k][at] = self._coded(sig[k])

    def drop(self, name: str) -> None:
        at = self.slots.pop(name)
        self._mark(at, frozenset())
        self.live[at] = False
        self.free.append(at)

    def _mark(self, at: int, terms: set | frozenset) -> None:
        byte, bit, was = at >> 3, np.uint8(128 >> (at & 7)), self.terms[at]
        gone = [x for x in was if x not in terms]
        if gone:
            self.bits[[self.rows[x] for x in gone], byte] &= ~bit
            for x in gone:
                self.uses[x] -= 1
                if not self.uses[x]:
                    self.unused.append(self.rows.pop(x))
                    del self.uses[x]
        come = [x for x in terms if x not in was]
        for x in come:
            if x not in self.rows:
                if not self.unused:
                    n = len(self.bits)
                    self.bits, self.unused = np.concatenate((self.bits, np.zeros_like(self.bits))), list(range(n, 2 * n))
                self.rows[x], self.uses[x] = self.unused.pop(), 0
            self.uses[x] += 1
        if come:
            self.bits[[self.rows[x] for x in come], byte] |= bit
        self.terms[at] = frozenset(terms)

    def _counts(self, kind: str, values) -> np.ndarray:
        """Of how many of the values each event has the term."""
        rows = [r for r in map(self.rows.get, [kind + x for x in values]) if r is not None]
        if not rows:
            return np.zeros(len(self.live), np.int16)
        return np.add.reduce(np.unpackbits(self.bits[rows], axis=1), axis=0, dtype=np.int16)

    def meet(self, item: dict, mine: dict) -> tuple[int, list[dict]]:
        """Of how many events the item is a candidate, and those among which the best is."""
        low = lambda k: {x.lower() for x in item[k]}
        tokens, entities, known = self._counts("t", mine["tokens"]), self._counts("e", mine["entities"]), self._counts("k", mine["known"]) > 0
        lexical = tokens / np.maximum(1.0, len(mine["tokens"]) + self.number["tokens"] - tokens)
        has = lambda kind, x: self._counts(kind, [x] if x else []) > 0
        duplicate, alias, action = has("g", item["duplicate_group"]), has("l", item["alias"]), has("a", item["action"])
        strong = duplicate | alias | known
        at = np.flatnonzero(self.live & (strong | (~self.closed & ((entities > 0) | action | (lexical >= LEXICAL)))))
        if not len(at):
            return 0, []
        if len(at) > CANDIDATES:
            recall = duplicate[at].astype(np.int64) + alias[at] + known[at] + 0.5 * (entities[at] > 0) + lexical[at]
            least = np.partition(recall, len(at) - CANDIDATES)[len(at) - CANDIDATES]
            sure, ties = at[recall > least], at[recall == least]
            more = CANDIDATES - len(sure)
            if len(ties) > more:
                ties = np.array(sorted(ties.tolist(), key=lambda i: (self.number["changed"][i], self.names[i]), reverse=True)[:more])
            at = np.concatenate((sure, ties))
        number = {k: v[at] for k, v in self.number.items()}
        lexical, entities, known, action, duplicate, alias = lexical[at], entities[at], known[at], action[at], duplicate[at], alias[at]
        overlap = entities / np.maximum(1.0, len(mine["entities"]) + number["entities"] - entities)
        third = has("3", item["entities"][2] if len(item["entities"]) > 2 else "")[at]
        apart = np.abs(item["time"] - number["time"])
        code = {k: v[at] for k, v in self.code.items()}
        own = {k: self._coded(item[k]) for k in self.code}
        conflicts = (apart > FAR_DAYS).astype(np.int64)
        for k, kind in (("identifiers", "i"), ("versions", "v")):
            if item[k]:
                conflicts += (number[k] > 0) & (self._counts(kind, low(k))[at] == 0)
        if own["place"]:
            conflicts += (code["place"] != 0) & (code["place"] != own["place"])
        if own["action"] and own["polarity"] in (1, -1):
            conflicts += (code["action"] != 0) & (code["action"] != own["action"]) & (code["polarity"] == -own["polarity"])
        raw = SEMANTIC * np.maximum(lexical, 0.65 * overlap + 0.35 * known) + STRUCTURE * (0.65 * overlap + 0.25 * action + 0.10 * third) + TEMPORAL * np.exp(-apart / TAU_DAYS) + DUPLICATE * duplicate + ALIAS * alias - np.minimum(0.8, 0.4 * conflicts)
        near = np.clip(raw, 0.0, 1.0)
        # Scores have four digits: those that may be equal to the greatest are compared in full.
        return len(at), [self.state["events"][self.names[i]] for i in at[near >= near.max() - 2e-4].tolist()]


def _facts(item: dict) -> str:
    facts = [("action", item["action"], item["polarity"])] * bool(item["action"]) + [("entity", e) for e in item["entities"]] + [("canonical_identifier", i) for i in item["identifiers"]]
    facts += [("version", x) for x in item["versions"]] + [("location", item["place"])] * bool(item["place"]) + [("modality", item["modality"])]
    return hashlib.sha256(json.dumps(sorted(facts), ensure_ascii=False).encode()).hexdigest()


def _state_of(event: dict, item: dict) -> str:
    weight = sum(min(1.0, w) for w in event["origins"].values())
    if weight >= INDEPENDENT or item["role"] == "official" or "official" in event["roles"]:
        return "need_to_know"
    if set(event["roles"]) <= LOW_ROLES and event["importance"] < LOW_IMPORTANCE:
        return "noise"
    return "developing" if len(event["members"]) > 1 else "watch"


def _refresh(event: dict, item: dict, mine: dict, views: dict) -> None:
    """Takes the item in: dispersion, tokens, signature, and a version more if the facts are others."""
    members = _viewed(event, views)["members"] if event["members"] else []
    event["apart"] += sum(1.0 - _jaccard(mine["tokens"], m) for m in members)
    event["members"].append({"id": item["id"], "tokens": item["tokens"]})
    n = len(event["members"])
    event["dispersion"] = round(event["apart"] / (n * (n - 1) / 2), 3) if n > 1 else 0.0
    event["tokens"] = sorted(set(event["tokens"]) | mine["tokens"])[:TOKENS]
    event["signature"] = {k: item[k] for k in (*FIELDS, "time") if k != "tokens"}
    views[event["id"]] = {**view(item, event["tokens"]), "members": [*members, mine["tokens"]]}
    event["last"], event["importance"] = max(event["last"], item["time"]), max(event["importance"], item["importance"])
    event["roles"] = sorted({*event["roles"], item["role"]})
    event["origins"][item["origin"]] = max(event["origins"].get(item["origin"], 0.0), item["weight"])
    for name, key in (("groups", "duplicate_group"), ("aliases", "alias")):
        if item[key] and item[key] not in event[name]:
            event[name].append(item[key])
    facts = _facts(item)
    if facts != event["facts"]:
        event["facts"], event["version"], event["changed"] = facts, event["version"] + 1, item["time"]
    event["state"] = _state_of(event, item)


def empty() -> dict:
    return {"events": {}, "assigned": {}}


def take(state: dict, item: dict, views: dict | None = None, index: Index | None = None) -> tuple:
    """Assigns one item in a block's state; an item that was seen is told its event and changes nothing.

    views goes from item to item of a block: the sets of its events, which the state holds as lists. So does index, if the
    block has one; without it the item is compared with every event. Events stand in the state in order of their last
    change, and the first goes when they are too many. An item with `again` False comes once and is not kept as seen.
    """
    views = {} if views is None else views
    seen = state["assigned"].get(str(item["id"]))
    if seen is not None:
        e = state["events"].get(seen)
        told = (e["version"], e["state"], len(e["members"]), e["dispersion"]) if e else (None,) * 4
        return (item["id"], seen, "idempotent", None, None, None, 0, "", *told)
    mine = view(item, item["tokens"])
    count, likely = index.meet(item, mine) if index else (None, state["events"].values())
    met = [c for c in (compared(item, e, mine, _viewed(e, views)) for e in likely) if c is not None]
    if index is None:
        met = sorted(met, key=lambda c: (c["recall"], c["event"]["changed"], c["event"]["id"]), reverse=True)[:CANDIDATES]
        count = len(met)
    best = max(met, key=lambda c: (c["score"], c["event"]["id"]), default=None)
    attach = best is not None and not best["conflicts"] and best["relation"] in ("same_event", "event_update", "duplicate") and best["score"] >= best["threshold"]
    if attach:
        event, decision, relation = best["event"], "attach", best["relation"]
    else:
        review = best is not None and best["score"] >= s.REVIEW
        decision, relation = ("review_new", "related_context") if review else ("new", "same_event")
        name = hashlib.sha1(f"{item['id']}".encode()).hexdigest()[:24]
        event = state["events"][name] = {
            "id": name, "status": "active", "members": [], "tokens": [], "apart": 0.0, "dispersion": 0.0, "signature": {}, "last": item["time"], "importance": 0.0, "roles": [], "origins": {}, "groups": [], "aliases": [], "facts": "", "version": 0, "changed": item["time"], "state": "watch",
        }
    version = event["version"]
    _refresh(event, item, mine, views)
    if event["version"] != version:
        state["events"][event["id"]] = state["events"].pop(event["id"])
    if item.get("again", True):
        state["assigned"][str(item["id"])] = event["id"]
    if index:
        index.put(event)
    if len(state["events"]) > OPEN_EVENTS:
        oldest = next(iter(state["events"]))
        del state["events"][oldest]
        views.pop(oldest, None)
        if index:
            index.drop(oldest)
    said = (best["score"], best["threshold"]) if best else (None, s.ATTACH)
    return (item["id"], event["id"], decision, relation, *said, count, ",".join(best["conflicts"]) if best else "", event["version"], event["state"], len(event["members"]), event["dispersion"])


LISTS = ("tokens", "entities", "identifiers", "versions", "dates")


def _items(rows: pd.DataFrame) -> list[dict]:
    out = rows.to_dict("records")
    for r in out:
        for k in LISTS:
            r[k] = [] if r[k] is None else list(r[k])
    return out


def prepared(rows: DataFrame, block: str = "block", at: str = "publish_time") -> DataFrame:
    """Items as the fold takes them: block, id, time in days and the fields of signatures.columns(); null strings become empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    number = lambda c, other: F.coalesce(F.col(c).cast("double"), F.lit(other)) if c in rows.columns else F.lit(other)
    day = F.coalesce(F.try_to_timestamp(F.get("dates", 0), F.lit("yyyy-MM-dd")), F.col(at).cast("timestamp"))
    return rows.select(
        F.col(block).alias("block"), F.col("id").cast("long").alias("id"), (F.coalesce(F.unix_micros(day), F.lit(0)) / 86400e6).alias("time"), *FIELDS,
        text("role").alias("role"), text("origin").alias("origin"), number("weight", 1.0).alias("weight"), number("importance", 0.0).alias("importance"), text("duplicate_group").alias("duplicate_group"), text("alias").alias("alias"),
    )


def _columns() -> list[str]:
    return [part.split()[0] for part in OUTPUT.split(", ")]


def assigned(items: DataFrame) -> DataFrame:
    """Each item's event, decision and the event's state behind it. A stream keeps its blocks' state from batch to batch."""
    kind = items.schema["block"].dataType.simpleString()

    def folded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, state, views, index = None, empty(), {}, None
        for rows in parts:
            found = []
            for item in _items(rows):
                its = None if pd.isna(item["block"]) else item["block"]
                if index is None or its != block:
                    block, state, views = its, empty(), {}
                    index = Index(state, views)
                found.append((block, *take(state, item, views, index)))
            yield pd.DataFrame(found, columns=["block", *_columns()])

    def onward(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, views = json.loads(held.get[0]) if held.exists else empty(), {}
        index = Index(state, views)
        found = [(key[0], *take(state, item, views, index)) for item in _items(pd.concat(list(parts)).sort_values(["time", "id"], kind="stable"))]
        held.update((json.dumps(state, ensure_ascii=False),))
        yield pd.DataFrame(found, columns=["block", *_columns()])

    schema = f"block {kind}, {OUTPUT}"
    if items.isStreaming:
        return items.groupBy("block").applyInPandasWithState(onward, schema, "state string", "append", GroupStateTimeout.NoTimeout)
    twice = items.groupBy("block", "id").agg(F.count("*").alias("n")).where("n > 1").select("block", "id", F.lit(True).alias("again"))
    flagged = items.withColumn("again", F.lit(False)) if twice.isEmpty() else items.join(twice, ["block", "id"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    return flagged.repartition("block").sortWithinPartitions("block", "time", "id").mapInPandas(folded, schema)
