"""Repair of the turn structure of conversations by alignment to an alternating grammar.

Legal conversations are `(s?(ua)+)?` in initials of roles: a system turn or none, then user and assistant in turn. There is one
legal string of every feasible length, and all of them end in the same letters; so one Wagner-Fischer table from the end of a
conversation, rows against letters still to come, aligns it to every length. The table is cut to an Ukkonen band that follows
from an incumbent, the cost of a plain repair; of the cheapest alignments of all lengths the least audit is traced.

A row is read twice in order of turn: once as a letter, a flag and a digest (for the audits), once with its text (for the repaired
rows). Neither holds a conversation's texts; only one letter a row is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, CUT = 2, 5, 5
PLAIN, BLANK, TRUNCATED, DUPLICATE, ABSENT = range(5)
_SPACE = " \t\n\x0b\x0c\r"
_FAR = np.int64(1) << 60
#: Cells of a table that are kept whole; beyond that rows are kept at intervals and the rest is made anew when traced.
CELLS = 1 << 22


def incumbent(letters: bytes, flags: np.ndarray) -> int:
    """Cost of a plain repair: faulty rows go, rows out of step go or are given the role that the next row asks for."""
    good = [c for c, f in zip(letters.decode("latin-1"), flags.tolist(), strict=True) if f == PLAIN]
    faulty = DELETE * (len(letters) - len(good))
    cost = turn = stay = 0
    first = 1 if good and good[0] == "s" else 0
    for at in range(first, len(good)):
        if good[at] == "ua"[turn]:
            turn, stay = turn ^ 1, stay + 1
        elif at + 1 < len(good) and good[at + 1] == "ua"[turn ^ 1]:
            cost, turn, stay = cost + 1, turn ^ 1, stay + 1
        else:
            cost += DELETE
    cost += DELETE * turn + DELETE * (first and stay - turn < 2)
    return faulty + min(DELETE * len(good), cost)


class Table:
    """Excess cost, over the deletion of faulty rows, of aligning rows i.. to the last k letters, for k near the number of good rows.

    The deviation t = k - good rows from i on costs 2 for each step down (a good row deleted) and 3 or more for each step up (a
    truncated row kept, a turn inserted), so that cells beyond slack / 2 and slack / 3 can't be on a way as cheap as the incumbent.
    """

    def __init__(self, letters: bytes, flags: np.ndarray):
        self.letters, self.flags, self.n = letters, flags, len(letters)
        self.base = DELETE * int((flags != PLAIN).sum())
        slack = incumbent(letters, flags) - self.base
        self.low, self.width = slack // 2, slack // 2 + slack // 3 + 1
        self.left = np.concatenate([np.cumsum((flags == PLAIN)[::-1])[::-1], [0]]).astype(np.int64)
        self.steps = np.arange(self.width, dtype=np.int64) * INSERT
        deviation = np.arange(self.width, dtype=np.int64) - self.low
        self.deviation = deviation
        # whether the letter read when k letters are left is u, for even and odd numbers of good rows
        self.user = [(deviation + s) % 2 == 0 for s in (0, 1)]
        self.stride = 1 if self.n * self.width <= CELLS else max(1, math.isqrt(self.n))
        self.kept: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}
        self.head = np.full(self.n + 1, _FAR)  # cost from row i on while the system turn is still to come
        self._fill()

    def _inserted(self, row: np.ndarray, i: int) -> np.ndarray:
        row[self.deviation < -self.left[i]] = _FAR
        return np.minimum.accumulate(row - self.steps) + self.steps

    def _before(self, after: np.ndarray, i: int) -> np.ndarray:
        """Row i of the table from row i + 1."""
        flag = self.flags[i]
        if flag in (BLANK, DUPLICATE):
            return after
        letter = self.letters[i : i + 1]
        user = self.user[self.left[i] & 1]
        wrong = (~user if letter == b"u" else user if letter == b"a" else np.ones(self.width, bool)).astype(np.int64)
        if flag == PLAIN:
            row = after + wrong
            row[self.deviation + self.left[i] < 1] = _FAR
            row[:-1] = np.minimum(row[:-1], after[1:] + DELETE)
        else:
            row = after.copy()
            taken = after[:-1] + (CUT - DELETE) + wrong[1:]
            taken[(self.deviation + self.left[i])[1:] < 1] = _FAR
            row[1:] = np.minimum(row[1:], taken)
        return self._inserted(np.minimum(row, _FAR), i)

    def _fill(self) -> None:
        row = np.full(self.width, _FAR)
        row[self.low] = 0
        row = self._inserted(row, self.n)
        self.kept[self.n] = row
        for i in range(self.n - 1, -1, -1):
            if self.letters[i : i + 1] == b"s" and self.flags[i] in (PLAIN, TRUNCATED):
                pairs = self._even(row, i + 1, 2)
                self.head[i] = row[pairs].min(initial=_FAR) + (0 if self.flags[i] == PLAIN else CUT - DELETE)
            self.head[i] = min(self.head[i], self.head[i + 1] + (DELETE if self.flags[i] == PLAIN else 0))
            row = self._before(row, i)
            if i % self.stride == 0:
                self.kept[i] = row

    def _even(self, row: np.ndarray, i: int, least: int) -> np.ndarray:
        k = self.deviation + self.left[i]
        return np.flatnonzero((k % 2 == 0) & (k >= least))

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            top = min(self.n, (i // self.stride + 1) * self.stride)
            row, self.block = self.kept[top], {}
            for j in range(top - 1, i - i % self.stride, -1):
                row = self._before(row, j)
                self.block[j] = row
        return self.block[i]

    def traced(self) -> tuple[int, str]:
        """The least cost over all lengths and, of the audits with that cost, the least."""
        first = self.row(0)
        even = self._even(first, 0, 0)
        best = int(min(first[even].min(initial=_FAR), self.head[0]))
        live = {int(t) for t in even if first[t] == best}
        waiting = self.head[0] == best
        audit, i, spent = bytearray(), 0, best
        while True:
            here = self.row(i)
            if i == self.n and any(self.deviation[t] == 0 for t in live) and spent == 0:
                return best + self.base, audit.decode()
            after = self.row(i + 1) if i < self.n else None
            flag = self.flags[i] if i < self.n else -1
            shift, gone = (1, DELETE) if flag == PLAIN else (0, 0)
            if after is not None:  # delete
                fits = {t + shift for t in live if t + shift < self.width and after[t + shift] + gone == spent}
                later = waiting and self.head[i + 1] + gone == spent
                if fits or later:
                    audit += b"D"
                    live, waiting, i, spent = fits, later, i + 1, spent - gone
                    continue
            fits = {t - 1 for t in live if t > 0 and here[t - 1] + INSERT == spent}
            if fits:
                audit += b"I"
                live, waiting, spent = fits, False, spent - INSERT
                continue
            down, extra = (0, 0) if flag == PLAIN else (1, CUT - DELETE)
            letter = self.letters[i : i + 1]
            for op, more in ((b"K", 0), (b"R", 1)):
                fits = set()
                for t in live:
                    k = self.deviation[t] + self.left[i]
                    same = letter == (b"u" if k % 2 == 0 else b"a")
                    if k >= 1 and t >= down and same == (op == b"K") and after[t - down] + extra + more == spent:
                        fits.add(t - down)
                if op == b"K" and waiting and letter == b"s" and flag in (PLAIN, TRUNCATED):
                    fits |= {int(t) for t in self._even(after, i + 1, 2) if after[t] + extra == spent}
                if fits:
                    audit += op
                    live, waiting, i, spent = fits, False, i + 1, spent - extra - more
                    break


def aligned(letters: bytes, flags: np.ndarray) -> tuple[int, str]:
    """Least cost and least audit of a conversation given by its rows' initials (u, a, s, others) and faults."""
    faulty = int((flags != PLAIN).sum())
    if incumbent(letters, flags) == DELETE * faulty:  # a band of one diagonal: each good row stays, each faulty one goes
        return DELETE * faulty, "".join("D" if f else "K" for f in flags.tolist())
    return Table(letters, flags).traced()


def prepared(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, letter, flag, digest); null roles and texts are one space."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    solid = F.rtrim("text", F.lit(_SPACE))
    flag = F.when(F.length(solid) == 0, BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), PLAIN).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("u", "a", "s"), first).otherwise("-")
    digest: Column = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), of(role).alias("role"), of(text).alias("text")).select("*", letter.alias("letter"), flag.alias("flag"), digest.alias("digest"))


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Runs of equal first columns, across batches."""
    have: list[pa.RecordBatch] = []
    key: object = None
    for batch in batches:
        column = batch.column(0)
        n = len(column)
        if not n:
            continue
        ids = column.to_pylist()
        cuts = [0, *(i for i in range(1, n) if ids[i] != ids[i - 1]), n]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if have and ids[lo] != key:
                yield key, have
                have = []
            key = ids[lo]
            have.append(batch.slice(lo, hi - lo))
    if have:
        yield key, have


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {}
    kind = None

    def made() -> pa.RecordBatch:
        arrays = [pa.array(out["conv"], kind), *(pa.array(out[c], pa.int64()) for c in COUNTS), pa.array(out["audit"], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, list(out))

    out = {c: [] for c in ("conv", *COUNTS, "audit")}
    for conv, pieces in conversations(batches):
        kind = pieces[0].schema.field(0).type
        rows = pa.Table.from_batches(pieces)
        rows = rows.filter(pc.not_equal(rows["flag"], ABSENT))
        n = rows.num_rows
        flags = rows["flag"].to_numpy().astype(np.int8)
        letters = "".join(rows["letter"].to_pylist()).encode()
        turns = [t for t in rows["turn"].to_pylist() if t is not None]
        seen: set[bytes] = set()
        for i, digest in enumerate(rows["digest"].to_pylist()):
            if digest in seen and flags[i] != BLANK:
                flags[i] = DUPLICATE
            seen.add(digest)
        cost, audit = aligned(letters, flags)
        row = (
            conv, turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0, int((flags == BLANK).sum()), int((flags == DUPLICATE).sum()), int((flags == TRUNCATED).sum()),
            sum(letters[i : i + 2] not in (b"su", b"ua", b"au") for i in range(n - 1)), cost, audit,
        )
        for column, x in zip(out.values(), row, strict=True):
            column.append(x)
        if len(out["conv"]) >= 4096:
            yield made()
            out = {c: [] for c in out}
    if out["conv"]:
        yield made()


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """For each conversation gaps, faults, illegal neighbours, cost and audit; rows are those of prepared().

    Rows go by turn, null turns first; equal turns by role and digest. `ids` (one column) names conversations that may have no
    rows: zeros and an empty audit. A null id is a conversation like others. The first fault of a row counts: blank, duplicate
    (same role and text before it), truncated. The table's time grows with rows times the band of one conversation.
    """
    narrow = rows.select("conv", "turn", "role", "letter", "flag", "digest")
    if ids is not None:
        mark = ids.distinct().select(F.col(ids.columns[0]).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit(" ").alias("role"), F.lit("-").alias("letter"), F.lit(ABSENT).alias("flag"), F.unhex(F.lit("00")).alias("digest"))
        narrow = narrow.unionByName(mark)
    ordered = narrow.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "digest").select("conv", "turn", "letter", "flag", "digest")
    return ordered.mapInArrow(_audit, f"conv {rows.schema['conv'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string")


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size, kind = 0, None
    conv, audit, at, place, odd = None, "", 0, 0, 0

    def put(role: str | None, text: str) -> None:
        nonlocal place, size
        target = "system" if odd and place == 0 else ("user", "assistant")[(place - odd) % 2]
        out.append((conv, place, target if role is None else role, text))
        size += len(text) + 32
        place += 1

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(None, "")
            at += 1

    def made() -> pa.RecordBatch:
        ids, places, roles, texts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv", "place", "role", "text"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(batch.num_rows):
            head, role, text = batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            if head == 0:
                inserted()
                conv, audit, at, place = batch.column(0)[i].as_py(), text, 0, 0
                odd = (len(audit) - audit.count("D")) % 2
            else:
                inserted()
                op, at = audit[at], at + 1
                if op != "D":
                    put(role if op == "K" else None, text)
            if size > 1 << 20:
                yield made()
                out, size = [], 0
    inserted()
    if out:
        yield made()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns (conv, place, role, text) by the audits found; within a partition by conversation and place.

    Inserted turns have an empty text. Each conversation is one run of rows in one partition, its audit before its texts.
    """
    heads = found.select("conv", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.unhex(F.lit("00")).alias("digest"))
    turns = rows.select("conv", F.lit(1).alias("head"), "turn", "role", "text", "digest")
    ordered = heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "head", F.asc_nulls_first("turn"), "role", "digest").select("conv", "head", "role", "text")
    return ordered.mapInArrow(_mended, f"conv {rows.schema['conv'].dataType.simpleString()}, place bigint, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, conv, digest = None, None, None
    for batch in batches:
        kind = batch.schema.field(0).type
        ids, hexes = [], []
        for c, place, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if place == 0:
                if digest is not None:
                    ids.append(conv)
                    hexes.append(digest.hexdigest())
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hexes, pa.string())], ["conv", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], ["conv", "sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the `role:text` lines of repaired(); conversations without turns have no row."""
    return turns.select("conv", "place", "role", "text").mapInArrow(_digest, f"conv {turns.schema['conv'].dataType.simpleString()}, sha256 string")
