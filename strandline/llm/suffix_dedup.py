"""Exact removal of repeated byte strings by suffix sorting (deep-shallow).

A byte goes if a string of `length` bytes that covers it also starts earlier. Equal strings choose equal anchors: the
leftmost k-gram with the least hash in the string. The strings of a text that follow each other and have the same anchor
are one window. Hashes only leave out what can't repeat: windows whose anchor stands nowhere else. The bytes of all
others are dealt to tasks by their anchor. There equal windows become one, and the suffixes of the different ones are
sorted over all their bytes: multikey quicksort, eight bytes a step, to a shallow depth, then blind tries for groups that
are still tied and not all alike. Neighbours in that order with equal bytes are repeats, and all but the earliest go.
An anchor that more windows share than one task should sort is split by the bytes that ever shorter runs of its strings
have in common, down to single strings, of which Spark takes the earliest by an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .textbytes import BASE, BYTE_CODES, buffers, chunks, mix

GRAM = 24
#: The longest strings whose windows fit the packed places.
LONGEST = 150
SHALLOW = 40


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of data[i : i + length] for every i, put together from hashes of powers of two."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, done, out = BYTE_CODES[data], 1, 0, None
    while True:
        if length & size:
            part = level[done : done + n]
            out = part if out is None else out + part * _power(done)
            done += size
        if size * 2 > length:
            return mix(out)
        level = level[:-size] + level[size:] * _power(size)
        size *= 2


def anchors_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` neighbours the place of its least hash, the leftmost of equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, size = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while size * 2 <= width:
        left = low[:-size] <= low[size:]
        low, at, size = np.where(left, low[:-size], low[size:]), np.where(left, at[:-size], at[size:]), size * 2
    rest = width - size
    return np.where(low[:n] <= low[rest : rest + n], at[:n], at[rest : rest + n]).astype(np.int64)


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, sorted; touching ones become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[new[1:], True]]


class BlindTrie:
    """Strings of one length ordered by branching positions only; bytes between branchings are compared once per insert."""

    def __init__(self, first: int, text: bytes, length: int):
        self.text, self.length = text, length
        self.root: list = [length, {}, [first]]  # [depth, children by byte, members of a leaf]

    def insert(self, start: int) -> None:
        text, node = self.text, self.root
        while node[1]:
            node = node[1].get(text[start + node[0]]) or next(iter(node[1].values()))
        leaf = node[2][0]
        a, b = text[start : start + self.length], text[leaf : leaf + self.length]
        if a == b:
            node[2].append(start)
            return
        depth = next(i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y)
        node, parent = self.root, None
        while node[1] and node[0] < depth:
            parent, node = node, node[1][a[node[0]]]
        if node[1] and node[0] == depth:
            node[1][a[depth]] = [self.length, {}, [start]]
            return
        branch = [depth, {b[depth]: node, a[depth]: [self.length, {}, [start]]}, []]
        if parent is None:
            self.root = branch
        else:
            parent[1][a[parent[0]]] = branch

    def classes(self) -> Iterator[list[int]]:
        """Members of each leaf, in the strings' order."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[1]:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[2]


def sorted_classes(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Places (in starts) of strings of `length` bytes that are equal to others, sorted by their bytes and then by place, and their class."""
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    eight = data.astype(np.uint64)
    for size in (1, 2, 4):
        eight = eight[:-size] << np.uint64(8 * size) | eight[size:]
    for depth in range(0, min(shallow, length) - 7, 8):
        word = eight[starts[order] + depth]
        sort = np.lexsort((word, group)) if depth else np.argsort(word, kind="stable")
        order, word, group = order[sort], word[sort], group[sort]
        new = np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])] if len(order) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        tied = np.bincount(group, minlength=1)[group] > 1
        order, group = order[tied], group[tied]
        if not len(order):
            return order, group
    first = np.r_[True, group[1:] != group[:-1]]
    group = np.cumsum(first) - 1
    lead = starts[order[first]][group]
    alike = np.ones(len(order), bool)
    for depth in range(min(shallow, length) & ~7, length, 8):  # the last word may reach back over the one before it
        depth = min(depth, length - 8)
        alike &= eight[starts[order] + depth] == eight[lead + depth]
    mixed = np.bincount(group, weights=~alike) > 0
    whole = ~mixed[group]
    found, label = [order[whole]], [group[whole]]
    text, free = data.tobytes() if mixed.any() else b"", len(first)
    bounds = np.flatnonzero(np.r_[first, True])
    for g in np.flatnonzero(mixed):
        members = order[bounds[g] : bounds[g + 1]]
        place = dict(zip(starts[members].tolist(), members.tolist(), strict=True))
        trie = BlindTrie(int(starts[members[0]]), text, length)
        for start in starts[members[1:]].tolist():
            trie.insert(start)
        for leaf in trie.classes():
            if len(leaf) > 1:
                found.append(np.array([place[x] for x in leaf]))
                label.append(np.full(len(leaf), free))
                free += 1
    return np.concatenate(found), np.concatenate(label)


def equal_classes(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> Iterator[np.ndarray]:
    """Classes of two or more starts whose strings of `length` bytes are equal, each in the order of starts."""
    order, label = sorted_classes(data, starts, length, shallow)
    bounds = np.flatnonzero(np.r_[True, label[1:] != label[:-1], True]) if len(label) else np.zeros(1, int)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield starts[order[a:b]]


def later_strings(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at starts (in order of precedence) are equal to one before them."""
    order, label = sorted_classes(data, starts, length)
    later = np.zeros(len(starts), bool)
    later[order[np.r_[False, label[1:] == label[:-1]]] if len(order) else order] = True
    return later


_MARKS = "doc long, tie long, key long, place long, hi long"
_SPANS = "doc long, tie long, lo long, hi long"
_WINDOWS = "g long, doc long, tie long, lo long, rel int, n int, bytes binary, crowded boolean"


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in columns], [x.split(" ")[0] for x in names.split(", ")])


def _merged_by_doc(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals by place of the document."""
    if not len(doc):
        return doc, lo, hi
    shift = doc.astype(np.int64) * (int(hi.max()) + 2)
    a, b = merge(lo + shift, hi + shift)
    d = a // (int(hi.max()) + 2)
    return d, a - d * (int(hi.max()) + 2), b - d * (int(hi.max()) + 2)


def _window_marks(length: int):
    """Task function: different windows of the batch (hi 0; place holds start, place of the anchor in it and number of strings), and the repeats among them as intervals."""
    width = length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            rank = np.lexsort((ties, docs))
            new = np.r_[True, (np.diff(docs[rank]) != 0) | (np.diff(ties[rank]) != 0)] if len(rank) else np.zeros(0, bool)
            batch = batch.take(pa.array(rank[new]))  # equal rows are one document
            docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            data, offsets = buffers(batch.column("text"))
            found = []
            for i, j in chunks(offsets):
                base, part = offsets[i], data[offsets[i] : offsets[j]]
                grams = rolling(part, GRAM)
                at = anchors_of(grams, width)
                if not len(at):
                    continue
                # a string must end in the text in which it starts
                ends = np.repeat(offsets[i + 1 : j + 1] - base, np.diff(offsets[i : j + 1]))[: len(at)]
                start = np.flatnonzero(np.arange(len(at)) + length <= ends)
                if not len(start):
                    continue
                first = np.flatnonzero(np.r_[True, at[start][1:] != at[start][:-1]])
                n = np.diff(np.r_[first, len(start)])
                lo, at = start[first], at[start[first]]
                found.append((grams[at], lo + base, at - lo, n))
            if not found:
                continue
            key, lo, rel, n = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.searchsorted(offsets, lo, "right") - 1
            _, back, often = np.unique(key, return_inverse=True, return_counts=True)
            again, seen, raw = np.zeros(len(key), bool), set(), data.tobytes()
            for k in np.flatnonzero(often[back] > 1).tolist():
                window = (int(rel[k]), raw[lo[k] : lo[k] + n[k] + length - 1])
                again[k] = window in seen
                seen.add(window)
            place = (lo - offsets[owner]) << 14 | rel << 7 | n
            new = ~again
            yield _batch(_MARKS, docs[owner[new]], ties[owner[new]], key[new].view(np.int64), place[new], np.zeros(int(new.sum())))
            if again.any():
                d, a, b = _merged_by_doc(owner[again], (place >> 14)[again], (place >> 14)[again] + n[again] + length - 1)
                yield _batch(_MARKS, docs[d], ties[d], np.zeros(len(d)), a, b)

    return run


def _windows(length: int):
    """Task function over documents with their open windows: the bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            sizes = batch.column("open").value_lengths().to_numpy()
            flat = batch.column("open").flatten()
            bounds = np.r_[0, np.cumsum(sizes)]
            for i, j in chunks(offsets, 1 << 22):
                some = flat.slice(bounds[i], bounds[j] - bounds[i])
                place, owner = some.field("place").to_numpy(), np.repeat(np.arange(i, j), sizes[i:j])
                lo, rel, n = place >> 14, place >> 7 & 127, place & 127
                ends = np.r_[0, np.cumsum(n + length - 1)]
                taken = data[np.repeat(offsets[owner] + lo - ends[:-1], np.diff(ends)) + np.arange(ends[-1])]
                held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken)])
                whose = pa.array(owner)
                columns = [some.field("key"), batch.column("doc").take(whose), batch.column("tie").take(whose), pa.array(lo), pa.array(rel.astype(np.int32)), pa.array(n.astype(np.int32)), held, some.field("crowded")]
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _WINDOWS.split(", ")])

    return run


def _split(size: int, length: int):
    """Task function: windows cut into runs of at most `size` strings, dealt by the bytes that all strings of such a run have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                i = 0
                while i < r["n"]:
                    low = (r["rel"] - i) // size * size  # the strings of a run hold all from here before the anchor ..
                    k = min(r["n"], r["rel"] - low + 1)
                    core = r["bytes"][r["rel"] - low : r["rel"] + length - low - size + 1]  # .. to here behind it
                    g = xxhash.xxh3_64_intdigest(core, seed=low * 1024 + size)
                    out.append({**r, "g": g - (g >> 63 << 64), "lo": r["lo"] + i, "rel": r["rel"] - i, "n": k - i, "bytes": r["bytes"][i : k + length - 1]})
                    i = k
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return run


def _repeats(length: int):
    """Group function over dealt windows: intervals of all strings that start earlier in the group too."""

    def run(table: pa.Table) -> pa.Table:
        doc, tie, lo, n = (table.column(c).to_numpy() for c in ("doc", "tie", "lo", "n"))
        order = np.lexsort((lo, tie, doc))
        same = [np.diff(x[order]) == 0 for x in (doc, tie, lo)]
        order = order[np.r_[True, ~(same[0] & same[1] & same[2])]]  # equal rows in different tasks are one document too
        doc, tie, lo, n = doc[order], tie[order], lo[order], n[order].astype(np.int64)
        data, offsets = buffers(table.column("bytes").take(pa.array(order)))
        raw, seen, new = data.tobytes(), set(), np.zeros(len(n), bool)
        for k in range(len(n)):
            window = raw[offsets[k] : offsets[k + 1]]
            new[k] = window not in seen
            seen.add(window)
        first = np.flatnonzero(new)
        row = np.repeat(first, n[first])
        within = np.arange(len(row)) - np.repeat(np.cumsum(n[first]) - n[first], n[first])
        later = later_strings(data, offsets[row] + within, length) if len(row) else np.zeros(0, bool)
        whole = np.flatnonzero(~new)
        which = np.r_[whole, row[later]]
        at = np.r_[lo[whole], (lo[row] + within)[later]]
        change = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])] if len(doc) else np.zeros(0, bool)
        place = np.cumsum(change) - 1
        d, a, b = _merged_by_doc(place[which], at, at + np.r_[n[whole], np.ones(int(later.sum()), np.int64)] + length - 1)
        lead = np.flatnonzero(change)
        return pa.Table.from_batches([_batch(_SPANS, doc[lead[d]], tie[lead[d]], a, b)])

    return run


_CUT = "struct<kept:binary,n_removed:long,n_spans:long>"
_CUT_TYPE = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.cast(pa.binary()), spans, strict=True):
        raw = text.as_py() or b""
        if found.as_py():
            flat = found.values
            lo, hi = merge(flat.field("lo").to_numpy(), flat.field("hi").to_numpy())
            edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append({"kept": kept, "n_removed": int((hi - lo).sum()), "n_spans": len(lo)})
        else:
            out.append({"kept": raw, "n_removed": 0, "n_spans": 0})
    return pa.array(out, _CUT_TYPE)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, crowd: int = 1 << 14) -> DataFrame:
    """Byte intervals to remove: doc, tie, lo, hi (may overlap), for docs keyed by keyed().

    Anchors that more than `crowd` windows share are split (see above), so that no task sorts an unbounded group.
    """
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"length must be from {GRAM} to {LONGEST}")
    rows = keyed(docs, doc_id, text).select("doc", "tie", F.col(text).alias("text")).where(F.octet_length("text") >= length)
    marks = staged(rows.mapInArrow(_window_marks(length), _MARKS))
    near = marks.where("hi > 0").select("doc", "tie", F.col("place").alias("lo"), "hi")
    often = marks.where("hi = 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > crowd).alias("crowded"))
    open_ = staged(marks.where("hi = 0").join(often, "key").groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "place", "crowded")).alias("open")))
    likely = members(open_)
    windows = staged(rows.where(likely("doc", "tie")).join(open_, ["doc", "tie"]).select("doc", "tie", "text", "open").mapInArrow(_windows(length), _WINDOWS))
    total, crowded = windows.agg(F.count("*"), F.count_if("crowded")).first()
    dealt, found = windows.where("not crowded"), [near]
    rest = windows.where("crowded")
    for size in (32, 8, 1) if crowded else ():
        split = staged(rest.mapInArrow(_split(size, length), _WINDOWS))
        sized = split.join(split.groupBy("g").agg(F.count("*").alias("held")).where("held > 1"), "g")
        if size > 1:
            dealt = dealt.unionByName(sized.where(F.col("held") <= crowd).drop("held"))
            rest = sized.where(F.col("held") > crowd).drop("held")
        else:
            firsts = sized.groupBy("bytes").agg(F.min(F.struct("doc", "tie", "lo")).alias("first"))
            later = sized.join(firsts, "bytes").where(F.struct("doc", "tie", "lo") > F.col("first"))
            found.append(later.select("doc", "tie", "lo", (F.col("lo") + length).alias("hi")))
    deals = int(total // 8192) + 1
    sorted_ = dealt.select(F.pmod("g", F.lit(deals)).alias("deal"), "doc", "tie", "lo", "n", "bytes").groupBy("deal").applyInArrow(_repeats(length), _SPANS)
    for part in found:
        sorted_ = sorted_.unionByName(part)
    return sorted_


def members(marks: DataFrame, buckets: int = 1024):
    """A column function of (doc, tie): false only for documents without marks.

    It is a bitmap of buckets * 32768 hashed bits (4 MB), whatever the input's size, and keeps texts that have nothing to
    join out of a shuffle. The more documents have marks, the less it leaves out; results do not depend on it.
    """
    spot = F.pmod(F.xxhash64("doc", "tie"), F.lit(buckets * 32768))
    rows = marks.select(F.floor(spot / 32768).cast("int").alias("bucket"), F.pmod(spot, F.lit(32768)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((buckets, 4096), np.uint8)
    for r in rows:
        bits[r.bucket] = np.frombuffer(bytes(r.bits), np.uint8)
    held = marks.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def probe(spots: pa.Array) -> pa.Array:
        at = spots.to_numpy()
        return pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    udf = F.arrow_udf(probe, "boolean")
    return lambda doc, tie: udf(F.pmod(F.xxhash64(doc, tie), F.lit(buckets * 32768)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with doc (the id, null first) and tie: 0, or the text's hash where some id repeats."""
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"))
    repeats = not ids.groupBy("doc").count().where("count > 1").isEmpty()
    return docs.withColumns({"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "tie": F.xxhash64(text) if repeats else F.lit(0).cast("long")})


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """Per row: doc_id, n_bytes, and cut (kept bytes, n_removed, n_spans).

    Order is that of doc_id (null first), then start. Rows with the same id are told apart by their texts' hashes; rows
    equal in both are one document and get the same answer. Null and empty texts, and those shorter than length, keep
    everything. What is removed was found equal byte by byte.
    """
    found = staged(spans(docs, doc_id, text, length).groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    rows = keyed(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), "doc", "tie", F.coalesce(F.col(text), F.lit("")).alias("text"))
    likely = members(found)
    cut = F.arrow_udf(_cut, _CUT).asNondeterministic()
    some = rows.where(likely("doc", "tie")).join(found, ["doc", "tie"], "left").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut("text", "spans").alias("cut"))
    intact = F.struct(F.col("text").cast("binary").alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    return some.unionByName(rows.where(~likely("doc", "tie")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), intact.alias("cut")))
