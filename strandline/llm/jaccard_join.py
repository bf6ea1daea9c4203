"""N-gram Jaccard join by parity sketches.

Each document is the set of its distinct n-word shingles. A set is hashed into a sketch of 64 x P bits in which every
shingle flips one bit; flips of shared shingles cancel, so the Hamming distance of two sketches is at most the size of
the sets' symmetric difference. Sets linked at a similarity of num/den differ in at most (a+b)(den-num)/(den+num)
shingles. Within a size band P exceeds that bound by one and some slack, so linked sets have slack + 1 parts or more in
which they hold the very same shingles (pigeonhole): the part's 64 parities and the XOR of its shingles' hashes agree,
and an equi-join on (band, part, parities, XOR) finds every link. Parts without a shingle say little; a set gives them
as keys only if it has more of them than the slack, as otherwise a linked set agrees with it in a part that has some.
Candidates whose folded sketches lie too far apart go (folds of large sets have a bit for each shingle); the others are
verified on the real sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import free, partitions, scratch, small_batches, staged
from .textbytes import mix, shingle_sets

#: 64-bit words of the folded sketch.
FOLD = 8
#: Texts whose keys are dealt together: few enough for their keys to stay small, and four times as many fit 16 bits.
TOGETHER = 1 << 12
#: Bytes of text for each group of dealt keys.
DEAL_BYTES = 1 << 24


class Bands:
    """Size bands such that linked sets lie in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lows = num, den, [1]

    def of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * self.den // self.num + 1))
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def differing(self, band: int) -> int:
        """The largest symmetric difference of linked sets up to this band."""
        while len(self.lows) < band + 2:
            self.of(self.lows[-1])
        return 2 * (self.lows[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def slack(self, band: int) -> int:
        """Parts beyond the one that linked sets must share; enough that few sets have more empty parts."""
        return (self.differing(band) + 4) // 8

    def parts(self, band: int) -> int:
        return self.differing(band) + 1 + self.slack(band)

    def wide(self, band: int) -> int:
        """Words of the wide fold: about a bit for each shingle, as FOLD words say nothing of large sets; 0 where FOLD words do."""
        words = FOLD
        while words * 64 < self.lows[band]:
            words *= 2
        return words if words > FOLD else 0


def sketch(members: np.ndarray, parts: int) -> np.ndarray:
    """Parities of a set's members over 64 x parts bits, as 64-bit parts."""
    bits = np.bincount(((members >> np.uint64(6)) % np.uint64(parts)).astype(np.int64) * 64 + (members & np.uint64(63)).astype(np.int64), minlength=64 * parts)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.uint64)


def part_sums(members: np.ndarray, parts: int, slack: int) -> np.ma.MaskedArray:
    """XOR of 32 hash bits of the members in each part; empty parts are masked unless there are more than slack."""
    at = ((members >> np.uint64(6)) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(parts, np.uint32)
    np.bitwise_xor.at(sums, at, (members >> np.uint64(32)).astype(np.uint32))
    empty = np.bincount(at, minlength=parts) == 0
    return np.ma.array(sums.view(np.int32), mask=empty & (empty.sum() <= slack))


def part_keys(members: np.ndarray, bands: Bands, band: int) -> np.ndarray:
    """Hashes of (band, part, parities, XOR) of a set's parts in a band."""
    parts = bands.parts(band)
    sums = part_sums(members, parts, bands.slack(band))
    place = np.uint64(band << 32) + np.arange(parts, dtype=np.uint64)
    keys = mix(mix(sketch(members, parts) + mix(place)) ^ sums.data.view(np.uint32).astype(np.uint64))
    return keys[~np.ma.getmaskarray(sums)]


def folded(parts: np.ndarray, words: int = FOLD) -> np.ndarray:
    """A sketch XOR-folded to some parts; its Hamming distances are at most those of the sketch."""
    out = np.zeros(words, np.uint64)
    for k in range(min(words, len(parts))):
        out[k] = np.bitwise_xor.reduce(parts[k::words])
    return out


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text")).where("text is not null")


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Node and shingle set of each different text of a batch that has words."""
    seen = set()
    for node, members in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
        if len(members) and node not in seen:
            seen.add(node)
            yield node, members


_DEALT = "deal int, kind int, batch long, keys binary, spots binary"
_ENTRIES = "key long, batch long, spot int, node long"


def _dealt_keys(n: int, num: int, den: int, bits: int):
    """Task function: the keys of a batch of texts, packed by the deal that the first `bits` of a key name.

    kind 0 holds each key once, by its next 32 bits and a spot: place of the text in the batch, lane, and whether more
    texts of the batch have the key; kind 1 those further texts, with whole keys, dealt anywhere, so that a common key
    brings one entry a batch to its deal; kind 2 the nodes of the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                nodes, keys, spots = [], [], []
                for node, members in _sets(whole.slice(at, TOGETHER), n):
                    own = bands.of(len(members))
                    for lane in (0, 1):
                        found = part_keys(members, bands, own + lane)
                        keys.append(found)
                        spots.append(np.full(len(found), len(nodes) * 4 + lane * 2, np.uint16))
                    nodes.append(node)
                if not nodes:
                    continue
                key, spot = np.concatenate(keys) >> np.uint64(32 - bits), np.concatenate(spots)
                del keys, spots
                order = np.argsort(key, kind="stable")
                key, spot = key[order], spot[order]
                first = np.r_[True, key[1:] != key[:-1]]
                many = np.diff(np.r_[np.flatnonzero(first), len(key)]) > 1
                once, lead = key[first], spot[first] | many.astype(np.uint16)
                deal = (once >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1], True])
                held = np.array(nodes, np.int64)
                batch = xxhash.xxh3_64_intdigest(held.tobytes()) >> 1
                anywhere = batch % (1 << bits)
                rows = [(int(deal[a]), 0, once[a:b].astype(np.uint32).tobytes(), lead[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                rows += [(anywhere, 1, key[~first].tobytes(), spot[~first].tobytes()), (anywhere, 2, held.tobytes(), b"")]
                columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([batch] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["deal", "kind", "batch", "keys", "spots"])

    return run


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """Group function: entries of keys that more than one text has, and the texts of batches (without a key)."""
    kind, batch = table.column("kind").to_numpy(), table.column("batch").to_numpy()
    packed, places = table.column("keys").to_pylist(), table.column("spots").to_pylist()
    out_key, out_batch, out_spot = [], [], []
    blocks = np.flatnonzero(kind == 0)
    if len(blocks):
        low = np.frombuffer(b"".join(packed[k] for k in blocks), np.uint32)
        spot = np.frombuffer(b"".join(places[k] for k in blocks), np.uint16)
        source = np.repeat(batch[blocks], [len(packed[k]) // 4 for k in blocks])
        order = np.argsort(low, kind="stable")
        low, spot, source = low[order], spot[order], source[order]
        group = np.cumsum(np.r_[True, low[1:] != low[:-1]]) - 1
        shared = (np.bincount(group)[group] > 1) | (spot & 1 == 1)
        out_key.append(low[shared].astype(np.int64) | key[0].as_py() << 32)
        out_batch.append(source[shared])
        out_spot.append(spot[shared])
    for k in np.flatnonzero(kind == 1):
        out_key.append(np.frombuffer(packed[k], np.int64))
        out_spot.append(np.frombuffer(places[k], np.uint16))
        out_batch.append(np.full(len(out_spot[-1]), batch[k]))
    entries = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (out_key, out_batch, out_spot)]
    names, of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(kind == 2):
        names.append(np.frombuffer(packed[k], np.int64))
        of.append(np.full(len(names[-1]), batch[k]))
        at.append(np.arange(len(names[-1])))
    n, m = len(entries[0]), sum(map(len, names))
    return pa.table({
        "key": pa.concat_arrays([pa.array(entries[0]), pa.nulls(m, pa.int64())]), "batch": pa.array(np.concatenate([entries[1], *of])),
        "spot": pa.array(np.concatenate([entries[2], *at]).astype(np.int32)), "node": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate(names))]),
    })


def _shared(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """key, lane, node: for each key that several different texts have, those texts.

    Keys have 32 bits beyond those that name their deal, and deals follow the amount of text, so at every size few keys
    meet by accident; what meets is verified later.
    """
    rows = _rows(docs, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(30, int(np.ceil(np.log2(max(partitions(docs), size / DEAL_BYTES, 1)))))
    met = staged(rows.mapInArrow(_dealt_keys(n, num, den, bits), _DEALT).groupBy("deal").applyInArrow(_met, _ENTRIES))
    names = met.where("key is null").select("batch", F.col("spot").alias("place"), "node").distinct()
    entries = met.where("key is not null").select("key", "batch", F.shiftright("spot", 2).alias("place"), F.shiftright("spot", 1).bitwiseAND(F.lit(1)).alias("lane"))
    return entries.join(names, ["batch", "place"]).select("key", "lane", "node").distinct()


_ABOUT = ("n_shingles", "band", "folds", "wide", "own")


def _about(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """node, n_shingles, band, folds and wide folds (of the sketches in its band and the next; own: words of the first) of each different text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            rows, wide = [], []
            for node, members in _sets(batch, n):
                band = bands.of(len(members))
                sketches = [sketch(members, bands.parts(band + k)) for k in (0, 1)]
                rows.append((node, len(members), band, bands.wide(band), np.concatenate([folded(x) for x in sketches])))
                wide.append(np.concatenate([np.zeros(0, np.uint64), *(folded(x, w) for k, x in enumerate(sketches) if (w := bands.wide(band + k)))]))
            flat = np.concatenate([np.zeros(0, np.uint64), *[r[4] for r in rows]]).view(np.int64)
            folds = pa.FixedSizeListArray.from_arrays(pa.array(flat), 2 * FOLD).cast(pa.list_(pa.int64()))
            ends = np.cumsum([0, *map(len, wide)]).astype(np.int32)
            wides = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *wide]).view(np.int64)))
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), folds, wides, pa.array([r[3] for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["node", *_ABOUT])

    found = _rows(docs, text).mapInArrow(run, "node long, n_shingles long, band int, folds array<long>, wide array<long>, own int")
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in _ABOUT])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose shingle sets have the similarity."""
    texts = staged(_rows(docs, text).join(_ends(pairs), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for b, left, right in zip(batch.column("b").to_pylist(), shingle_sets(batch.column("text_a"), n), batch.column("text_b"), strict=True):
                if b != last:
                    last, held = b, next(shingle_sets(pa.array([right.as_py()]), n))
                shared = len(np.intersect1d(left, held, assume_unique=True))
                keep.append(den * shared >= num * (len(left) + len(held) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame, text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """For each different text with words: node (xxhash64 of the text), n_shingles, label (its component's smallest node).

    Two texts link when den * intersection >= num * union of their distinct n-word shingles (whole texts). Equal texts
    are one node, so groups of copies are never expanded. Every bucket of equal sketch parts has a lead, its smallest
    node. A text is compared first with the lead that it meets most often, then with those of its leads that are in
    another component, and last buckets whose members are still in different components compare those, so no link
    between components is lost. Pairs come to the exact comparison only if their sizes and folded sketches allow a link.
    Null and empty texts and texts of white space have no node. The tables made on the way are deleted.
    """
    with scratch(docs.sparkSession) as kept:
        return kept(_grouped(docs, text, n, num, den))


def _grouped(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    with small_batches(docs.sparkSession):
        shared = staged(_shared(docs, text, n, num, den))
        about = staged(_about(docs, text, n, num, den))
    leads = shared.groupBy("key").agg(F.min("node").alias("lead"))
    spokes = shared.join(leads, "key").where("node <> lead").groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("common"))
    spokes = staged(spokes)
    first = spokes.groupBy("a").agg(F.max(F.struct("common", "b")).alias("best")).select("a", F.col("best.b").alias("b"))

    def close_by(x: Column, y: Column, bits: Column) -> Column:
        """Whether so many bits of difference allow sets of sizes x and y to link."""
        return (den + num) * bits <= (den - num) * (x + y)

    def possible(x: Column, y: Column, folds: list[tuple[Column, Column]]) -> Column:
        """Whether sizes x and y and folded sketches allow a link."""
        return (den * F.least(x, y) >= num * F.greatest(x, y)) & close_by(x, y, sum((F.bit_count(p.bitwiseXOR(q)) for p, q in folds), F.lit(0)))

    def found(pairs: DataFrame) -> DataFrame | None:
        """The links among pairs, None if there are none."""
        left, right = (about.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in _ABOUT]) for x in "ab")

        def fold(k: int, x: str, y: str) -> Column:
            return F.get(f"folds_{x}", F.when(F.col(f"band_{x}") < F.col(f"band_{y}"), FOLD).otherwise(0) + k)

        near = possible(F.col("n_shingles_a"), F.col("n_shingles_b"), [(fold(k, "a", "b"), fold(k, "b", "a")) for k in range(FOLD)])

        def lane(x: str, y: str) -> Column:
            """The wide fold of x in the band that it shares with y."""
            upper = F.slice(f"wide_{x}", F.col(f"own_{x}") + 1, F.greatest(F.size(f"wide_{x}") - F.col(f"own_{x}"), F.lit(0)))
            return F.when(F.col(f"band_{x}") < F.col(f"band_{y}"), upper).otherwise(F.slice(f"wide_{x}", F.lit(1), F.col(f"own_{x}")))

        bits = F.aggregate(F.zip_with(lane("a", "b"), lane("b", "a"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
        wide_near = close_by(F.col("n_shingles_a"), F.col("n_shingles_b"), bits)
        close = staged(pairs.join(left, "a").join(right, "b").where((F.abs(F.col("band_a") - F.col("band_b")) <= 1) & near & wide_near).select("a", "b"))
        if close.isEmpty():
            return None
        links = staged(_verified(close, docs, text, n, num, den))
        return None if links.isEmpty() else links

    def labelled(rows: DataFrame, node: str, out: str) -> DataFrame:
        named = labels.select(F.col("node").alias("_n"), F.col("label").alias(out))
        return rows.join(named, F.col(node) == F.col("_n"), "left").withColumn(out, F.coalesce(out, F.col(node))).drop("_n")

    none = docs.sparkSession.createDataFrame([], "a long, b long")
    links = found(first) or none
    labels = components(links)
    apart = labelled(labelled(spokes.select("a", "b"), "a", "label_a"), "b", "label_b").where("label_a <> label_b").select("a", "b")
    if (more := found(apart.join(first, ["a", "b"], "left_anti"))) is not None:
        links = links.unionByName(more)
        labels = components(links)
    rows = labelled(shared, "node", "label")
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    folds = [f"f{k}" for k in range(FOLD)]
    sized = about.select("node", "n_shingles", "folds")
    open_ = rows.join(mixed, "key", "left_semi").join(sized, "node")
    open_ = staged(open_.select("key", "node", "n_shingles", "label", *[F.get("folds", F.col("lane") * FOLD + k).alias(f) for k, f in enumerate(folds)]))
    other = open_.select(F.col("key").alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in ("node", "n_shingles", "label", *folds)])
    far = (F.col("label") != F.col("label_b")) & (F.col("node") > F.col("node_b")) & possible(F.col("n_shingles"), F.col("n_shingles_b"), [(F.col(f), F.col(f"{f}_b")) for f in folds])
    rest = open_.join(other, (F.col("key") == F.col("key_b")) & far).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    if (more := found(rest.join(spokes.select("a", "b"), ["a", "b"], "left_anti"))) is not None:
        labels = components(links.unionByName(more))
    return staged(about.select("node", "n_shingles").join(labels, "node", "left").select("node", "n_shingles", F.coalesce("label", "node").alias("label")))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included).

    Documents without words have n_shingles 0 and stand alone. A null doc_id takes part but never names a component
    that has another; repeated rows each return a row. Extra columns are ignored. No rows in, no rows out.
    """
    groups = jaccard_groups(docs, text, n, num, den)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"))
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    # the smallest id of each component, by node
    named = groups.join(least, "node")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    nodes = groups.join(ids, "label").select("node", "n_shingles", "component_id")
    return rows.join(nodes, "node", "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row left of each component: the smallest doc_id, ties by the text's hash, then one of equal rows.

    Rows without words are kept. Columns stay as they are.
    """
    groups = jaccard_groups(docs, text, n, num, den)
    node, row, other, kept, times = free(docs, "_node", "_row", "_other", "_kept", "_times")
    keyed = docs.withColumns({node: F.xxhash64(text), row: F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])})
    rank = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("d"), F.col(node).alias("t"), F.col(row).alias("r"))
    rows = keyed.select(F.col(node).alias("node"), F.col(row).alias("row"), rank.alias("rank")).groupBy("node", "row").agg(F.min("rank").alias("rank"), F.count("*").alias("times"))
    firsts = rows.join(groups, "node").groupBy("label").agg(F.min(F.struct("rank", "times")).alias("first"))
    chosen = groups.join(firsts, "label").select(F.col("node").alias(other), F.when(F.col("first.rank.t") == F.col("node"), F.col("first.rank.r")).alias(kept), F.col("first.times").alias(times))
    chosen = staged(chosen)
    left = keyed.join(chosen, F.col(node) == F.col(other), "left").where(F.col(times).isNull() | (F.col(row) == F.col(kept)))
    if chosen.where(F.col(kept).isNotNull() & (F.col(times) > 1)).isEmpty():
        return left.select(*docs.columns)
    once = left.where(F.col(times).isNotNull()).dropDuplicates([node, row])
    return left.where(F.col(times).isNull()).select(*docs.columns).unionByName(once.select(*docs.columns))
