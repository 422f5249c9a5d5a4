"""N-gram Jaccard join over size-banded tiles with bitmap signatures (operator 11).

A document's set: the distinct shingles of ``width`` words of its text with A-Z lower-cased (fewer words: all of
them as one; none: the empty set, linked with nothing). Two sets link at ``100 * |A & B| >= percent * |A | B|``.
The links are exact, but for collisions of 56-bit hashes of different shingles within one pair.

1. *Sets.* Each text becomes the sorted codes of its shingles: a byte for how frequent the shingle is, by a table of
   counts of fixed size over all documents, then 56 bits of its hash. Any order that all documents share would be right;
   this one puts rare shingles first. Equal sets are one class (128-bit digest): copies cost no comparison.
2. *Prefixes.* Linked sets share one of the first ``n - ceil(percent n / 100) + 1`` shingles of each. Sizes are cut into
   bands such that links never leave neighbouring bands; only classes that share a prefix shingle with a class of a
   near band go on. Shingles of a passage that a third of the documents hold stand last and meet nothing. Of shingles
   that the same classes share, one stands for all.
3. *Leaders.* In each (shingle, band) every class is checked against one leader of the band and one of the band below.
   These links, a few rows per class, give first components.
4. *Tiles.* What is left to decide are pairs of different components. Shingles whose classes lie in one component
   go; the others form tiles of (shingle, band), cut into blocks, each pair of blocks a group of its own. In a
   tile, bit counts of hashed bitmaps bound the overlap of all pairs from above in arrays; only pairs that may
   link and lie in different components can leave it. In a first round just each component's best pair does, which joins
   almost all that belong together; a second round, over the tiles that are still mixed, emits all that is left.
5. *Check.* Candidates are bounded by bit counts; those that pass are decided by intersecting their sorted arrays,
   which only their texts are scanned for again.
6. Components over all links, mapped back to the documents by their class.

Defined cases: a null or blank text has the empty set and its own id as component; rows with a null id are
returned and link (null only where no reachable row has an id); repeated rows repeat in the result; different texts
of one id are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.groups import group_starts, whole_groups

from .common import WordTable, pick, range_hash, slices, stored, utf8
from .simhash import components

WIDTH, PERCENT = 5, 80
COUNT_BITS, COUNT_BLOCK = 21, 1 << 16  # the table of counts has 2**21 entries at every size of the corpus; slots in a block of it
TILE_ROWS = 2048
SMALL_KEYS = 1_000_000  # 64-bit keys in a broadcast at most; more meet in a shuffle join
MAX_BITMAP = 16384  # bits; a wider set fills its bitmap, which loosens the bound and changes no result


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of ``n`` shares at least with any set it links to."""
    return (percent * n + 99) // 100


def band_starts(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands: a set and the greatest set it can link to lie in neighbouring bands at most."""
    starts = [1, 2]
    while starts[-1] < largest:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    return np.array(starts, dtype=np.int64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, with repeats, and the first one's place per text (the total last)."""
    t = WordTable([x.lower() for x in texts])
    n_words = np.diff(t.first)
    at, last = np.arange(len(t.hash)), np.repeat(t.first[1:], n_words)
    fits = (at + width <= last) | ((at == np.repeat(t.first[:-1], n_words)) & (last - at < width))
    at = at[fits]
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    return range_hash(t.hash, at, np.minimum(at + width, last[fits])), np.concatenate([[0], np.cumsum(n)])


def text_sets(texts: list[bytes], width: int, counts: np.ndarray) -> list[np.ndarray]:
    """The set of each text: its distinct shingles' codes, sorted, rare ones first."""
    h, first = shingle_hashes(texts, width)
    codes = (counts[_slot(h)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(codes[lo:hi])
        new = np.empty(len(own), dtype=bool)
        new[:1] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
    return out


def set_id(codes: np.ndarray) -> bytes:
    return blake2b(codes.tobytes(), digest_size=16).digest()


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packed blocks (sorted by block), as they stream by."""
    block, total = None, np.zeros(COUNT_BLOCK, dtype=np.int64)
    for b in batches:
        for k, packed in zip(b.column("block").to_pylist(), b.column("packed").to_pylist(), strict=True):
            if block is not None and k != block:
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "packed": pa.array([_packed(total)])})
                total = np.zeros(COUNT_BLOCK, dtype=np.int64)
            block = k
            total = total + np.frombuffer(zlib.decompress(packed), dtype=np.int64)
    if block is not None:
        yield pa.record_batch({"block": pa.array([block], pa.int32()), "packed": pa.array([_packed(total)])})


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles per slot of the table of counts, as rounded logarithms. Each task sends its table as packed blocks, which
    are added in two steps, so that a block's sum is spread over tasks first."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for b in batches:
            texts = utf8(b.column("text"))
            for lo, hi in slices(texts):
                total += np.bincount(_slot(shingle_hashes(texts[lo:hi], width)[0]), minlength=len(total))
        rows = [(k, _packed(x)) for k, x in enumerate(total.reshape(-1, COUNT_BLOCK)) if x.any()]
        task = TaskContext.get().partitionId() % 64
        yield pa.record_batch({"block": pa.array([k for k, _ in rows], pa.int32()), "part": pa.array([task] * len(rows), pa.int32()),
                               "packed": pa.array([p for _, p in rows], pa.binary())})

    parts = docs.select("text").mapInArrow(scan, "block int, part int, packed binary")
    some = parts.repartition("block", "part").sortWithinPartitions("block", "part").select("block", "packed").mapInArrow(
        _add_blocks, "block int, packed binary")
    blocks = some.repartition("block").sortWithinPartitions("block").mapInArrow(_add_blocks, "block int, packed binary")
    out = np.zeros((1 << COUNT_BITS) // COUNT_BLOCK * COUNT_BLOCK, dtype=np.uint8).reshape(-1, COUNT_BLOCK)  # bounded
    for r in blocks.collect():
        out[r["block"]] = np.rint(4 * np.log2(np.frombuffer(zlib.decompress(bytes(r["packed"])), dtype=np.int64) + 1.0))
    return out.ravel()


def document_sets(docs: DataFrame, counts: Broadcast, width: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_hash, n, set_id (null: the empty set), cls (its first 64 bits), band; and where
    a slice of texts holds the set for the first time, its prefix and bitmap."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    starts = band_starts(percent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for lo, hi in slices(texts):
                sets = text_sets(texts[lo:hi], width, counts.value)
                n = np.array([len(x) for x in sets], dtype=np.int64)
                ids = [set_id(x) if len(x) else None for x in sets]
                seen: set[bytes | None] = {None}
                fresh = [not (i in seen or seen.add(i)) for i in ids]
                size = np.where(fresh, n - least_overlap(n, percent) + 1, 0)  # one at least for a set
                prefix = [x[:k] for x, k in zip(sets, size.tolist(), strict=True)]
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").slice(lo, hi - lo), "text_hash": b.column("text_hash").slice(lo, hi - lo),
                    "n": n, "set_id": pa.array(ids, pa.binary()),
                    "cls": np.frombuffer(b"".join((i or bytes(16))[:8] for i in ids), dtype=np.int64),
                    "band": np.searchsorted(starts, n, "right").astype(np.int32),
                    "prefix": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32),
                                                       np.concatenate([*prefix, np.zeros(0, dtype=np.uint64)]).view(np.int64)),
                    "bits": pa.array([bitmap(x).tobytes() if f else None for x, f in zip(sets, fresh, strict=True)], pa.binary())})

    return docs.mapInArrow(scan, f"doc_id {id_type}, text_hash long, n long, set_id binary, cls long, band int, "
                                 "prefix array<bigint>, bits binary")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(h, cls, band): the prefix shingles that several classes of one band or of neighbouring bands share; one shingle
    for each set of classes."""
    keys = sets.where("bits is not null").select(F.explode("prefix").alias("h"), "cls", "band")
    bands = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("band") % 64)).alias("bands")
    near = F.col("bands").bitwiseAND(F.call_function("shiftleft", F.col("bands"), F.lit(1)).bitwiseOR(
        F.call_function("shiftrightunsigned", F.col("bands"), F.lit(63)))) != 0
    met = keys.groupBy("h").agg(F.count("*").alias("n"), bands).where((F.col("n") > F.bit_count("bands")) | near).select("h")
    # stored: the joins meet on plain tables, which lets them split a hot shingle
    # by sorting at every size: the plan does not change with the data, nor does what it shuffles per row
    rows = stored(keys.join(stored(met, "met").hint("merge"), "h", "left_semi").distinct(), "met_rows")
    of_band = rows.groupBy("h", "band").agg(F.count("*").alias("n"))
    every = of_band.groupBy("h").agg(F.collect_list(F.struct("band", "n")).alias("bands"))  # as many as there are bands
    good = F.filter("bands", lambda b: (b["n"] > 1) | F.exists("bands", lambda c: F.abs(c["band"] - b["band"]) == 1))
    good = stored(every.select("h", F.explode(good).alias("b")).select("h", "b.band"), "met_bands")
    shared = stored(rows.join(good.hint("merge"), ["h", "band"], "left_semi").select("h", "cls", "band"), "shared_rows")
    who = [F.bit_xor(F.xxhash64(F.lit(i), "cls")).alias(f"who{i}") for i in (0, 1)]
    one = shared.groupBy("h").agg(F.count("*").alias("n"), *who).groupBy("n", "who0", "who1").agg(F.min("h").alias("h")).select("h")
    return stored(shared.join(stored(one, "one_of_each").hint("merge"), "h", "left_semi"), "shared")


def bitmap(h: np.ndarray) -> np.ndarray:
    """Bitmap of a set: one bit per hash, at least eight bits of width per shingle up to ``MAX_BITMAP``."""
    bits = min(MAX_BITMAP, max(64, 1 << int(8 * len(h) - 1).bit_length()))
    flags = np.zeros(bits, dtype=bool)
    flags[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def same_width(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of 64-bit values, the wider ones folded to the narrowest width."""
    least = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, least), axis=0) for m in maps]).view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> int:
    both = same_width([a, b])
    return int(np.bitwise_count(both[0] ^ both[1]).sum())


def may_link(apart: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of the given sizes may link when ``apart`` bits of their bitmaps differ: every such bit is a
    shingle of one set alone, which bounds the overlap from above."""
    overlap = np.minimum((n_a + n_b - apart) // 2, np.minimum(n_a, n_b))
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted arrays without repeats) link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    overlap = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * overlap >= percent * (len(a) + len(b) - overlap)


def _checked_small(keys: DataFrame, name: str) -> DataFrame:
    """Distinct 64-bit keys, stored; to be broadcast only where there are at most ``SMALL_KEYS`` of them."""
    keys = stored(keys.distinct(), name)
    return F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys


class Checker:
    """Decides candidate pairs of classes: ``light`` holds (cls, set_id, text_hash, n, bits), ``docs`` the texts."""

    def __init__(self, docs: DataFrame, light: DataFrame, counts: Broadcast, width: int, percent: int):
        self.docs, self.light, self.counts, self.width, self.percent = docs, light, counts, width, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b): the linked pairs among candidates (a, b), as set ids."""
        near = stored(self._bounded(pairs), "bounded")
        arrays = stored(self._arrays(near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()), "arrays")
        for side in "ab":
            near = near.join(arrays.select(F.col("set_id").alias(side), F.col("codes").alias(f"codes_{side}")).hint("merge"), side)
        percent = self.percent

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [[np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in ("codes_a", "codes_b")]
                keep = pa.array([linked(x, y, percent) for x, y in zip(*both, strict=True)], pa.bool_())
                yield batch.select(["a", "b"]).filter(keep)

        return near.mapInArrow(exact, "a binary, b binary")

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        sided, percent = pairs.select("a", "b").distinct(), self.percent
        own = self.light.select("cls", "set_id", "n", "bits")
        for side in "ab":
            sided = sided.join(own.select(*[F.col(c).alias(side if c == "cls" else f"{c}_{side}") for c in own.columns]).hint("merge"), side)

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                maps = [[np.frombuffer(x, dtype=np.uint8) for x in batch.column(c).to_pylist()] for c in ("bits_a", "bits_b")]
                apart = [differing(x, y) for x, y in zip(*maps, strict=True)]
                keep = may_link(np.array(apart, dtype=np.int64), n_a, n_b, percent)
                yield pa.record_batch({c: batch.column(f"set_id_{c}").filter(pa.array(keep)) for c in "ab"})

        return sided.where("set_id_a <> set_id_b").mapInArrow(bound, "a binary, b binary")

    def _arrays(self, wanted: DataFrame) -> DataFrame:
        """(set_id, codes) of the wanted sets, from their texts."""
        hashes = _checked_small(self.light.join(wanted, "set_id", "left_semi").select("text_hash"), "text_hashes")
        texts = self.docs.join(hashes, "text_hash", "left_semi").select("text")
        width, counts = self.width, self.counts

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = utf8(b.column("text"))
                for lo, hi in slices(texts):
                    own = {set_id(x): x.tobytes() for x in text_sets(texts[lo:hi], width, counts.value) if len(x)}
                    yield pa.record_batch({"set_id": pa.array(list(own), pa.binary()), "codes": pa.array(list(own.values()), pa.binary())})

        rows = texts.mapInArrow(scan, "set_id binary, codes binary")
        return rows.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])


def leader_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): in each (shingle, band) every class with the least class of the band and of the band below."""
    least = shared.groupBy("h", "band").agg(F.min("cls").alias("leader"))
    both = least.select("h", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "leader")
    return shared.join(both, ["h", "band"]).where("leader <> cls").select(
        F.least("leader", "cls").alias("a"), F.greatest("leader", "cls").alias("b"))


def tile_pairs(shared: DataFrame, light: DataFrame, roots: DataFrame, percent: int, tile_rows: int, whole: bool) -> DataFrame:
    """(a, b): classes of different components that meet in a tile and may link by their bitmaps; without ``whole``
    one pair per component and tile."""
    named = light.join(roots, "set_id", "left").select(
        "cls", "n", "bits", F.xxhash64(F.coalesce("root", "set_id")).alias("comp"))
    placed = stored(shared.join(named.select("cls", "comp").hint("merge"), "cls"), "placed")
    mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    rows = stored(placed.join(mixed, "h"), "mixed")
    sizes = rows.groupBy("h", "band").agg(F.count("*").alias("size"))
    # a tile holds its band (side 0) and the band below (side 1); each side is cut into blocks
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / tile_rows).cast("int")).select("h", "band", "blocks")
    own = rows.join(sizes, ["h", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    below = sizes.select("h", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    above = sizes.select("h", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    own = own.join(below, ["h", "band"], "left").join(above, ["h", "band"], "left")

    def tasks(upto: str, kind: str):
        return F.when(F.col(upto).isNotNull(), F.transform(F.sequence(F.lit(0), F.col(upto) - 1), lambda j: F.struct(
            F.lit(kind).alias("kind"), F.col("band").alias("at"), j.alias("x"), F.col("block").alias("y"))))

    inside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.lit("in").alias("kind"), F.col("band").alias("at"), F.least(j, "block").alias("x"), F.greatest(j, "block").alias("y")))
    down = tasks("below", "cross")
    up = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(
        F.lit("cross").alias("kind"), (F.col("band") + 1).alias("at"), F.col("block").alias("x"), j.alias("y"))))
    empty = F.expr("array()").cast("array<struct<kind:string,at:int,x:int,y:int>>")
    every = F.concat(inside, F.coalesce(down, empty), F.coalesce(up, empty))
    dealt = own.withColumn("t", F.explode(every)).select(
        F.xxhash64("h", "t.kind", "t.at", "t.x", "t.y").alias("task"), "cls",
        # -1: compared with all of the task; else only with the other side
        F.when(F.col("t.kind") == "cross", F.when(F.col("t.at") == F.col("band"), 0).otherwise(1))
        .when(F.col("t.x") == F.col("t.y"), -1).otherwise(F.when(F.col("block") == F.col("t.x"), 0).otherwise(1)).alias("side"))
    alone = dealt.groupBy("task").agg(F.count("*").alias("k"), F.min("side").alias("s"), F.max("side").alias("e")).where(
        "k > 1 and (s = -1 or s <> e)").select("task")
    dealt = dealt.join(alone, "task").join(named.select("cls", "n", "bits", "comp").hint("merge"), "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["task"]):
            cls, side, n, comp = (t.column(c).to_numpy() for c in ("cls", "side", "n", "comp"))
            bits = [np.frombuffer(x, dtype=np.uint8) for x in t.column("bits").to_pylist()]
            a, b = [], []
            edges = np.append(group_starts(t, ["task"]), t.num_rows).tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = slice(lo, hi)
                x, y = (compare_all if whole else compare_best)(same_width(bits[at]), side[at], n[at], comp[at], percent)
                a.append(np.minimum(cls[at][x], cls[at][y]))
                b.append(np.maximum(cls[at][x], cls[at][y]))
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long")


def _near(i: int, maps: np.ndarray, side: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows after ``i`` that may link to it from another component, and the bits that differ."""
    at = np.arange(i + 1, len(n))
    at = at[(comp[at] != comp[i]) & ((side[at] != side[i]) | (side[at] < 0))]
    at = at[100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])]
    apart = np.bitwise_count(maps[at] ^ maps[i]).sum(axis=1, dtype=np.int64)
    good = may_link(apart, n[at], n[i], percent)
    return at[good], apart[good]


def compare_all(maps: np.ndarray, side: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a tile that may link and lie in different components."""
    found = [_near(i, maps, side, n, comp, percent)[0] for i in range(len(n) - 1)]
    return np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([*found, np.zeros(0, dtype=np.int64)])


def compare_best(maps: np.ndarray, side: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the same pairs the best one of every component: the least share of differing bits."""
    which = np.unique(comp, return_inverse=True)[1]
    best, pair = np.full(which.max() + 1, np.inf), np.full((which.max() + 1, 2), -1)
    for i in range(len(n) - 1):
        at, apart = _near(i, maps, side, n, comp, percent)
        if len(at):
            share = apart / (n[at] + n[i])
            order = np.argsort(-share, kind="stable")  # of one component the best is written last
            order = order[share[order] < best[which[at[order]]]]
            best[which[at[order]]] = share[order]
            pair[which[at[order]]] = np.stack([np.full(len(order), i), at[order]], axis=1)
            k = int(np.argmin(share))
            if share[k] < best[which[i]]:
                best[which[i]], pair[which[i]] = share[k], (i, at[k])
    pair = np.unique(pair[pair[:, 0] >= 0], axis=0)
    return pair[:, 0], pair[:, 1]


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
            tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (the least id reachable over links)."""
    docs = pick(df, doc_id=id_col, text=text_col, text_hash=F.xxhash64(F.col(f"`{text_col}`")))
    counts = df.sparkSession.sparkContext.broadcast(shingle_counts(docs, width))  # 2**COUNT_BITS bytes
    sets = stored(document_sets(docs, counts, width, percent), "sets")
    shared = shared_shingles(sets)
    wanted = _checked_small(shared.select("cls"), "wanted")
    light = sets.where("bits is not null").join(wanted, "cls", "left_semi")
    light = stored(light.select("cls", "set_id", "text_hash", "n", "bits").dropDuplicates(["set_id"]), "light")
    check = Checker(docs, light, counts, width, percent)
    links = stored(check.links(leader_pairs(shared)), "links")
    for whole in (False, True):
        roots = components(links).withColumnRenamed("node", "set_id")
        more = stored(check.links(tile_pairs(shared, light, roots, percent, tile_rows, whole)), "links")
        links = links.unionByName(more)
    roots = components(links).withColumnRenamed("node", "set_id")
    classes = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = stored(classes.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(classes.join(least, "root").select("set_id", "component_id"), "named_classes")
    return sets.join(classes.hint("merge"), "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
