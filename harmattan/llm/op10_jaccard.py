"""Exact n-gram Jaccard join by partition of the token universe and pigeonhole.

Two shingle sets with similarity of at least ``percent`` differ in at most H shingles. Sets are
put into size bands; in the scheme of a band, a hash deals the shingles to m segments.

* m = H + 1 + x: two linked sets agree in at least x + 1 whole segments. Under one order of all
  segment contents from frequent to rare, both drop their x most frequent ones (empty segments first) and
  still share one: each set spends its budget where candidates are cheapest.
* In bands of small sets such segments would hold too few shingles to tell sets apart; there
  (H + 1) / 2 segments are used, with each segment and all its one-deletion neighbours as keys: of that
  many segments one differs by at most one shingle, and then a key is shared.

A set takes part in the scheme of its own band and in those of smaller sets it may be linked
with. Keys held by one set only are streamed away; what is left makes candidates without listing the pairs
of a group: all members of a key are paired with one pivot, verified on a histogram sketch
(distance at most H) and then on the sets, and linked ones are merged. Sets that have too few items in
common with all others that are still apart leave; after some rounds with other pivots only pairs whose members are
still apart are left, and these are all verified: members outside a key's largest component with all others, as far as their
sizes and parities allow a link. So no link between components is lost, and a large group of copies costs
a few pairs for each member.

Equal sets count as one throughout, by 64-bit digest. Tokens are 64-bit hashes of word n-grams.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing;
fewer words than n make one shingle of the whole sequence; rows that repeat an id are one
document; rows with a null id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harmattan.llm.graph import components
from harmattan.llm.kernel import Slice, mix, slices, windows, words_of
from harmattan.llm.runs import shared_runs
from harmattan.session import materialize

SKETCH = 64
EMPTY_BIT = 128
PARITIES = [f"parity_{i}" for i in range(8)]


@dataclass(frozen=True)
class Bands:
    """Size bands and their schemes, for sets of up to 2**30 shingles."""

    low: np.ndarray
    high: np.ndarray
    segments: np.ndarray
    spare: np.ndarray  # x; -1 where one-deletion keys are used
    percent: int

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def bands(percent: int = 80, surplus: float = 0.15, least_filling: float = 3.0) -> Bands:
    low, high, segments, spare = [], [], [], []
    lo = 1
    while lo < 1 << 30:
        hi = max(lo, lo * 100 // percent)
        # Largest difference of a set of at most hi and one of at most hi / similarity.
        most = (100 - percent) * (hi + hi * 100 // percent) // (100 + percent)
        x = int(np.ceil(surplus * (most + 1)))
        m = most + 1 + x
        if hi / m < least_filling:
            m, x = -(-(most + 1) // 2), -1
        low.append(lo)
        high.append(hi)
        segments.append(m)
        spare.append(x)
        lo = hi + 1
    if len(low) > EMPTY_BIT:
        raise ValueError("similarity too close to 1: too many size bands")
    return Bands(*(np.array(x, np.int64) for x in (low, high, segments, spare)), percent)


@dataclass
class Sets:
    """Shingle sets of a slice's documents: distinct hashes in rising order by document."""

    items: np.ndarray
    first: np.ndarray
    digest: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.size)


def sets_of(s: Slice, n: int) -> Sets:
    w = words_of(s, lower=True)
    h, inside = windows(w.hash, w.first, n)
    doc = w.doc[: len(h)][inside]
    h = h[inside]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(mix(w.hash[a:z] + np.arange(z - a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for a, z in zip(w.first[short], w.first[short + 1])], np.uint64)
        h, doc = np.concatenate([h, mix(whole)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
    h, doc = h[keep], doc[keep]
    first = np.searchsorted(doc, np.arange(len(s) + 1))
    total = np.zeros(len(s), np.uint64)
    np.add.at(total, doc, mix(h ^ np.uint64(0xA0761D6478BD642F)))
    return Sets(h, first, mix(total + np.diff(first).astype(np.uint64)))


def digests(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc, set size, set digest and histogram sketch of each row."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for s in slices(b.column(1)):
                t = sets_of(s, n)
                sketch = np.bincount(t.doc * SKETCH + (t.items >> np.uint64(58)).astype(np.int64), minlength=len(s) * SKETCH)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * SKETCH), pa.array(sketch.astype(np.int32)))
                yield pa.record_batch([pa.array(ids[s.lo : s.hi]), pa.array(t.size.astype(np.int64)), pa.array(t.digest.view(np.int64)), sketch], ["doc", "n", "set", "sketch"])

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc long, n long, `set` long, sketch array<int>")


def _keys(value: np.ndarray, segment: np.ndarray, band: np.ndarray) -> np.ndarray:
    """56 bits of content and place, 7 bits of band; the empty bit stays clear."""
    h = mix(value ^ mix(segment.astype(np.uint64) << np.uint64(8) | band.astype(np.uint64)))
    return (h & np.uint64(0xFFFFFFFFFFFFFF00)) | band.astype(np.uint64)


def signatures(t: Sets, scheme: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, document and number of keys that the document may still drop, for all its schemes."""
    out, size = [], t.size
    own = scheme.of(np.maximum(size, 1))
    value = mix(t.items ^ np.uint64(0xE7037ED1A0B428DB))
    for back in range(int(own.max(initial=0)) + 1):
        band = own - back
        valid = (size > 0) & (band >= 0)
        band = np.maximum(band, 0)
        valid &= 100 * scheme.high[band] >= scheme.percent * size
        if not valid.any():
            break
        m = np.where(valid, scheme.segments[band], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        keep = valid[t.doc]
        items, doc, v = t.items[keep], t.doc[keep], value[keep]
        place = mix(items + (band[doc].astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(32)
        segment = ((place * m[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total, count = np.zeros(base[-1], np.uint64), np.bincount(base[doc] + segment, minlength=base[-1])
        np.add.at(total, base[doc] + segment, v)
        seg_doc = np.repeat(np.arange(len(size)), m)
        seg_no = np.arange(base[-1]) - base[seg_doc]
        x = scheme.spare[band]
        empty = count == 0
        n_empty = np.bincount(seg_doc[empty], minlength=len(size))
        near = x < 0  # one-deletion schemes: all segments, all neighbours, nothing dropped
        dropped = ~near & (n_empty <= x)
        spare = np.where(near, 0, np.where(dropped, x - n_empty, x))
        emit = ~(empty & dropped[seg_doc])
        key = _keys(total[emit], seg_no[emit], band[seg_doc[emit]])
        key |= np.where(empty[emit] & ~near[seg_doc[emit]], np.uint64(EMPTY_BIT), np.uint64(0))
        out.append((key, seg_doc[emit], spare[seg_doc[emit]]))
        some = near[doc]
        if some.any():
            at = base[doc[some]] + segment[some]
            out.append((_keys(total[at] - v[some], segment[some], band[doc[some]]), doc[some], np.zeros(int(some.sum()), np.int64)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _signature_rows(docs: DataFrame, n: int, scheme: Bands, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for s in slices(b.column(1)):
                t = sets_of(s, n)
                key, doc, spare = signatures(t, scheme)
                if len(key):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(t.digest[doc].view(np.int64)), pa.array(spare.astype(np.int32))], ["key", "set", "spare"])

    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, "key long, `set` long, spare int")


def candidate_keys(docs: DataFrame, n: int, scheme: Bands, id_col: str, text_col: str) -> DataFrame:
    """key, set of the keys that two or more sets share after each has dropped its most frequent ones;
    weight is the number of keys that the set keeps in the scheme."""
    shared = materialize(shared_runs(_signature_rows(docs, n, scheme, id_col, text_col), "key", "set", "spare").distinct())
    often = shared.groupBy("key").agg(F.count("*").alias("often"))
    own = Window.partitionBy("set", F.col("key").bitwiseAND(F.lit(127)))
    order = own.orderBy(F.col("key").bitwiseAND(F.lit(EMPTY_BIT)).desc(), F.desc("often"), "key")
    kept = shared.join(often, "key").withColumns({"place": F.row_number().over(order), "all": F.count("*").over(own)}).filter("place > spare").select("key", "set", (F.col("all") - F.col("spare")).alias("weight"))
    return materialize(kept)


def parities(t: Sets) -> np.ndarray:
    """A row of bits for each set: whether the items that fall on a bit are odd in number. Two sets differ in at least as many
    items as their rows differ in bits."""
    out = np.zeros((len(t.first) - 1, len(PARITIES)), np.uint64)
    bit = (t.items >> np.uint64(32)) % np.uint64(64 * len(PARITIES))
    np.bitwise_xor.at(out, (t.doc, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _set_rows(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """set, items of one document of each wanted set, and its parities; ``wanted`` has doc and set."""

    def run(batches):
        for b in batches:
            for s in slices(b.column(1)):
                t = sets_of(s, n)
                items = pa.ListArray.from_arrays(pa.array(t.first.astype(np.int32)), pa.array(t.items.view(np.int64)))
                yield pa.record_batch([b.column(0).slice(s.lo, len(s)), items, *(pa.array(p) for p in parities(t).view(np.int64).T)], ["set", "items", *PARITIES])

    return docs.join(wanted, "doc").select("set", "text").mapInArrow(run, f"`set` long, items array<long>, {', '.join(f'{p} long' for p in PARITIES)}")


def supported(sets: DataFrame, items: DataFrame, one_in: int, percent: int) -> DataFrame:
    """set, n, alone of those of the sets that may have a link among them: a set that is linked shares
    all but (100 - percent) % of its items, so no more of its items, in any part of the universe, may
    be without a second owner. ``alone`` counts those, among the items of one in ``one_in`` parts of the universe.
    """
    part = F.filter("items", lambda i: F.pmod(F.xxhash64(i), F.lit(one_in)) == 0)
    own = items.join(sets, "set").select("set", F.size("items").alias("n"), part.alias("part"))
    listed = own.select("set", F.explode("part").alias("item"))
    twice = listed.groupBy("item").agg(F.count("*").alias("owners")).filter("owners > 1")
    shared = listed.join(twice, "item", "left_semi").groupBy("set").agg(F.count("*").alias("shared"))
    alone = F.size("part") - F.coalesce("shared", F.lit(0))
    return own.join(shared, "set", "left").select("set", "n", alone.alias("alone")).filter(100 * F.col("alone") <= (100 - percent) * F.col("n"))


def _may_link(n_a: Column, alone_a: Column, n_b: Column, alone_b: Column | int, percent: int) -> Column:
    """Whether the items that are not alone suffice for a link of sets of these sizes."""
    return (100 + percent) * F.least(n_a - alone_a, n_b - alone_b) >= percent * (n_a + n_b)


def _linked(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def apart_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """set, component, other, other_component of the members of a key in ``rows`` (key, set, component, n, alone, parities) that
    are still apart and may be linked.

    A key's largest component is met by the members outside of it, and its own members are not paired among each other; sizes,
    common items and parities are compared before a pair is made.
    """
    main = rows.groupBy("key", "component").agg(F.count("*").alias("members")).groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("main"))
    placed = rows.join(main, "key")
    other = placed.select("key", *[F.col(c).alias(f"other_{c}") for c in rows.columns if c not in ("key", "set")], F.col("set").alias("other"))
    once = (F.col("other_component") == F.col("main")) | (F.col("set") < F.col("other"))
    may = _may_link(F.col("n"), F.col("alone"), F.col("other_n"), F.col("other_alone"), percent)
    differ = reduce(Column.__add__, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"other_{p}"))) for p in PARITIES])
    near = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("other_n"))
    both = placed.filter("component <> main").join(other, "key").filter((F.col("component") != F.col("other_component")) & once & may & near)
    return both.select("set", "component", "other", "other_component")


def join(docs: DataFrame, n: int = 5, percent: int = 80, pivots: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_shingles and component_id (smallest id reachable by links) of each document."""
    scheme = bands(percent)
    info = materialize(digests(docs, n, id_col, text_col)).dropDuplicates(["doc"])
    keys = candidate_keys(docs, n, scheme, id_col, text_col)
    sets = info.filter("n > 0").groupBy("set").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    wanted = sets.join(keys.select("set").distinct(), "set", "left_semi")
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    items = materialize(_set_rows(plain, n, wanted.select("doc", "set")))
    sketches = materialize(wanted.select("set", "n", "sketch"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Components of the members of those pairs that are linked."""
        left, right = (sketches.select(*[F.col(c).alias(side if c == "set" else f"{c}_{side}") for c in ("set", "n", "sketch")]) for side in ("a", "b"))
        most = F.floor((100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
        apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
        near = pairs.join(left, "a").join(right, "b").filter(apart <= most).drop("sketch_a", "sketch_b")
        full = near.join(items.select(F.col("set").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("set").alias("b"), F.col("items").alias("y")), "b")
        return full.filter(_linked(F.size(F.array_intersect("x", "y")), F.col("n_a"), F.col("n_b"), percent)).select("component_a", "component_b").distinct()

    def ordered(set_a: str, component_a: str, set_b: str, component_b: str) -> list[Column]:
        """a < b, so that a pair found under several keys is one row."""
        swap = F.col(set_a) > F.col(set_b)
        return [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name) for name, x, y in (("a", set_a, set_b), ("b", set_b, set_a), ("component_a", component_a, component_b), ("component_b", component_b, component_a))]

    open_, merges = keys.withColumn("component", F.col("set")), []
    columns = ["key", "set", "weight"]
    for turn in range(pivots + 1):
        if turn in (1, 2):
            # Sets without enough common items leave; first by a part of the universe, then by all of it.
            still = materialize(supported(open_.select("set").distinct(), items, 4 if turn == 1 else 1, percent))
            columns = ["key", "set", "weight", "n", "alone"]
            open_ = open_.drop("n", "alone").join(still, "set")
            # So do sets from keys whose smallest member is too large for what they have in common.
            smallest = open_.groupBy("key").agg(F.min("n").alias("smallest"))
            open_ = open_.join(smallest, "key").filter(_may_link(F.col("n"), F.col("alone"), F.greatest("smallest", F.ceil(F.col("n") * percent / 100)), F.lit(0), percent)).drop("smallest")
            open_ = materialize(open_)
        # Keys whose members are still in different components, each with another pivot; first the set that shares most.
        pivot = F.min_by(F.struct("set", "component"), F.struct(-F.col("weight"), "set") if turn == 0 else F.xxhash64("set", F.lit(turn)))
        apart = open_.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), pivot.alias("pivot")).filter("least < most")
        open_ = materialize(open_.join(apart.select("key", F.col("pivot.set").alias("pivot"), F.col("pivot.component").alias("pivot_component")), "key"))
        if open_.isEmpty():
            break
        if turn < pivots:
            pairs = open_.filter("component <> pivot_component").select(*ordered("set", "component", "pivot", "pivot_component"))
        else:
            # All pairs of members that are still apart.
            sized = open_ if "alone" in columns else open_.join(sketches.select("set", "n"), "set").withColumn("alone", F.lit(0))
            sized = sized.select("key", "set", "component", "n", "alone").join(items.select("set", *PARITIES), "set")
            pairs = apart_pairs(sized, percent).select(*ordered("set", "component", "other", "other_component"))
        merged = components(verified(pairs.distinct()), "component_a", "component_b")
        merges.append(merged)
        open_ = open_.select(*columns, "component").join(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
        open_ = open_.select(*columns, F.coalesce("new", "component").alias("component"))
    label = info.select("doc", "n", F.when(F.col("n") > 0, F.col("set")).alias("label"))
    for merged in merges:
        label = label.join(merged.select(F.col("node").alias("label"), F.col("component").alias("new")), "label", "left").select("doc", "n", F.coalesce("new", "label").alias("label"))
    label = materialize(label)
    least = label.filter("n > 0").groupBy("label").agg(F.min("doc").alias("component_id"))
    return label.join(least, "label", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
