"""Removal of repeated byte strings by column-wise construction of a collection BWT.

A string of ``length`` bytes that starts anywhere else too, in any document, is removed wherever
it stands. Building the Burrows-Wheeler transform of whole documents symbol by symbol takes as
many rounds as the longest document has bytes; so the collection is first cut to what can repeat:

1. Anchors: of every ``length``-byte window the k-byte gram with the smallest hash. Equal windows
   choose the same anchor at the same place, so a repeated window lies around an anchor whose hash
   occurs twice. Anchors that occur once are streamed away after a shuffle by hash.
2. Segments: the bytes that the windows of a kept anchor cover, at most 2 * length - k, shuffled
   by anchor. Equal segments are streamed: their windows all repeat, and one of them goes on.
3. Columns: the segments of many anchors, aligned at their anchors, are written to a scratch file
   column by column and read back from right to left. Each round inserts one symbol of every segment: a stable
   sort by symbol within each anchor gives the next order of the collection (its transform), and
   the common prefix of neighbours grows by one or starts anew. A window repeats exactly
   if its common prefix with a neighbour reaches ``length``; bytes are compared, not hashes.

The number of rounds depends on ``length`` alone. A block holds at most ``block_rows`` distinct
segments; an anchor with more (a common passage between ever different neighbours) is not
gathered: its windows go on by 128-bit hash through one more shuffle, which is exact up to hash collisions.

Defined cases: null and empty texts have no bytes and the digest of the empty string; texts
shorter than ``length`` lose nothing; a null id takes no part and its row is kept whole; every row is a
document of its own only if its id is unique: rows that repeat id and text share their removals, which are all their windows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmattan.llm.kernel import BYTE_VALUES, Slice, mix, prefix_hash, rolling_hash, sliding_argmin, slices, span_hash
from harmattan.llm.runs import shared_runs
from harmattan.session import materialize

_SALT = np.uint64(0xD6E8FEB86659FD93)


def _anchors(s: Slice, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash, first window and number of windows of each anchor of a slice."""
    none = np.zeros(0, np.int64)
    h = rolling_hash(BYTE_VALUES[s.data], k)
    chosen = sliding_argmin(h, length - k + 1)
    if not len(chosen):
        return none, none.astype(np.uint64), none, none
    start = np.arange(len(chosen))
    doc_end = np.repeat(s.starts[1:], np.diff(s.starts))[: len(chosen)]
    start = start[start + length <= doc_end]
    chosen = chosen[start]
    begin = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)])[: len(chosen)])
    size = np.diff(np.append(begin, len(chosen)))
    return chosen[begin], h[chosen[begin]], start[begin], size


def seeds(docs: DataFrame, length: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Anchor hash, occurrence and document of every anchor."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for s in slices(b.column(1)):
                at, h, _, _ = _anchors(s, length, k)
                if len(at):
                    doc = np.searchsorted(s.starts, at, side="right") - 1
                    own = ids[s.lo : s.hi][doc]
                    # Told apart by document and place; equal rows of one document are told apart by the row.
                    occurrence = mix(own.view(np.uint64) * _SALT ^ mix((at - s.starts[doc]).astype(np.uint64) | (doc + s.lo).astype(np.uint64) << np.uint64(40)))
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(occurrence.view(np.int64)), pa.array(own)], ["anchor", "occurrence", "doc"])

    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(run, "anchor long, occurrence long, doc long")


def segments(held: DataFrame, length: int, k: int) -> DataFrame:
    """Segments around the kept anchors of each document: doc, text, anchors -> one row for each."""

    def run(batches):
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(2)
            for s in slices(b.column(1)):
                at, h, first, size = _anchors(s, length, k)
                if not len(at):
                    continue
                doc = np.searchsorted(s.starts, at, side="right") - 1
                own = lists.slice(s.lo, len(s))
                kept_doc = np.repeat(np.arange(len(s), dtype=np.uint64), pa.compute.list_value_length(own).to_numpy(zero_copy_only=False))
                kept = mix(own.flatten().to_numpy().view(np.uint64) ^ kept_doc * _SALT)
                hit = np.isin(mix(h ^ doc.astype(np.uint64) * _SALT), kept)
                at, h, first, size, doc = at[hit], h[hit], first[hit], size[hit], doc[hit]
                if not len(at):
                    continue
                stop = first + size + length - 1
                digest = mix(span_hash(prefix_hash(BYTE_VALUES[s.data]), first, stop) ^ mix((at - first).astype(np.uint64)))
                raw = s.data.tobytes()
                yield pa.record_batch(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(ids[s.lo : s.hi][doc]),
                        pa.array((first - s.starts[doc]).astype(np.int64)),
                        pa.array((at - first).astype(np.int32)),
                        pa.array([raw[a:z] for a, z in zip(first.tolist(), stop.tolist())], pa.binary()),
                    ],
                    ["anchor", "digest", "doc", "first", "lead", "bytes"],
                )

    return held.mapInArrow(run, "anchor long, digest long, doc long, first long, lead int, bytes binary")


def repeated_windows(group: np.ndarray, lead: np.ndarray, data: list[bytes], length: int, k: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur in another segment of its group.

    ``group`` is in rising order. The columns run from ``length - k`` bytes before the anchor to
    ``length`` bytes after its start.
    """
    before, n = length - k, len(data)
    width = before + length
    offset = before - lead
    sizes = np.array([len(x) for x in data])
    symbols = np.zeros((n, width), np.uint16)  # 0: outside the segment
    flat = np.frombuffer(b"".join(data), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offset, sizes)
    symbols[row, column] = flat.astype(np.uint16) + 1
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])).astype(np.uint16)
    hits = np.zeros((width, n), bool)
    with tempfile.TemporaryFile() as columns:
        np.ascontiguousarray(symbols.T[::-1]).tofile(columns)
        del symbols
        columns.seek(0)
        order, common = np.arange(n), np.zeros(n, np.int64)
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(2 * n), np.uint16)
            by_symbol = np.argsort(symbol[order], kind="stable")
            place = by_symbol[np.argsort(number[order[by_symbol]], kind="stable")]
            # Neighbours of the next order with equal symbols: the least common prefix between them, and one.
            new = order[place]
            same = np.zeros(n, bool)
            same[1:] = (symbol[new[1:]] == symbol[new[:-1]]) & (number[new[1:]] == number[new[:-1]]) & (symbol[new[1:]] > 0)
            at = np.flatnonzero(same)
            grown = np.zeros(n, np.int64)
            if len(at):
                a, z = place[at - 1], place[at]
                bounds = np.empty(2 * len(at), np.int64)
                bounds[0::2], bounds[1::2] = a + 1, z + 1
                padded = np.append(common, 0)
                grown[at] = np.minimum.reduceat(padded, bounds)[0::2] + 1
            order, common = new, grown
            full = np.flatnonzero(common >= length)
            if len(full):
                hits[c, order[full]] = True
                hits[c, order[full - 1]] = True
    return [hits[o : o + z - length + 1, i] for i, (o, z) in enumerate(zip(offset.tolist(), sizes.tolist()))]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - edge[0::2]).tolist()))


def scan(rows: DataFrame, length: int, k: int, block_rows: int, max_group: int) -> DataFrame:
    """doc, at, n: runs of n repeated windows; or, with ``open`` set, single windows of oversized groups by hash."""

    def run(batches):
        block: list[list] = []  # anchor, digest, doc, first, lead, bytes, several
        group_from, over = 0, None  # where the open anchor begins in the block; an anchor that grew too large

        def result(out):
            doc, at, n, one, two = (list(x) for x in zip(*out)) if out else ([], [], [], [], [])
            return pa.record_batch([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc", "at", "n", "w1", "w2"])

        def whole(r):
            return (r[2], r[3], len(r[5]) - length + 1, None, None)

        def windows(r):
            values = BYTE_VALUES[np.frombuffer(r[5], np.uint8)]
            one = rolling_hash(values, length)
            two = rolling_hash(mix(values), length)
            return [(r[2], r[3] + i, 1, int(a), int(b)) for i, (a, b) in enumerate(zip(one.view(np.int64), two.view(np.int64)))]

        def flush(part):
            out = []
            if len(part) > 1:
                masks = repeated_windows(np.array([r[0] for r in part]), np.array([r[4] for r in part]), [r[5] for r in part], length, k)
                for r, mask in zip(part, masks):
                    if not r[6]:
                        out += [(r[2], r[3] + a, n, None, None) for a, n in _runs(mask)]
            return out

        for b in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in b.columns]):
                r = [*r, False]
                if block and block[-1][0] == r[0] and block[-1][1] == r[1]:
                    # Equal to the last segment: all its windows repeat.
                    if not block[-1][6]:
                        block[-1][6] = True
                        out.append(whole(block[-1]))
                    out.append(whole(r))
                    continue
                if not block or block[-1][0] != r[0]:
                    if over is not None and over != r[0]:
                        over, block, group_from = None, [], 0
                    elif len(block) >= block_rows:
                        out += flush(block)
                        block = []
                    group_from = len(block)
                elif over is None and len(block) - group_from >= max_group:
                    out += flush(block[:group_from])
                    for old in block[group_from:]:
                        out += windows(old)
                    block, group_from, over = block[-1:], 0, r[0]
                if over is not None:
                    out += windows(r)
                    block = [r]
                    continue
                block.append(r)
            yield result(out)
        yield result(flush(block) if over is None else [])

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "digest")
    return dealt.mapInArrow(run, "doc long, at long, n long, w1 long, w2 long")


def repeats(docs: DataFrame, length: int = 200, k: int = 64, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 8192, max_group: int = 32_768) -> DataFrame:
    """doc and the runs (at, n) of its windows that occur elsewhere."""
    kept = shared_runs(seeds(docs, length, k, id_col, text_col), "anchor", "occurrence", "doc").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(kept, "doc")
    found = materialize(scan(segments(texts.select("doc", "text", "anchors"), length, k), length, k, block_rows, max_group))
    settled = found.filter("w1 is null").select("doc", "at", "n")
    # Windows of oversized anchors, counted by hash.
    open_ = found.filter("w1 is not null")
    often = open_.groupBy("w1", "w2").agg(F.count("*").alias("times")).filter("times > 1")
    rest = open_.join(often, ["w1", "w2"], "left_semi").select("doc", "at", "n")
    return settled.union(rest).groupBy("doc").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))


def _covered(s: Slice, at: pa.Array, n: pa.Array, length: int) -> np.ndarray:
    sizes = pa.compute.fill_null(pa.compute.list_value_length(at), 0).to_numpy(zero_copy_only=False)
    first = np.repeat(s.starts[:-1], sizes) + at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.zeros(len(s.data) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def report(docs: DataFrame, length: int = 200, k: int = 64, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, bytes, bytes removed, removed runs and the digest of the remaining bytes; with ``keep`` also those."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialize(repeats(docs, length, k, id_col, text_col))

    def run(batches):
        for b in batches:
            rows, left = [], []
            for s in slices(b.column(1)):
                gone = _covered(s, b.column(2).slice(s.lo, len(s)), b.column(3).slice(s.lo, len(s)), length)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = s.starts[1:-1]
                inner = inner[inner < len(gone)]
                begins[inner] = gone[inner]
                count, spans = (np.concatenate([[0], np.cumsum(x)])[s.starts].tolist() for x in (gone, begins))
                for i, (a, z) in enumerate(zip(s.starts[:-1].tolist(), s.starts[1:].tolist())):
                    rest = s.data[a:z]
                    if count[i + 1] > count[i]:
                        rest = rest[~gone[a:z]]
                    rest = rest.tobytes()
                    rows.append((z - a, count[i + 1] - count[i], spans[i + 1] - spans[i], hashlib.sha256(rest).hexdigest()))
                    if keep:
                        left.append(rest)
            if rows:
                columns = [b.column(0), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], pa.array([r[3] for r in rows])]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.record_batch([*columns, pa.array(left, pa.binary())], [*names, "kept"]) if keep else pa.record_batch(columns, names)

    joined = docs.select(F.col(id_col), F.col(text_col)).join(found.select(F.col("doc").alias("_doc"), F.col("at").alias("_at"), F.col("n").alias("_n")), F.col(id_col).cast("long") == F.col("_doc"), "left")
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    return joined.select(id_col, text_col, "_at", "_n").mapInArrow(run, schema)
