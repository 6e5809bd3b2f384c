"""Vector best-fit packing of tokenized documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of the squared
lengths of what it holds). Pieces are placed in order of falling length; each goes to the open
sequence that has room in every respect and that scores best: the smallest weighted norm of what
would be left (``residual``), or the largest weighted dot product of need and rest (``dot``).
If none has room a new sequence is opened.

Documents are tokenized in slices of an Arrow batch, each different run of a slice once; the pieces (five numbers each) are written to the shared
folder, dealt by hash into groups of about ``group_size``, and each group is packed in one task. The number of
groups grows with the number of pieces, so a task's memory does not; what is lost is at
most one part-filled sequence for each group.

Defined cases: a null text is empty and its piece is the end id alone; every piece of full
length is a sequence of its own; rows that repeat an id are packed each for itself; equal scores go to the
sequence opened first; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmattan.llm.kernel import Slice, column_buffers, slices
from harmattan.session import materialize

END_OF_TEXT = "<|endoftext|>"
END_ID = b"\0\0\0\0"
#: A space next to other white space: there a cut before the space could differ from the whole text.
_UNSAFE = re.compile(r"\s[ ]|[ ]\s")
#: White space of one byte, and the bytes that begin a longer one.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEAD = np.zeros(256, bool)
_WIDE = {c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()}
_LEAD[[c[0] for c in _WIDE]] = True


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 belongs to a white space character."""
    out = _WHITE[data]
    at = np.flatnonzero(_LEAD[data])
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        for char in _WIDE:
            hit = at[np.logical_and.reduce([padded[at + i] == b for i, b in enumerate(char)])]
            for i in range(len(char)):
                out[hit + i] = True
    return out


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


class ByteEncoder(dict):
    """Ids of a byte-level BPE whose pre-tokenizer ties a single space to the word after it.

    The texts of a slice are cut into runs before their single spaces, and its different runs are encoded as one text. Texts
    with other white space next to a space, or with what may be a special token, are encoded each for itself.

    The dictionary keeps the ids of runs that were encoded alone. It is bounded: when full it
    becomes the older generation, from which runs met again move back. The ids are those of the
    tokenizer file's ``encode(..., add_special_tokens=False)``.
    """

    def __init__(self, path: str, limit: int = 200_000):
        import json

        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = {c: b for b, c in _byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(plain[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.limit, self.older = limit, {}
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            ids = array("I", self.encoding.encode_ordinary(run)).tobytes()
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.split is not None and "<|" in text:
            return b"".join(self.special.get(part) or self._plain(part) for part in self.split.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return array("I", self.encoding.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[r] for r in map(" ".__add__, rest)])

    def encode_slice(self, s: Slice) -> list[memoryview]:
        """Ids of each text of a slice, as bytes."""
        data, starts = s.data, s.starts
        own = starts[:-1][starts[:-1] < starts[1:]]
        begins = data == 0x20
        begins[own] = True
        begin = np.flatnonzero(begins)
        offsets = np.append(begin, len(data))
        end = offsets[1:]
        # A run may end in white space only with its text, and may not have any after its space.
        closes = np.zeros(len(data) + 1, bool)
        closes[starts[1:]] = True
        white = white_bytes(data)
        second = np.minimum(begin + 1, end - 1)
        odd = begin[white[end - 1] & ~closes[end] | (data[begin] == 0x20) & (second > begin) & white[second]]
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if self.split is not None else odd[:0]
        apart = np.zeros(len(s), bool)
        apart[np.searchsorted(starts, np.concatenate([odd, special]), side="right") - 1] = True
        text = np.searchsorted(starts, begin, side="right") - 1
        runs = binaries(offsets, data)
        if apart.any():
            kept = ~apart[text]
            runs, text = runs.filter(pa.array(kept)), text[kept]
        offsets, data = self._ids_of(runs)
        first = offsets[np.searchsorted(text, np.arange(len(s) + 1))]
        ids = memoryview(data)
        whole = s.data
        return [memoryview(self.encode(whole[starts[i] : starts[i + 1]].tobytes().decode())) if apart[i] else ids[first[i] : first[i + 1]] for i in range(len(s))]

    def _ids_of(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and bytes of the ids of each run. Runs that begin with a space and do not end in white space are encoded as one text."""
        coded = runs.dictionary_encode()
        data, offsets = column_buffers(coded.dictionary)
        if not len(data):
            return np.zeros(len(runs) + 1, np.int64), np.zeros(0, np.uint8)
        together = (data[offsets[:-1]] == 0x20) & ~white_bytes(data)[offsets[1:] - 1]
        sizes = np.diff(offsets)
        ids = np.array(self.encoding.encode_ordinary(data[np.repeat(together, sizes)].tobytes().decode()), "<u4")
        # Each of these runs ends with a token.
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes[together])) + 1
        alone = [self[data[offsets[i] : offsets[i + 1]].tobytes().decode()] for i in np.flatnonzero(~together)]
        lengths = np.concatenate([4 * np.diff(ends, prepend=0), np.array([len(x) for x in alone], np.int64)])
        known = binaries(np.concatenate([[0], np.cumsum(lengths)]), np.frombuffer(ids.tobytes() + b"".join(alone), np.uint8))
        place = np.empty(len(together), np.int64)
        place[np.concatenate([np.flatnonzero(together), np.flatnonzero(~together)])] = np.arange(len(together))
        data, offsets = column_buffers(known.take(pa.array(place[coded.indices.to_numpy()])))
        return offsets, data


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins by which byte-level vocabularies spell bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ByteEncoder:
    """One encoder for each Python worker, which serves many tasks."""
    return ByteEncoder(path)


@dataclass(frozen=True)
class Capacity:
    """Room of a sequence, and the weight of each respect in the score."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.0625, 0.0625)
    rule: str = "residual"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: full ones after a first that may be shorter."""
    first = (n - 1) % size + 1
    return [(0, first), *((first + i, size) for i in range(0, n - first, size))]


def pack(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items of one length are placed together, with the same
    result as one after the other: under the residual rule a bin that is best stays best until
    it is full."""
    whole = np.array([capacity.tokens, capacity.documents, capacity.cost], np.int64)
    weights = np.asarray(capacity.weights)
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    rest = np.zeros((n, 3), np.int64)
    bins = np.zeros(n, np.int64)
    opened, at = 0, 0
    active = np.zeros(0, np.int64)
    smallest = lengths.min() if n else 0
    while at < n:
        length = int(lengths[order[at]])
        m = int(np.searchsorted(-lengths[order], -length, side="right")) - at
        need = np.array([length, 1, length * length], np.int64)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while m:
            fits = active[(rest[active] >= need).all(1)]
            if len(fits):
                share = (rest[fits] - (need if capacity.rule == "residual" else 0)) / whole
                score = (weights * share * share).sum(1) if capacity.rule == "residual" else -(weights * share * (need / whole)).sum(1)
                fits = fits[np.argsort(score, kind="stable")]
                room = (rest[fits] // need).min(1) if capacity.rule == "residual" else np.ones(len(fits), np.int64)
            else:
                new = -(-m // int((whole // need).min())) if capacity.rule == "residual" else 1
                fits = np.arange(opened, opened + new)
                rest[fits] = whole
                opened += new
                active = np.concatenate([active, fits])
                room = (rest[fits] // need).min(1) if capacity.rule == "residual" else np.ones(new, np.int64)
            if capacity.rule != "residual":
                fits, room = fits[:1], room[:1]
            before = np.concatenate([[0], np.cumsum(room)])
            taken = np.clip(m - before[:-1], 0, room)
            used = int(taken.sum())
            bins[order[at : at + used]] = np.repeat(fits, taken)
            rest[fits] -= taken[:, None] * need
            at, m = at + used, m - used
        active = active[rest[active, 0] >= smallest]
    by_bin = np.argsort(bins[order], kind="stable")
    sorted_bins, sizes = bins[order][by_bin], lengths[order][by_bin]
    ends = np.cumsum(sizes)
    begin = np.flatnonzero(np.concatenate([[True], sorted_bins[1:] != sorted_bins[:-1]])) if n else np.zeros(0, np.int64)
    base = np.repeat((ends - sizes)[begin], np.diff(np.append(begin, n)))
    offsets = np.zeros(n, np.int64)
    offsets[order[by_bin]] = ends - sizes - base
    return bins, offsets


def tokenize(docs: DataFrame, path: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length and CRC-32 of its ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(path)
        for b in batches:
            own, piece, start, length, crc = [], [], [], [], []
            for s in slices(b.column(1)):
                for i, ids in enumerate(encoder.encode_slice(s), s.lo):
                    for p, (at, n) in enumerate(pieces := cut(len(ids) // 4 + 1, size)):
                        own.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(END_ID if p == len(pieces) - 1 else b"", zlib.crc32(ids[4 * at : 4 * (at + n)])))
            if own:
                yield pa.record_batch([b.column(0).take(pa.array(own)), *[pa.array(x, pa.int64()) for x in (piece, start, length, crc)]], [id_col, "piece", "start", "length", "ids_crc32"])

    schema = f"`{id_col}` {kind}, piece long, start long, length long, ids_crc32 long"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("piece", F.col("piece").cast("int"))


def pack_documents(docs: DataFrame, path: str, capacity: Capacity = Capacity(), group_size: int = 32_768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and the place each is given."""
    pieces = materialize(tokenize(docs, path, capacity.tokens, id_col, text_col))
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def fill(group):
        bins, offsets = pack(group["length"].to_numpy(), capacity)
        number = group["_group"].to_numpy()[:1].astype(np.int64) << 32 if len(bins) else 0
        return group.drop_columns("_group").append_column("sequence_id", pa.array(bins + number)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(fill, schema)
