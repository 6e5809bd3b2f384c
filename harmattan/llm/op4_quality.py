"""Quality rules: hashed word and character n-gram logistic regression, calibrated, with fixed thresholds.

Every text gets base counts (words, characters in words, symbols, repeated lines, words in
repeated windows) and a base verdict. A logistic regression on hashed word unigrams and bigrams
and character 4-grams, trained on labelled rows and calibrated by Platt's method on rows kept
back from the fit, gives the probability of good quality; a text is kept if it passes the base
rules and the probability reaches the threshold.

Scoring runs in Arrow batches without a shuffle. Defined cases: a null or empty text has zero
counts, fails the base rules and has probability 0.5 when it has no n-gram; rows with a null label
are not learnt from; without any label of one class the model is neutral (probability 0.5, so
the base rules alone decide); repeated rows give repeated results; other columns are passed by
or, in :func:`filter_documents`, kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harmattan.llm import common
from harmattan.llm.kernel import BYTE_VALUES, Slice, Words, column_buffers, mix, prefix_hash, slices, span_hash, sums, windows, words_of

BITS = 16
FEATURES = 3 << BITS  # word unigrams, word bigrams, character 4-grams
SCALE = 30.0
#: N-grams take some seventy bytes of work arrays for each byte of text, so slices are smaller than elsewhere.
SLICE = 1 << 19

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds of the verdict."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_probability: float = 0.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, total: np.ndarray) -> np.ndarray:
        return common.sigmoid(self.slope * (total + self.bias) + self.offset)


NEUTRAL = Model(np.zeros(FEATURES, np.float32), 0.0, 1.0, 0.0)


def features(s: Slice, w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: the feature of each n-gram, and the first n-gram of each document."""
    shift = np.uint64(64 - BITS)
    out = [((w.hash >> shift).astype(np.int64), w.first)]
    h, ok = windows(w.hash, w.first, 2)
    out.append(_within((mix(h) >> shift).astype(np.int64) + (1 << BITS), ok, w.first))
    d = s.data.astype(np.uint32)
    code = d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24 if len(d) > 3 else np.zeros(0, np.uint32)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    ok = np.ones(len(code), bool)
    for back in (1, 2, 3):
        at = s.starts[1:-1] - back
        ok[at[(at >= 0) & (at < len(code))]] = False
    # Grams that begin before the last three bytes of a shorter document cross its end too.
    out.append(_within(code.astype(np.int64) + (2 << BITS), ok, s.starts))
    return out


def _within(feature: np.ndarray, ok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.concatenate([[0], np.cumsum(ok)])
    return feature[ok], count[np.minimum(first, len(ok))]


def base_counts(s: Slice, w: Words) -> dict[str, np.ndarray]:
    """Exact counts of each document of a slice."""
    solid = np.zeros(len(s.data) + 1, np.int32)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.stop, -1)
    in_word = np.cumsum(solid[:-1]) > 0
    points = in_word & ((s.data & 0xC0) != 0x80)
    out = {"n_words": w.counts, "word_chars": sums(points, s.starts), "n_symbols": sums(SYMBOLS[s.data], s.starts)}

    # Lines that hold a word, compared within their document.
    cut = np.flatnonzero(s.data == 10)
    edges = np.unique(np.concatenate([s.starts, cut + 1]))
    begin, end = edges[:-1], edges[1:].copy()
    has_break = np.zeros(len(s.data) + 1, bool)
    has_break[cut + 1] = True
    end -= has_break[end]
    full = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
    begin, end = begin[full], end[full]
    line = span_hash(prefix_hash(BYTE_VALUES[s.data]), begin, end)
    doc = np.searchsorted(s.starts, begin, side="right") - 1
    order = np.lexsort((line, doc))
    same = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][same], minlength=len(s))

    # Words covered by a 3-word window that the text holds twice or more.
    h, ok = windows(w.hash, w.first, 3)
    covered = np.zeros(len(w.start) + 1, np.int32)
    if len(h):
        at = np.flatnonzero(ok)
        key = mix(h[at] + w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.zeros(len(key), bool)
        equal = key[1:] == key[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        at = at[order[twin]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 3, -1)
    out["n_repeat_words"] = sums(np.cumsum(covered[:-1]) > 0, w.first)
    return out


def totals(s: Slice, w: Words, weights: np.ndarray) -> np.ndarray:
    """Linear score of each document: for each family the mean weight of its n-grams."""
    out = np.zeros(len(s))
    for feature, first in features(s, w):
        out += SCALE * sums(weights[feature].astype(np.float64), first) / np.maximum(np.diff(first), 1)
    return out


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", key_col: str = "doc_id", max_rows: int = 3000, l2: float = 1e-4) -> Model:
    """Fits and calibrates on at most ``max_rows`` labelled rows, drawn by hash of the key.

    Each sampled text is reduced to hashed counts in the tasks; the fit itself is over that
    bounded sample. One row in four is kept back for the calibration.
    """
    sample = common.labelled_sample(docs, labels, label_col, max_rows, key_col, text_col)

    def counted(batches):
        for b in batches:
            label = b.column("y").to_numpy(zero_copy_only=False)
            for s in slices(b.column("t"), SLICE):
                w = words_of(s)
                docs, feats, vals = [], [], []
                for feature, first in features(s, w):
                    size = np.diff(first)
                    key, count = np.unique(np.repeat(np.arange(len(s)), size) * FEATURES + feature, return_counts=True)
                    docs.append(key // FEATURES)
                    feats.append(key % FEATURES)
                    vals.append(SCALE * count / np.maximum(size, 1)[key // FEATURES])
                docs, feats, vals = np.concatenate(docs), np.concatenate(feats), np.concatenate(vals)
                order = np.argsort(docs, kind="stable")
                ends = np.cumsum(np.bincount(docs, minlength=len(s)))[:-1]
                yield pa.record_batch(
                    {
                        "y": pa.array(label[s.lo : s.hi], pa.int32()),
                        "f": pa.array([x.astype("<i4").tobytes() for x in np.split(feats[order], ends)], pa.binary()),
                        "v": pa.array([x.astype("<f4").tobytes() for x in np.split(vals[order], ends)], pa.binary()),
                    }
                )

    got = sample.mapInArrow(counted, "y int, f binary, v binary").toArrow()
    y = got["y"].to_numpy().astype(float)
    if len(y) < 8 or y.min() == y.max():
        return NEUTRAL
    # The sample as two flat arrays, without a copy for each row.
    (feats, ends), (vals, _) = (column_buffers(got[c]) for c in ("f", "v"))
    feats, vals, ends = feats.view("<i4"), vals.view("<f4"), ends // 4
    del got
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    chosen = np.repeat(~held, np.diff(ends))
    at = np.repeat(np.cumsum(~held, dtype=np.int32) - 1, np.diff(ends))[chosen]
    w, bias = common.fit_logistic(at, feats[chosen], vals[chosen], y[~held], FEATURES, l2, steps=80, rate=0.05)
    rest = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = np.array([np.dot(w[feats[a:b]], vals[a:b]) for a, b in zip(ends[rest], ends[rest + 1])]) + bias
    slope, offset = common.fit_platt(z, y[rest])
    return Model(w.astype(np.float32), bias, slope, offset)


def _verdicts(column: pa.Array, model: Model, rules: Rules) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {}
    for s in slices(column, SLICE):
        w = words_of(s)
        out = base_counts(s, w)
        out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
        out["probability"] = model.probability(totals(s, w, model.weights))
        out["kept"] = ~out["base_failed"] & (out["probability"] >= rules.min_probability)
        for k, v in out.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in parts.items()}


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts, base_failed, kept and the calibrated probability of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: three tables of 2**BITS weights

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = _verdicts(b.column(1), shared.value, rules)
                yield pa.record_batch(
                    [b.column(0), *[pa.array(out[c], pa.int64()) for c in RESULT], pa.array(out["base_failed"]), pa.array(out["kept"]), pa.array(out["probability"])],
                    [id_col, *RESULT, "base_failed", "kept", "probability"],
                )

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in RESULT) + ", base_failed boolean, kept boolean, probability double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, model: Model, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_verdicts(b.column(b.schema.get_field_index(text_col)), shared.value, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
