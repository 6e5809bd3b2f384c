"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of variable order (up to three bytes) holds the counts
of the byte that follows. A text is coded with every language's frozen statistics; a byte not yet
seen in a context escapes to the next shorter one (method C, with full exclusion of the bytes
already offered), and the shortest code wins. As the statistics do not change while a text is
coded, the code length of each (context, byte) is worked out once; scoring a byte is one table
look-up for all languages together.

Bytes are read through 64 classes (letters with case folded, space, digit, other ASCII, UTF-8
lead bytes, continuation bytes by their low five bits). What a class hides costs the same in
every language, so the comparison of code lengths is unaffected.

Counting runs over all training rows; what reaches the driver is one count per (language,
four-byte context), at most 64**4 per language however large the corpus.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing could be learnt; equal code lengths go to the language that sorts first; repeated rows
count as often as they occur; a null id is in no fold and may be learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmattan.llm.kernel import Slice, slices, sums

SYMBOLS = 64
UNKNOWN = "und"


def _classes() -> np.ndarray:
    out = np.full(256, 28, np.uint32)  # other ASCII
    out[97:123] = out[65:91] = np.arange(26)
    out[[32, *range(9, 14)]] = 26
    out[48:58] = 27
    out[0x80:0xC0] = 32 + (np.arange(64) & 31)
    out[0xC0:0xC3] = 29
    out[0xC3] = 30
    out[0xC4:] = 31
    return out


CLASS = _classes()
SPACE = np.uint32(26)


def grams(s: Slice) -> np.ndarray:
    """Code of the three classes before each byte and its own; spaces stand before a text."""
    sym = CLASS[s.data]
    code = sym.copy()
    for back in (1, 2, 3):
        before = np.full(len(sym), SPACE, np.uint32)
        before[back:] = sym[:-back] if len(sym) > back else before[back:]
        for j in range(back):
            at = s.starts[:-1] + j
            before[at[at < s.starts[1:]]] = SPACE
        code |= before << np.uint32(6 * back)
    return code


@dataclass(frozen=True)
class Model:
    """Frozen code lengths in nats: cost[row[context], symbol, language]."""

    languages: tuple[str, ...]
    row: np.ndarray
    cost: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_context: int = 16) -> Model:
    """Counts every row with a text and a language. Contexts of order three met fewer than
    ``min_context`` times over all languages are cut from the trees; order two takes over."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))

    def count(batches):
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            names = np.array(b.column("l").to_pylist(), object)
            for s in slices(b.column("t")):
                code, own = grams(s), names[s.lo : s.hi]
                for name in sorted(set(own)):
                    mask = np.repeat(own == name, np.diff(s.starts))
                    key, n = np.unique(code[mask], return_counts=True)
                    if name in kept:
                        key, inverse = np.unique(np.concatenate([kept[name][0], key]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([kept[name][1], n])).astype(np.int64)
                    kept[name] = key, n
        for name, (key, n) in kept.items():
            for i in range(0, len(key), 100_000):
                part = slice(i, i + 100_000)
                yield pa.record_batch({"l": pa.array([name] * len(key[part]), pa.string()), "code": pa.array(key[part].astype(np.int32)), "n": pa.array(n[part].astype(np.int64))})

    counts = rows.mapInArrow(count, "l string, code int, n long").groupBy("l", "code").agg(F.sum("n").alias("n")).toArrow()
    return build(counts["l"].to_numpy(zero_copy_only=False), counts["code"].to_numpy(), counts["n"].to_numpy(), min_context)


def build(lang: np.ndarray, code: np.ndarray, n: np.ndarray, min_context: int) -> Model:
    languages = tuple(sorted(set(lang)))
    context, total = np.unique(code >> 6, return_inverse=True)
    met = np.bincount(total, n, len(context)) if len(context) else np.zeros(0)
    context = context[met >= min_context]
    # Rows: every context of order two, then the kept ones of order three.
    row = (np.arange(1 << 18) & 4095).astype(np.int32)
    row[context] = 4096 + np.arange(len(context))
    cost = np.zeros((4096 + len(context), SYMBOLS, len(languages)), np.float32)
    for i, name in enumerate(languages):
        own = lang == name
        sparse = np.zeros((len(context), SYMBOLS), np.float64)
        at = row[code[own] >> 6]
        deep = at >= 4096
        np.add.at(sparse, (at[deep] - 4096, code[own][deep] & 63), n[own][deep])
        two = np.bincount(code[own] & ((1 << 18) - 1), n[own], 1 << 18).reshape(4096, SYMBOLS)
        one = two.reshape(64, 64, SYMBOLS).sum(0)
        zero = one.sum(0, keepdims=True)
        every = np.arange(4096)
        cost[:4096, :, i] = _lengths([two, one[every & 63], np.broadcast_to(zero, (4096, SYMBOLS))])
        for lo in range(0, len(context), 8192):
            c = context[lo : lo + 8192]
            cost[4096 + lo : 4096 + lo + len(c), :, i] = _lengths([sparse[lo : lo + 8192], two[c & 4095], one[c & 63], np.broadcast_to(zero, (len(c), SYMBOLS))])
    return Model(languages, row, cost)


def _lengths(levels: list[np.ndarray]) -> np.ndarray:
    """Code lengths of all symbols, given counts from the longest context to order zero."""
    length = np.zeros(levels[0].shape)
    open_ = np.ones(levels[0].shape, bool)
    escape = np.zeros((len(levels[0]), 1))
    for counts in levels:
        left = np.where(open_, counts, 0.0)
        n, d = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
        hit = left > 0
        with np.errstate(divide="ignore"):
            length = np.where(hit, escape - np.log(np.maximum(left, 1e-300) / np.maximum(n + d, 1)), length)
            escape = escape - np.where(d > 0, np.log(np.maximum(d, 1) / np.maximum(n + d, 1)), 0.0)
        open_ &= ~hit
    return np.where(open_, escape + np.log(np.maximum(open_.sum(1, keepdims=True), 1)), length)


def code_lengths(s: Slice, model: Model) -> np.ndarray:
    """Code length of each document in each language, in nats."""
    code = grams(s)
    flat = model.row[code >> 6].astype(np.int64) * SYMBOLS + (code & 63)
    table = model.cost.reshape(-1, len(model.languages))
    return np.stack([sums(table[:, i][flat].astype(np.float64), s.starts) for i in range(len(model.languages))], axis=1)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (posterior of the winner under equal priors) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 64**3 contexts by language

    def run(batches):
        for b in batches:
            m = shared.value
            names = np.array([*m.languages, UNKNOWN], object)
            best, score = [], []
            for s in slices(b.column(1)):
                if not m.languages:
                    best.append(np.zeros(len(s), int))
                    score.append(np.zeros(len(s)))
                    continue
                length = code_lengths(s, m)
                i = length.argmin(1)
                best.append(i)
                score.append(1 / np.exp(np.clip(length.min(1, keepdims=True) - length, -700, 0)).sum(1))
            if best:
                letter = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                pick = np.where(letter, np.concatenate(best), len(m.languages))
                yield pa.record_batch([b.column(0), pa.array(names[pick], pa.string()), pa.array(np.where(letter, np.concatenate(score), 0.0))], [id_col, "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(F.col(id_col), F.col(text_col), letters).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
