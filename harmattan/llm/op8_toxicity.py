"""Toxicity after noisy-channel deobfuscation.

Words that may hide others (digits or signs among letters, letters repeated three times or more,
letters set apart by spaces or marks) are read as a lattice: each sign offers the letters it may
stand for, a repeated letter or a mark may also be dropped. The Viterbi path under a character
model (four letters, counts over all texts, Witten-Bell smoothing) is the restored word. All
other words have a single path, themselves, and pass unchanged.

The restored text is scored by a logistic regression on hashed character 3- to 5-grams. Of the
grams in a bounded sample of labelled rows, drawn by class, all that clearly go with the toxic label
(G test) are taken; the fit is calibrated on scores of rows kept back in turn.

Counting and scoring run in Arrow batches; what reaches the driver is one count for each of 28**4
letter groups and the sample's selected grams. Defined cases: a null or empty text has the score of a text
without any gram; rows with a null label are not learnt from; without labels of both classes
every score is 0; repeated rows give repeated results; an id that is null is in no fold.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmattan.llm import common
from harmattan.llm.kernel import Slice, slices, words_of
from harmattan.session import materialize

# Signs and the letters they may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
}

BITS = 20
ORDER = 4
LETTERS = 28  # a-z, the edge of a word, any other letter
EDGE, OTHER = 26, 27

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_DIGIT_END = np.zeros(256, bool)
_DIGIT_END[list(b"0123456789$@")] = True
_SYMBOL = np.full(256, EDGE, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
_SYMBOL[128:] = OTHER


# --- character model -------------------------------------------------------------------------


@dataclass(frozen=True)
class CharModel:
    """Cost in nats of a letter after three others, as a table [a, b, c, next]."""

    cost: np.ndarray


def count_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each group of four letters occurs over all texts."""

    def run(batches):
        total = np.zeros(LETTERS**ORDER, np.int64)
        for b in batches:
            for s in slices(b.column(0)):
                sym = _SYMBOL[s.data]
                sym = sym[np.concatenate([[True], (sym[1:] != OTHER) | ((s.data[1:] & 0xC0) != 0x80)])] if len(sym) else sym
                sym = np.concatenate([np.full(3, EDGE), sym, np.full(1, EDGE)])
                code = ((sym[:-3] * LETTERS + sym[1:-2]) * LETTERS + sym[2:-1]) * LETTERS + sym[3:]
                total += np.bincount(code, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"code": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    return docs.filter(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    got = count_letters(docs, text_col).toArrow()
    counts = np.zeros(LETTERS**ORDER)
    counts[got["code"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape((LETTERS,) * ORDER)
    p = np.full(LETTERS, 1 / LETTERS)
    for level in range(ORDER):
        c = counts.sum(tuple(range(ORDER - 1 - level))) if level < ORDER - 1 else counts
        n, d = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = (c + d * p) / np.maximum(n + d, 1) + (n + d == 0) * p
    return CharModel((-np.log(np.maximum(p, 1e-12))).astype(np.float32))


class Restorer:
    """Viterbi decoding of obfuscated words; results are kept, up to a bound, for each worker."""

    SIGN, DROP_MARK, DROP_REPEAT, KEEP_REPEAT = 0.7, 0.3, 0.3, 1.5

    def __init__(self, model: CharModel, limit: int = 100_000):
        self.cost = model.cost.reshape(-1).tolist()
        self.limit, self.known = limit, {}

    def restore(self, token: str) -> str:
        out = self.known.get(token)
        if out is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            out = self.known[token] = self._decode(token.lower())
        return out

    def _decode(self, token: str) -> str:
        size, cut = LETTERS, LETTERS**3
        edge = (EDGE * size + EDGE) * size + EDGE
        # Best path into each state (the last three letters): cost and a chain of (letter, rest).
        paths: dict[int, tuple[float, object]] = {edge: (0.0, None)}
        before, run = "", 0
        for ch in token:
            run = run + 1 if ch == before else 1
            letter = ch.isalpha()
            options = [(ch, self.KEEP_REPEAT if run > 2 else 0.0)] if letter else [(x, self.SIGN) for x in LEET.get(ch, "")]
            drop = (self.DROP_REPEAT if run > 2 else 1.0) if letter and run > 1 else None if letter else self.DROP_MARK if ch not in LEET else 4.0
            following: dict[int, tuple[float, object]] = {}
            for state, (cost, chain) in paths.items():
                if drop is not None and (state not in following or following[state][0] > cost + drop):
                    following[state] = (cost + drop, chain)
                for x, extra in options:
                    i = ord(x) - 97
                    i = i if 0 <= i < 26 else OTHER
                    to = state * size + i
                    total = cost + extra + self.cost[to]
                    to %= cut
                    if to not in following or following[to][0] > total:
                        following[to] = (total, (x, chain))
            paths, before = following, ch
        _, chain = min(((c + self.cost[state * size + EDGE], p) for state, (c, p) in paths.items()), key=lambda r: r[0])
        out = []
        while chain is not None:
            out.append(chain[0])
            chain = chain[1]
        return "".join(reversed(out))


def suspicious(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and document of each span that may hide a word; no two overlap."""
    w = words_of(s, hashes=False)
    n, data = len(w.start), s.data
    if not n:
        return w.start, w.stop, w.doc
    letter = _LETTER[data]
    at = np.arange(len(data))
    count = np.concatenate([[0], np.cumsum(letter)])
    has_letter = count[w.stop] > count[w.start]
    last = np.maximum.accumulate(np.where(letter, at, -1))[w.stop - 1]
    following = np.minimum.accumulate(np.where(letter, at, len(data))[::-1])[::-1][w.start]
    # A sign before the last letter; or up to two digits right after it, which end the word.
    leet = np.concatenate([[0], np.cumsum(_LEET[data])])
    marks = np.concatenate([[0], np.cumsum(~letter)])
    tail = w.stop - 1 - last
    digits = np.concatenate([[0], np.cumsum(_DIGIT_END[data])])
    odd = has_letter & ((leet[np.maximum(last, w.start)] > leet[w.start]) | ((tail > 0) & (tail <= 2) & (digits[w.stop] - digits[np.minimum(last + 1, w.stop)] == tail)))
    # Marks between letters.
    odd |= has_letter & (marks[np.maximum(last, w.start)] > marks[np.minimum(following, np.maximum(last, w.start))])
    # Three equal letters in a row, case aside.
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    triple = np.zeros(len(data), bool)
    triple[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & (data[2:] < 128)
    triples = np.concatenate([[0], np.cumsum(triple)])
    odd |= triples[w.stop] > triples[np.minimum(w.start + 2, w.stop)]
    # Runs of three or more single letters: one span.
    lone = (count[w.stop] - count[w.start] == 1) & (w.stop - w.start <= 2) & (data[w.start] < 128) | (w.stop - w.start == 1) & _LEET[data[w.start]]
    joins = lone[1:] & lone[:-1] & (w.doc[1:] == w.doc[:-1])
    group = np.cumsum(np.concatenate([[True], ~joins]))
    size = np.bincount(group)
    spaced = lone & (size[group] >= 3)
    odd &= ~spaced
    head = np.flatnonzero(spaced & np.concatenate([[True], ~joins]))
    tail_of = head + size[group[head]] - 1
    start = np.concatenate([w.start[odd], w.start[head]])
    stop = np.concatenate([w.stop[odd], w.stop[tail_of]])
    doc = np.concatenate([w.doc[odd], w.doc[head]])
    order = np.argsort(start, kind="stable")
    return start[order], stop[order], doc[order]


def restored(s: Slice, restorer: Restorer) -> tuple[Slice, Slice, np.ndarray]:
    """The slice with hidden words blanked, the restored words, and the document of each of those."""
    start, stop, doc = suspicious(s)
    data = s.data.copy()
    blank = np.zeros(len(data) + 1, np.int32)
    np.add.at(blank, start, 1)
    np.add.at(blank, stop, -1)
    data[np.cumsum(blank[:-1]) > 0] = 32
    raw = s.data.tobytes()
    words = [restorer.restore(raw[a:b].decode()).encode() for a, b in zip(start.tolist(), stop.tolist())]
    joined = np.frombuffer(b"".join([b" " + x + b" " for x in words]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) + 2 for x in words])]).astype(np.int64)
    return Slice(s.lo, s.hi, data, s.starts), Slice(0, len(words), joined, starts), doc


# --- grams and the classifier ----------------------------------------------------------------


def grams(s: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 3, 4, 5: bucket of each byte n-gram of the folded text, and the document it lies in."""
    data = s.data
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if len(low) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        low[upper] += 32
    low[~_LETTER[data] & ~((data >= 48) & (data <= 57))] = 32
    doc = np.repeat(np.arange(len(s), dtype=np.int32), np.diff(s.starts))
    wide, out = low.astype(np.uint64), []
    for n in (3, 4, 5):
        m = len(low) - n + 1
        if m <= 0:
            break
        code = np.full(m, n, np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | wide[j : j + m]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        inside = doc[:m] == doc[n - 1 :]
        out.append((code.astype(np.int32)[inside], doc[:m][inside]))
    return out


def present(s: Slice, restorer: Restorer, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Document and gram of each distinct (document, gram), optionally of wanted grams alone."""
    text, words, word_doc = restored(s, restorer)
    found = []
    for part, names in ((text, None), (words, word_doc)):
        for gram, doc in grams(part):
            if wanted is not None:
                hit = wanted[gram]
                gram, doc = gram[hit], doc[hit]
            found.append((doc if names is None else names[doc]).astype(np.int64) << BITS | gram)
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    chars: CharModel
    weights: np.ndarray  # by bucket; zero for grams not taken
    bias: float
    slope: float
    offset: float
    learnt: bool

    def score(self, s: Slice, restorer: Restorer) -> np.ndarray:
        if not self.learnt:
            return np.zeros(len(s))
        doc, gram = present(s, restorer, self.weights != 0)
        return common.sigmoid(self.slope * (np.bincount(doc, self.weights[gram], len(s)) + self.bias) + self.offset)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", max_rows: int = 20_000, min_z: float = 5.0) -> Model:
    """Character model over all of ``docs``; classifier on at most ``max_rows`` labelled rows, drawn by class and hash of the key.

    The rarer class fills up to half of the sample; scores are set back to the share it has among all labels.
    """
    chars = char_model(docs, text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chars)
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull())
    totals = {0: 0, 1: 0} | {int(r["y"]): r["n"] for r in usable.groupBy(F.col(label_col).alias("y")).agg(F.count("*").alias("n")).collect()}
    quotas = {y: min(totals[y], max(max_rows // 2, max_rows - totals[1 - y])) for y in (0, 1)}
    sample = materialize(common.labelled_sample(docs, labels, label_col, max_rows, key_col, text_col, quotas))

    def count(batches):
        restorer, hits, n = Restorer(shared.value), np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for s in slices(b.column("t")):
                hits += np.bincount(present(s, restorer, None)[1], minlength=1 << BITS)
        at = np.flatnonzero(hits)
        yield pa.record_batch({"gram": pa.array(np.concatenate([[-1], at]), pa.int32()), "n": pa.array(np.concatenate([[n], hits[at]]), pa.int64())})

    counted = {y: sample.filter(F.col("y") == y).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias(f"n{y}")) for y in (0, 1)}
    got = counted[1].join(counted[0], "gram", "left").toArrow()  # at most 2**BITS rows
    gram, pos, neg = (np.nan_to_num(got[c].to_numpy()).astype(np.int64) for c in ("gram", "n1", "n0"))
    n_pos, n_neg = int(pos[gram == -1].sum()), int(neg[gram == -1].sum())
    if not n_pos or not n_neg:
        return Model(chars, np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0, False)
    ratio = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    # The signed root of the G statistic, which does not punish a gram for never occurring in clean rows.
    share = (pos + neg) / (n_pos + n_neg)
    g = np.zeros(len(gram))
    for seen, n, p in ((pos, n_pos, share), (neg, n_neg, share), (n_pos - pos, n_pos, 1 - share), (n_neg - neg, n_neg, 1 - share)):
        g += 2 * seen * np.log(np.maximum(seen, 1) / np.maximum(n * p, 1e-300))
    z = np.sign(ratio) * np.sqrt(np.maximum(g, 0))
    take = np.flatnonzero((gram >= 0) & (z > min_z) & (ratio > 1))
    chosen = np.sort(gram[take])
    number = np.full(1 << BITS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    picked = spark.sparkContext.broadcast(number)

    def select(batches):
        restorer = Restorer(shared.value)
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            part = np.array([zlib.crc32(k.encode()) % 4 for k in b.column("k").to_pylist()], np.int32)
            for s in slices(b.column("t")):
                doc, gram = present(s, restorer, picked.value >= 0)
                lists = np.split(picked.value[gram], np.cumsum(np.bincount(doc, minlength=len(s)))[:-1])
                yield pa.record_batch({"y": pa.array(y[s.lo : s.hi], pa.int32()), "f": pa.array([x.astype("<i4").tobytes() for x in lists], pa.binary()), "part": pa.array(part[s.lo : s.hi])})

    got = sample.mapInArrow(select, "y int, f binary, part int").toArrow()
    y = got["y"].to_numpy().astype(float)
    feats = [np.frombuffer(x, "<i4") for x in got["f"].to_pylist()]
    part = got["part"].to_numpy()

    def fit(rows: np.ndarray) -> tuple[np.ndarray, float]:
        at = np.repeat(np.arange(len(rows)), [len(feats[i]) for i in rows])
        cols = np.concatenate([feats[i] for i in rows]) if len(rows) else np.zeros(0, np.int32)
        return common.fit_logistic(at, cols, np.ones(len(cols)), y[rows], max(len(chosen), 1), 1e-4, steps=150, rate=0.1)

    # Weights from all rows; the calibration from scores that each part gets by a fit on the others.
    w, bias = fit(np.arange(len(y)))
    z = np.array([w[f].sum() for f in feats]) + bias
    if all(len(set(y[part != p])) == 2 for p in range(4)):
        for p in range(4):
            own, at = fit(np.flatnonzero(part != p))
            for i in np.flatnonzero(part == p):
                z[i] = own[feats[i]].sum() + at
    slope, offset = common.fit_platt(z, y)
    offset += np.log(totals[1] / totals[0]) - np.log(quotas[1] / quotas[0])
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w[: len(chosen)]
    return Model(chars, weights, bias, slope, offset, True)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, score and predicted label of each row; with ``keep_text`` also the restored words."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        restorer = Restorer(shared.value.chars)
        for b in batches:
            values, words = [], []
            for s in slices(b.column(1)):
                values.append(shared.value.score(s, restorer))
                if keep_text:
                    own: list[list[str]] = [[] for _ in range(len(s))]
                    _, part, doc = restored(s, restorer)
                    raw = part.data.tobytes()
                    for i, d in enumerate(doc.tolist()):
                        own[d].append(raw[part.starts[i] : part.starts[i + 1]].decode().strip())
                    words += own
            if values:
                p = np.concatenate(values)
                columns = [b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                names = [id_col, "score", "predicted"]
                if keep_text:
                    columns.append(pa.array(words, pa.list_(pa.string())))
                    names.append("restored")
                yield pa.record_batch(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int" + (", restored array<string>" if keep_text else ""))
