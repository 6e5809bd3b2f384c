"""Phrase collocations by Toivonen mining: a sample proposes, a full pass counts, failures are expanded.

Frequent phrases (runs of up to ``max_words`` words within a piece, counted by language) obey the
rule that every part of a frequent phrase is frequent. So a phrase need only be counted if its first and its
last words, one word left out, are both expected to be frequent:

1. A sample of the documents proposes the frequent phrases, at a lowered threshold.
2. One pass over all documents counts the proposed phrases and their negative border: every word, and
   every longer phrase whose parts were proposed but which itself was not. Phrases travel as hashes of 47 bits with
   their counts, packed by ranges of the hash.
3. A border phrase that proves frequent is a failure. Each further pass counts the phrases that hold one,
   which may not have been counted, until a pass shows no failure.
4. A last pass spells and counts whatever has a frequent hash. These counts are exact: a hash that two phrases share
   could only let a phrase in that this pass then finds too rare.

What was proposed, and what is frequent, is kept in bit filters of fixed size, which is all that a pass leaves
behind. A false positive counts a phrase too many and loses none. Each task takes slices of whole documents, numbers their
words by an exact dictionary and adds up equal phrases before the shuffle; what stays under the threshold ends there.

Defined cases: null texts count as empty, null languages as ``und``; repeated rows count each time;
empty tables give no rows; further columns are ignored. A very long text is a slice of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.llm.kernel import BYTE_VALUES, Slice, mix, prefix_hash, slices, span_hash
from harmattan.session import materialize

#: Bytes that end a piece, and those that part words within one.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text worked on at a time: the arrays of a slice take about 30 times as much.
SLICE = 1 << 19
STEP = np.uint64(0xD1342543DE82EF95)
#: Rows that a task holds back to add them up.
HELD = 1 << 19
#: Different spelt phrases that a task keeps to meet more of the same, in so many parts by hash that are added up one by one.
KEPT = 3 << 19
PARTS = 16
#: Lower bits of a hash that are dropped; the next one marks phrases of the greatest length.
DROP = np.uint64(16)
LONGEST = np.uint64(1) << DROP


@dataclass(frozen=True)
class Mining:
    """What is looked for, and how the sample is drawn (these change the work, never the result)."""

    max_words: int = 3
    min_count: int = 10
    sample_of: int = 4  # one document in so many
    sample_count: int = 2  # occurrences in the sample that propose a phrase
    filter_bits: int = 26  # 8 MB; two such filters are broadcast
    rows_a_range: int = 256  # documents for each range of hashes, which one task adds up at a time


def text_hash(column: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    (s,) = slices(column, 1 << 62) if len(column) else (None,)
    if s is None:
        return np.zeros(0, np.uint64)
    return span_hash(prefix_hash(BYTE_VALUES[s.data]), s.starts[:-1], s.starts[1:])


class Filter:
    """A set of hashes as bits: holds all that were put in, and some more."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.bits, self.words | other.words)


def words_in(s: Slice) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a slice in lower case, the document of each, and whether the next one follows in the same piece."""
    data = LOWER[s.data]
    solid = ~GAP[data]
    begin, end = solid.copy(), solid.copy()
    if len(data):
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = s.starts[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[solid]))
    doc = np.searchsorted(s.starts, start, side="right") - 1
    piece = np.cumsum(BREAK[data], dtype=np.int32)[start]
    follows = np.zeros(len(start), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return words, doc, follows


def count_slice(s: Slice, langs: pa.Array, job: Mining, wanted: Filter | None, done: Filter | None = None, spelt: bool = False):
    """Yields (hashes, texts, counts) of the phrases of a slice that a pass has to count.

    A phrase of several words is counted if all its parts are in ``wanted``, and not if all are in ``done``; words are
    counted where there is no ``done``. Without ``wanted`` (the sample) all phrases shorter than the maximum are counted. With
    ``spelt``, only phrases in ``wanted`` themselves are counted and texts are given: phrase, tab and language, an empty
    phrase carrying the number of words of a language.
    """
    words, doc, follows = words_in(s)
    n = len(words)
    if not n:
        return
    names, vocabulary = langs.dictionary_encode(), words.dictionary_encode()
    kinds = len(vocabulary.dictionary)
    lang, word = names.indices.to_numpy()[doc], vocabulary.indices.to_numpy()
    unit = lang.astype(np.int64) * kinds + word
    width = len(names.dictionary) * kinds
    word_hash = text_hash(vocabulary.dictionary)
    lang_hash = mix(text_hash(names.dictionary))
    labels = names.dictionary.cast(pa.large_string())

    def text(at: np.ndarray, k: int) -> pa.Array:
        parts = [vocabulary.dictionary.take(pa.array(word[at + i])) for i in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return pc.binary_join_element_wise(phrase, labels.take(pa.array(lang[at])), pa.scalar("\t", pa.large_string()))

    if spelt:
        total = np.bincount(lang, minlength=len(labels))
        yield lang_hash, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), labels, pa.scalar("\t", pa.large_string())), total
    # Per place, for the phrase of k words that begins there: its code and hash; whether the pass before counted it.
    at, code = np.arange(n), unit
    h = mix(lang_hash[lang] * STEP + word_hash[word])
    past = np.full(n, done is not None)
    for k in range(1, job.max_words + (wanted is not None)):
        if k > 1:
            at = np.flatnonzero(follows[:-1] & open_[:-1] & open_[1:])
            if code.max() >= (1 << 62) // width:
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            code = code[at] * width + unit[at + k - 1]
            h = mix(h[at] * STEP + word_hash[word[at + k - 1]])
            past = closed[at] & closed[at + 1]
        own = h | LONGEST if k == job.max_words else h & ~LONGEST
        held = wanted.holds(own) if wanted is not None else np.ones(len(at), bool)
        counted = held if spelt else ~past
        if counted.any():
            _, first, count = np.unique(code[counted], return_index=True, return_counts=True)
            first = np.flatnonzero(counted)[first]
            yield own[first], text(at[first], k) if spelt else None, count
        if k == job.max_words or not held.any():
            return
        # What was left out at one length is left out of all longer phrases, in this pass and the one before.
        open_, closed = np.zeros(n, bool), np.zeros(n, bool)
        open_[at] = held
        if done is not None:
            closed[at] = past & done.holds(own)
        if k > 1:
            wide, hashes = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            wide[at], hashes[at] = code, h
            code, h = wide, hashes


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sums of their counts."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[begin], np.add.reduceat(n, begin, dtype=np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lower bytes of numbers, first all first bytes, then all second ones: what is alike lies together for the compression."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, width * n).reshape(width, n).T
    return out.view("<u8").ravel()


def frequent_hashes(docs: DataFrame, job: Mining, ranges: int, least: int, wanted: Filter | None, done: Filter | None = None) -> DataFrame:
    """Column h: hashes of phrases that a pass over ``docs`` (lang, text) counts ``least`` times or more.

    ``ranges`` (a power of two) parts the hashes; a task adds up one range at a time, and every range
    holds about as many, since equal phrases are one entry a task.
    """
    sent = docs.sparkSession.sparkContext.broadcast((wanted, done))  # fixed size
    bits = ranges.bit_length() - 1

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed():
            h, n = summed(*(np.concatenate(c) for c in zip(*held)))
            held.clear()
            at = (h >> np.uint64(64 - bits)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            end = np.append(begin[1:], len(h))
            for lo in range(0, len(begin), 128):
                some = list(zip(begin[lo : lo + 128], end[lo : lo + 128]))
                blobs = [_planes(h[a:b] >> DROP, 6) + _planes(n[a:b], 5) for a, b in some]
                yield pa.record_batch([pa.array(at[begin[lo : lo + 128]], pa.int32()), pa.array(blobs, pa.binary())], ["at", "entries"])

        size = 0
        for b in batches:
            for s in slices(b.column(1), SLICE):
                for h, _, n in count_slice(s, b.column(0).slice(s.lo, len(s)), job, *sent.value):
                    if held and size + len(h) > HELD:
                        yield from packed()
                        size = 0
                    held.append((h >> DROP << DROP, n.astype(np.int32)))
                    size += len(h)
        if held:
            yield from packed()

    def add(batches):
        at, held = None, []

        def enough():
            h, n = summed(*(np.concatenate(c) for c in zip(*held)))
            return pa.record_batch([pa.array((h[n >= least] << DROP).view(np.int64))], ["h"])

        for b in batches:
            for own, entries in zip(b.column(0).to_pylist(), b.column(1)):
                if own != at and held:
                    yield enough()
                    held = []
                at, raw = own, entries.as_py()
                n = len(raw) // 11
                held.append((_numbers(raw, 6, n), _numbers(raw[6 * n :], 5, n).astype(np.int64)))
        if held:
            yield enough()

    packs = docs.mapInArrow(count, "at int, entries binary")
    return packs.repartition("at").sortWithinPartitions("at").mapInArrow(add, "h long")


def hash_filter(hashes: DataFrame, job: Mining) -> tuple[Filter, Filter]:
    """Bit filters of a column h of hashes: of all, and of those that are not of the greatest length; their size is fixed."""
    place = F.shiftrightunsigned("h", 64 - job.filter_bits)
    longest = F.col("h").bitwiseAND(int(LONGEST)) != 0
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - job.filter_bits}) & 63 AS INT))")
    rows = hashes.select(F.shiftright(place, 6).alias("word"), bit.alias("bit"), F.when(longest, F.lit(0)).otherwise(bit).alias("short"))
    word, *bits = (c.to_numpy() for c in rows.groupBy("word").agg(F.bit_or("bit").alias("bit"), F.bit_or("short").alias("short")).toArrow().columns)
    out = []
    for b in bits:
        words = np.zeros(1 << (job.filter_bits - 6), np.uint64)
        words[word] = b.view(np.uint64)
        out.append(Filter(job.filter_bits, words))
    return out[0], out[1]


def spelt_counts(docs: DataFrame, job: Mining, wanted: Filter) -> DataFrame:
    """text, a: exact counts of all phrases in ``wanted`` that have ``min_count`` or more, and the words of each language."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def added(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        texts = pa.chunked_array([t for t, _ in held]).dictionary_encode().combine_chunks()
        return texts.dictionary, np.bincount(texts.indices.to_numpy(), np.concatenate([n for _, n in held]), len(texts.dictionary)).astype(np.int64)

    def sent_on(held):
        for texts, n in map(added, filter(None, held)):
            for lo in range(0, len(n), 1 << 16):
                yield pa.record_batch([texts.slice(lo, 1 << 16).cast(pa.string()), pa.array(n[lo : lo + (1 << 16)])], ["text", "n"])

    def run(batches):
        held, size, room = [[] for _ in range(PARTS)], 0, HELD // 2
        for b in batches:
            for s in slices(b.column(1), SLICE):
                for h, text, n in count_slice(s, b.column(0).slice(s.lo, len(s)), job, sent.value, spelt=True):
                    part = h >> np.uint64(60)
                    for i in range(PARTS):
                        at = np.flatnonzero(part == i)
                        if len(at):
                            held[i].append((text.take(pa.array(at)), n[at]))
                    size += len(n)
                    if size >= room:
                        for i in range(PARTS):
                            if held[i]:
                                held[i] = [added(held[i])]
                        size = sum(len(own[0][1]) for own in held if own)
                        if size >= KEPT:
                            yield from sent_on(held)
                            held, size = [[] for _ in range(PARTS)], 0
                        room = size + HELD // 2
        yield from sent_on(held)

    counts = docs.mapInArrow(run, "text string, n long").groupBy("text").agg(F.sum("n").alias("a"))
    return counts.filter((F.col("a") >= job.min_count) | F.col("text").startswith("\t"))


def frequent(docs: DataFrame, job: Mining = Mining(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, int]:
    """lang, k, phrase, a of all phrases with ``min_count`` or more occurrences, and the number of counting passes over all rows.

    Rows with k = 0 carry the number of words of each language.
    """
    given = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(given, F.col(text_col).alias("text"))
    in_sample = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(job.sample_of)) == 0
    ranges = 1 << min(max((docs.count() // job.rows_a_range).bit_length(), 6), 24)
    wanted, _ = hash_filter(frequent_hashes(docs.filter(in_sample).select(given, F.col(text_col).alias("text")), job, ranges, job.sample_count, None), job)
    done, known, passes = None, None, 0
    while True:
        found, short = hash_filter(frequent_hashes(rows, job, ranges, job.min_count, wanted, done), job)
        passes += 1
        known = found if known is None else known | found
        if not (short.words & ~wanted.words).any():
            break
        wanted, done = wanted | short, wanted
    counts = materialize(spelt_counts(rows, job, known))
    phrase = F.substring_index("text", "\t", 1)
    language = F.col("text").substr(F.length(phrase) + 2, F.length("text"))
    # Words of a phrase are parted by one space each.
    k = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    return counts.select(language.alias("lang"), k.alias("k"), phrase.alias("phrase"), "a"), passes


def scored(found: DataFrame, min_count: int = 10) -> DataFrame:
    """lang, k, phrase, a, l, r, score of the candidates, by their lowest cut; products are exact decimals."""
    counts = found.filter((F.col("k") > 0) & (F.col("a") >= min_count))
    cuts = counts.filter(F.col("k") > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    words = F.split("phrase", " ")
    cuts = cuts.withColumns({"left": F.array_join(F.slice(words, 1, F.col("cut")), " "), "rest": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ")})
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r"))
    score = F.lit(1_000_000).cast("decimal(7,0)") * a * a
    priced = cuts.join(left, ["lang", "left"]).join(rest, ["lang", "rest"]).withColumns({"top": score, "bottom": l * r})
    priced = priced.withColumn("score", F.expr("top DIV bottom"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return priced.groupBy("lang", "k", "phrase", "a").agg(best).select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, top: int = 2000, share: int = 50, job: Mining = Mining(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate goes if a longer one holds its words side by side and has ``share`` per cent of its
    occurrences or more, whether or not the longer one stays.
    """
    found, _ = frequent(docs, job, id_col, text_col, lang_col)
    candidates = scored(found, job.min_count)
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(0), F.col("k") - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))))
    longer = found.filter(F.col("k") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    totals = found.filter(F.col("k") == 0).select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
