"""Substring removal by seed and extend over winnowed word anchors.

A window is ``length`` consecutive words of one document. Each document is reduced to anchors: of
every window the word k-gram with the smallest hash. Equal windows choose the same anchor, so a
window that two documents share lies around an anchor that both have.

1. Seed: anchors are joined on their hash; those that occur in two or more documents are kept.
2. Extend: around each kept anchor of a document the windows that chose it are taken, to the left
   and to the right as far as windows can reach.
3. A window found in a document with a smaller id is a repeat; neighbouring repeats make up the maximal
   repeated runs, whose words are removed.

Seeding and extension are shuffles by hash whose runs are streamed, so a passage that a third of
the documents hold is read once, in order, without being gathered in memory; no pairs are made.
Keys are 64-bit hashes of words; a window must collide in both anchor and window hash to be taken wrongly.

Defined cases: a null or empty text has no words and the digest of the empty string; texts shorter
than a window lose nothing; a null id takes no part in the comparison and its row is kept whole; rows that repeat an
id with the same text are one document and get the same result; other columns are passed by, or kept by :func:`remove`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmattan.llm.kernel import Slice, Words, mix, sliding_argmin, slices, windows, words_of
from harmattan.llm.runs import later_owners, shared_runs
from harmattan.session import materialize


def anchored(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and hash of each window that stays within a document, and the place of its anchor."""
    h, inside = windows(w.hash, w.first, length)
    grams, _ = windows(w.hash, w.first, k)
    at = np.flatnonzero(inside)
    return at, h[at], sliding_argmin(grams, length - k + 1)[at] if len(at) else at


def seeds(docs: DataFrame, length: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Anchor hash and document of every anchor."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for s in slices(b.column(1)):
                w = words_of(s)
                at, _, anchor = anchored(w, length, k)
                if len(at):
                    anchor = np.unique(anchor)
                    grams, _ = windows(w.hash, w.first, k)
                    yield pa.record_batch([pa.array(grams[anchor].view(np.int64)), pa.array(ids[s.lo : s.hi][w.doc[anchor]])], ["anchor", "doc"])

    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "anchor long, doc long")


def extend(held: DataFrame, length: int, k: int) -> DataFrame:
    """Windows around the kept anchors of each document: doc, text, anchors -> window, doc, at."""

    def run(batches):
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(2)
            for s in slices(b.column(1)):
                w = words_of(s)
                at, h, anchor = anchored(w, length, k)
                if not len(at):
                    continue
                grams, _ = windows(w.hash, w.first, k)
                own = lists.slice(s.lo, len(s))
                kept_doc = np.repeat(np.arange(len(s), dtype=np.uint64), pa.compute.list_value_length(own).to_numpy(zero_copy_only=False))
                salt = np.uint64(0xD6E8FEB86659FD93)
                kept = mix(own.flatten().to_numpy().view(np.uint64) ^ (kept_doc * salt))
                mine = mix(grams[anchor] ^ (w.doc[anchor].astype(np.uint64) * salt))
                hit = np.isin(mine, kept)
                window = mix(h[hit] ^ mix(grams[anchor[hit]]))
                doc = w.doc[at[hit]]
                yield pa.record_batch([pa.array(window.view(np.int64)), pa.array(ids[s.lo : s.hi][doc]), pa.array((at[hit] - w.first[doc]).astype(np.int32))], ["window", "doc", "at"])

    return held.mapInArrow(run, "window long, doc long, at int")


def repeats(docs: DataFrame, length: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and the starts of its windows that a document with a smaller id holds too."""
    kept = shared_runs(seeds(docs, length, k, id_col, text_col), "anchor", "doc").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(kept, "doc")
    found = later_owners(extend(texts.select("doc", "text", "anchors"), length, k), "window", "doc", "at")
    return found.groupBy("doc").agg(F.collect_set("at").alias("starts"))


def _covered(s: Slice, w: Words, starts: pa.Array, length: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    own = starts.slice(s.lo, len(s))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(own), 0).to_numpy(zero_copy_only=False)
    at = np.repeat(w.first[:-1], sizes) + own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + length, len(w.start)), -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(docs: DataFrame, length: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """row (all columns but the text), text and the starts of its repeated windows."""
    found = materialize(repeats(docs, length, k, id_col, text_col))
    rest = F.struct(*[docs[c] for c in docs.columns if c != text_col])
    rows = docs.select(rest.alias("row"), docs[text_col].alias("text"), docs[id_col].cast("long").alias("doc"))
    return rows.join(found, "doc", "left").select("row", "text", "starts")


def report(docs: DataFrame, length: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words, words removed and the digest of the kept words of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, removed, digest = [], [], []
            for s in slices(b.column(1)):
                w = words_of(s)
                gone = _covered(s, w, b.column(2), length)
                raw, first = s.data.tobytes(), w.first.tolist()
                spans = [raw[a:z] for a, z in zip(w.start[~gone].tolist(), w.stop[~gone].tolist())]
                left = np.concatenate([[0], np.cumsum(~gone)])[w.first].tolist()
                for i in range(len(s)):
                    n.append(first[i + 1] - first[i])
                    removed.append(n[-1] - (left[i + 1] - left[i]))
                    digest.append(hashlib.sha256(b" ".join(spans[left[i] : left[i + 1]])).hexdigest())
            if n:
                yield pa.record_batch([b.column(0).field(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], [id_col, "n_words", "n_removed", "kept_sha256"])

    rows = _joined(docs.select(docs[id_col], docs[text_col]), length, k, id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, length: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of the text; white space around kept words stays as it is.

    A null text and a text that loses nothing stay unchanged.
    """

    def run(batches):
        for b in batches:
            texts, starts = b.column(1), b.column(2)
            out: list[str | None] = []
            for s in slices(texts):
                w = words_of(s)
                gone = _covered(s, w, starts, length)
                raw = s.data.tobytes()
                # From a removed word to the next word: the white space after it goes too.
                cut = np.zeros(len(s.data) + 1, np.int32)
                after = np.minimum(np.append(w.start[1:], len(s.data)), s.starts[1:][w.doc]) if len(w.start) else w.start
                np.add.at(cut, w.start[gone], 1)
                np.add.at(cut, after[gone], -1)
                keep = np.cumsum(cut[:-1]) == 0
                touched = np.bincount(w.doc[gone], minlength=len(s)) > 0
                for i, (a, z) in enumerate(zip(s.starts[:-1].tolist(), s.starts[1:].tolist())):
                    out.append(s.data[a:z][keep[a:z]].tobytes().decode() if touched[i] else raw[a:z].decode())
            if out:
                yield pa.record_batch([b.column(0), pa.compute.if_else(pa.compute.is_valid(texts), pa.array(out, texts.type), texts)], ["row", "text"])

    joined = _joined(docs, length, k, id_col, text_col)
    done = joined.mapInArrow(run, T.StructType([joined.schema["row"], joined.schema["text"]]))
    return done.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
