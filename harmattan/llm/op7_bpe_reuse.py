"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts the texts into chunks at places that depend on content
alone, so that copied passages fall into the same chunks wherever they stand. A chunk is encoded
once and kept; documents are put together from kept chunks. A cut may fall inside a word, and the
tokenizer never merges across white space, so a chunk keeps its first and last fragment apart:
at a join the fragments on both sides are glued and encoded again, over as many chunks as it takes
to reach white space on both sides, which gives exactly the ids of the whole text. Words within chunks are
reused in the same way.

This holds for tokenizers whose pre-tokenizer splits at white space and drops it (the tokens of a
text are those of its words). Both stores are bounded and started anew when full: that
changes the time only, never the ids. There is no shuffle; a lost task is simply run again.

Defined cases: a null text is empty: no ids, and the decoded text is empty. Repeated rows give
repeated results. A text without white space is one word and is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harmattan.llm.kernel import BYTE_VALUES, rolling_hash, slices

#: White space that every pre-tokenizer of this kind drops; rarer kinds stay inside words.
_TO_SPACE = bytes.maketrans(b"\t\n\r", b"   ")


class ChunkCoder:
    """Encodes and decodes texts of UTF-8 bytes by reusing chunks and words."""

    def __init__(self, path: str, window: int = 8, mean_chunk: int = 128, max_words: int = 250_000, max_chunks: int = 60_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.window, self.mask = window, np.uint64(mean_chunk - 1)
        self.max_words, self.max_chunks = max_words, max_chunks
        self.words: dict[bytes, tuple[bytes, bytes]] = {b"": (b"", b"")}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.chunks: dict[bytes, tuple] = {}

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places where chunks begin: the starts of documents and those that the content defines."""
        h = rolling_hash(BYTE_VALUES[data], self.window)
        at = np.flatnonzero((h & self.mask) == 0) + self.window
        at = at[at < len(data)]
        at = at[(data[at] & 0xC0) != 0x80]
        return np.union1d(at, starts)

    def _learn(self, needed: set[bytes]) -> None:
        """Makes sure that all needed words are kept. Full, the store becomes the older generation,
        from which words met again move back."""
        missing = needed - self.words.keys()
        if len(self.words) + len(missing) > self.max_words:
            self.older, self.words, missing = self.words, {b"": (b"", b"")}, needed
        back = missing & self.older.keys()
        self.words.update((w, self.older[w]) for w in back)
        texts = [w for w in missing if w not in self.words]
        names = self.names
        for w, e in zip(texts, self.tokenizer.encode_batch_fast([w.decode() for w in texts], add_special_tokens=False)):
            # Without a decoder the library joins the tokens' names by spaces.
            self.words[w] = array("I", e.ids).tobytes(), " ".join([names[i] for i in e.ids]).encode()

    def _assemble(self, words: list[bytes]) -> tuple[bytes, bytes]:
        got = [self.words[w] for w in words]
        return b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])

    def encode(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[bytes, bytes]]:
        """For each document: its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        raw = data.tobytes().translate(_TO_SPACE)
        cuts = self.cuts(data, starts).tolist()
        keys = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.chunks) > self.max_chunks:
            self.chunks = {}
        fresh = {k: k.split(b" ") for k in dict.fromkeys(keys) if k not in self.chunks}
        place = {p: i for i, p in enumerate(cuts)}

        # Words of new chunks, and the words glued from fragments at the joins.
        glued: list[list] = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            parts, open_ = [], []
            for key in keys[place[a] : place[b]] if b > a else ():
                pieces = fresh.get(key)
                head, tail = (pieces[0], pieces[-1]) if pieces is not None else (self.chunks[key][0], self.chunks[key][2])
                single = len(pieces) == 1 if pieces is not None else self.chunks[key][3]
                open_.append(head)
                if not single:
                    parts.append((b"".join(open_) if len(open_) > 1 else open_[0], key))
                    open_ = [tail]
            parts.append((b"".join(open_), None))
            glued.append(parts)
        needed = {w for parts in glued for w, _ in parts}
        for pieces in fresh.values():
            needed.update(pieces[1:-1])
        self._learn(needed)
        for key, pieces in fresh.items():
            self.chunks[key] = (pieces[0], self._assemble(pieces[1:-1]), pieces[-1], len(pieces) == 1)
        out = []
        for parts in glued:
            ids, decoded = [], []
            for word, key in parts:
                i, d = self.words[word]
                ids.append(i)
                if d:
                    decoded.append(d)
                if key is not None:
                    i, d = self.chunks[key][1]
                    ids.append(i)
                    if d:
                        decoded.append(d)
            out.append((b"".join(ids), b" ".join(decoded)))
        return out


@lru_cache(maxsize=1)
def coder_of(path: str) -> ChunkCoder:
    """One coder for each Python worker, which serves many tasks."""
    coder = ChunkCoder(path)
    if coder.tokenizer.decoder is not None:
        raise ValueError("chunks can be decoded one by one only if the tokenizer file names no decoder")
    return coder


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids and of the decoded text; with ``keep`` also both of them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = coder_of(path)
        for b in batches:
            got: list[tuple[bytes, bytes]] = []
            for s in slices(b.column(1)):
                part = coder.encode(s.data, s.starts)
                got += part if keep else [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in part]
            if not got:
                continue
            if keep:
                rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in got]
            else:
                rows = got
            columns = [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([d.decode() for _, d in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
