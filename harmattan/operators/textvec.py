"""Message tagging, conversation context, hash embeddings, nearest vectors, close spellings."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.functions.text import token_sorted
from harmattan.operators.keyed import top_per_key
from harmattan.session import materialize

# Keyword lists of intents, query types and domains, tried in order.
INTENTS = [
    ("DRILL_DOWN", ["detail", "decomp", "par region", "par produit", "par mois", "par client", "par categorie", "par vendeur"]),
    ("COMPARE_PERFORMANCE", ["compare", "compar", "ecart", "variation"]),
    ("QUERY_KPI", ["kpi", "marge", "ca", "chiffre", "stock", "tresorerie", "alerte", "anomalie", "risque"]),
]
QUERY_TYPES = [
    ("kpi_query", ["kpi", "marge", "ca", "chiffre", "stock", "tresorerie"]),
    ("insight_request", ["comment", "pourquoi", "explique"]),
]
DOMAINS = [
    ("sales", ["vente", "commercial", "canal", "client"]),
    ("stocks", ["stock", "rupture", "depot", "appro"]),
    ("finance", ["tresorerie", "finance", "marge", "creance"]),
    ("regions", ["region", "territoire", "agence", "zone"]),
    ("alerts", ["alerte", "anomalie", "risque", "conflit"]),
]
DIMENSIONS = ["region", "produit", "client", "categorie", "vendeur", "depot", "canal", "mois", "trimestre", "semestre", "jour"]
MONTH_NAMES = r"\b(janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre)\b"
# Small-talk openings and phrases.
OPENINGS = [
    ("greeting", r"^(bonjour|bonsoir|salut|hello|coucou|hey|yo|re)\b"),
    ("thanks", r"^(merci|merci beaucoup|super|parfait|top|ok)\b"),
    ("farewell", r"^(au revoir|bye|a bientot|a bientôt|a plus|bonne journee|bonne journée)\b"),
]
IDENTITY = ["qui es tu", "tu es qui", "qui tu es", "presente toi", "présente toi", "cest quoi toi", "c est quoi toi"]
CAPABILITIES = [
    "que fais tu", "quest ce que tu fais", "qu est ce que tu fais", "que sais tu faire", "tu peux faire quoi", "tu sais faire quoi",
    "tu peux faire", "que peux tu faire", "qu est ce que tu sais faire", "a quoi tu sers", "à quoi tu sers", "quelle est ta mission",
    "quel est ton role", "quel est ton rôle",
]


def _any(text: Column, words: Sequence[str]) -> Column:
    """One scan of the text for all words."""
    return text.rlike("|".join(words))


def first_match(text: Column, table: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    lowered = F.lower(text)
    out = F.lit(default)
    for name, words in reversed(table):
        out = F.when(_any(lowered, words), name).otherwise(out)
    return out


def intent(text: Column) -> Column:
    return first_match(text, INTENTS, "ASK_DATA")


def query_type(text: Column) -> Column:
    return first_match(text, QUERY_TYPES, "data_query")


def domain(text: Column, page: Column | None = None) -> Column:
    """The page the user is on decides when it is a known domain, otherwise the words do."""
    by_words = first_match(text, DOMAINS, "dashboard")
    if page is None:
        return by_words
    return F.when(F.lower(page).isin([d for d, _ in DOMAINS] + ["dashboard", "clients"]), F.lower(page)).otherwise(by_words)


def months(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(MONTH_NAMES), F.lit(1))


def has_number(text: Column) -> Column:
    return text.rlike(r"\d")


def requested_dimension(text: Column) -> Column:
    """First dimension, in list order, that the message names."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(d), F.lit(d)) for d in DIMENSIONS])


def small_talk(text: Column) -> Column:
    """greeting, thanks, farewell, identity, capabilities or null."""
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9éèêàçùôîûäöü\s]", " ")
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    out = F.when(_any(clean, IDENTITY), "identity").when(_any(clean, CAPABILITIES), "capabilities")
    for name, pattern in reversed(OPENINGS):
        out = F.when(clean.rlike(pattern), name).otherwise(out)
    return out


def recent_context(messages: DataFrame, session: str, order: str, role: str, text: str, n: int = 5, width: int = 200) -> DataFrame:
    """Last messages of each session in order, each cut to a display width."""
    recent = top_per_key(messages.select(session, order, role, F.substring(text, 1, width).alias("__t")), [session], [F.desc(order)], n)
    speaker = F.when(F.col(role) == "user", "Utilisateur").otherwise("Assistant")
    line = F.struct(F.col(order).alias("o"), F.concat(F.lit("["), speaker, F.lit("] "), "__t").alias("l"))
    lines = F.array_sort(F.collect_list(line))
    return recent.groupBy(session).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("context"))


# --- vectors ----------------------------------------------------------------------------------
class CharWeights:
    """Weights drawn from the md5 of ``char_i``, each worked out once a worker.

    Characters met first and early positions are kept in a table of bounded size; others are worked out once a call.
    """

    def __init__(self, chars: int = 128, positions: int = 1 << 15):
        self.row = np.full(0x110000, -1, np.int16)
        self.table = np.full((chars, positions), np.nan)
        self.used = 0

    def __call__(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for c in np.unique(code):
            if self.row[c] < 0 and self.used < len(self.table):
                self.row[c], self.used = self.used, self.used + 1
        row = self.row[code]
        kept = (row >= 0) & (at < self.table.shape[1])
        out = np.full(len(code), np.nan)
        out[kept] = self.table[row[kept], at[kept]]
        new = np.flatnonzero(np.isnan(out))
        pairs, place = np.unique(at[new] * 0x110000 + code[new], return_inverse=True)
        drawn = [int(hashlib.md5(f"{chr(x % 0x110000)}_{x // 0x110000}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for x in pairs.tolist()]
        out[new] = np.array(drawn, float)[place]
        self.table[row[kept], at[kept]] = out[kept]
        return out


@lru_cache(maxsize=1)
def _char_weights() -> CharWeights:
    return CharWeights()


def char_sums(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``dim`` sums of each text, and how many of them, from the first on, a character has met."""
    codes = [np.frombuffer((t or "").encode("utf-32-le"), "<u4").astype(np.int64) for t in texts.to_pylist()]
    length = np.array([len(c) for c in codes])
    at = np.concatenate([np.arange(n) for n in length])
    place = np.repeat(np.arange(len(codes)), length) * dim + at % dim
    sums = np.bincount(place, _char_weights()(np.concatenate(codes), at), len(codes) * dim)
    return sums.reshape(-1, dim), np.minimum(length, dim)


def unit_rows(keys: pa.Array, sums: np.ndarray, met: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """(key, dim, weight) rows of the sums that were met, each key's of length one."""
    row, at = np.nonzero(np.arange(sums.shape[1]) < met[:, None])
    norm = np.sqrt((sums * sums).sum(axis=1))
    return pa.record_batch([keys.take(pa.array(row)), pa.array(at, pa.int32()), pa.array(sums[row, at] / norm[row])], names)


def repeated_slots(rows: DataFrame, words: int) -> DataFrame:
    """Bits of the hashes ``__hash`` that more than one row has, as (__slot, __bits): ``words`` rows at most, however many rows there are."""
    twice = rows.groupBy("__hash").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr(f"pmod(shiftright(__hash, 6), {words}L)").alias("__slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(__hash & 63 AS INT))")).alias("__bits"))


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 384, rows: int = 64, block_rows: int = 1024, words: int = 1 << 16) -> DataFrame:
    """Deterministic unit vector of a text, as (key, dim, weight) rows.

    Character i adds a weight drawn from the md5 of ``char_i`` to position i modulo ``dim``.
    Characters are added up within their row, ``rows`` texts at a time. A row whose key no other row has is finished where it was
    read. Rows that may share a key, by a bit table of ``words`` words that is broadcast, leave one row of sums for a key and
    ``block_rows`` texts; these are added up in the order of the key, with one key's sums held. ``df`` is read again for its keys.
    """
    names = [key, "dim", "weight"]
    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, dim int, weight double"

    def finished(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                yield unit_rows(part.column(0), *char_sums(part.column(1), dim), names)

    def packed(batches):
        for b in batches:
            for block in (b.slice(lo, block_rows) for lo in range(0, b.num_rows, block_rows)):
                keys, of = block.column(0), np.arange(block.num_rows)
                if not pa.types.is_nested(keys.type):
                    coded = keys.dictionary_encode(null_encoding="encode")
                    keys, of = coded.dictionary, coded.indices.to_numpy()
                sums, met = np.zeros((len(keys), dim)), np.zeros(len(keys), np.int64)
                for lo in range(0, block.num_rows, rows):
                    some = of[lo : lo + rows]
                    added, length = char_sums(block.column(1).slice(lo, rows), dim)
                    np.add.at(sums, some, added)
                    np.maximum.at(met, some, length)
                ends = pa.array(np.concatenate([[0], met.cumsum()]), pa.int32())
                yield pa.record_batch([keys, pa.ListArray.from_arrays(ends, pa.array(sums[np.arange(dim) < met[:, None]]))], [key, "__sums"])

    def met_by_key(batches):
        held = None  # the last key so far, whose rows may go on
        for b in batches:
            for block in (b.slice(lo, block_rows) for lo in range(0, b.num_rows, block_rows)):
                first, length = block.column(2).to_numpy(zero_copy_only=False), block.column(1).value_lengths().to_numpy()
                run = first.cumsum()
                at = np.arange(length.sum()) - np.repeat(length.cumsum() - length, length)
                sums = np.bincount(np.repeat(run, length) * dim + at, block.column(1).flatten().to_numpy(), (run[-1] + 1) * dim).reshape(-1, dim)
                met = np.zeros(len(sums), np.int64)
                np.maximum.at(met, run, length)
                before = block.column(0).slice(0, 1)
                if held:
                    before, sums[0], met[0] = held[0], sums[0] + held[1][0], max(met[0], held[2][0])
                keys = pa.concat_arrays([before, block.column(0).filter(pa.array(first))])
                yield unit_rows(keys[:-1], sums[:-1], met[:-1], names)
                held = keys[-1:], sums[-1:], met[-1:]
        if held:
            yield unit_rows(*held, names)

    # Strings that are equal by their collation may differ in their hashes.
    texts = df.select(key, F.col(text).cast("string").alias("__text"), (F.lit(0).cast("bigint") if "collate" in kind else F.xxhash64(key)).alias("__hash"))
    slots = F.broadcast(repeated_slots(texts, words))
    shared = (F.expr(f"pmod(shiftright(__hash, 6), {words}L)") == F.col("__slot")) & (F.expr("shiftright(__bits, CAST(__hash & 63 AS INT)) & 1") == 1)
    alone = texts.join(slots, shared, "left_anti").select(key, "__text").mapInArrow(finished, out)
    meeting = texts.join(slots, shared, "left_semi").select(key, "__text").mapInArrow(packed, f"`{key}` {kind}, __sums array<double>")
    in_order = meeting.withColumn("__first", F.row_number().over(W.partitionBy(key).orderBy(key)) == 1)
    return alone.unionByName(in_order.mapInArrow(met_by_key, out))


def centres_of(examples: DataFrame, cells: int, sample_rows: int) -> np.ndarray:
    """Directions spread over a bounded sample: each the one farthest from those before."""
    sample = examples.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()
    if sample.empty:
        return np.zeros((0, 0))
    x, _ = _directions(sample["v"])
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((1, 1))
    chosen = [0]
    best = x @ x[0]
    while len(chosen) < min(cells, len(x)) and best.min() < 1 - 1e-9:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return x[chosen]


def _directions(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one (zero stays zero), and the lengths they had."""
    x = np.stack([np.asarray(v, dtype=float) for v in vectors])
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1.0)[:, None], length


def _angles(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    x, _ = _directions(vectors)
    if centres.shape[1] != x.shape[1]:
        return np.full((len(x), len(centres)), np.pi)
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest finite scores of each row, the first columns on ties."""
    if scores.shape[1] <= k:
        return np.nonzero(scores > -np.inf)
    edge = np.partition(scores, -k, axis=1)[:, -k, None]
    above, level = scores > edge, scores == edge
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero((above | (level & (level.cumsum(axis=1, dtype=np.int32) <= room))) & (scores > -np.inf))


def nearest(
    queries: DataFrame, examples: DataFrame, vector: str, key: str, k: int = 5, minimum: float = 0.3, cells: int = 64, first: int = 2, block_rows: int = 8192,
    sample_rows: int = 4096, compared: list[int] | None = None,
) -> DataFrame:
    """Best ``k`` examples by cosine for each query vector, above a minimum; exact.

    Examples lie in the cell of the centre with the smallest angle; a cell knows its radius. No example of a cell can be nearer
    to a query than the angle to its centre less the radius. A query first visits the ``first`` cells with the best bound, and
    then just those whose bound reaches its k-th similarity so far. A query is shuffled once for each cell it visits and each
    block of ``block_rows`` of the cell's examples, an example once for each such block of its cell's queries, so that copies of
    one vector are not one task and a task holds two blocks. Centres come from a bounded sample; they and the radii, one row a cell, are all that passes the driver.
    ``compared`` takes up the number of pairs each round compares.
    """
    id_type = examples.schema[key].dataType.simpleString()

    def rows(side: DataFrame) -> DataFrame:
        return side.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND id IS NOT NULL")

    given, asked = rows(examples), rows(queries)
    centres = centres_of(given, cells, sample_rows)
    out = f"query_id {id_type}, example_id {id_type}, similarity double"
    if not len(centres):
        return examples.sparkSession.createDataFrame([], out + ", rank int")

    def assign(parts):
        for part in parts:
            if len(part):
                angle = _angles(part["v"], centres)
                own = angle.argmin(axis=1)
                zero = np.array([not np.any(v) for v in part["v"]])
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "cell": own, "angle": np.where(zero, np.pi, angle[np.arange(len(own)), own])})

    held = materialize(given.mapInPandas(assign, f"id {id_type}, v array<double>, cell int, angle double"))
    known = {r["cell"]: (r["radius"], r["n"]) for r in held.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    full = np.array(sorted(known))
    radius = np.array([known[c][0] for c in full])
    blocks = {c: -(-known[c][1] // block_rows) for c in known}

    def visits(side: DataFrame, later: bool) -> DataFrame:
        """Queries with the cells of a round."""

        def choose(parts):
            for part in parts:
                if not len(part):
                    continue
                # A margin for rounding; a bound too high costs a visit and no result.
                bound = np.cos(np.maximum(_angles(part["v"], centres)[:, full] - radius - 1e-6, 0.0))
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, np.argsort(-bound, axis=1, kind="stable")[:, :first], True, axis=1)
                chosen = early & (bound >= minimum)
                if later:
                    chosen = ~early & (bound >= part["least"].to_numpy()[:, None])
                at, cell = np.nonzero(chosen)
                ids, vectors = part["id"].to_numpy(), part["v"].to_numpy()
                # A batch may visit every cell; its copies leave in pieces.
                for lo in range(0, len(at), block_rows):
                    some = slice(lo, lo + block_rows)
                    yield pd.DataFrame({"id": ids[at[some]], "v": vectors[at[some]], "cell": full[cell[some]]})

        return side.mapInPandas(choose, f"id {id_type}, v array<double>, cell int")

    sizes = F.create_map(*[F.lit(x) for c in known for x in (c, blocks[c])])

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "example_id": [], "similarity": []})
        # Columns in the order of ids, so that of equal similarities the first ones count.
        x = x.sort_values("id")
        a, b = (np.stack([np.asarray(v, dtype=float) for v in side["v"]]) for side in (q, x))
        a_length, b_length = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        query_ids, example_ids = q["id"].to_numpy(), x["id"].to_numpy()
        found = []
        for lo in range(0, len(a), 512):
            scores = (a[lo : lo + 512] @ b.T) / (np.outer(a_length[lo : lo + 512], b_length) + 1e-8)
            scores[~(scores >= minimum) | (query_ids[lo : lo + 512, None] == example_ids[None, :])] = -np.inf
            row, col = _best_columns(scores, k)
            found.append(pd.DataFrame({"query_id": query_ids[lo + row], "example_id": example_ids[col], "similarity": scores[row, col]}))
        return pd.concat(found)

    def compare(visiting: DataFrame) -> DataFrame:
        visiting = materialize(visiting)
        counts = {r["cell"]: r["count"] for r in visiting.groupBy("cell").count().collect()}
        if compared is not None:
            compared.append(sum(n * known[c][1] for c, n in counts.items()))
        if not counts:
            return examples.sparkSession.createDataFrame([], out)
        # Queries of a cell are dealt into blocks too, each of which meets every block of its examples.
        turns = F.create_map(*[F.lit(n) for c in counts for n in (c, -(-counts[c] // block_rows))])

        def dealt(blocks_of: Column) -> Column:
            return F.pmod(F.xxhash64("id"), blocks_of).cast("int")

        def each(blocks_of: Column) -> Column:
            return F.explode(F.sequence(F.lit(0), blocks_of - 1))

        left = visiting.withColumn("turn", dealt(turns[F.col("cell")])).withColumn("block", each(sizes[F.col("cell")]))
        right = held.where(F.col("cell").isin(list(map(int, counts)))).select("id", "v", "cell", dealt(sizes[F.col("cell")]).alias("block"))
        right = right.withColumn("turn", each(turns[F.col("cell")]))
        return left.groupBy("cell", "block", "turn").cogroup(right.groupBy("cell", "block", "turn")).applyInPandas(best, out)

    order = [F.desc("similarity"), F.col("example_id")]
    early = materialize(top_per_key(compare(visits(asked, False)), ["query_id"], order, k).drop("rank"))
    reached = early.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("similarity")).alias("least"))
    rest = asked.join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(float(minimum))))
    return top_per_key(early.unionByName(compare(visits(rest, True))), ["query_id"], order, k)


# --- close spellings ----------------------------------------------------------------------------
def allowed_edits(length: Column, threshold: int) -> Column:
    """Edits that still leave the similarity at the threshold, for the longer text's length."""
    return F.floor(length * (100 - threshold) / 100).cast("int")


def gram_class(length: Column, threshold: int) -> Column:
    """How texts with partners up to this length are compared: q of the q-grams and the edits that are allowed.

    Two texts within e edits keep ``length + 1 - q * (e + 1)`` common q-grams of the longer one, so q is taken as
    large as leaves at least one.
    """
    edits = allowed_edits(length, threshold)
    q = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(length / (edits + 1)))).cast("int")
    return F.struct(q.alias("q"), edits.alias("edits"))


def rare_grams(texts: DataFrame, threshold: int) -> DataFrame:
    """The inverted index of ``close_candidates``: texts ``s`` with ``class``, ``gram`` and its place ``at``.

    The q-grams of all texts are ordered by their frequency. e edits destroy at most q * e of them, so of a text's rarest
    q * e + 1 (and those as rare as the last) one must stand in any text within e edits. A text is indexed
    for every class of the longer partners it can have; frequent q-grams hardly ever enter the index.
    """
    size = F.length("s")
    partners = F.sequence(size, F.greatest(size, F.floor(size * 100 / threshold).cast("int")))
    held = texts.withColumn("classes", F.array_distinct(F.transform(partners, lambda n: gram_class(n, threshold))))
    grams = held.select("s", F.explode(F.array_distinct(F.transform("classes", lambda c: c["q"]))).alias("q")).where(F.length("s") >= F.col("q"))
    q = F.col("q")
    grams = grams.select("s", "q", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("s") - q + 1), lambda i: F.col("s").substr(i, q))).alias("at", "gram"))
    seen = grams.groupBy("q", "gram").agg(F.count("*").alias("seen"))
    ordered = grams.join(seen, ["q", "gram"]).groupBy("s", "q").agg(F.sort_array(F.collect_list(F.struct("seen", "gram", "at"))).alias("grams"))
    indexed = held.select("*", F.explode("classes").alias("class")).withColumn("q", F.col("class.q")).join(ordered, ["s", "q"])
    last = F.element_at("grams", F.least(F.size("grams"), F.col("class.q") * F.col("class.edits") + 1))
    prefix = F.filter("grams", lambda g: (g["seen"] < last["seen"]) | ((g["seen"] == last["seen"]) & (g["gram"] <= last["gram"])))
    return indexed.select("s", "class", F.explode(prefix).alias("g")).select("s", "class", F.col("g.gram").alias("gram"), F.col("g.at").alias("at"))


def close_candidates(texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs a, b of distinct texts ``s`` that may be alike: a rare q-gram in common at nearly the same place, lengths within reach."""
    index = rare_grams(texts, threshold)
    longer = index.where(F.col("class") == gram_class(F.length("s"), threshold))
    a, b = index.alias("a"), longer.alias("b")
    size_a, size_b, edits = F.length("a.s"), F.length("b.s"), F.col("b.class.edits")
    near = (F.abs(F.col("a.at") - F.col("b.at")) <= edits) & (size_b - size_a <= edits)
    ordered = (size_a < size_b) | ((size_a == size_b) & (F.col("a.s") < F.col("b.s")))
    met = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.gram") == F.col("b.gram")) & near & ordered)
    return met.select(F.col("a.s").alias("a"), F.col("b.s").alias("b")).distinct()


def close_pairs(values: DataFrame, value: str, n: str, threshold: int = 85) -> DataFrame:
    """All pairs of distinct values at least ``threshold`` alike (1 to 100) after token sorting.

    Candidates come from an inverted index of rare q-grams; the edit distance, bounded by what the threshold allows,
    is computed on them alone. Nothing is capped: every pair above the threshold is a candidate.
    """
    if not 1 <= threshold <= 100:
        raise ValueError("the threshold is between 1 and 100")
    texts = values.select(F.col(value).alias("v"), F.col(n).alias("n"), token_sorted(F.col(value)).alias("s")).where("s <> ''")
    # Spellings with the same tokens are one text here and are paired at the end.
    pairs = close_candidates(texts.select("s").distinct(), threshold)
    longest = F.greatest(F.length("a"), F.length("b"))
    distance = F.expr(f"levenshtein(a, b, CAST(floor(greatest(length(a), length(b)) * {100 - threshold} / 100) AS INT))")
    score = F.floor(100 * (longest - F.col("distance")) / longest).cast("int")
    alike = pairs.withColumn("distance", distance).where("distance >= 0").select("a", "b", score.alias("score"))
    same = texts.select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(100).alias("score")).distinct()
    left, right = (texts.select(F.col("v").alias(v), F.col("n").alias(f"n_{v}"), F.col("s").alias(s)) for v, s in (("left", "a"), ("right", "b")))
    found = alike.where(F.col("score") >= threshold).unionByName(same).join(left, "a").join(right, "b")
    once = (F.col("a") != F.col("b")) | (F.col("left") < F.col("right"))
    return found.where(once & (F.lower("left") != F.lower("right"))).select("left", "n_left", "right", "n_right", "score")


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of :func:`close_pairs` as canonical and variant: the more frequent, then the longer, then the first one leads."""
    left = (
        (F.col("n_left") > F.col("n_right"))
        | ((F.col("n_left") == F.col("n_right")) & (F.length("left") > F.length("right")))
        | ((F.col("n_left") == F.col("n_right")) & (F.length("left") == F.length("right")) & (F.col("left") < F.col("right")))
    )
    return pairs.select(
        F.when(left, F.col("left")).otherwise(F.col("right")).alias("canonical"), F.when(left, F.col("right")).otherwise(F.col("left")).alias("variant"),
        "score", F.when(left, F.col("n_left")).otherwise(F.col("n_right")).alias("n_canonical"), F.when(left, F.col("n_right")).otherwise(F.col("n_left")).alias("n_variant"),
    )


def close_variants(df: DataFrame, column: str, threshold: int = 85) -> DataFrame:
    """Close spellings of an entity column with the canonical one."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return canonical_pairs(close_pairs(values, "v", "n", threshold))
