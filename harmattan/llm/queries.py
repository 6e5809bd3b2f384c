"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmattan.llm import op1_surrogates, op2_langid, op3_forest, op4_quality, op5_packing, op6_columns, op7_bpe_reuse, op8_toxicity, op9_substrings, op10_jaccard, op11_filter_audit, op12_chat_windows, op13_phrases
from harmattan.llm.common import fold, table

#: Key of the surrogates of the registered queries; a production run brings its own secret.
SURROGATE_KEY = "surrogates of the registered queries"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op2_language_ppm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, by statistics of the documents of the folds 0, 1 and 3 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = op2_langid.train(docs.filter(~held_out))
    return op2_langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op4_quality.train(docs, table(spark, sf_dir, "labels"))
    return op4_quality.score(docs, model)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_bpe_chunk_reuse")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_bpe_reuse.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_toxicity_deobfuscated")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text; labels are learnt from the folds 1 to 4 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = op8_toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return op8_toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data and secrets in its text."""
    return op1_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key=SURROGATE_KEY)


@query("op3_ann_projection_forest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose id is divisible by 20, among all other rows."""
    return op3_forest.search(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


@query(
    "op9_substring_dedup",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d) x),
 f AS (SELECT k, MIN(doc_id) AS m FROM g GROUP BY k),
 r AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE m < g.doc_id) x),
 w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
 s AS (SELECT w.doc_id, COUNT(r.p) AS gone, string_agg(CASE WHEN r.p IS NULL THEN word END, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.p = r.p GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_substrings.report(table(spark, sf_dir, "documents"))


@query(
    "op10_ngram_jaccard",
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 t AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws) + 1, 2)))) AS i FROM d) x),
 n AS (SELECT doc_id, COUNT(*) AS n FROM t GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(ANY_VALUE(n), 0) AS n_shingles, MIN(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON d.doc_id = r.a GROUP BY 1""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard.join(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query(
    "op6_suffix_columns_dedup",
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
 g AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM b) x),
 f AS (SELECT k FROM g GROUP BY k HAVING COUNT(*) > 1),
 o AS (SELECT doc_id, i, i > 199 + coalesce(LAG(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 1 AS far FROM g SEMI JOIN f USING (k)),
 q AS (SELECT doc_id, i, SUM(CAST(far AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
 r AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 200 AS z FROM q GROUP BY doc_id, run),
 e AS (SELECT *, coalesce(LAG(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past, LEAD(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM r),
 k AS (SELECT doc_id, SUM(z - a) AS gone, COUNT(*) AS spans, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) || substr(ANY_VALUE(h), 2 * MAX(z) + 1) AS kept FROM e JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_columns.report(table(spark, sf_dir, "documents"))


@query(
    "op11_filter_interaction_audit",
    r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, MIN(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
 l AS (SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS good, MAX(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, fails, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM f GROUP BY 1, 2),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS y),
 o AS (SELECT a.y || b.y || c.y || d.y || e.y AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.y, b.y, c.y, d.y, e.y])) = 5),
 s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS y, [strpos('ABCDE', q) FOR q IN string_split(filter_order[:step - 1], '') IF q <> ''] AS earlier FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o) z),
 h AS (SELECT part, filter_order, step, y, n, good, toxic, fails[strpos('ABCDE', y)] AS here, len([1 FOR i IN earlier IF fails[i]]) > 0 AS gone, len([1 FOR w IN fails IF w]) = 1 AS alone FROM c, s),
 g AS (SELECT part, filter_order, step, y, SUM(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, SUM(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, SUM(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, SUM(CASE WHEN here AND alone THEN n ELSE 0 END) AS unique_fails, SUM(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, SUM(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM h GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, y) AS BIGINT) AS shapley FROM g""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents, by source, in all 120 orders."""
    return op11_filter_audit.audit(op11_filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: A planted conversation whose texts hold what common templates use as marks.
PLANTED = (-7, "\\### Assistant: </turn> ok")


@query(
    "op12_chat_windows",
    r"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 f AS (SELECT *, '<|turn|>' || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || '<|text|>' || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM c),
 t AS (SELECT *, len(regexp_extract_all(piece, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) AS n, i = 1 AND role = 'system' AS opens FROM f),
 q AS (SELECT *, SUM(n) OVER (PARTITION BY conv_id ORDER BY i) AS z, z - n AS a, MAX(CASE WHEN opens THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS reserve, (z - n) // 16384 AS seg FROM t),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS j FROM q WHERE NOT opens),
 r AS (SELECT conv_id, j, seg, a AS start, piece FROM o WHERE j = 1
  UNION ALL SELECT o.conv_id, o.j, o.seg, CASE WHEN o.seg <> r.seg OR o.z - r.start > greatest(768 - o.reserve, 1) THEN o.a ELSE r.start END, o.piece FROM r JOIN o ON o.conv_id = r.conv_id AND o.j = r.j + 1),
 w AS (SELECT DISTINCT conv_id, start FROM r),
 s AS (SELECT conv_id, length(piece) AS chars FROM r
  UNION ALL SELECT conv_id, length(piece) FROM w JOIN o USING (conv_id) WHERE a >= start - 256 AND z <= start
  UNION ALL SELECT q.conv_id, length(piece) FROM q LEFT JOIN w USING (conv_id) WHERE opens),
 k AS (SELECT conv_id, SUM(chars) AS formatted_chars FROM s GROUP BY 1)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256, CAST(ANY_VALUE(formatted_chars) AS BIGINT) AS formatted_chars
FROM t JOIN k USING (conv_id) GROUP BY conv_id""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one in windows of 1024 tokens, read back and digested."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = PLANTED
    planted = spark.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return op12_chat_windows.digests(op12_chat_windows.windows(given.unionByName(planted)))


@query(
    "op13_phrase_collocations",
    r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
 g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) z) x),
 f AS (SELECT lang, k, phrase, COUNT(*) AS a FROM g GROUP BY 1, 2, 3),
 n AS (SELECT lang, SUM(a) AS n FROM f WHERE k = 1 GROUP BY 1),
 c AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
 s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
 b AS (SELECT lang, phrase, k, a, MIN({'score': score, 'cut': cut, 'l': l, 'r': r}) AS best FROM s GROUP BY 1, 2, 3, 4),
 t AS (SELECT lang, phrase, MAX(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) AS phrase FROM c WHERE k = 3) y GROUP BY 1, 2),
 k AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN t USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(best.l AS BIGINT) AS l, CAST(best.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(best.score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return op13_phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
