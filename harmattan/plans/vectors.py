"""Queries over text tags, vectors, close spellings and outliers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmattan.operators import anomaly, textvec
from harmattan.plans.cleaning import DIRTY
from harmattan.plans.registry import Tables, query


def _words(table, default):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{n}'" for n, w in table) + f" ELSE '{default}' END"


@query(
    "text_message_tags",
    f"SELECT conv_id, turn, {_words(textvec.INTENTS, 'ASK_DATA')} AS intent, {_words(textvec.QUERY_TYPES, 'data_query')} AS query_type, {_words(textvec.DOMAINS, 'dashboard')} AS domain, regexp_matches(text, '[0-9]') AS has_number FROM conversations",
)
def text_message_tags(t: Tables):
    m = F.col("text")
    return t.conversations.select(
        "conv_id", "turn", textvec.intent(m).alias("intent"), textvec.query_type(m).alias("query_type"), textvec.domain(m).alias("domain"), textvec.has_number(m).alias("has_number")
    )


# Messages about orders, so that months, dimensions and small talk occur.
_TALK_SQL = """talk AS (SELECT o_orderkey AS id, concat(CASE o_orderkey % 7 WHEN 0 THEN 'Bonjour, ' WHEN 1 THEN 'Merci ! ' WHEN 2 THEN 'Qui es-tu ? ' WHEN 3 THEN 'Tu peux faire quoi pour ' WHEN 4 THEN 'Au revoir ' ELSE 'Compare ' END, 'les ventes par ',
 CASE o_orderkey % 4 WHEN 0 THEN 'region' WHEN 1 THEN 'produit' WHEN 2 THEN 'mois' ELSE 'magasin' END, ' de ', CASE o_orderkey % 3 WHEN 0 THEN 'mars et avril' WHEN 1 THEN 'JUIN' ELSE 'noel' END, ' ', o_orderstatus) AS text FROM orders)"""


def _talk(t: Tables):
    k = F.col("o_orderkey")
    opening = F.when(k % 7 == 0, "Bonjour, ").when(k % 7 == 1, "Merci ! ").when(k % 7 == 2, "Qui es-tu ? ").when(k % 7 == 3, "Tu peux faire quoi pour ").when(k % 7 == 4, "Au revoir ").otherwise("Compare ")
    dimension = F.when(k % 4 == 0, "region").when(k % 4 == 1, "produit").when(k % 4 == 2, "mois").otherwise("magasin")
    month = F.when(k % 3 == 0, "mars et avril").when(k % 3 == 1, "JUIN").otherwise("noel")
    return t.orders.select(k.alias("id"), F.concat(opening, F.lit("les ventes par "), dimension, F.lit(" de "), month, F.lit(" "), "o_orderstatus").alias("text"))


@query(
    "text_entities",
    f"""WITH {_TALK_SQL} SELECT id, array_to_string(regexp_extract_all(lower(text), '\\b(janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre)\\b', 1), ',') AS months,
 CASE WHEN contains(lower(text), 'region') THEN 'region' WHEN contains(lower(text), 'produit') THEN 'produit' WHEN contains(lower(text), 'mois') THEN 'mois' WHEN contains(lower(text), 'jour') THEN 'jour' END AS dimension FROM talk""",
)
def text_entities(t: Tables):
    m = F.col("text")
    return _talk(t).select("id", F.array_join(textvec.months(m), ",").alias("months"), textvec.requested_dimension(m).alias("dimension"))


@query(
    "text_small_talk",
    "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'greeting' WHEN 1 THEN 'thanks' WHEN 2 THEN 'identity' WHEN 3 THEN 'capabilities' WHEN 4 THEN 'farewell' END AS category FROM orders",
)
def text_small_talk(t: Tables):
    return _talk(t).select("id", textvec.small_talk(F.col("text")).alias("category"))


@query(
    "text_recent_context",
    """SELECT conv_id, string_agg(concat('[', CASE WHEN role = 'user' THEN 'Utilisateur' ELSE 'Assistant' END, '] ', left(text, 200)), chr(10) ORDER BY turn) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) x WHERE r <= 5 GROUP BY conv_id""",
)
def text_recent_context(t: Tables):
    return textvec.recent_context(t.conversations, "conv_id", "turn", "role", "text")


@query(
    "vector_hash_embedding",
    """WITH c AS (SELECT doc_id, CAST(i AS BIGINT) AS i, text[i + 1] AS ch FROM documents, unnest(range(length(text))) AS u(i)),
 s AS (SELECT doc_id, CAST(i % 384 AS INT) AS dim, SUM(CAST(CAST(concat('0x', left(md5(concat(ch, '_', i)), 8)) AS BIGINT) AS DOUBLE) / 4294967295) AS w FROM c GROUP BY 1, 2)
SELECT doc_id, dim, ROUND(w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id)), 8) AS weight FROM s""",
)
def vector_hash_embedding(t: Tables):
    return textvec.hash_embedding(t.documents, "doc_id", "text").withColumn("weight", F.round("weight", 8))


@query(
    "vector_nearest",
    """WITH q AS (SELECT vec_id, embedding FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, e.vec_id AS example_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) + 1e-8) AS sim
  FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT query_id, example_id, ROUND(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, example_id) AS INT) AS rank FROM s WHERE sim >= 0.3 QUALIFY rank <= 5""",
)
def vector_nearest(t: Tables):
    vectors = t.embeddings.select("vec_id", "embedding")
    return textvec.nearest(vectors, vectors, "embedding", "vec_id").withColumn("similarity", F.round("similarity", 6))


_SORTED = "array_to_string(list_sort(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ')"


@query(
    "text_close_variants",
    f"""{DIRTY}, v AS (SELECT client AS v, COUNT(*) AS n, {_SORTED.format(c='client')} AS s FROM dirty_orders WHERE client IS NOT NULL GROUP BY 1),
 p AS (SELECT a.v AS l, a.n AS nl, b.v AS r, b.n AS nr, CAST(floor(100 * (greatest(length(a.s), length(b.s)) - levenshtein(a.s, b.s)) / greatest(length(a.s), length(b.s))) AS INT) AS score
  FROM v a JOIN v b ON a.v < b.v AND lower(a.v) <> lower(b.v) AND abs(length(a.s) - length(b.s)) <= 5),
 o AS (SELECT *, nl > nr OR (nl = nr AND length(l) >= length(r)) AS f FROM p WHERE score >= 85)
SELECT CASE WHEN f THEN l ELSE r END AS canonical, CASE WHEN f THEN r ELSE l END AS variant, score, CASE WHEN f THEN nl ELSE nr END AS n_canonical, CASE WHEN f THEN nr ELSE nl END AS n_variant FROM o""",
)
def text_close_variants(t: Tables):
    return textvec.close_variants(t.dirty_orders, "client")


@query(
    "text_close_products",
    f"""WITH v AS (SELECT p_name AS v, COUNT(*) AS n, {_SORTED.format(c='p_name')} AS s FROM part GROUP BY 1),
 p AS (SELECT a.v AS l, a.n AS nl, b.v AS r, b.n AS nr, CAST(floor(100 * (greatest(length(a.s), length(b.s)) - levenshtein(a.s, b.s)) / greatest(length(a.s), length(b.s))) AS INT) AS score FROM v a JOIN v b ON a.v < b.v),
 o AS (SELECT *, nl > nr OR (nl = nr AND length(l) >= length(r)) AS f FROM p WHERE score >= 60)
SELECT CASE WHEN f THEN l ELSE r END AS canonical, CASE WHEN f THEN r ELSE l END AS variant, score, CASE WHEN f THEN nl ELSE nr END AS n_canonical, CASE WHEN f THEN nr ELSE nl END AS n_variant FROM o""",
)
def text_close_products(t: Tables):
    return textvec.close_variants(t.part, "p_name", 60)


# --- outliers ---------------------------------------------------------------------------------
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(t: Tables):
    return t.lineitem.withColumn("_row_number", F.xxhash64(*t.lineitem.columns))


@query(
    "outlier_feature_matrix",
    """WITH f AS (SELECT _row_number, TRY_CAST(CASE WHEN regexp_matches(quantite, '^-?[0-9]+$') THEN quantite END AS DOUBLE) AS q, TRY_CAST(CASE WHEN regexp_matches(prix, '^-?[0-9]+$') THEN prix END AS DOUBLE) AS p FROM dirty_orders),
 k AS (SELECT * FROM f WHERE q IS NOT NULL OR p IS NOT NULL)
SELECT _row_number, COALESCE(q, (SELECT MEDIAN(q) FROM k)) AS quantite, COALESCE(p, (SELECT MEDIAN(p) FROM k)) AS prix FROM k""".replace("WITH f", DIRTY + ", f"),
)
def outlier_feature_matrix(t: Tables):
    return anomaly.feature_matrix(t.dirty_orders, ["quantite", "prix"])


@query("outlier_forest")
def outlier_forest(t: Tables):
    scored = anomaly.isolation_forest(_lines(t), _FEATURES, 0.02)
    return scored.select("_row_number", F.round("score", 6).alias("score"), "is_outlier")


@query("outlier_explanations")
def outlier_explanations(t: Tables):
    return anomaly.explain(anomaly.isolation_forest(_lines(t), _FEATURES, 0.02), _FEATURES)


# A forest that SQL can state too: 20 complete trees of depth three, cuts and leaf sizes by rule.
_TREES, _SPAN = 20, (50.0, 100_000.0, 0.1)


def _cut(tree: int, node: int) -> float:
    return _SPAN[(tree + node) % 3] * ((tree * 7 + node * 5) % 20 + 0.5) / 20


def fixed_forest() -> pd.DataFrame:
    rows = []
    for tree in range(_TREES):
        for node in range(15):
            inner = node < 7
            rows.append((tree, node, (tree + node) % 3 if inner else -1, _cut(tree, node) if inner else 0.0, 2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1, 256 if not node else (tree * 3 + node) % 31 + 1, (node + 1).bit_length() - 1))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "right", "size", "depth"])


def _walk(at: str, tree: str) -> str:
    """The child of a node: on the right if the feature lies above the cut."""
    x = f"CASE ({tree} + {at}) % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice ELSE l_discount END"
    span = f"CASE ({tree} + {at}) % 3 WHEN 0 THEN {_SPAN[0]}::DOUBLE WHEN 1 THEN {_SPAN[1]}::DOUBLE ELSE {_SPAN[2]}::DOUBLE END"
    return f"2 * {at} + 1 + CAST(CAST({x} AS DOUBLE) > {span} * (({tree} * 7 + {at} * 5) % 20 + 0.5::DOUBLE) / 20 AS INT)"


_PATH = "CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1) / {n}::DOUBLE END"
_SCORED = f"""f AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, row_number() OVER () AS i FROM lineitem),
 a AS (SELECT *, {_walk('0', 't')} AS n1 FROM f, unnest(range({_TREES})) AS u(t)), b AS (SELECT *, {_walk('n1', 't')} AS n2 FROM a), c AS (SELECT *, {_walk('n2', 't')} AS leaf FROM b),
 d AS (SELECT *, (t * 3 + leaf) % 31 + 1 AS size FROM c), e AS (SELECT i, SUM(3 + {_PATH.format(n='size')}) AS total FROM d GROUP BY i),
 s AS (SELECT f.*, round(pow(2, -total / {_TREES} / (SELECT {_PATH.format(n='256')})), 9) AS score FROM f JOIN e USING (i)),
 scored AS (SELECT *, score > (SELECT quantile_cont(score, 0.98) FROM s) + 1e-9 AS is_outlier FROM s)"""


def _fixed(t: Tables, matrix: DataFrame | None = None):
    scores = anomaly.score_rows(matrix or anomaly.feature_matrix(_lines(t), _FEATURES), fixed_forest(), _FEATURES)
    # Paths are sums in another order than in SQL.
    return anomaly.flagged(scores.withColumn("score", F.round("score", 9)), 0.02)


@query("outlier_fixed_forest", f"WITH {_SCORED} SELECT CAST(round(score * 1000000) AS BIGINT) AS score, is_outlier, COUNT(*) AS n FROM scored GROUP BY 1, 2")
def outlier_fixed_forest(t: Tables):
    """Rows by score and flag; line items have no key, so they are counted."""
    return _fixed(t).groupBy(F.round(F.col("score") * 1_000_000).cast("bigint").alias("score"), "is_outlier").agg(F.count("*").alias("n"))


@query(
    "outlier_summary",
    f"""WITH {_SCORED}, z AS (SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (is_outlier) AS n_outliers, AVG(score - 0.5) FILTER (is_outlier) AS margin FROM scored)
SELECT n_rows, n_outliers, CASE WHEN n_outliers = 0 THEN 'low' WHEN n_outliers <= greatest(1, n_rows // 50) THEN 'medium' WHEN n_outliers <= greatest(2, n_rows // 20) THEN 'high' ELSE 'critical' END AS severity,
 round(least(99.99, greatest(0.0, 50 + coalesce(margin, 0) * 20)), 2) AS confidence, true AS flagged_is_top_share, true AS confidence_in_range FROM z""",
)
def outlier_summary(t: Tables):
    """The summary of the fixed forest, and what SQL can say of the forest fitted to the rows.

    The share of flagged rows follows from the exact quantile: never more than asked, and only ties make it less.
    """
    matrix = anomaly.feature_matrix(_lines(t), _FEATURES)
    fitted = anomaly.flagged(anomaly.forest_scores(matrix, _FEATURES), 0.02)
    edge = fitted.agg(F.max(F.when(~F.col("is_outlier"), F.col("score")))).scalar()
    ties = fitted.agg(F.count_if(F.col("score") == edge)).scalar()
    share, n = F.col("n_outliers"), F.col("n_rows")
    exact = (share <= F.ceil(n * 0.02)) & (share + ties >= F.floor(n * 0.02))
    checked = anomaly.run_summary(fitted).select(exact.alias("flagged_is_top_share"), F.col("confidence").between(50, 99.99).alias("confidence_in_range"))
    return anomaly.run_summary(_fixed(t, matrix)).join(checked, how="cross")


@query(
    "outlier_fixed_explanations",
    f"""WITH {_SCORED}, m AS (SELECT MEDIAN(l_quantity) AS q, MEDIAN(l_extendedprice) AS p, MEDIAN(l_discount) AS d FROM lineitem),
 r AS (SELECT i, unnest([{{'c': 'l_quantity', 'r': l_quantity / q}}, {{'c': 'l_extendedprice', 'r': l_extendedprice / p}}, {{'c': 'l_discount', 'r': l_discount / d}}]) AS x FROM scored, m WHERE is_outlier)
SELECT x.c AS "column", CASE WHEN x.r > 2.5 THEN 'above' ELSE 'below' END AS direction, CAST(round(x.r * 10) AS BIGINT) AS ratio, COUNT(*) AS n FROM r WHERE x.r > 2.5 OR x.r < 0.4 GROUP BY 1, 2, 3""",
)
def outlier_fixed_explanations(t: Tables):
    told = anomaly.explain(_fixed(t), _FEATURES)
    return told.groupBy("column", "direction", F.round(F.col("ratio") * 10).cast("bigint").alias("ratio")).agg(F.count("*").alias("n"))


@query(
    "outlier_deviations",
    """WITH m AS (SELECT MEDIAN(l_extendedprice) AS p, MEDIAN(l_quantity) AS q FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / p AS rp, l_quantity / q AS rq, l_extendedprice, l_quantity, p, q FROM lineitem, m WHERE l_discount >= 0.1)
SELECT 'l_extendedprice' AS "column", CASE WHEN rp > 2.5 THEN 'above' ELSE 'below' END AS direction, COUNT(*) AS n FROM r WHERE rp > 2.5 OR rp < 0.4 GROUP BY 2
UNION ALL SELECT 'l_quantity', CASE WHEN rq > 2.5 THEN 'above' ELSE 'below' END, COUNT(*) FROM r WHERE rq > 2.5 OR rq < 0.4 GROUP BY 2""",
)
def outlier_deviations(t: Tables):
    flagged = _lines(t).withColumn("is_outlier", F.col("l_discount") >= 0.1)
    return anomaly.explain(flagged, ["l_extendedprice", "l_quantity"]).groupBy("column", "direction").agg(F.count("*").alias("n"))
