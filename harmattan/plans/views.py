"""Inputs derived from the given tables.

``sales`` is a star join that reads only the dimensions its columns need. The dirty inputs
are written once as SQL that both Spark and the checking engine understand; only a few
date functions differ and are filled in per dialect.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from harmattan.plans.registry import Tables

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Output column of the sales view -> (dimension that carries it, expression).
SALES_COLUMNS = {
    "id_commande": ("lineitem", "l_orderkey"),
    "ligne": ("lineitem", "l_linenumber"),
    "l_partkey": ("lineitem", "l_partkey"),
    "l_suppkey": ("lineitem", "l_suppkey"),
    "quantite": ("lineitem", "CAST(l_quantity AS DECIMAL(12,2))"),
    "prix_unitaire": ("lineitem", "l_extendedprice / l_quantity"),
    "montant_brut": ("lineitem", "CAST(l_extendedprice AS DECIMAL(12,2))"),
    "montant_total": ("lineitem", "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(20,4))"),
    "remise": ("lineitem", "l_discount"),
    "date_livraison": ("lineitem", "CAST(l_shipdate AS DATE)"),
    "statut_ligne": ("lineitem", "l_linestatus"),
    "retour": ("lineitem", "l_returnflag"),
    "date": ("orders", "CAST(o_orderdate AS DATE)"),
    "priorite": ("orders", "o_orderpriority"),
    "client": ("customer", "c_name"),
    "segment": ("customer", "c_mktsegment"),
    "pays": ("nation", "n_name"),
    "region": ("region", "r_name"),
    "produit": ("part", "p_name"),
    "marque": ("part", "p_brand"),
    "categorie": ("part", "p_type"),
    "vendeur": ("supplier", "s_name"),
}
# Dimension -> (dimension it hangs on, fact-side key, own key).
SALES_EDGES = {
    "orders": ("lineitem", "l_orderkey", "o_orderkey"),
    "customer": ("orders", "o_custkey", "c_custkey"),
    "nation": ("customer", "c_nationkey", "n_nationkey"),
    "region": ("nation", "n_regionkey", "r_regionkey"),
    "part": ("lineitem", "l_partkey", "p_partkey"),
    "supplier": ("lineitem", "l_suppkey", "s_suppkey"),
}
# Full order of sales lines, for first/last.
SALES_ORDER = ["id_commande", "ligne", "l_partkey", "l_suppkey", "montant_brut", "date_livraison"]

_FROM = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""
SALES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, (_, e) in SALES_COLUMNS.items()) + " FROM " + _FROM


def sales(t: "Tables", columns: Sequence[str] = ()) -> DataFrame:
    """Sales lines with the requested columns; unused dimensions are never read."""
    columns = list(columns) or list(SALES_COLUMNS)
    needed: list[str] = []
    for c in columns:
        dimension, chain = SALES_COLUMNS[c][0], []
        while dimension != "lineitem":
            chain.append(dimension)
            dimension = SALES_EDGES[dimension][0]
        needed += [d for d in reversed(chain) if d not in needed]
    df = t.lineitem
    for dimension in needed:
        _, fact_key, own_key = SALES_EDGES[dimension]
        df = df.join(t.read(dimension), F.col(fact_key) == F.col(own_key))
    return df.selectExpr(*[f"{SALES_COLUMNS[c][1]} AS {c}" for c in columns])


# --- dirty orders -------------------------------------------------------------------
_SPARK = {
    "day_serial": "datediff(d, DATE'1899-12-30')",
    "copied_orders": "{orders} LATERAL VIEW explode(array(0, 1, 2, 3)) copies AS copy",
    "cell_orders": "{orders} LATERAL VIEW explode(sequence(0, 6)) copies AS copy",
}
_CHECK = {
    "day_serial": "date_diff('day', DATE '1899-12-30', d)",
    "copied_orders": "orders, unnest([0, 1, 2, 3]) AS copies(copy)",
    "cell_orders": "orders, unnest([0, 1, 2, 3, 4, 5, 6]) AS copies(copy)",
}

_MONTH_NAMES = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"]
_MONTH_CASE = "CASE m " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_MONTH_NAMES, 1)) + " END"

DIRTY_ORDERS = f"""
SELECT _row_number, id_commande, client, date_commande, montant, quantite, prix, statut, categorie, email, notes FROM (
 SELECT k * 10 + copy AS _row_number,
  CASE WHEN copy = 3 THEN '' WHEN k % 89 = 0 THEN '' ELSE concat('CMD-', CAST(k AS STRING)) END AS id_commande,
  CASE WHEN copy = 3 THEN NULL WHEN k % 29 = 0 THEN 'N/A' WHEN k % 7 = 0 THEN concat('  DIST. OUAGA ', c, ' ')
       WHEN k % 7 = 1 THEN concat('dist. ouaga ', c) WHEN k % 7 = 2 THEN concat('Dist.  Ouaga ', c, '.') ELSE concat('Dist. Ouaga ', c) END AS client,
  CASE WHEN copy = 3 THEN NULL WHEN k % 53 = 0 THEN '31/02/1999' WHEN k % 59 = 0 THEN 'bientot' WHEN k % 4 = 0 THEN CAST(d AS STRING)
       WHEN k % 4 = 1 THEN concat(lpad(CAST(day_n AS STRING), 2, '0'), '/', lpad(CAST(m AS STRING), 2, '0'), '/', CAST(y AS STRING))
       WHEN k % 4 = 2 THEN concat(CAST(day_n AS STRING), ' ', {_MONTH_CASE}, ' ', CAST(y AS STRING))
       ELSE CAST({{day_serial}} AS STRING) END AS date_commande,
  CASE WHEN copy = 3 THEN ' ' WHEN k % 17 = 0 THEN '' WHEN k % 31 = 0 THEN concat('(', CAST(units AS STRING), '.', cc, ')')
       WHEN k % 61 = 0 THEN 'a voir' WHEN k % 67 = 0 THEN '0'
       WHEN k % 5 = 0 THEN concat(CAST(CAST(floor(units / 1000) AS BIGINT) AS STRING), ' ', lpad(CAST(units % 1000 AS STRING), 3, '0'), ',', cc, ' FCFA')
       WHEN k % 5 = 1 THEN concat(CAST(CAST(floor(units / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(units % 1000 AS STRING), 3, '0'), '.', cc, ' EUR')
       WHEN k % 5 = 2 THEN concat('0,', lpad(CAST(CAST(floor(units / 10000) AS BIGINT) AS STRING), 2, '0'), 'M')
       ELSE concat(CAST(units AS STRING), '.', cc) END AS montant,
  CASE WHEN copy = 3 THEN NULL WHEN k % 41 = 0 THEN '-3' WHEN k % 37 = 0 THEN NULL ELSE CAST(k % 20 AS STRING) END AS quantite,
  CASE WHEN copy = 3 THEN NULL WHEN k % 23 = 0 THEN NULL WHEN k % 20 = 0 THEN '30' ELSE CAST(CAST(floor(units / (k % 20)) AS BIGINT) AS STRING) END AS prix,
  CASE WHEN copy = 3 THEN NULL WHEN copy = 2 THEN 'X' WHEN k % 3 = 0 THEN lower(s) ELSE s END AS statut,
  CASE WHEN copy = 3 OR k % 4 = 0 THEN NULL ELSE p END AS categorie,
  CASE WHEN copy = 3 THEN NULL WHEN k % 19 = 0 THEN concat('user', CAST(cust AS STRING), ' at example') ELSE concat('user', CAST(cust AS STRING), '@example.com') END AS email,
  CASE WHEN copy <> 3 AND k % 50 = 0 THEN 'ok' ELSE NULL END AS notes
 FROM (
  SELECT o_orderkey AS k, copies.copy AS copy, CAST(o_custkey % 100 AS STRING) AS c, o_custkey AS cust, o_orderstatus AS s, o_orderpriority AS p,
   CAST(o_orderdate AS DATE) AS d, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS day_n,
   CAST(floor(o_totalprice) AS BIGINT) AS units, lpad(CAST(CAST(floor(o_totalprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') AS cc
  FROM {{copied_orders}}
  WHERE copies.copy = 0 OR (copies.copy = 1 AND o_orderkey % 11 = 0) OR (copies.copy = 2 AND o_orderkey % 13 = 0) OR (copies.copy = 3 AND o_orderkey % 97 = 0)
 ) base) filled
"""

# Sheets of forty rows and seven columns: data tables with blank separators, sparse pivots, crosstabs.
CELLS = """
SELECT sheet_id, row_idx, col_idx, CASE
  WHEN kind = 0 AND row_idx = 0 THEN CASE copy WHEN 0 THEN 'id' WHEN 1 THEN 'client' WHEN 2 THEN 'date' WHEN 3 THEN 'montant' WHEN 4 THEN 'quantite' WHEN 5 THEN 'vide' ELSE 'statut' END
  WHEN kind = 0 AND row_idx % 13 = 12 THEN NULL
  WHEN kind = 0 THEN CASE copy WHEN 0 THEN concat('CMD-', CAST(k AS STRING)) WHEN 1 THEN concat('client ', CAST(cust % 100 AS STRING)) WHEN 2 THEN day WHEN 3 THEN CASE WHEN k % 9 <> 0 THEN CAST(units AS STRING) END WHEN 4 THEN CAST(k % 20 AS STRING) WHEN 6 THEN s END
  WHEN kind = 1 AND row_idx = 0 THEN CASE copy WHEN 0 THEN 'Produit' WHEN 1 THEN 'Janvier' WHEN 2 THEN 'Fevrier' WHEN 3 THEN 'Mars' WHEN 4 THEN 'Avril' WHEN 5 THEN 'Mai' ELSE 'Juin' END
  WHEN kind = 2 AND row_idx = 0 THEN CASE copy WHEN 0 THEN 'Segment >>' WHEN 1 THEN 'Grand' WHEN 4 THEN 'Petit' WHEN 6 THEN 'Total' END
  WHEN kind = 2 AND row_idx = 1 THEN CASE copy WHEN 0 THEN 'Region' WHEN 1 THEN 'Nord' WHEN 2 THEN 'Sud' WHEN 3 THEN 'Est' WHEN 4 THEN 'Nord' WHEN 5 THEN 'Sud' ELSE 'Ensemble' END
  WHEN kind = 2 AND row_idx = 2 THEN CASE WHEN copy = 0 THEN 'Produit' END
  WHEN copy = 0 THEN concat('Produit ', CAST(k % 50 AS STRING)) WHEN copy = k % 6 + 1 THEN CAST(units AS STRING) END AS value
FROM (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS sheet_id, CAST(floor(o_orderkey / 40) AS BIGINT) % 3 AS kind, o_orderkey % 40 AS row_idx, CAST(copies.copy AS BIGINT) AS col_idx, copies.copy AS copy, o_orderkey AS k, o_custkey AS cust,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(floor(o_totalprice) AS BIGINT) AS units, o_orderstatus AS s FROM {cell_orders}) g
"""

KPI_CALCULATIONS = """
SELECT kpi, period_start, period_end, calculated_value FROM (
 SELECT region AS kpi, CAST(concat(mois, '-01') AS DATE) AS period_start, MAX(jour) AS period_end,
  CAST(SUM(montant_total) AS DECIMAL(20,4)) AS calculated_value
 FROM (SELECT region, concat(CAST(extract(year FROM date) AS STRING), '-', lpad(CAST(extract(month FROM date) AS STRING), 2, '0')) AS mois,
        last_day(date) AS jour, montant_total FROM {sales}) s
 GROUP BY region, mois) k
"""

SNAPSHOT_A = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 10 <> 3"
SNAPSHOT_B = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 14 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
 FROM {orders} WHERE o_orderkey % 10 <> 7"""

DERIVED = {
    "dirty_orders": (DIRTY_ORDERS, ("orders",)),
    "cells": (CELLS, ("orders",)),
    "kpi_calculations": (KPI_CALCULATIONS, ("sales",)),
    "snapshot_a": (SNAPSHOT_A, ("orders",)),
    "snapshot_b": (SNAPSHOT_B, ("orders",)),
}


# Derived inputs whose cells are long expressions are written once per application and scale
# folder, as landing a source would; queries then scan files with pruned columns.
STAGED = ("dirty_orders", "cells")
_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def derived(t: "Tables", name: str) -> DataFrame:
    if name not in STAGED:
        return _derived(t, name)
    from harmattan.session import materialize

    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(_derived(t, name))
    return _STAGES[key]


def _derived(t: "Tables", name: str) -> DataFrame:
    text, inputs = DERIVED[name]
    frames = {i: t.sales("region", "date", "montant_total") if i == "sales" else t.read(i) for i in inputs}
    named = {i: "{" + i + "}" for i in inputs}
    return t.sql(text.format(**named, **_SPARK), **frames)


def ctes(*names: str) -> str:
    """WITH clause for the checking SQL, with inputs in dependency order."""
    parts: list[str] = []

    def add(name: str) -> None:
        if any(p.startswith(f"{name} AS ") for p in parts):
            return
        if name == "sales":
            parts.append(f"sales AS ({SALES_SQL})")
            return
        text, inputs = DERIVED[name]
        for i in inputs:
            if i == "sales":
                add(i)
        parts.append(f"{name} AS ({text.format(**{i: i for i in inputs}, **_CHECK)})")

    for name in names:
        add(name)
    return "WITH " + ",\n".join(parts) + "\n"
