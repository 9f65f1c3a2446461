"""Key maintenance and change application (W2, J4, A4, S7, D2, D3, D5, J2,
J3, F4, D4, F3, J1) on orders / customer / lineitem.

Mapping: orders play stays and tasks, customer plays a patched table and
the survey table, lineitem provides the (naturally duplicated) batch key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import keyed as K
from ..operators.joins import left_join_suffixed
from ..session import read_table

ROUND = 6
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]


def _round(df, cols):
    return df.select(*[F.round(c, ROUND).alias(c) if c in cols else F.col(c) for c in df.columns])


def dedupe_first_wins(spark, sf):
    li = read_table(spark, sf, "lineitem")
    out = K.first_per_key(li, LINE_KEYS, LINE_REST, LINE_REST)
    return _round(out, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _order_batch(spark, sf):
    """A batch that carries every order twice; the second copy arrives later
    (``_seq`` 1) with a different priority, so first-wins is observable."""
    o = read_table(spark, sf, "orders").select(*ORDER_COLS)
    first = o.withColumn("_seq", F.lit(0))
    second = o.withColumn("o_orderpriority", F.lit("9-RESENT")).withColumn("_seq", F.lit(1))
    return first.unionByName(second)


def _stored_orders(spark, sf):
    return read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")


def insert_if_absent(spark, sf):
    batch = _order_batch(spark, sf)
    new = K.insert_if_absent(batch, _stored_orders(spark, sf), ["o_orderkey"], ["_seq"])
    return _round(new.drop("_seq"), ["o_totalprice"])


def ingest_counts(spark, sf):
    batch = _order_batch(spark, sf)
    new = K.insert_if_absent(batch, _stored_orders(spark, sf), ["o_orderkey"], ["_seq"])
    return K.ingest_counts(batch, new)


def _customer(spark, sf):
    return read_table(spark, sf, "customer")


def _patch_map(spark, sf):
    c = _customer(spark, sf)
    fields = F.create_map(F.lit("c_acctbal"), F.lit(None).cast("string"),
                          F.lit("c_mktsegment"), F.lit("AUTO"),
                          F.lit("c_custkey"), F.lit("-1"))       # protected: ignored
    hits = c.where(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey", fields.alias("fields"))
    # patches addressed to keys that do not exist are rejected, not applied
    misses = c.where(F.col("c_mktsegment") == "BUILDING").select(
        (F.col("c_custkey") + F.lit(10 ** 12)).alias("c_custkey"), fields.alias("fields"))
    return hits.unionByName(misses)


def patch_set_nulls(spark, sf):
    patched, _ = C.apply_patch_map(_customer(spark, sf), _patch_map(spark, sf), ["c_custkey"])
    return _round(patched, ["c_acctbal"])


def patch_merge_rejects(spark, sf):
    """Two patches per key merged in their order; empty, unreadable and unknown ones come back."""
    c = _customer(spark, sf)
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    first = F.when(seg == "AUTOMOBILE", F.create_map(F.lit("c_acctbal"), F.lit("1.5"), F.lit("c_name"), F.lit("uno"))) \
             .when(seg == "BUILDING", F.create_map(F.lit("c_acctbal"), F.lit("12,5"))) \
             .when(seg == "MACHINERY", F.create_map(F.lit("c_custkey"), F.lit("7"))) \
             .otherwise(F.create_map(F.lit("c_name"), F.lit("nadie")))
    known = F.when(seg == "HOUSEHOLD", k + F.lit(10 ** 12)).otherwise(k)
    one = c.select(known.alias("c_custkey"), first.alias("fields"), F.lit(1).alias("orden"))
    two = c.where(seg == "AUTOMOBILE").select("c_custkey", F.create_map(F.lit("c_acctbal"), F.lit("2.5")).alias("fields"), F.lit(2).alias("orden"))
    patched, rejected = C.apply_patch_map(c, one.unionByName(two), ["c_custkey"], order_cols=["orden"])
    return (_round(patched, ["c_acctbal"]).select("c_custkey", "c_name", "c_acctbal", F.lit("tabla").alias("motivo"))
            .unionByName(rejected.select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"), "motivo")))


def patch_nonnull(spark, sf):
    c = _customer(spark, sf)
    patch = c.where(F.col("c_mktsegment") == "AUTOMOBILE").select(
        "c_custkey", F.lit(None).cast("double").alias("c_acctbal"),
        F.lit("AUTO").alias("c_mktsegment"), F.lit(None).cast("string").alias("c_name"))
    patched, _ = C.apply_patch_nonnull(c, patch, ["c_custkey"])
    return _round(patched, ["c_acctbal"])


def delete_keys(spark, sf):
    c = _customer(spark, sf)
    deletes = c.where(F.col("c_nationkey") == 0).select("c_custkey")
    kept, _ = C.delete_keys(c, deletes, ["c_custkey"])
    return _round(kept, ["c_acctbal"])


ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
ORDER_STATUSES = ["O", "F"]


def validate_fk(spark, sf):
    o = read_table(spark, sf, "orders")
    managers = _customer(spark, sf).where(F.col("c_mktsegment") != "HOUSEHOLD").select(
        F.col("c_custkey").alias("name"))
    episodes = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episodio"))
    checked = C.validate_tasks(
        o, managers, episodes, manager_col="o_custkey", episode_col="o_orderkey",
        enum_checks=[("o_orderpriority", ORDER_PRIORITIES, "prioridad_invalida"),
                     ("o_orderstatus", ORDER_STATUSES, "status_invalido")])
    return checked.select("o_orderkey", F.coalesce("motivo", F.lit("ok")).alias("motivo"))


def filter_optional(spark, sf):
    o = read_table(spark, sf, "orders").select(*ORDER_COLS)
    f = C.optional_filter(o, {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None},
                          extra=F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return _round(f.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50), ["o_totalprice"])


def left_join_suffix(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("fecha"))
    c = _customer(spark, sf).select("c_custkey", F.col("c_acctbal").alias("total"),
                                    F.col("c_mktsegment").alias("segmento"))
    survey = c.unionByName(c.where(F.col("segmento") == "BUILDING"))   # duplicated answers
    out = left_join_suffixed(o, survey, "o_custkey", "c_custkey", suffix="_score")
    return _round(out, ["total", "total_score"])


def _stay_batch(spark, sf, stored=False):
    o = read_table(spark, sf, "orders")
    if stored:
        o = o.where(F.col("o_orderstatus") == "F")
    ep = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.col("o_custkey").cast("string"))
    return o.select(ep.alias("episodio"), F.col("o_orderdate").alias("marca_temporal"),
                    F.col("o_orderkey"), F.col("o_totalprice").cast("string").alias("probabilidad_sobre_estadia"))


def insert_stays(spark, sf):
    """D1 on orders-as-stays: (customer, order date) is the key; orders with an
    unspecified priority arrive without episode; status F rows are stored."""
    accepted, rejected = C.insert_stays(_stay_batch(spark, sf), _stay_batch(spark, sf, stored=True),
                                        order_cols=["o_orderkey"], stamp=False)
    cols = ["episodio", "marca_temporal", "o_orderkey", "prob_sobre_estadia", "motivo"]
    return accepted.withColumn("motivo", F.lit("aceptado")).select(*cols).unionByName(rejected.select(*cols))


QUERIES = {
    "insert_stays": insert_stays,
    "dedupe_first_wins": dedupe_first_wins,
    "insert_if_absent": insert_if_absent,
    "ingest_counts": ingest_counts,
    "patch_set_nulls": patch_set_nulls,
    "patch_merge_rejects": patch_merge_rejects,
    "patch_nonnull": patch_nonnull,
    "delete_keys": delete_keys,
    "validate_fk": validate_fk,
    "filter_optional": filter_optional,
    "left_join_suffix": left_join_suffix,
}

_BATCH = """
WITH batch AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 0 AS seq
  FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, '9-RESENT', 1 FROM orders),
d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq) AS rn FROM batch) t
  WHERE rn = 1),
ins AS (
  SELECT * FROM d WHERE NOT EXISTS (
    SELECT 1 FROM orders s WHERE s.o_orderstatus = 'F' AND s.o_orderkey IS NOT DISTINCT FROM d.o_orderkey))
"""

ORACLE = {
    "insert_stays": """
WITH b AS (
  SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS episodio,
         o_orderdate AS marca_temporal, o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS prob_sobre_estadia FROM orders),
s AS (SELECT * FROM b WHERE o_orderstatus = 'F' AND episodio IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY episodio, marca_temporal ORDER BY o_orderkey) AS rn
      FROM b WHERE episodio IS NOT NULL AND episodio <> '' AND marca_temporal IS NOT NULL),
t AS (
  SELECT episodio, marca_temporal, o_orderkey, prob_sobre_estadia, CASE WHEN rn = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.episodio = v.episodio
                                           AND s.marca_temporal = v.marca_temporal)
              THEN 'aceptado' ELSE 'duplicado' END AS motivo FROM v
  UNION ALL
  SELECT episodio, marca_temporal, o_orderkey, prob_sobre_estadia, 'falta_clave' FROM b
  WHERE episodio IS NULL OR episodio = '' OR marca_temporal IS NULL)
SELECT * FROM t""",
    "dedupe_first_wins": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity,
       round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount,
       round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
                 l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
                 l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS rn
      FROM lineitem) t
WHERE rn = 1""",
    "insert_if_absent": _BATCH + """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate,
       o_orderpriority FROM ins""",
    "ingest_counts": _BATCH + """
SELECT (SELECT count(*) FROM ins) AS inserted,
       (SELECT count(*) FROM batch) - (SELECT count(*) FROM ins) AS duplicates,
       (SELECT count(*) FROM batch) AS total""",
    "patch_set_nulls": """
WITH p AS (SELECT c_custkey AS k, CAST(NULL AS DOUBLE) AS acctbal, 'AUTO' AS seg
           FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
SELECT c.c_custkey, c.c_name, c.c_nationkey,
       CASE WHEN p.k IS NOT NULL THEN p.acctbal ELSE round(c.c_acctbal, 6) END AS c_acctbal,
       CASE WHEN p.k IS NOT NULL THEN p.seg ELSE c.c_mktsegment END AS c_mktsegment
FROM customer c LEFT JOIN p ON c.c_custkey = p.k""",
    "patch_merge_rejects": """
SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'uno' WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN c_name ELSE 'nadie' END AS c_name,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 2.5 ELSE round(c_acctbal, 6) END AS c_acctbal, 'tabla' AS motivo
FROM customer
UNION ALL
SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_custkey + 1000000000000 ELSE c_custkey END, NULL, NULL,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'valor_invalido' WHEN 'MACHINERY' THEN 'patch_vacio' ELSE 'no_encontrado' END
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""",
    "patch_nonnull": """
WITH p AS (SELECT c_custkey AS k, CAST(NULL AS DOUBLE) AS acctbal, 'AUTO' AS seg,
                  CAST(NULL AS VARCHAR) AS name
           FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
SELECT c.c_custkey, coalesce(p.name, c.c_name) AS c_name, c.c_nationkey,
       round(coalesce(p.acctbal, c.c_acctbal), 6) AS c_acctbal,
       coalesce(p.seg, c.c_mktsegment) AS c_mktsegment
FROM customer c LEFT JOIN p ON c.c_custkey = p.k""",
    "delete_keys": """
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment
FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = 0 AND d.c_custkey = c.c_custkey)""",
    "validate_fk": """
WITH m AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
f AS (SELECT o.*, m.k IS NOT NULL AS has_m, e.k IS NOT NULL AS has_e
      FROM orders o LEFT JOIN m ON o.o_custkey = m.k LEFT JOIN e ON o.o_orderkey = e.k)
SELECT o_orderkey, CASE WHEN NOT has_m THEN 'gestora_inexistente'
            WHEN NOT has_e THEN 'paciente_inexistente'
            WHEN o_orderpriority IS NULL
                 OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
                 THEN 'prioridad_invalida'
            WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F') THEN 'status_invalido'
            ELSE 'ok' END AS motivo
FROM f""",
    "filter_optional": """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate,
       o_orderpriority
FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1995-01-01'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
    "left_join_suffix": """
WITH s AS (SELECT c_custkey, c_acctbal AS total, c_mktsegment AS segmento FROM customer
           UNION ALL
           SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT o.o_orderkey, o.o_custkey, round(o.o_totalprice, 6) AS total, o.o_orderdate AS fecha,
       s.c_custkey, round(s.total, 6) AS total_score, s.segmento
FROM orders o LEFT JOIN s ON o.o_custkey = s.c_custkey""",
}
