"""Summary operators (A1, W1, T1, J5, W3, F7, A2, T3, F5, J6, X24) on the
record-history table ``events``: ``user_id`` plays the episode,
``ts`` the record time, ``event_id`` the tie-break and ``event_type`` the bed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as S
from ..operators.asof import asof_join
from ..session import read_table

ROUND = 6


def _events(spark, sf):
    # keys present
    return read_table(spark, sf, "events").where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())


def latest_per_key(spark, sf):
    ev = _events(spark, sf)
    out = S.latest_per_key(ev, ["user_id"], ["ts", "event_id"],
                           ["event_id", "ts", "event_type", "value", "props"])
    return out.withColumn("value", F.round("value", ROUND))


def latest_page(spark, sf):
    return S.page(latest_per_key(spark, sf), ["user_id"], skip=20, limit=50)


def asof_last_nonnull(spark, sf):
    ev = _events(spark, sf)
    bed = F.when(F.col("event_type") != "error", F.col("event_type"))
    purchase_ts = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("_purchase")
    days = S.day_level_last(ev, "user_id", "ts", bed, "event_id", [purchase_ts])
    # The discharge day of every episode, from the day-level rows.
    cutoffs = days.groupBy("user_id").agg(F.to_date(F.max("_purchase")).alias("fecha_alta"))
    return S.asof_last_nonnull(days, cutoffs, "user_id", "fecha_alta", "ultima_cama")


def asof_seconds(spark, sf):
    """J5 at seconds: the last bed 90 seconds before every discharge."""
    ev = _events(spark, sf)
    cuts = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 90 SECONDS")).alias("corte"))
    beds = ev.where(F.col("event_type") != "error").select("user_id", "ts", F.col("event_id").alias("orden"), F.col("event_type").alias("ultima_cama"),
                                                           F.col("ts").alias("desde"))
    return asof_join(cuts, beds, ["user_id"], "corte", "ts", ["ultima_cama", "desde"], ["orden"])


def history_ordered(spark, sf):
    orders = read_table(spark, sf, "orders").where(F.col("o_custkey").isNotNull())
    return S.history_positions(orders, "o_custkey", ["o_orderdate", "o_orderkey"],
                               ["o_orderkey", "o_orderdate"], pos="pos")


def current_state_active(spark, sf):
    ev = _events(spark, sf).withColumn("cama", F.col("event_type"))
    # Discharge marker: '' for ordinary records (not truthy), the text for errors.
    ev = ev.withColumn("estado_de_alta", F.when(F.col("event_type") == "error", F.lit("error"))
                       .otherwise(F.lit("")))
    cur = S.current_state(ev, "user_id", "ts", "event_id", ["event_id", "ts", "cama"])
    active = S.active_keys(ev, "user_id", "ts", "event_id",
                           ["fecha_alta", "fecha_de_alta", "fecha_finalizacion", "estado_de_alta"])
    return S.restrict_to(cur, active, "user_id")


def _events_as_stays(spark, sf):
    ev = _events(spark, sf)
    return ev.select(
        F.col("user_id").cast("string").alias("episodio"), F.col("ts").alias("marca_temporal"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("cama"),
        F.when(F.col("event_type") == "purchase", F.to_date("ts")).alias("fecha_alta"),
        F.col("props").alias("convenio"),
        F.floor(F.col("value") * 100).cast("string").alias("valor_parcial"))


def people_summary(spark, sf):
    """The whole people-summary job (F1, A1, J5, P14, P13) over every episode."""
    return S.people_summary(_events_as_stays(spark, sf), limit=None)


def episode_history(spark, sf):
    """The episode-history job (A2 + P13/P14) for every episode, flat form."""
    ev = _events(spark, sf).select(
        F.col("user_id").cast("string").alias("episodio"), F.col("ts").alias("marca_temporal"),
        F.col("event_type").alias("cama"), F.col("props").alias("status"))
    return S.episode_history(ev)


QUERIES = {
    "episode_history": episode_history,
    "people_summary": people_summary,
    "latest_per_key": latest_per_key,
    "latest_page": latest_page,
    "asof_last_nonnull": asof_last_nonnull,
    "asof_seconds": asof_seconds,
    "history_ordered": history_ordered,
    "current_state_active": current_state_active,
}

_LATEST = """
SELECT user_id, event_id, ts, event_type, round(value, 6) AS value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) t
WHERE rn = 1"""

ORACLE = {
    "asof_seconds": """
SELECT c.event_id, c.user_id, c.corte, e.event_type AS ultima_cama, e.ts AS desde
FROM (SELECT event_id, user_id, ts - INTERVAL 90 SECOND AS corte FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL) c
LEFT JOIN events e ON e.user_id = c.user_id AND e.ts <= c.corte AND e.event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY e.ts DESC NULLS LAST, e.event_id DESC NULLS LAST) = 1""",
    "latest_per_key": _LATEST,
    "latest_page": _LATEST + "\nORDER BY user_id LIMIT 50 OFFSET 20",
    "asof_last_nonnull": """
WITH e AS (
  SELECT user_id, ts, event_id, event_type,
         CASE WHEN event_type <> 'error' THEN event_type END AS bed
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
fa AS (
  SELECT user_id, CAST(MAX(CASE WHEN event_type = 'purchase' THEN ts END) AS DATE) AS fecha_alta
  FROM e GROUP BY user_id),
c AS (
  SELECT e.user_id, e.bed,
         row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rn
  FROM e JOIN fa ON e.user_id = fa.user_id
  WHERE e.bed IS NOT NULL AND e.ts < CAST(fa.fecha_alta AS TIMESTAMP) + INTERVAL 1 DAY)
SELECT fa.user_id, fa.fecha_alta, c.bed AS ultima_cama
FROM fa LEFT JOIN c ON fa.user_id = c.user_id AND c.rn = 1""",
    "history_ordered": """
SELECT o_custkey, o_orderkey, o_orderdate,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos
FROM orders WHERE o_custkey IS NOT NULL""",
    "current_state_active": """
WITH l AS (
  SELECT user_id, event_id, ts, event_type,
         row_number() OVER (PARTITION BY user_id
                            ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS rn
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, event_id, ts, event_type AS cama FROM l
WHERE rn = 1 AND (event_type IS NULL OR event_type <> 'error')""",
}


_NULL_TEXT = ["nombre", "sexo", "fecha_de_nacimiento", "tipo_cuenta_1", "tipo_cuenta_2", "tipo_cuenta_3",
              "fecha_admision", "nombre_de_la_aseguradora", "dias_hospitalizacion", "riesgo_social",
              "riesgo_clinico", "riesgo_administrativo", "rut", "prob_sobre_estadia", "grd_code"]

ORACLE["people_summary"] = """
WITH st AS (
  SELECT CAST(user_id AS VARCHAR) AS episodio, ts AS marca_temporal,
         CASE WHEN event_type <> 'error' THEN event_type END AS cama,
         CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END AS fecha_alta,
         props AS convenio, CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS valor_parcial
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episodio ORDER BY marca_temporal DESC) AS rn
                     FROM st) t WHERE rn = 1),
b AS (SELECT l.episodio, st.cama,
             row_number() OVER (PARTITION BY l.episodio ORDER BY st.marca_temporal DESC) AS rn
      FROM l JOIN st ON st.episodio = l.episodio
      WHERE st.cama IS NOT NULL AND st.marca_temporal < CAST(l.fecha_alta AS TIMESTAMP) + INTERVAL 1 DAY)
SELECT l.episodio, l.fecha_alta,
       CASE WHEN trim(l.convenio) = '' THEN NULL ELSE l.convenio END AS convenio,
       CASE WHEN trim(l.valor_parcial) = '' THEN NULL ELSE l.valor_parcial END AS valor_parcial,
       b.cama AS ultima_cama, """ + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _NULL_TEXT) + """
FROM l LEFT JOIN b ON b.episodio = l.episodio AND b.rn = 1"""


_HIST_NULL = [f for f in S.HISTORY_FIELDS if f not in ("marca_temporal", "cama", "status")] + \
    ["prob_sobre_estadia", "grd_code"]

ORACLE["episode_history"] = """
SELECT CAST(user_id AS VARCHAR) AS episodio, ts AS marca_temporal,
       CASE WHEN trim(event_type) = '' THEN NULL ELSE event_type END AS cama,
       CASE WHEN trim(props) = '' THEN NULL ELSE props END AS status,
       row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos, """ + \
    ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _HIST_NULL) + """
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"""
