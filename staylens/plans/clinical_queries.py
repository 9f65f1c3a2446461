"""Feed normalisation and record handling (P3, P4, P6, P9-P11, S6, X5, X10, X25,
F2, D7, M1, M3, M8) on text frames derived row by row from the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import changes as C
from ..operators import features as FE
from ..operators import ingest as I
from ..session import read_table
from .training_queries import clinical_and_survey


def _stay_texts(o):
    k = F.col("o_orderkey")
    date = F.col("o_orderdate")
    return o.select(
        F.concat(F.lit("EP"), k.cast("string")).alias("episodio"),
        F.when(k % 3 == 0, F.date_format(date, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")).alias("marco_temporal"),
        F.concat(F.lit(" "), (k % 40).cast("string"), F.lit(" d")).alias("dias_hospitalizacion"),
        F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("C-"), (k % 90).cast("string"))).alias("cama"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("-1")).alias("rut"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("nombre"),
        F.lit("Femenino").alias("sexo"), (k % 30000 + 1).cast("string").alias("fecha_de_nacimiento"),
        F.date_format(date, "dd/MM/yyyy").alias("control"), (k % 90000 + 10000).cast("string").alias("codigo"), F.col("o_orderpriority").alias("nota"))


def stays_normalised(spark, sf):
    out = I.normalize_stays(_stay_texts(read_table(spark, sf, "orders")))
    return out.select("episodio", "marca_temporal", "dias_hospitalizacion", "cama", "run", "nombre", "fecha_de_nacimiento", "control", "codigo", "nota",
                      "riesgo_social", F.col("_synthetic_identity").alias("sintetico"), F.col("_tipo_fuente").alias("fuente"))


def census_normalised(spark, sf):
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    raw = read_table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("servicio"), F.concat(F.lit(" b-"), (k % 70).cast("string"), F.lit(" ")).alias("nro_cama"),
        F.when(k % 4 != 0, F.date_format(date, "dd/MM/yyyy")).alias("fecha"),
        F.when(k % 3 == 0, F.lit("1305")).when(k % 3 == 1, F.lit("7:45")).otherwise(F.lit("")).alias("hora"),
        F.concat((k % 1000).cast("string"), F.lit("-k")).alias("rut"), k.cast("string").alias("fila"),
        F.when(k % 8 == 0, F.lit("camas 05-03-2025 1430.csv")).otherwise(F.lit("censo_06-03-2025.csv")).alias("_file_name"))
    rows, key = I.normalize_census(raw)
    return rows.select("unidad", "cama", "run", "fila", "snapshot_at", F.lit(",".join(key)).alias("clave"), F.col("_tipo_fuente").alias("fuente"))


def model_dataset(spark, sf):
    grd, score = clinical_and_survey(spark, sf)
    return FE.make_dataset(grd, score).withColumn("peso", F.round("peso", 6))


def stratified_split(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("clase"))
    train, test = FE.stratified_split(o, "clase", "o_orderkey")
    return train.withColumn("lado", F.lit("train")).unionByName(test.withColumn("lado", F.lit("test")))


def class_weights(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("A")).alias("clase"), "l_quantity")
    out = FE.class_weights(li, "clase", "l_quantity", "w")
    return out.select("l_orderkey", "l_linenumber", "clase", F.round("w", 6).alias("w"))


def managers_added(spark, sf):
    c = read_table(spark, sf, "customer")
    new = c.select(F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).alias("name"))
    stored = c.where(F.col("c_nationkey") < 5).select(F.col("c_name").alias("name"))
    return C.add_managers(stored, new.unionByName(new))


def addressed_records(spark, sf):
    """Record ids and time texts of stays, and the stay that an id addresses."""
    stays = read_table(spark, sf, "orders").select(F.concat(F.lit("EP"), F.col("o_custkey").cast("string")).alias("episodio"),
                                                   F.col("o_orderdate").cast("timestamp_ntz").alias("marca_temporal"))
    first = C.address_records(stays, "EP1", "1995-01-01").select("episodio", "marca_temporal")
    all_ids = stays.select("episodio", "marca_temporal")
    return (all_ids.unionByName(first).select("episodio", X.row_id("episodio", F.date_format("marca_temporal", "yyyy-MM-dd")).alias("id"),
                                              X.iso_text("marca_temporal").alias("marca"), X.utc_iso(F.col("marca_temporal").cast("timestamp")).alias("utc")))


def coerced_types(spark, sf):
    p = read_table(spark, sf, "part")
    out, num, cat = FE.coerce_types(p, exclude=["p_partkey"])
    return out.select("p_partkey", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"), "p_brand",
                      F.lit(",".join(sorted(num))).alias("numericas"), F.lit(",".join(sorted(cat))).alias("categoricas"))


QUERIES = {f.__name__: f for f in (stays_normalised, census_normalised, model_dataset, stratified_split, class_weights, managers_added,
                                   addressed_records, coerced_types)}

_CLINICAL = """
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, max(l_linenumber) AS max_line,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_line
  FROM lineitem GROUP BY 1),
base AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS episodio, CAST(20 + o.o_custkey % 70 AS DOUBLE) AS edad,
         CASE WHEN o.o_custkey % 2 = 0 THEN 'Hombre' ELSE 'Mujer' END AS sexo, coalesce(o.o_orderpriority, 'Desconocido') AS servicio_clinico,
         coalesce(c.c_mktsegment, 'Desconocido') AS prevision, 2.0 + o.o_orderkey % 5 AS norma, CAST(l.n_lines AS DOUBLE) AS estancia,
         CAST(CAST(l.qty AS INTEGER) AS DOUBLE) AS total, l.max_line % 4 AS salud, l.returned, l.open_line, l.l_orderkey,
         CAST(o.o_custkey % 50 AS DOUBLE) AS codigo_grd, CAST(o.o_orderdate AS TIMESTAMP) AS fecha
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN lines l ON o.o_orderkey = l.l_orderkey),
q AS (SELECT quantile_cont(total, 0.33) AS q33, quantile_cont(total, 0.66) AS q66 FROM base),
q2 AS (SELECT q33, CASE WHEN q66 <= q33 THEN q33 + 1e-6 ELSE q66 END AS q66 FROM q)"""

ORACLE = {
    "stays_normalised": """
SELECT 'EP' || o_orderkey AS episodio,
  CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('minute', CAST(o_orderdate AS TIMESTAMP)) ELSE date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) END AS marca_temporal,
  CAST(o_orderkey % 40 AS BIGINT) AS dias_hospitalizacion, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE 'C-' || (o_orderkey % 90) END AS cama,
  o_custkey || '-1' AS run, 'N' || o_custkey AS nombre, DATE '1899-12-30' + CAST(o_orderkey % 30000 + 1 AS INTEGER) AS fecha_de_nacimiento,
  strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS control, CAST(o_orderkey % 90000 + 10000 AS VARCHAR) AS codigo, o_orderpriority AS nota,
  CAST(NULL AS VARCHAR) AS riesgo_social, FALSE AS sintetico, 'respuestas_formulario' AS fuente
FROM orders""",
    "census_normalised": """
SELECT o_orderpriority AS unidad, upper('b-' || (o_orderkey % 70)) AS cama, upper((o_orderkey % 1000) || '-k') AS run, CAST(o_orderkey AS VARCHAR) AS fila,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN TIMESTAMP '2025-03-05 14:30:00' ELSE TIMESTAMP '2025-03-06 00:00:00' END
       ELSE date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '13 hours 5 minutes'
            WHEN 1 THEN INTERVAL '7 hours 45 minutes' ELSE INTERVAL '0 minutes' END END AS snapshot_at,
  'unidad,cama,snapshot_at' AS clave, 'censo_camas' AS fuente
FROM orders""",
    "model_dataset": f"""
WITH {_CLINICAL}
SELECT episodio, edad, sexo, servicio_clinico, prevision, CAST(norma AS DOUBLE) AS fecha_estimada_de_alta,
  CAST(CASE WHEN total IS NULL OR q33 IS NULL THEN 1.0 WHEN total <= q33 THEN 0.0 WHEN total <= q66 THEN 1.0 ELSE 2.0 END AS DOUBLE) AS riesgo_social,
  CAST(CASE WHEN salud IS NULL THEN 1.0 ELSE least(greatest(CAST(salud AS DOUBLE) - 1.0, 0.0), 2.0) END AS DOUBLE) AS riesgo_clinico,
  CAST(CASE WHEN l_orderkey IS NULL THEN 0.0 WHEN open_line = 1 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS riesgo_administrativo, codigo_grd,
  CAST(coalesce(CAST(estancia > norma AS INTEGER), 0) AS INTEGER) AS excede_norma,
  CAST(round(least(greatest(1.0 + 0.05 * coalesce(greatest(estancia - norma, 0.0), 0.0), 1.0), 3.0), 6) AS DOUBLE) AS peso, fecha
FROM base, q2""",
    "stratified_split": """
WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS clase FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY clase ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#42'), o_orderkey) - 1 AS r,
             count(*) OVER (PARTITION BY clase) AS n FROM o)
SELECT o_orderkey, clase, CASE WHEN r < round(n * 0.8) THEN 'train' ELSE 'test' END AS lado FROM r""",
    "class_weights": """
WITH l AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'A') AS clase, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, clase, round(CAST(count(*) OVER () AS DOUBLE) / ((SELECT count(*) FROM (SELECT DISTINCT clase FROM l)) * count(*) OVER (PARTITION BY clase)) * l_quantity, 6) AS w FROM l""",
    "managers_added": """
SELECT DISTINCT c_name AS name FROM customer c
WHERE c_custkey % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM customer s WHERE s.c_nationkey < 5 AND s.c_name = c.c_name)""",
    "addressed_records": """
WITH s AS (SELECT 'EP' || o_custkey AS episodio, CAST(o_orderdate AS TIMESTAMP) AS m FROM orders),
a AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE episodio = 'EP1' AND m = TIMESTAMP '1995-01-01')
SELECT episodio, sha256(episodio || '|' || strftime(m, '%Y-%m-%d')) AS id, strftime(m, '%Y-%m-%dT%H:%M:%S') AS marca, strftime(m, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM a""",
    "coerced_types": """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, round(CAST(p_retailprice AS DOUBLE), 6) AS p_retailprice, p_brand,
  (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE part) WHERE column_name <> 'p_partkey' AND column_type <> 'VARCHAR') AS numericas,
  (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE part) WHERE column_name <> 'p_partkey' AND column_type = 'VARCHAR') AS categoricas
FROM part""",
}
