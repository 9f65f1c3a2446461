"""Scalar functions (X1, X3-X9, X11-X13, X26, P7, P13, P14) and the union
(U1) on text synthesised row by row from orders / customer keys and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.ingest import fill_identity
from ..operators.scoring import fill_template
from ..session import read_table

ROUND = 6


def _s(c):
    return F.col(c).cast("string")


def lenient_int(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = (F.when(k % 4 == 0, F.concat(F.lit(" $"), _s("o_custkey"), F.lit("."),
                                       F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" ")))
            .when(k % 4 == 1, F.concat(_s("o_custkey"), F.lit(".5")))
            .when(k % 4 == 2, F.concat(F.lit("--"), _s("o_custkey")))
            .otherwise(F.concat(F.lit("-"), _s("o_custkey"))))
    return o.select("o_orderkey", raw.alias("texto")).withColumn("valor", X.lenient_int(F.col("texto")))


def _serial_text(k, c):
    return F.when(k % 2 == 0, F.concat((k % 60000).cast("string"), F.lit(","), (c % 100).cast("string"))) \
            .otherwise(F.concat((k % 60000).cast("string"), F.lit("."), (c % 100).cast("string")))


def excel_serial(spark, sf):
    o = read_table(spark, sf, "orders")
    s = _serial_text(F.col("o_orderkey"), F.col("o_custkey"))
    return o.select("o_orderkey", s.alias("serial")).select(
        "o_orderkey", "serial", X.excel_serial_to_timestamp(F.col("serial")).alias("marca"),
        X.excel_serial_to_timestamp(F.col("serial"), with_time=False).alias("fecha"))


def _date_texts(o):
    k = F.col("o_orderkey")
    ts = F.timestamp_add("MINUTE", (k % 24) * 60 + k % 60, F.col("o_orderdate"))
    serial = F.concat((k % 80000 + 1).cast("string"), F.lit(".5"))          # dates from 1899 on
    return (F.when(k % 11 == 10, F.lit(None).cast("string"))
             .when(k % 5 == 0, F.date_format(ts, "dd/MM/yyyy HH:mm"))
             .when(k % 5 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
             .when(k % 5 == 2, F.date_format(ts, "dd-MM-yyyy"))
             .when(k % 5 == 3, serial)
             .otherwise(F.date_format(ts, "dd/MM/yyyy")))


def parse_dates(spark, sf):
    o = read_table(spark, sf, "orders")
    t = o.select("o_orderkey", _date_texts(o).alias("texto"))
    return t.select("o_orderkey", "texto", X.parse_datetime(F.col("texto"), True).alias("marca"),
                    X.parse_datetime(F.col("texto"), False).alias("fecha"))


def looks_date(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = (F.when(k % 4 == 0, F.concat(F.lit("4"), F.lpad((k % 10000).cast("string"), 4, "0")))
            .when(k % 4 == 1, F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"))
            .when(k % 4 == 2, F.date_format(F.col("o_orderdate"), "dd/MM/yyyy HH:mm"))
            .otherwise(F.concat(F.lit("A"), k.cast("string"))))
    t = o.select("o_orderkey", raw.alias("texto"))
    return t.select("o_orderkey", "texto", X.looks_like_date(F.col("texto")).alias("parece_fecha"),
                    X.carried_value(F.col("texto"), True).alias("valor"))


def _body(c):
    return F.lit(7000000) + (F.col("c_custkey") * 7919) % 20000000


def check_digit(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select("c_custkey", _body(c).alias("cuerpo")).withColumn("dv", X.check_digit(F.col("cuerpo")))


def seed_sha1(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", X.seed_from_key(_s("o_orderkey")).alias("semilla"))


def stay_identities(spark, sf):
    """Stay records with partly missing identity, derived from customer."""
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("EP"), k.cast("string")).alias("episodio"),
        F.when(F.col("c_acctbal") > 0, F.concat(k.cast("string"), F.lit("-K"))).alias("run"),
        F.when(F.col("c_acctbal") > 0, F.concat(k.cast("string"), F.lit("-K"))).alias("rut"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit(None)).otherwise(F.col("c_name")).alias("nombre"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit(None)).otherwise(F.lit("Femenino")).alias("sexo"),
        F.when(F.col("c_nationkey") % 4 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit("1980-01-01").cast("date"), (k % 1000).cast("int")))
         .alias("fecha_de_nacimiento"),
        F.when(k % 2 == 0, (F.lit(40) + k % 30).cast("string")).alias("edad"),
        F.timestamp_add("HOUR", k, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("marca_temporal"),
    )


def identity_fill(spark, sf):
    out = fill_identity(stay_identities(spark, sf))
    return out.select("episodio", "run", "rut", "nombre", "sexo", "fecha_de_nacimiento", "_synthetic_identity")


def birthdate(spark, sf):
    s = stay_identities(spark, sf)
    seed2 = F.conv(F.substring(F.sha1(F.col("episodio")), 13, 12), 16, 10).cast("bigint")
    return s.select("episodio", X.birthdate(seed2, X.lenient_int(F.col("edad")), F.col("marca_temporal"))
                    .alias("fecha_de_nacimiento"))


SEX_TEXT = ["m", "Masculino", " H ", "hombre", "F", "femenino", "MUJER", "x", None, ""]


def normalise_text(spark, sf):
    c = read_table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    sex = F.element_at(F.array(*[F.lit(v).cast("string") for v in SEX_TEXT]), (k % 10 + 1).cast("int"))
    stay = (F.when(k % 3 == 0, n.cast("string"))
             .when(k % 3 == 1, F.concat(F.lit("2024-03-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))))
    raw = c.select("c_custkey",
                   F.concat(F.lit(" "), F.lower(F.substring("c_name", 10, 9)), F.lit(" ")).alias("cama"),
                   sex.alias("sexo"), stay.alias("estancia"),
                   F.when(n == 5, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("segmento"))
    return raw.select("c_custkey", X.upper_trim(F.col("cama")).alias("cama"),
                      X.normalize_sex(F.col("sexo")).alias("sexo"),
                      X.allowed_stay_days(F.col("estancia")).alias("estancia_norma"),
                      X.fill_unknown(F.col("segmento")).alias("segmento"))


def blank_to_null(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    raw = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("  "))
            .when(k % 4 == 2, F.col("c_name")).otherwise(F.lit(None).cast("string")))
    t = c.select("c_custkey", raw.alias("texto"))
    return t.select("c_custkey", X.blank_to_null_ingest(F.col("texto")).alias("al_cargar"),
                    X.blank_to_null_read(X.blank_to_null_ingest(F.col("texto"))).alias("al_leer"))


def alias_fallback(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.coalesce(F.when(k % 3 != 0, F.concat(F.lit("R"), k.cast("string"))),
                   F.concat(F.lit("T"), k.cast("string"))).alias("rut"),
        F.round(F.coalesce(F.when(k % 2 != 0, (k % 100).cast("double") / 100.0),
                           F.col("c_acctbal") / 10000.0), ROUND).alias("prob_sobre_estadia"),
        F.coalesce(F.when(k % 5 != 0, k % 50), F.lit(51401).cast("bigint")).alias("grd_code"),
    )


TEMPLATE = {"edad": 60, "sexo": "Desconocido", "prevision": "FONASA", "codigo_grd": 0}


def defaults_fill(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    partial = c.select("c_custkey",
                       F.when(k % 3 != 0, (F.lit(20) + k % 70).cast("int")).alias("edad"),
                       F.when(F.col("c_nationkey") % 2 == 0, F.lit("Mujer")).alias("sexo"))
    return fill_template(partial, TEMPLATE).select("c_custkey", *TEMPLATE)


def union_by_name(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("clave"),
                                               F.round("o_totalprice", ROUND).alias("monto"),
                                               F.col("o_orderdate").alias("fecha"))
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("clave"),
                                                 F.round("c_acctbal", ROUND).alias("monto"),
                                                 F.col("c_mktsegment").alias("segmento"))
    return o.unionByName(c, allowMissingColumns=True)


QUERIES = {
    "lenient_int": lenient_int,
    "excel_serial": excel_serial,
    "parse_dates": parse_dates,
    "looks_date": looks_date,
    "check_digit": check_digit,
    "seed_sha1": seed_sha1,
    "identity_fill": identity_fill,
    "birthdate": birthdate,
    "normalise_text": normalise_text,
    "blank_to_null": blank_to_null,
    "alias_fallback": alias_fallback,
    "defaults_fill": defaults_fill,
    "union_by_name": union_by_name,
}


# --- SQL twins ---------------------------------------------------------------
def _serial_ts(v):
    return (f"(CASE WHEN abs({v}) <= 106751 THEN TIMESTAMP '1899-12-30 00:00:00' + "
            f"to_seconds(CAST(floor({v} * 86400.0) AS BIGINT)) END)")


def _num(s):
    return f"TRY_CAST(replace(trim({s}), ',', '.') AS DOUBLE)"


def _parse(s):
    v = _num(s)
    fmts = ["%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%d-%m-%Y %H:%M:%S", "%d-%m-%Y %H:%M",
            "%d-%m-%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y"]
    parts = [_serial_ts(v),
             f"CASE WHEN regexp_matches(trim({s}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
             f"THEN TRY_CAST(trim({s}) AS TIMESTAMP) END"]
    parts += [f"try_strptime(trim({s}), '{f}')" for f in fmts]
    return "coalesce(" + ", ".join(parts) + ")"


def _dv(body):
    s = f"reverse(CAST({body} AS VARCHAR))"
    tot = (f"list_sum(list_transform(range(length({s})), "
           f"lambda i: CAST(substr({s}, i + 1, 1) AS INTEGER) * (2 + i % 6)))")
    return (f"(CASE WHEN 11 - {tot} % 11 = 11 THEN '0' WHEN 11 - {tot} % 11 = 10 THEN 'K' "
            f"ELSE CAST(11 - {tot} % 11 AS VARCHAR) END)")


MALE = X.MALE_FIRST_NAMES


def _list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_IDENT_INPUT = """
st AS (
  SELECT 'EP' || CAST(c_custkey AS VARCHAR) AS episodio,
    CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) || '-K' END AS run,
    CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) || '-K' END AS rut,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL ELSE c_name END AS nombre,
    CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'Femenino' END AS sexo,
    CASE WHEN c_nationkey % 4 = 0 THEN NULL
         ELSE CAST(DATE '1980-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS DATE) END AS fecha_de_nacimiento,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(40 + c_custkey % 30 AS VARCHAR) END AS edad,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(c_custkey) AS marca_temporal
  FROM customer),
sd AS (
  SELECT *, CAST('0x' || substr(sha1(episodio), 1, 12) AS BIGINT) AS seed,
         CAST('0x' || substr(sha1(episodio), 13, 12) AS BIGINT) AS seed2,
         TRY_CAST(regexp_replace(edad, '[^0-9-]', '', 'g') AS BIGINT) AS edad_n
  FROM st),
bd AS (
  SELECT *, make_date(CAST(CASE WHEN edad_n IS NOT NULL
                                THEN greatest(1900, coalesce(year(marca_temporal), 2010) - greatest(0, edad_n))
                                ELSE 1935 + seed2 % 81 END AS INTEGER),
                      CAST((seed2 // 81) % 12 + 1 AS INTEGER), CAST((seed2 // 972) % 28 + 1 AS INTEGER)) AS syn_dob
  FROM sd)"""

FEMALE = X.FEMALE_FIRST_NAMES
LAST = X.LAST_NAMES
_BODY = "(7000000 + (seed // 800) % 20000001)"

ORACLE = {
    "lenient_int": """
WITH t AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 4 = 0 THEN ' $' || CAST(o_custkey AS VARCHAR) || '.' ||
                                      lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' '
         WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS VARCHAR) || '.5'
         WHEN o_orderkey % 4 = 2 THEN '--' || CAST(o_custkey AS VARCHAR)
         ELSE '-' || CAST(o_custkey AS VARCHAR) END AS texto
  FROM orders)
SELECT o_orderkey, texto, TRY_CAST(regexp_replace(texto, '[^0-9-]', '', 'g') AS BIGINT) AS valor FROM t""",
    "excel_serial": f"""
WITH t AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 60000 AS VARCHAR) || ',' || CAST(o_custkey % 100 AS VARCHAR)
         ELSE CAST(o_orderkey % 60000 AS VARCHAR) || '.' || CAST(o_custkey % 100 AS VARCHAR) END AS serial
  FROM orders)
SELECT o_orderkey, serial, {_serial_ts(_num('serial'))} AS marca,
       CAST({_serial_ts(_num('serial'))} AS DATE) AS fecha FROM t""",
    "parse_dates": f"""
WITH b AS (
  SELECT o_orderkey, o_orderdate,
         o_orderdate + to_minutes(CAST((o_orderkey % 24) * 60 + o_orderkey % 60 AS BIGINT)) AS ts FROM orders),
t AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 11 = 10 THEN NULL
         WHEN o_orderkey % 5 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M')
         WHEN o_orderkey % 5 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
         WHEN o_orderkey % 5 = 2 THEN strftime(ts, '%d-%m-%Y')
         WHEN o_orderkey % 5 = 3 THEN CAST(o_orderkey % 80000 + 1 AS VARCHAR) || '.5'
         ELSE strftime(ts, '%d/%m/%Y') END AS texto
  FROM b)
SELECT o_orderkey, texto, {_parse('texto')} AS marca, CAST({_parse('texto')} AS DATE) AS fecha FROM t""",
    "looks_date": f"""
WITH t AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 4 = 0 THEN '4' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
         WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
         ELSE 'A' || CAST(o_orderkey AS VARCHAR) END AS texto
  FROM orders),
f AS (
  SELECT *, coalesce(regexp_matches(trim(texto), '^[0-9]{{5}}(\\.[0-9]+)?$')
             OR regexp_matches(trim(texto), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?)?$')
             OR regexp_matches(trim(texto), '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}(\\s+[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?)?$'),
             false) AS parece_fecha
  FROM t)
SELECT o_orderkey, texto, parece_fecha,
       CASE WHEN parece_fecha THEN strftime({_parse('texto')}, '%Y-%m-%dT%H:%M:%S')
            ELSE nullif(texto, '') END AS valor
FROM f""",
    "check_digit": f"""
WITH t AS (SELECT c_custkey, 7000000 + (c_custkey * 7919) % 20000000 AS cuerpo FROM customer)
SELECT c_custkey, cuerpo, {_dv('cuerpo')} AS dv FROM t""",
    "seed_sha1": """
SELECT o_orderkey, CAST('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) AS semilla
FROM orders""",
    "identity_fill": f"""
WITH {_IDENT_INPUT},
syn AS (
  SELECT *,
    CASE WHEN seed % 2 = 0 THEN ({_list(MALE)})[(seed // 2) % 20 + 1]
         ELSE ({_list(FEMALE)})[(seed // 2) % 20 + 1] END || ' ' || ({_list(LAST)})[(seed // 40) % 20 + 1]
      AS syn_nombre,
    CASE WHEN seed % 2 = 0 THEN 'Masculino' ELSE 'Femenino' END AS syn_sexo,
    CAST({_BODY} AS VARCHAR) || '-' || {_dv(_BODY)} AS syn_run,
    nullif(episodio, '') IS NOT NULL AS has_ep
  FROM bd)
SELECT episodio,
  CASE WHEN has_ep AND nullif(run, '') IS NULL THEN syn_run ELSE run END AS run,
  CASE WHEN has_ep AND nullif(run, '') IS NULL THEN syn_run ELSE rut END AS rut,
  CASE WHEN has_ep AND nullif(nombre, '') IS NULL THEN syn_nombre ELSE nombre END AS nombre,
  CASE WHEN has_ep AND nullif(sexo, '') IS NULL THEN syn_sexo ELSE sexo END AS sexo,
  CASE WHEN has_ep AND fecha_de_nacimiento IS NULL THEN syn_dob ELSE fecha_de_nacimiento END AS fecha_de_nacimiento,
  has_ep AND (nullif(run, '') IS NULL OR nullif(nombre, '') IS NULL OR nullif(sexo, '') IS NULL
              OR fecha_de_nacimiento IS NULL) AS _synthetic_identity
FROM syn""",
    "birthdate": f"""
WITH {_IDENT_INPUT}
SELECT episodio, syn_dob AS fecha_de_nacimiento FROM bd""",
    "normalise_text": f"""
WITH r AS (
  SELECT c_custkey, ' ' || lower(substr(c_name, 10, 9)) || ' ' AS cama,
    ({_list(SEX_TEXT)})[c_custkey % 10 + 1] AS sexo,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR)
         WHEN c_custkey % 3 = 1 THEN '2024-03-' || lpad(CAST(c_nationkey % 28 + 1 AS VARCHAR), 2, '0') END AS estancia,
    CASE WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END AS segmento
  FROM customer)
SELECT c_custkey, nullif(upper(trim(cama)), '') AS cama,
  CASE WHEN sexo IS NULL THEN 'Desconocido'
       WHEN lower(trim(sexo)) IN ('m', 'masculino', 'h', 'hombre') THEN 'Hombre'
       WHEN lower(trim(sexo)) IN ('f', 'femenino', 'mujer') THEN 'Mujer' ELSE sexo END AS sexo,
  coalesce(TRY_CAST(trim(estancia) AS DOUBLE), CAST(day(TRY_CAST(estancia AS DATE)) AS DOUBLE)) AS estancia_norma,
  coalesce(segmento, 'Desconocido') AS segmento
FROM r""",
    "blank_to_null": """
WITH t AS (
  SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '  '
                         WHEN c_custkey % 4 = 2 THEN c_name END AS texto
  FROM customer)
SELECT c_custkey, nullif(texto, '') AS al_cargar,
       CASE WHEN trim(nullif(texto, '')) = '' THEN NULL ELSE nullif(texto, '') END AS al_leer
FROM t""",
    "alias_fallback": """
SELECT c_custkey,
  coalesce(CASE WHEN c_custkey % 3 <> 0 THEN 'R' || CAST(c_custkey AS VARCHAR) END,
           'T' || CAST(c_custkey AS VARCHAR)) AS rut,
  round(coalesce(CASE WHEN c_custkey % 2 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) / 100.0 END,
                 c_acctbal / 10000.0), 6) AS prob_sobre_estadia,
  coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 50 END, 51401) AS grd_code
FROM customer""",
    "defaults_fill": """
SELECT c_custkey,
  coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(20 + c_custkey % 70 AS INTEGER) END, 60) AS edad,
  coalesce(CASE WHEN c_nationkey % 2 = 0 THEN 'Mujer' END, 'Desconocido') AS sexo,
  'FONASA' AS prevision, 0 AS codigo_grd
FROM customer""",
    "union_by_name": """
SELECT o_custkey AS clave, round(o_totalprice, 6) AS monto, o_orderdate AS fecha FROM orders
UNION ALL BY NAME
SELECT c_custkey AS clave, round(c_acctbal, 6) AS monto, c_mktsegment AS segmento FROM customer""",
}
