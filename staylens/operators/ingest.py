"""Normalisation of the two CSV feeds into keyed tables.

Stays (``estadias``): canonical header dictionary (P3), typed dates and day
counts (X1, X4), carried extra columns (P6 with the X5 heuristic), identity
filling (X8/X9), ML defaults (P7) and lineage (P9) -- one ``select``.
Census (``camas``): synonym resolution (P4), snapshot time assembly (X10,
S6), upper/trim of bed and id (X11), carried extras (P6).
Uniqueness (W2 + J4) is applied by :mod:`keyed` on the business key.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import scalars as X

# FIXED VALUES: canonical stay headers (after slugging) -> stored name.
STAY_CANON = {
    "marco_temporal": "marca_temporal", "status": "status",
    "causa_devolucion_rechazo": "causa_devolucion_rechazo", "ultima_modificacion": "ultima_modificacion",
    "episodio": "episodio", "que_gestion_se_solicito": "que_gestion_se_solicito",
    "fecha_inicio": "fecha_inicio", "hora_inicio": "hora_inicio", "informe": "informe",
    "tipo_cuenta_1": "tipo_cuenta_1", "tipo_cuenta_2": "tipo_cuenta_2", "tipo_cuenta_3": "tipo_cuenta_3",
    "nombre": "nombre", "rut": "run", "fecha_admision": "fecha_admision", "mes": "mes", "ano": "ano",
    "fecha_alta": "fecha_alta", "cama": "cama",
    "texto_libre_diagnostico_admision": "texto_libre_diagnostico_admision",
    "diagnostico_transfer": "diagnostico_transfer", "convenio": "convenio",
    "nombre_de_la_aseguradora": "nombre_de_la_aseguradora", "valor_parcial": "valor_parcial",
    "solicitud_de_traslado": "solicitud_de_traslado", "concretado": "concretado",
    "dias_hospitalizacion": "dias_hospitalizacion", "dias_reales": "dias_reales", "mes2": "mes2",
    "ano2": "ano2", "fecha_de_nacimiento": "fecha_de_nacimiento", "sexo": "sexo", "estado": "estado",
    "motivo_de_cancelacion": "motivo_de_cancelacion", "motivo_de_rechazo": "motivo_de_rechazo",
    "tipo_de_solicitud": "tipo_de_solicitud", "tipo_de_traslado": "tipo_de_traslado",
    "motivo_de_traslado": "motivo_de_traslado", "centro_de_destinatario": "centro_de_destinatario",
    "nivel_de_atencion": "nivel_de_atencion", "servicio_especialidad": "servicio_especialidad",
    "fecha_de_finalizacion": "fecha_de_finalizacion", "hora_de_finalizacion": "hora_de_finalizacion",
    "dias_solicitados_homecare": "dias_solicitados_homecare",
    "texto_libre_causa_rechazo": "texto_libre_causa_rechazo",
}
STAY_TIMESTAMPS = ["marca_temporal", "ultima_modificacion", "fecha_inicio", "fecha_de_finalizacion"]
STAY_DATES = ["fecha_admision", "fecha_alta", "fecha_de_nacimiento"]
STAY_DAY_COUNTS = ["dias_hospitalizacion", "dias_reales", "dias_solicitados_homecare"]
STAY_ML_DEFAULTS = ["riesgo_social", "riesgo_clinico", "riesgo_administrativo", "prob_sobre_estadia",
                    "grd_code"]
STAY_KEY = ["episodio", "marca_temporal"]
STAY_SOURCE, CENSUS_SOURCE = "respuestas_formulario", "censo_camas"

# FIXED VALUES: census synonyms, first present variant wins.
CENSUS_SYNONYMS = {
    "unidad": ["unidad", "servicio", "establecimiento", "area", "pabellon", "unidad_clinica"],
    "sala": ["sala", "sector", "modulo", "habitacion"],
    "cama": ["cama", "bed", "nro_cama", "numero_cama", "id_cama"],
    "estado": ["estado", "status", "ocupacion", "disponibilidad", "condicion"],
    "paciente": ["paciente", "nombre_paciente", "paciente_nombre"],
    "run": ["run", "rut", "id_paciente", "identificacion"],
    "diagnostico": ["diagnostico", "dx_principal", "diagnostico_principal"],
    "fecha": ["fecha", "fecha_registro", "fecha_corte", "fecha_medicion", "marca_temporal", "timestamp",
              "fecha_carga"],
    "hora": ["hora", "hora_registro", "hora_medicion"],
    "fecha_hora": ["fecha_hora", "fechahora", "datetime", "fecha_y_hora", "marca_temporal"],
}
CENSUS_KEYS = [["unidad", "sala", "cama", "snapshot_at"], ["unidad", "cama", "snapshot_at"],
               ["cama", "snapshot_at"]]
# FIXED VALUES: shapes of the time stamp in a file name.
FILE_STAMP_WITH_TIME = r"(\d{2})[-_/](\d{2})[-_/](\d{4}).*?(\d{2})(\d{2})"
FILE_STAMP_DATE = r"(\d{2})[-_/](\d{2})[-_/](\d{4})"


def fill_identity(df: DataFrame, episode: str = "episodio", age: str | None = "edad",
                  record_ts: str | None = "marca_temporal") -> DataFrame:
    """Fill only missing identity fields from hash draws of the episode;
    flag rows that received any synthetic value. Rows without an episode are
    left untouched."""
    for c, t in (("run", "string"), ("rut", "string"), ("nombre", "string"), ("sexo", "string"),
                 ("fecha_de_nacimiento", "date")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    age_col = X.lenient_int(F.col(age)) if age and age in df.columns else None
    ts_col = F.col(record_ts) if record_ts and record_ts in df.columns else None
    syn = X.synthetic_identity(F.col(episode), age_col, ts_col)
    has_ep = X.first_truthy(episode).isNotNull()

    def missing(c):
        return X.first_truthy(c).isNull() if dict(df.dtypes)[c] == "string" else F.col(c).isNull()

    need = {c: has_ep & missing(c) for c in ("run", "nombre", "sexo", "fecha_de_nacimiento")}
    any_need = need["run"] | need["nombre"] | need["sexo"] | need["fecha_de_nacimiento"]
    staged = df.withColumn("_syn", syn).withColumn("_need_run", need["run"])
    out = staged.select(
        *[c for c in df.columns if c not in ("run", "rut", "nombre", "sexo", "fecha_de_nacimiento")],
        F.when(F.col("_need_run"), F.col("_syn.run")).otherwise(F.col("run")).alias("run"),
        F.when(F.col("_need_run"), F.col("_syn.run")).otherwise(F.col("rut")).alias("rut"),
        F.when(need["nombre"], F.col("_syn.nombre")).otherwise(F.col("nombre")).alias("nombre"),
        F.when(need["sexo"], F.col("_syn.sexo")).otherwise(F.col("sexo")).alias("sexo"),
        F.when(need["fecha_de_nacimiento"], F.col("_syn.fecha_de_nacimiento"))
         .otherwise(F.col("fecha_de_nacimiento")).alias("fecha_de_nacimiento"),
        any_need.alias("_synthetic_identity"),
    )
    return out


def normalize_stays(raw: DataFrame, extra_serials: bool = False) -> DataFrame:
    """Stays feed: slugged text columns in, typed canonical columns out.

    ``raw`` holds only STRING columns whose names are already slugged (P1).
    Unmapped columns are carried; ISO and dd/mm/yyyy text in them becomes ISO
    text. ``extra_serials`` also takes bare 5-digit numbers for serial dates (off
    by default: they may be codes).
    """
    control = [c for c in raw.columns if c.startswith("_")]   # scan bookkeeping, carried as is
    cols = [c for c in raw.columns if c not in control]
    H.require(cols, ["episodio"], "stays")
    if "marca_temporal" not in cols and "marco_temporal" not in cols:
        raise ValueError("stays: missing required columns ['marca_temporal' or 'marco_temporal']")
    select: list[Column] = []
    produced = set()
    for src, dst in STAY_CANON.items():
        if src not in cols or dst in produced:
            continue
        c = F.col(src)
        if dst in STAY_TIMESTAMPS:
            v = X.parse_datetime(c, keep_time=True)
        elif dst in STAY_DATES:
            v = X.parse_datetime(c, keep_time=False)
        elif dst in STAY_DAY_COUNTS:
            v = X.lenient_int(c)
        else:
            v = X.blank_to_null_ingest(c)
        select.append(v.alias(dst))
        produced.add(dst)
        if src == "rut":
            select.append(v.alias("rut"))
            produced.add("rut")
    if "marca_temporal" not in produced:          # the key is always normalised
        select.append(X.parse_datetime(F.col("marca_temporal"), True).alias("marca_temporal"))
        produced.add("marca_temporal")
    consumed = set(STAY_CANON) | {"marca_temporal"}
    for c in cols:
        if c not in consumed and c not in produced:
            select.append(X.carried_value(F.col(c), extra_serials).alias(c))
            produced.add(c)
    for c in STAY_ML_DEFAULTS:
        if c not in produced:
            select.append(F.lit(None).cast("string").alias(c))
    select.append(F.lit(STAY_SOURCE).alias("_tipo_fuente"))
    select += [F.col(c) for c in control]
    return fill_identity(raw.select(*select))


def file_stamp(file_name: Column) -> Column:
    """Snapshot time from a file name, ``dd-mm-yyyy ... hhmm`` or the date at 00:00."""
    # The scan reports the name URL-escaped; decode it, then '%20' -> space.
    name = F.regexp_replace(F.try_url_decode(file_name), "%20", " ")
    g = lambda pat, i: F.regexp_extract(name, pat, i)
    # yyyy-mm-dd text cast with try_cast: no match or an impossible date -> NULL
    date_only = F.concat_ws("-", g(FILE_STAMP_DATE, 3), g(FILE_STAMP_DATE, 2), g(FILE_STAMP_DATE, 1)) \
        .try_cast("date").cast("timestamp_ntz")
    hh, mi = g(FILE_STAMP_WITH_TIME, 4).try_cast("int"), g(FILE_STAMP_WITH_TIME, 5).try_cast("int")
    valid_time = hh.between(0, 23) & mi.between(0, 59)
    with_time = F.timestamp_add("MINUTE", hh * 60 + mi, date_only)
    return F.when(F.coalesce(valid_time, F.lit(False)), with_time).otherwise(date_only)


def clock_text(c: Column) -> Column:
    """Keep digits and ':'; ``1305`` -> ``13:05``."""
    h = F.regexp_replace(c.cast("string"), r"[^0-9:]", "")
    return F.regexp_replace(h, r"^(\d{2})(\d{2})$", "$1:$2")


def normalize_census(raw: DataFrame, file_name_col: str | None = "_file_name") -> tuple[DataFrame, list[str]]:
    """Census feed: returns (normalised rows, unique key chosen from the headers)."""
    control = [c for c in raw.columns if c.startswith("_")]   # scan bookkeeping, carried as is
    cols = [c for c in raw.columns if c not in control]
    m = H.resolve_synonyms(cols, CENSUS_SYNONYMS)
    if "cama" not in m:
        raise ValueError("census: no 'cama' column")
    stamp = file_stamp(F.col(file_name_col)) if file_name_col and file_name_col in raw.columns else F.lit(None)
    if "fecha_hora" in m:
        row_time = X.parse_datetime(F.col(m["fecha_hora"]), True)
    elif "fecha" in m and "hora" in m:
        day = X.parse_datetime(F.col(m["fecha"]), False)
        clock = F.nullif(clock_text(F.col(m["hora"])), F.lit(""))
        t = F.coalesce(F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), clock),
                                          F.lit("yyyy-MM-dd H:mm")).cast("timestamp_ntz"),
                       F.when(clock.isNull(), day.cast("timestamp_ntz")))
        row_time = t
    elif "fecha" in m:
        row_time = X.parse_datetime(F.col(m["fecha"]), False).cast("timestamp_ntz")
    else:
        row_time = F.lit(None).cast("timestamp_ntz")
    select = []
    for std in ["unidad", "sala", "cama", "estado", "paciente", "run", "diagnostico"]:
        if std not in m:
            continue
        c = F.col(m[std])
        v = X.upper_trim(c) if std in ("cama", "run") else X.blank_to_null_ingest(c)
        select.append(v.alias(std))
    select.append(F.coalesce(row_time, stamp).alias("snapshot_at"))
    used = set(m.values())
    for c in cols:
        if c not in used and c not in ("snapshot_at",):
            select.append(X.blank_to_null_ingest(F.col(c)).alias(c))
    select.append(F.lit(CENSUS_SOURCE).alias("_tipo_fuente"))
    select += [F.col(c) for c in control]
    present = set(m) | {"snapshot_at"}
    key = next(k for k in CENSUS_KEYS if set(k) <= present)
    return raw.select(*select), key
