"""Per-episode summaries over a record history: latest row, value as of a
cut-off, ordered history, current bed, active episodes, paging.

All of them are aggregates keyed by the episode (sort-based when the buffer
is a struct). Spark runs them with a partial (map-side) aggregation, so the
shuffle carries at most one row per key per map task and a key holding a
third of the table costs no more than any other key in the reduce stage.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .ranking import position_in_key


def latest_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence,
                   payload: Sequence[str] | None = None, nulls_last: bool = False) -> DataFrame:
    """The newest row of every key.

    ``max`` over one ordered struct keeps NULL fields of the winning row.
    With ``nulls_last`` a NULL ordering value ranks below every real value.
    """
    keys = list(keys)
    payload = list(payload) if payload is not None else [c for c in df.columns if c not in keys]
    row = ordered_struct(order_cols, payload, nulls_last)
    return (df.groupBy(*keys)
              .agg(F.max(row).alias("_row"))
              .select(*keys, *[F.col("_row")[p].alias(p) for p in payload]))


def ordered_struct(order_cols: Sequence, payload: Sequence[str], nulls_last: bool = False) -> Column:
    """One struct whose leading fields are the ordering: ``max``/``min`` of it
    is the newest/oldest row (ties broken by the payload, so deterministic),
    with a single aggregation buffer per key."""
    parts = []
    for i, c in enumerate(order_cols):
        c = F.col(c) if isinstance(c, str) else c
        if nulls_last:
            parts.append(c.isNotNull().alias(f"_n{i}"))
        parts.append(c.alias(f"_o{i}"))
    return F.struct(*parts, *[F.col(p).alias(p) for p in payload])


def page(df: DataFrame, order_cols: Sequence, skip: int = 0, limit: int | None = None) -> DataFrame:
    """One ordered page (a top-k, no full sort); without a limit all rows after ``skip``."""
    out = df.orderBy(*order_cols)
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def day_level_last(history: DataFrame, key: str, ts: str, value: Column, tiebreak: str,
                   extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """Pre-aggregate a history to one row per (key, day): the day's last
    non-NULL value and its ordering struct. Rows per key after this step are
    bounded by the number of calendar days."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    # max skips NULL structs: rows without a value do not compete.
    last = F.max(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    return (history
            .groupBy(F.col(key), F.to_date(F.col(ts)).alias("_day"))
            .agg(last.alias("_last"), *extra_aggs))


def asof_last_nonnull(day_last: DataFrame, cutoffs: DataFrame, key: str, cutoff: str,
                      out: str) -> DataFrame:
    """Last non-NULL value with ``ts < cutoff + 1 day`` per key.

    ``day_last`` comes from :func:`day_level_last`; ``cutoffs`` has one row per
    key (NULL cut-off = not discharged -> NULL answer). Every key of
    ``cutoffs`` appears once in the result.
    """
    # One join and one aggregate: day rows after the cut-off become NULL,
    # which max skips. The aggregate reuses the join's partitioning.
    eligible = F.when(F.col("_day") <= F.col(cutoff), F.col("_last"))
    return (cutoffs.select(key, cutoff).join(day_last, key, "left")
                   .groupBy(key, cutoff)
                   .agg(F.max(eligible)["v"].alias(out)))


def history_positions(df: DataFrame, key: str, order_cols: Sequence, payload: Sequence[str],
                      pos: str = "pos") -> DataFrame:
    """A2 (flat form): every record with its 0-based position inside the key."""
    return position_in_key(df.select(key, *payload), [key], order_cols, name=pos)


def history_arrays(df: DataFrame, key: str, order_col: str, fields: Sequence[str],
                   out: str = "registros") -> DataFrame:
    """A2 (nested form, the source's response shape): one ordered array per key.

    This gathers a key's whole history into one value, so it is used only for
    a point lookup of one episode (:func:`episode_history`); every
    all-keys history goes through :func:`history_positions`.
    """
    rec = F.struct(F.col(order_col), *[F.col(f) for f in fields if f != order_col])
    return df.groupBy(key).agg(F.sort_array(F.collect_list(rec)).alias(out))


def current_state(snapshots: DataFrame, key: str, primary_ts: str, secondary_ts: str | None,
                  payload: Sequence[str]) -> DataFrame:
    """Newest snapshot per key by ``primary_ts`` then ``secondary_ts``, NULLs last."""
    order = [primary_ts] + ([secondary_ts] if secondary_ts else [])
    return latest_per_key(snapshots, [key], order, payload, nulls_last=True)


def active_keys(records: DataFrame, key: str, ts: str, tiebreak: str | None,
                discharge_fields: Sequence[str]) -> DataFrame:
    """keys whose newest record has no truthy discharge field."""
    present = [c for c in discharge_fields if c in records.columns]
    order = [ts] + ([tiebreak] if tiebreak else [])
    latest = latest_per_key(records, [key], order, present or [ts])
    flag = X.first_truthy(*present) if present else F.lit(None)
    return latest.where(flag.isNull()).select(key)


def restrict_to(df: DataFrame, keys_df: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key appears in ``keys_df`` (semi join)."""
    return df.join(keys_df, key, "left_semi")


def clean_blanks(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P13 at read time: whitespace-only text -> NULL, in one projection."""
    cols = set(cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    return df.select(*[X.blank_to_null_read(c).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# FIXED VALUES: fields of the people summary (latest record per episode).
SUMMARY_FIELDS = ["nombre", "sexo", "fecha_de_nacimiento", "tipo_cuenta_1", "tipo_cuenta_2",
                  "tipo_cuenta_3", "fecha_admision", "fecha_alta", "convenio", "nombre_de_la_aseguradora",
                  "valor_parcial", "dias_hospitalizacion", "riesgo_social", "riesgo_clinico",
                  "riesgo_administrativo"]
ALIASES = {"rut": ["run", "rut"], "prob_sobre_estadia": ["prob_sobre_estadia", "probabilidad_sobre_estadia"],
           "grd_code": ["grd_code", "codigo_grd"]}


def _with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    return df.select("*", *[F.lit(None).cast("string").alias(n) for n in missing])


def people_summary(stays: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Episode summary job: F1 -> A1 (latest record) + J5 (bed as of the end
    of the discharge day) -> P14 aliases -> P13 blanks -> T1 page.

    Both parts are aggregates keyed by the episode; the bed uses the
    day-level pre-aggregation, so no episode history is ever collected.
    """
    needed = SUMMARY_FIELDS + ["cama"] + [c for cs in ALIASES.values() for c in cs]
    s = _with_columns(stays, needed).where(F.col("episodio").isNotNull() & F.col("marca_temporal").isNotNull())
    s = s.withColumn("_tie", F.lit(0))
    payload = SUMMARY_FIELDS + sorted({c for cs in ALIASES.values() for c in cs})
    latest = latest_per_key(s, ["episodio"], ["marca_temporal"], payload + ["marca_temporal"])
    latest = latest.withColumn("fecha_alta", F.col("fecha_alta").cast("date"))
    days = day_level_last(s, "episodio", "marca_temporal", X.blank_to_null_ingest(F.col("cama")), "_tie")
    # one join on the episode: its day rows meet its latest record (J5), and the aggregate
    # reuses the join's partitioning
    kept = latest.select("episodio", F.struct(*[c for c in latest.columns if c != "episodio"]).alias("_row"))
    eligible = F.when(F.col("_day") <= F.col("_row.fecha_alta"), F.col("_last"))
    both = kept.join(days, "episodio", "left").groupBy("episodio").agg(F.any_value("_row").alias("_row"), F.max(eligible)["v"].alias("ultima_cama"))
    out = both.select("episodio", "_row.*", "ultima_cama").select(
        "episodio", *[c for c in SUMMARY_FIELDS],
        *[F.coalesce(*[F.col(c) for c in cs]).alias(name) for name, cs in ALIASES.items()],
        "ultima_cama")
    out = clean_blanks(out)
    return page(out, ["episodio"], skip, limit) if skip or limit is not None else out


# FIXED VALUES: per-record fields of the episode history.
HISTORY_FIELDS = ["marca_temporal", "que_gestion_se_solicito", "ultima_modificacion", "fecha_inicio",
                  "hora_inicio", "mes", "ano", "cama", "texto_libre_diagnostico_admision",
                  "diagnostico_transfer", "concretado", "solicitud_de_traslado", "status",
                  "causa_devolucion_rechazo", "estado", "motivo_de_cancelacion", "motivo_de_rechazo",
                  "tipo_de_traslado", "centro_de_destinatario", "nivel_de_atencion",
                  "servicio_especialidad", "fecha_de_finalizacion", "hora_de_finalizacion",
                  "dias_solicitados_homecare", "texto_libre_causa_rechazo", "riesgo_social",
                  "riesgo_clinico", "riesgo_administrativo"]


def episode_history(stays: DataFrame, episode: str | None = None, nested: bool = False) -> DataFrame:
    """Episode history job: every record of each episode in time order (A2)
    with P14 aliases and P13 blanks. Flat (episode, pos, fields...) by
    default; ``nested`` gives the ordered array of one ``episode``."""
    s = stays.where(F.col("episodio").isNotNull())
    if episode is not None:
        s = s.where(F.col("episodio") == F.lit(episode))          # F2 point lookup
    present = [f for f in HISTORY_FIELDS if f in s.columns]
    aliases = []
    for name in ("prob_sobre_estadia", "grd_code"):
        srcs = [c for c in ALIASES[name] if c in s.columns]
        if srcs:
            aliases.append(F.coalesce(*[F.col(c) for c in srcs]).alias(name))
    s = clean_blanks(s.select("episodio", *present, *aliases))
    fields = [c for c in s.columns if c != "episodio"]
    # Fields absent from the input are constant NULLs: added after the heavy
    # steps, so they are never shuffled or checkpointed.
    absent = [f for f in HISTORY_FIELDS + ["prob_sobre_estadia", "grd_code"] if f not in s.columns]
    if nested:
        if episode is None:
            raise ValueError("the nested form collects a whole history into one value: "
                             "only for a single episode; use the flat form for all episodes")
        return history_arrays(_with_columns(s, absent), "episodio", "marca_temporal", fields + absent)
    s = s.withColumn("_row", F.xxhash64(*[F.col(c).cast("string") for c in fields]))
    out = history_positions(s, "episodio", ["marca_temporal", "_row"], fields + ["_row"]).drop("_row")
    return _with_columns(out, absent)


DISCHARGE_FIELDS = ["fecha_alta", "fecha_de_alta", "fecha_finalizacion", "estado_de_alta"]


def current_bed(census: DataFrame, stays: DataFrame | None = None,
                include_discharged: bool = True) -> DataFrame:
    """Current bed of every episode (T3 + X24 + J6/F5), as one job.

    Newest census row per episode by ``snapshot_at`` then ``marca_temporal``
    (NULLs last); ``unidad`` falls back to ``asign_enfermeria`` and the
    reported time to ``marca_temporal``. With ``include_discharged=False``
    only episodes whose newest stay record has no truthy discharge field are
    kept (semi join against the active keys).
    """
    fields = ["unidad", "asign_enfermeria", "sala", "cama", "estado", "paciente",
              "snapshot_at", "marca_temporal"]
    c = census.where(F.col("episodio").isNotNull())
    for f in fields:
        if f not in c.columns:
            c = c.withColumn(f, F.lit(None).cast("timestamp_ntz" if f in ("snapshot_at", "marca_temporal")
                                                  else "string"))
    newest = current_state(c, "episodio", "snapshot_at", "marca_temporal", fields)
    out = newest.select("episodio", X.first_truthy("unidad", "asign_enfermeria").alias("unidad"),
                        "sala", "cama", "estado", "paciente",
                        F.coalesce("snapshot_at", "marca_temporal").alias("timestamp"))
    if not include_discharged:
        if stays is None:
            raise ValueError("active-only current bed needs the stays table")
        active = active_keys(stays.where(F.col("episodio").isNotNull()), "episodio", "marca_temporal",
                             None, DISCHARGE_FIELDS)
        out = restrict_to(out, active, "episodio")
    return out
