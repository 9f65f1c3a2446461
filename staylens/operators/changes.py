"""Batch application of row-level changes (inserts, patches, deletes) and the
task table's referential checks (D1-D7).

Every change is a join on the business key; rejected rows come back as a
second DataFrame with a reason instead of an HTTP status.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keyed

# FIXED VALUES: task enums and default status.
TASK_TYPES = ["social", "general", "clinica", "administrativa", "coordinacion"]
TASK_PRIORITIES = ["alta", "media", "baja", "critica"]
TASK_STATUSES = ["completado", "en progreso", "pendiente", "cancelada"]
TASK_DEFAULT_STATUS = "pendiente"
PROTECTED_STAY_FIELDS = ["_id", "episodio", "marca_temporal"]


def _in(c: Column, values: Sequence) -> Column:
    """Enum membership with NULL counted as not a member."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def optional_filter(df: DataFrame, equals: Mapping[str, object], extra: Column | None = None) -> DataFrame:
    """conjunction of the supplied equality predicates; None = not supplied."""
    cond = F.lit(True)
    for c, v in equals.items():
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    if extra is not None:
        cond = cond & extra
    return df.where(cond)


def _one_patch(values: DataFrame, keys: Sequence[str], fields: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key (NULL keys included): per field the last supplied value in
    ``order_cols`` order. ``values`` has for every field a struct column
    ``_v_<field>`` (NULL: not supplied). The aggregate combines map-side."""
    order = F.struct(*order_cols) if order_cols else F.lit(0)
    last = [F.max(F.when(F.col(f"_v_{f}").isNotNull(), F.struct(order.alias("o"), F.col(f"_v_{f}").alias("v")))).alias(f"_m_{f}") for f in fields]
    return values.groupBy(*keys).agg(*last, F.lit(True).alias("_hit")) if last else values.select(*keys).distinct().withColumn("_hit", F.lit(True))


def _set_fields(base: DataFrame, merged: DataFrame, keys: Sequence[str], fields: Sequence[str],
                extra: Mapping[str, Column] | None = None) -> DataFrame:
    """``base`` with the merged values; NULL keys match each other."""
    r = merged.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_m_{f}" for f in fields], "_hit")
    cond = F.lit(True)
    for k in keys:
        cond = cond & base[k].eqNullSafe(r[f"_k_{k}"])
    cols = []
    for c in base.columns:
        if c in fields:
            cols.append(F.when(F.col(f"_m_{c}").isNotNull(), F.col(f"_m_{c}")["v"]["x"]).otherwise(base[c]).alias(c))
        elif extra and c in extra:
            cols.append(F.when(F.col("_hit"), extra[c]).otherwise(base[c]).alias(c))
        else:
            cols.append(base[c])
    return base.join(r, cond, "left").select(*cols)


def apply_patch_map(base: DataFrame, patch: DataFrame, keys: Sequence[str],
                    fields_col: str = "fields", protected: Sequence[str] = (),
                    order_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Set every supplied field, NULL included; key/protected fields never change.

    ``patch`` holds the key plus a ``MAP<STRING,STRING>`` of supplied fields.
    Several patches of a key are merged: the last one in ``order_cols`` order wins
    field by field (without an order, the largest value). Returns (patched table,
    rejected patches): ``patch_vacio`` when nothing but key and protected fields
    is supplied, ``valor_invalido`` when a value doesn't cast to its column's type,
    ``no_encontrado`` when the key doesn't exist. A rejected patch changes nothing.
    """
    keys = list(keys)
    locked = set(keys) | set(protected)
    fields = [f for f in base.schema.fields if f.name not in locked]
    given = F.col(fields_col)
    has = {f.name: F.coalesce(F.map_contains_key(given, F.lit(f.name)), F.lit(False)) for f in fields}
    text = {f.name: F.element_at(given, F.lit(f.name)) for f in fields}
    some, bad = F.lit(False), F.lit(False)
    for f in fields:
        some = some | has[f.name]
        bad = bad | (has[f.name] & text[f.name].isNotNull() & text[f.name].try_cast(f.dataType).isNull())
    checked = patch.withColumn("motivo", F.when(~some, F.lit("patch_vacio")).when(bad, F.lit("valor_invalido")))
    good = checked.where(F.col("motivo").isNull()).drop("motivo")
    values = good.select(*keys, *[c for c in order_cols if c not in keys], *[
        F.when(has[f.name], F.struct(text[f.name].try_cast(f.dataType).alias("x"))).alias(f"_v_{f.name}") for f in fields])
    names = [f.name for f in fields]
    patched = _set_fields(base, _one_patch(values, keys, names, order_cols), keys, names)
    missing = keyed.exclude_existing(good, base, keys).withColumn("motivo", F.lit("no_encontrado"))
    return patched, checked.where(F.col("motivo").isNotNull()).unionByName(missing)


def apply_patch_nonnull(base: DataFrame, patch: DataFrame, keys: Sequence[str],
                        stamp_col: str | None = None, order_cols: Sequence[str] = (),
                        validate=None) -> tuple[DataFrame, DataFrame]:
    """Only non-NULL supplied fields change; optionally stamp ``stamp_col``.

    ``patch`` has the key plus any subset of the base columns. Several patches of a
    key are merged as in :func:`apply_patch_map`. ``validate(patch)`` may add a
    column ``motivo`` with a reason for refusal (e.g. :func:`validate_task_patch`).
    Rejected: ``patch_vacio``, the validation's reasons, ``valor_invalido`` and
    ``no_encontrado``; a rejected patch changes nothing.
    """
    keys = list(keys)
    types = {f.name: f.dataType for f in base.schema.fields}
    fields = [c for c in patch.columns if c not in keys and c in types and c not in order_cols]
    some, bad = F.lit(False), F.lit(False)
    for c in fields:
        some = some | F.col(c).isNotNull()
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull())
    checked = validate(patch) if validate else patch.withColumn("motivo", F.lit(None).cast("string"))
    checked = checked.withColumn("motivo", F.when(~some, F.lit("patch_vacio")).otherwise(F.coalesce("motivo", F.when(bad, F.lit("valor_invalido")))))
    good = checked.where(F.col("motivo").isNull()).drop("motivo")
    values = good.select(*keys, *[c for c in order_cols if c not in keys], *[
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).try_cast(types[c]).alias("x"))).alias(f"_v_{c}") for c in fields])
    stamp = {stamp_col: F.current_timestamp()} if stamp_col else None
    patched = _set_fields(base, _one_patch(values, keys, fields, order_cols), keys, fields, stamp)
    missing = keyed.exclude_existing(good, base, keys).withColumn("motivo", F.lit("no_encontrado"))
    return patched, checked.where(F.col("motivo").isNotNull()).unionByName(missing)


def validate_task_patch(managers: DataFrame, episodes: DataFrame, **kw):
    """A ``validate`` for :func:`apply_patch_nonnull`: supplied managers and episodes
    must exist and supplied enum values be known; fields that aren't supplied pass."""
    def check(patch: DataFrame) -> DataFrame:
        names = {"manager_col": "gestor", "episode_col": "paciente_episodio"} | {k: v for k, v in kw.items() if k in ("manager_col", "episode_col")}
        full = patch
        for c in [*names.values(), "tipo", "prioridad", "status"]:
            if c not in full.columns:
                full = full.withColumn(c, F.lit(None).cast("string"))
        checked = validate_tasks(full, managers, episodes, given_only=True, **kw)
        return checked.select(*patch.columns, "motivo")
    return check


def delete_keys(base: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Drop rows whose key is listed; also return keys that were not found."""
    kept = keyed.exclude_existing(base, deletes.select(*keys), keys)
    not_found = keyed.exclude_existing(deletes.select(*keys), base, keys)
    return kept, not_found


def validate_tasks(tasks: DataFrame, managers: DataFrame, episodes: DataFrame,
                   manager_col: str = "gestor", episode_col: str = "paciente_episodio",
                   manager_key: str = "name", episode_key: str = "episodio",
                   enum_checks: Sequence[tuple[str, Sequence, str]] | None = None,
                   given_only: bool = False) -> DataFrame:
    """First failing reason per task, in fixed order
    manager -> episode -> enums; ``motivo`` is NULL for accepted rows. With
    ``given_only`` a NULL field isn't checked (patches)."""
    if enum_checks is None:
        enum_checks = [("tipo", TASK_TYPES, "tipo_invalido"),
                       ("prioridad", TASK_PRIORITIES, "prioridad_invalida"),
                       ("status", TASK_STATUSES, "status_invalido")]
    m = managers.select(F.col(manager_key).alias(manager_col))
    e = episodes.select(F.col(episode_key).alias(episode_col))
    flagged = keyed.existing_flag(tasks, m, [manager_col], "_has_manager")
    flagged = keyed.existing_flag(flagged, e, [episode_col], "_has_episode")
    asked = lambda c: F.col(c).isNotNull() if given_only else F.lit(True)
    reason = F.when(asked(manager_col) & ~F.col("_has_manager"), F.lit("gestora_inexistente")) \
              .when(asked(episode_col) & ~F.col("_has_episode"), F.lit("paciente_inexistente"))
    for col, allowed, label in enum_checks:
        reason = reason.when(asked(col) & ~_in(F.col(col), allowed), F.lit(label))
    return flagged.withColumn("motivo", reason).drop("_has_manager", "_has_episode")


def insert_tasks(tasks: DataFrame, managers: DataFrame, episodes: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (defaults and audit stamps added) and rejected rows."""
    if "status" in tasks.columns:
        tasks = tasks.withColumn("status", F.coalesce(F.col("status"), F.lit(TASK_DEFAULT_STATUS)))
    checked = validate_tasks(tasks, managers, episodes, **kw)
    now = F.current_timestamp()
    accepted = (checked.where(F.col("motivo").isNull()).drop("motivo")
                .withColumn("created_at", now).withColumn("updated_at", now))
    return accepted, checked.where(F.col("motivo").isNotNull())


def add_managers(stored: DataFrame | None, new: DataFrame, name_col: str = "name") -> DataFrame:
    """Trimmed, non-empty, unique names not yet stored."""
    cand = (new.select(F.trim(F.col(name_col)).alias(name_col))
               .where(F.col(name_col).isNotNull() & (F.col(name_col) != "")))
    cand = cand.distinct()
    return cand if stored is None else keyed.exclude_existing(cand, stored, [name_col])


STAY_ALIAS_PAIRS = [("prob_sobre_estadia", "probabilidad_sobre_estadia"), ("grd_code", "codigo_grd")]
STAY_ML_FIELDS = ["riesgo_social", "riesgo_clinico", "riesgo_administrativo"]


def insert_stays(batch: DataFrame, stored: DataFrame | None, keys: Sequence[str] = ("episodio", "marca_temporal"),
                 order_cols: Sequence | None = None, stamp: bool = True) -> tuple[DataFrame, DataFrame]:
    """Insert stay records whose key is absent.

    Both key fields are mandatory (``falta_clave``); alias pairs are filled
    from each other and both written (P14); absent ML fields default to NULL
    (P7); audit stamps are added (P9); the first row of a key in the batch
    wins and keys already stored are rejected (``duplicado``: W2 + J4).
    """
    keys = list(keys)
    df = batch
    for a, b in STAY_ALIAS_PAIRS:
        if a not in df.columns:
            df = df.withColumn(a, F.lit(None).cast("string"))
        if b not in df.columns:
            df = df.withColumn(b, F.lit(None).cast("string"))
        df = df.withColumn("_a", F.coalesce(F.col(a), F.col(b))).withColumn(b, F.coalesce(F.col(b), F.col(a))) \
               .withColumn(a, F.col("_a")).drop("_a")
    for c in STAY_ML_FIELDS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    has_keys = F.lit(True)
    for k in keys:
        has_keys = has_keys & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    missing = df.where(~has_keys).withColumn("motivo", F.lit("falta_clave"))
    valid = df.where(has_keys)
    # equal rows are counted first (map-side), so every row ends up accepted or rejected
    # and a key that many rows share is small before it is joined
    columns = valid.columns
    grouped = valid.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    row = F.struct(*(order_cols or ()), *[c for c in columns if c not in (order_cols or ())])
    first = grouped.groupBy(*keys).agg(F.min(row).alias("_first"))
    if stored is not None:
        first = keyed.existing_flag(first, stored, keys, "_stored")
    else:
        first = first.withColumn("_stored", F.lit(False))
    ranked = grouped.join(first, keys).withColumn("_wins", row.eqNullSafe(F.col("_first")) & ~F.col("_stored"))
    accepted = ranked.where("_wins").select(*columns)
    again = F.explode(F.sequence(F.lit(1), F.col("_n") - F.col("_wins").cast("int")))
    rejected_dup = ranked.where(F.col("_n") > F.col("_wins").cast("int")).withColumn("_again", again).select(*columns)
    rejected = missing.unionByName(rejected_dup.withColumn("motivo", F.lit("duplicado")), allowMissingColumns=True)
    if stamp:
        now = F.current_timestamp()
        accepted = accepted.withColumn("created_at", now).withColumn("updated_at", now)
    return accepted, rejected


def address_records(df: DataFrame, episode: str, record: str) -> DataFrame:
    """one stay record by episode plus either its record id (64-hex
    SHA-256 of the key) or its timestamp text."""
    from ..functions.scalars import parse_datetime, row_id
    by_id = row_id("episodio", "marca_temporal") == F.lit(record)
    is_id = len(record) == 64 and all(ch in "0123456789abcdef" for ch in record.lower())
    cond = by_id if is_id else (F.col("marca_temporal") == parse_datetime(F.lit(record), True))
    return df.where((F.col("episodio") == F.lit(episode)) & cond)
