"""Seeded GRD / Score generation (G1) and fixed fixture rows.

Each generated row is a pure function of a driving key and a seed: uniform
draws come from md5 of ``key#seed#field`` (so any engine can re-derive
them) compared against cumulative weights. Generation is a projection over
the driving table: no driver loop, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: categories and weights of the synthetic clinical table.
SEXES = ["Hombre", "Mujer"]
ADMISSION_TYPES = ["Programado", "Urgente", "Emergencia"]
ADMISSION_CUTS = [0.6, 0.9]
SERVICES = ["Medicina", "Cirugía", "Cardiología", "Neurología", "Pediatría", "Ginecología",
            "Traumatología", "Urología", "Oftalmología", "Dermatología"]
INSURERS = ["FONASA", "ISAPRE", "Particular"]
INSURER_CUTS = [0.7, 0.95]
DIAGNOSES = ["I25.1", "K80.2", "J44.1", "A09", "I21.9", "G93.1", "M79.3", "N18.6", "H25.9", "L70.9"]
GRD_CODES = [51401, 61203, 174121, 81601, 104132, 41023, 61201, 91501, 121142, 194163]
GRD_TYPES = ["M", "Q"]
GRD_TYPE_CUTS = [0.7]
PROCEDURES = [0, 4651, 9228, 8363, 9223]
PROCEDURE_CUTS = [0.4, 0.6, 0.8, 0.9]
AGE_MIN, AGE_MAX = 18, 85
NORM_MIN, NORM_MAX = 1.0, 10.0


def uniform(key: Column, seed: int, field: str) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5(key#seed#field)."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}#{field}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def weighted_choice(u: Column, values, cuts) -> Column:
    """Pick ``values[i]`` for the first cumulative cut above ``u``."""
    out = None
    for v, c in zip(values, cuts):
        out = F.when(u < F.lit(c), F.lit(v)) if out is None else out.when(u < F.lit(c), F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def uniform_choice(u: Column, values) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u * len(values)) + 1).cast("int"))


def generate_grd(keys: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """G1: one synthetic clinical row per driving key."""
    k = F.col(key_col)
    u = lambda f: uniform(k, seed, f)
    return keys.select(
        F.concat(F.lit("TEST"), k.cast("string")).alias("episodio_cmbd"),
        (F.lit(AGE_MIN) + F.floor(u("edad") * (AGE_MAX - AGE_MIN + 1))).cast("int").alias("edad_en_anos"),
        uniform_choice(u("sexo"), SEXES).alias("sexo_desc_"),
        weighted_choice(u("tipo"), ADMISSION_TYPES, ADMISSION_CUTS).alias("tipo_ingreso_descripcion_"),
        uniform_choice(u("servicio"), SERVICES).alias("servicio_ingreso_descripcion_"),
        weighted_choice(u("prevision"), INSURERS, INSURER_CUTS).alias("prevision_desc_"),
        uniform_choice(u("diag"), DIAGNOSES).alias("diagnostico_principal"),
        (F.floor((F.lit(NORM_MIN) + u("norma") * (NORM_MAX - NORM_MIN)) * 100) / 100.0).alias("estancia_norma_grd"),
        uniform_choice(u("grd"), GRD_CODES).cast("bigint").alias("ir_grd_codigo_"),
        weighted_choice(u("tipo_grd"), GRD_TYPES, GRD_TYPE_CUTS).alias("ir_tipo_grd"),
        weighted_choice(u("proc"), PROCEDURES, PROCEDURE_CUTS).cast("bigint").alias("proced_01_principal_cod_"),
        F.lit(0).alias("dias_estadia"),
    )


def generate_score(keys: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """G1: one synthetic survey row per driving key (sub-scales 0-3, total = sum)."""
    k = F.col(key_col)
    subs = ["habitacional", "socioeconomica", "salud_mental", "redes", "cuidador"]
    cols = {s: F.floor(uniform(k, seed, s) * 4).cast("int") for s in subs}
    total = None
    for c in cols.values():
        total = c if total is None else total + c
    return keys.select(F.concat(F.lit("TEST"), k.cast("string")).alias("episodio"),
                       total.alias("total"), *[c.alias(s) for s, c in cols.items()])


def controlled_cases(spark) -> tuple[DataFrame, DataFrame]:
    """Two low, two medium and two high risk cases (fixture rows)."""
    grd = spark.createDataFrame(
        [("LOW001", 30, "Mujer", "Programado", "Oftalmología", "ISAPRE", 2.0, 61203),
         ("LOW002", 25, "Hombre", "Programado", "Dermatología", "Particular", 1.5, 91501),
         ("MID001", 55, "Mujer", "Urgente", "Medicina", "FONASA", 5.0, 104132),
         ("MID002", 62, "Hombre", "Urgente", "Cirugía", "FONASA", 6.0, 81601),
         ("HIGH001", 82, "Hombre", "Emergencia", "UCI Medicina", "FONASA", 3.0, 41023),
         ("HIGH002", 78, "Mujer", "Emergencia", "UCI Cardiología", "FONASA", 2.5, 51401)],
        "episodio_cmbd string, edad_en_anos int, sexo_desc_ string, tipo_ingreso_descripcion_ string, "
        "servicio_ingreso_descripcion_ string, prevision_desc_ string, estancia_norma_grd double, "
        "ir_grd_codigo_ bigint")
    score = spark.createDataFrame(
        [("LOW001", 2, 0, 0, 0, 1, 1), ("LOW002", 1, 0, 0, 0, 0, 1),
         ("MID001", 7, 1, 2, 1, 2, 1), ("MID002", 8, 2, 2, 2, 1, 1),
         ("HIGH001", 14, 3, 3, 3, 3, 2), ("HIGH002", 13, 3, 2, 3, 3, 2)],
        "episodio string, total int, habitacional int, socioeconomica int, salud_mental int, "
        "redes int, cuidador int")
    return grd, score
