"""Training and scoring end to end (M1, M2, M8-M13, T5) on a clinical table
derived from orders x customer and a survey table aggregated from
lineitem. Model fitting has no SQL twin: rows-only check."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import training as TR
from ..session import read_table


def clinical_and_survey(spark, sf, hold=lambda t: t):
    """GRD-like rows (one per order) and Score-like rows (one per order with lines).
    ``hold`` gets the two tables that several steps read (the lines of an order, the GRD-like rows)."""
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    li = read_table(spark, sf, "lineitem")
    lines = hold(li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.max("l_linenumber").alias("max_line"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("open_line")))
    grd = (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(lines.select("l_orderkey", "n_lines"), o.o_orderkey == lines.l_orderkey, "left")
             .select(F.col("o_orderkey").cast("string").alias("episodio_cmbd"),
                     F.col("o_orderdate").alias("fecha_ingreso_completa"),
                     (F.lit(2.0) + F.col("o_orderkey") % 5).alias("estancia_norma_grd"),
                     F.col("n_lines").cast("double").alias("estancia_del_episodio"),
                     (F.lit(20) + F.col("o_custkey") % 70).alias("edad_en_anos"),
                     F.when(F.col("o_custkey") % 2 == 0, "Hombre").otherwise("Mujer").alias("sexo_desc_"),
                     F.col("o_orderpriority").alias("servicio_ingreso_descripcion_"),
                     F.col("c_mktsegment").alias("prevision_desc_"),
                     (F.col("o_custkey") % 50).alias("ir_grd_codigo_")))
    score = lines.select(
        F.col("l_orderkey").cast("string").alias("episodio"),
        F.col("qty").cast("int").alias("total"),
        (F.col("max_line") % 4).alias("salud_mental"),
        F.when(F.col("returned") == 1, "si").otherwise("no").alias("gestion"),
        F.when(F.col("open_line") == 1, "soporte_financiero").otherwise("coordinacion_familiar")
         .alias("categorizacion_de_gestion"))
    return hold(grd), score


def train_score(spark, sf):
    grd, score = clinical_and_survey(spark, sf, lambda t: t.persist(StorageLevel.MEMORY_AND_DISK))
    ds = FE.make_dataset(grd, score)
    res = TR.train_and_score(ds, with_baseline=False)   # output: calibrated boosted scores
    return res["test_scores"].select("episodio", "excede_norma", F.round("p", 6).alias("p"))


QUERIES = {"train_score": train_score}
ORACLE: dict = {}
