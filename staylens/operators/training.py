"""Model fitting and evaluation.

Preprocessing mirrors the source pipeline: median imputation of numbers
(M4), mode imputation of categories (M5), one-hot with rare levels pooled for
the linear model (M6) or ordinal codes with unknown -1 for the boosted model
(M7), balanced class weights times sample weights (M8). The linear model is
MLlib's, the boosted one that of :mod:`boosting`; it is calibrated with a
one-feature logistic regression on its margin over a hash-sampled slice (T5,
M11). Fits are distributed; no row cap is needed.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting as B
from . import features as FE
from . import levels as LV
from . import metrics as M
from . import reports as R
from . import sampling as SA
from ..functions.scalars import nan_to_null
from .joins import with_scalars
from .selection import exact_quantiles
from .scoring import CATEGORICAL_FEATURES, NUMERIC_FEATURES

SEED = 42
ROUNDS = 100
MIN_FREQUENCY = 0.01


def _linear_stages(num: Sequence[str], cat: Sequence[str]):
    imp = Imputer(strategy="median", inputCols=list(num), outputCols=[c + "_i" for c in num])
    # at most 1 / MIN_FREQUENCY levels a column are left by the preparation
    idx = StringIndexer(inputCols=list(cat), outputCols=[c + "_x" for c in cat],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[c + "_x" for c in cat], outputCols=[c + "_v" for c in cat],
                        handleInvalid="keep", dropLast=False)
    vec = VectorAssembler(inputCols=[c + "_i" for c in num] + [c + "_v" for c in cat],
                          outputCol="features", handleInvalid="keep")
    return [imp, idx, ohe, vec]


class Preparation:
    """M5, with M6 for the linear or M4 and M7 for the boosted model, learned on the
    training rows and applied to any batch. Modes, medians and the at most
    1 / ``MIN_FREQUENCY`` frequent levels are plain values, level dictionaries are tables; all are
    saved with the model."""

    def __init__(self, kind: str, modes: dict, frequent: dict, medians: dict | None = None, levels: dict | None = None):
        self.kind, self.modes, self.frequent, self.medians, self.levels = kind, modes, frequent, medians or {}, levels or {}

    @classmethod
    def learn(cls, train: DataFrame, kind: str, num: Sequence[str] = NUMERIC_FEATURES,
              cat: Sequence[str] = CATEGORICAL_FEATURES) -> "Preparation":
        modes, frequent = {}, {}
        for c in cat:
            counts = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(c).alias("v")))["v"]).first()
            modes[c] = best[0] if best else None
        if kind != "logistic":
            medians = {c: m for c, (m,) in zip(num, exact_quantiles(train, [(c, [0.5]) for c in num]))}
            return cls(kind, modes, {}, medians, {c: LV.ordinal_levels(train, c) for c in cat})
        filled = cls(kind, modes, {})._fill(train)
        n = filled.count()
        for c in cat:
            levels = filled.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n * MIN_FREQUENCY)
            frequent[c] = sorted(r[0] for r in levels.select(c).collect() if r[0] is not None)
        return cls(kind, modes, frequent)

    def _fill(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in self.modes.items() if m is not None})

    def inputs(self) -> list[str]:
        """The boosted model's feature columns."""
        return [c + "_i" for c in self.medians] + [c + "_o" for c in self.levels]

    def apply(self, df: DataFrame) -> DataFrame:
        out = self._fill(df)
        if self.frequent:
            return out.withColumns({c: F.when(F.col(c).isin(levels), F.col(c)).otherwise(F.lit(FE.INFREQUENT))
                                    for c, levels in self.frequent.items()})
        out = out.withColumns({c + "_i": F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(m).cast("double")) for c, m in self.medians.items()})
        for c, levels in self.levels.items():
            out = LV.ordinal_code(out, c, levels, c + "_o")
        return out

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "modes": self.modes, "frequent": self.frequent, "medians": self.medians})

    @classmethod
    def from_json(cls, text: str, levels: dict | None = None) -> "Preparation":
        return cls(**json.loads(text), levels=levels)


def fit(train: DataFrame, kind: str = "gbt", weight_col: str = "w",
        num: Sequence[str] = NUMERIC_FEATURES, cat: Sequence[str] = CATEGORICAL_FEATURES, rounds: int = ROUNDS,
        id_col: str = "episodio"):
    """Fit the linear model (L2 of strength one, unscaled) or the boosted
    one (up to ``rounds`` trees) with sample weights. Returns (preparation, model)."""
    # The preparation and the iterative fits read their input many times: materialise it once.
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    prepared = None
    try:
        prep = Preparation.learn(train, kind, num, cat)
        prepared = prep.apply(train).persist(StorageLevel.MEMORY_AND_DISK)
        if kind != "logistic":
            return prep, B.fit(prepared, prep.inputs(), "excede_norma", weight_col, B.Settings(rounds=rounds),
                               id_col if id_col in train.columns else None)
        total = prepared.agg(F.sum(weight_col)).first()[0] or 1.0
        clf = LogisticRegression(labelCol="excede_norma", weightCol=weight_col, maxIter=500, tol=1e-6,
                                 regParam=1.0 / float(total), elasticNetParam=0.0, standardization=False)
        return prep, Pipeline(stages=_linear_stages(num, cat) + [clf]).fit(prepared)
    finally:
        for held in (prepared, train):
            if held is not None:
                held.unpersist()


def margin(fitted, df: DataFrame) -> DataFrame:
    """Positive-class probability (M13) and raw margin of a fitted model."""
    prep, model = fitted
    prepared = prep.apply(df)
    if isinstance(model, B.Boosted):
        scored = prepared.withColumn("margin", model.margin()).withColumn("p_raw", 1 / (1 + F.exp(-F.col("margin"))))
        return scored.drop(*prep.inputs())
    scored = model.transform(prepared)
    return (scored.withColumn("p_raw", vector_to_array("probability")[1])
                  .withColumn("margin", vector_to_array("rawPrediction")[1])
                  .drop("features", "rawPrediction", "probability", "prediction"))


def fit_sigmoid(cal_scored: DataFrame, weight_col: str = "w"):
    """Platt scaling = logistic regression on the single margin feature."""
    vec = VectorAssembler(inputCols=["margin"], outputCol="m_vec")
    lr = LogisticRegression(labelCol="excede_norma", featuresCol="m_vec", weightCol=weight_col,
                            regParam=0.0, maxIter=100, predictionCol="cal_pred",
                            probabilityCol="cal_prob", rawPredictionCol="cal_raw")
    return Pipeline(stages=[vec, lr]).fit(cal_scored)


def apply_sigmoid(cal_model, scored: DataFrame, out: str = "p") -> DataFrame:
    res = cal_model.transform(scored)
    return (res.withColumn(out, vector_to_array("cal_prob")[1])
               .drop("m_vec", "cal_pred", "cal_prob", "cal_raw"))


def fit_isotonic_cv(train: DataFrame, kind: str = "gbt", n_folds: int = 3, id_col: str = "episodio",
                    weight_col: str = "w", rounds: int = ROUNDS) -> list:
    """Isotonic calibration with cross-validation, as an ensemble.

    Fold ids come from a hash of the id (no driver-side split). For every
    fold the model is fitted on the other folds and an isotonic map is fitted
    on the held-out fold's probabilities; prediction averages the calibrated
    probabilities of the fold members (see :func:`apply_isotonic_cv`).
    """
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(n_folds))
    data = train.withColumn("_fold", fold).persist(StorageLevel.MEMORY_AND_DISK)
    members = []
    for f in range(n_folds):
        fitted = fit(data.where(F.col("_fold") != f).drop("_fold"), kind, weight_col, rounds=rounds)
        held = margin(fitted, data.where(F.col("_fold") == f).drop("_fold"))
        iso = IsotonicRegression(labelCol="excede_norma", featuresCol="p_raw", weightCol=weight_col,
                                 predictionCol="p_iso").fit(held)
        members.append((fitted, iso))
    data.unpersist()
    return members


def apply_isotonic_cv(members: list, df: DataFrame, id_col: str = "episodio", out: str = "p") -> DataFrame:
    """Average of the fold members' calibrated probabilities (one column per
    member, computed row-wise: no join, no shuffle)."""
    scored = df
    names = []
    for i, (fitted, iso) in enumerate(members):
        m = iso.transform(margin(fitted, scored).drop("margin")).withColumnRenamed("p_iso", f"_p{i}").drop("p_raw")
        scored = m.select(*df.columns, *names, f"_p{i}")
        names.append(f"_p{i}")
    avg = sum((F.col(n) for n in names), F.lit(0.0)) / F.lit(float(len(names)))
    return scored.withColumn(out, avg).drop(*names)


def evaluate(scored: DataFrame, y: str = "excede_norma", p: str = "p") -> DataFrame:
    """M14-M16 in one row (each metric a small DataFrame plan)."""
    return with_scalars(M.ranking_metrics(scored, y, p), M.brier(scored, y, p))


def train_and_score(dataset: DataFrame, id_col: str = "episodio", with_baseline: bool = True,
                    rounds: int = ROUNDS) -> dict:
    """Full training run: split (M2), weights (M8), linear baseline, boosted
    model on the core slice, sigmoid calibration on a hash sample (T5, M11),
    scores of the test side. Returns a dict of DataFrames / models."""
    data = dataset.persist(StorageLevel.MEMORY_AND_DISK)
    train, test = FE.time_split(data, "fecha")
    test = test.withColumn("w", F.col("peso"))
    cal, core = SA.split_sample(train, id_col, hold=lambda sample: sample.persist(StorageLevel.MEMORY_AND_DISK))
    core = core.persist(StorageLevel.MEMORY_AND_DISK)      # counted by class, then weighted
    # each model is balanced on the rows it is fitted on
    balanced = lambda df: FE.class_weights(df, "excede_norma", "peso", "w")
    boosted = fit(balanced(core), "gbt", rounds=rounds)
    core.unpersist()
    # The calibration slice holds at most CAL_MAX rows (T5), so one partition
    # is enough and saves per-iteration task overhead in the L-BFGS loop.
    cal_scored = margin(boosted, cal.withColumn("w", F.col("peso"))).coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
    # the calibrator sees the plain sample weights; class balancing is a
    # property of the classifiers only
    cal_model = fit_sigmoid(cal_scored, weight_col="peso")
    test_scored = apply_sigmoid(cal_model, margin(boosted, test))
    out = {
        "test_scores": test_scored.select(id_col, "excede_norma", "p"),
        "deciles": R.decile_lift(test_scored, "excede_norma", "p"),
        "models": {"boosted": boosted, "calibrator": cal_model},
    }
    if with_baseline:
        baseline = fit(balanced(train), "logistic")
        base_scored = margin(baseline, test).withColumn("p", F.col("p_raw"))
        out["baseline_scores"] = base_scored.select(id_col, "excede_norma", "p")
        out["models"]["baseline"] = baseline
    return out


def save_models(models: dict, base_path: str) -> None:
    """Persist fitted models. ``models``: name -> (preparation, model) as
    :func:`fit` returns it, or a bare pipeline model (a calibrator)."""
    for name, m in models.items():
        path = f"{base_path.rstrip('/')}/{name}"
        prep, model = m if isinstance(m, tuple) else (None, m)
        if isinstance(model, B.Boosted):
            _write_text(model.to_json(), f"{path}/boosted")
            for c, levels in prep.levels.items():
                levels.write.mode("overwrite").parquet(f"{path}/levels/{c}")
        else:
            model.write().overwrite().save(f"{path}/model")
        _write_text(prep.to_json() if prep else "", f"{path}/preparation")


def _write_text(text: str, path: str) -> None:
    _spark().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(base_path: str, name: str):
    """One saved model, as it was passed to :func:`save_models`; None if absent."""
    from .keyed import read_if_exists
    path = f"{base_path.rstrip('/')}/{name}"
    text = read_if_exists(_spark(), f"{path}/preparation", "text")
    if text is None:
        return None
    value = text.first()
    boosted = read_if_exists(_spark(), f"{path}/boosted", "text")
    if boosted is not None:
        columns = json.loads(value[0])["modes"]
        levels = {c: _spark().read.parquet(f"{path}/levels/{c}") for c in columns}
        return Preparation.from_json(value[0], levels), B.Boosted.from_json(boosted.first()[0])
    model = PipelineModel.load(f"{path}/model")
    return (Preparation.from_json(value[0]), model) if value and value[0] else model


def load_preferred(base_path: str, order: Sequence[str] = ("boosted", "baseline")):
    """(name, fitted, calibrator) of the first saved model in preference order;
    the calibrator, if one was saved, belongs to the boosted model."""
    for name in order:
        fitted = load_model(base_path, name)
        if fitted is not None:
            return name, fitted, load_model(base_path, "calibrator") if name == "boosted" else None
    raise FileNotFoundError(f"no model under {base_path}")


def _spark() -> SparkSession:
    return SparkSession.getActiveSession()


def score_tables(fitted, grd: DataFrame, score: DataFrame, calibrator=None,
                 template: Sequence[str] | None = None, output: str = "id",
                 run_stamp: str | None = None) -> DataFrame:
    """Score a GRD table and a survey table without outcomes.

    Headers are standardised (P2) and aligned to the template by one trailing
    '_' (P8); the survey key is discovered among the candidates (P4); the
    tables are joined (J1) and turned into the nine features exactly as for
    training; the result carries the episode id, probability and tier (X16)
    (``output="all"``: every feature too; ``run_stamp``: a
    ``fecha_prediccion`` column for time-stamped run outputs, S9).
    """
    from ..functions import headers as H
    from ..functions.scalars import tier_vector
    grd = grd.toDF(*[H.standardize(c) for c in grd.columns])
    score = score.toDF(*[H.standardize(c) for c in score.columns])
    if template:
        ren = H.align_trailing_underscore(grd.columns, template)
        grd = grd.select(*[F.col(c).alias(ren.get(c, c)) for c in grd.columns])
    ds = FE.make_dataset(grd, score, fecha=None, stay=None)
    scored = margin(fitted, ds)
    if calibrator is not None:
        scored = apply_sigmoid(calibrator, scored)
    else:
        scored = scored.withColumn("p", F.col("p_raw"))
    keep = ["episodio"] + ([c for c in ds.columns if c not in ("episodio", "excede_norma", "peso", "fecha")]
                           if output == "all" else [])
    out = scored.select(*keep, "p", tier_vector(F.col("p")).alias("riesgo_categoria"))
    return out.withColumn("fecha_prediccion", F.lit(run_stamp)) if run_stamp else out
