"""Direct multi-horizon forecasting with gradient-boosted trees: one model per horizon."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.functions.numeric import units_from_log
from restock.operators.frames import SERIES
from restock.operators.relational import columns_of_type, row_mean
from restock.operators.reshape import wide_to_long
from restock.session import cut_lineage

HORIZONS = 7
TARGET = "log_units_sold"
KEY = [*SERIES, "c_date"]
# below every feature value, so a tree can branch on "missing"
MISSING = -1000.0
# split candidates of a numeric feature; a categorical feature always gets one for each of its values
NUMERIC_BINS = 64
STOP_TOLERANCE = 0.01

# fixed values: search ranges, under Spark's parameter names
SEARCH_SPACE = {
    "stepSize": ("uniform", 1e-5, 0.2),
    "minInstancesPerNode": ("step", 5, 50, 5),
    "subsamplingRate": ("uniform", 0.5, 1.0),
}
FIXED_PARAMS = {"maxIter": 100, "maxDepth": 7, "featureSubsetStrategy": "0.6"}


def target_columns(horizons: int = HORIZONS, target: str = TARGET) -> list[str]:
    return [f"h{h}_{target}" for h in range(1, horizons + 1)]


def typed_parameters(df: DataFrame, column: str) -> DataFrame:
    """Text parameters as typed columns: digits only → whole number, with a dot → float, else text.

    What does not fit its type (digits beyond 64 bits) stays text.
    """
    x = F.col(column)
    whole = x.rlike("^[0-9]+$")
    real = x.contains(".") & ~whole
    return df.withColumns(
        {
            "as_int": F.when(whole, x.try_cast("bigint")),
            "as_float": F.when(real, x.try_cast("double")),
            "as_text": F.when(
                ~(whole & x.try_cast("bigint").isNotNull()) & ~(real & x.try_cast("double").isNotNull()), x
            ),
        }
    )


def gbt(**params) -> GBTRegressor:
    return GBTRegressor(seed=42, **params)


def categorical_columns(df: DataFrame) -> list[str]:
    """Integer and string columns; the model treats them as categories, however many values occur."""
    return columns_of_type(df, "integer", "string")


def most_categories(df: DataFrame, features: Sequence[str]) -> int:
    """The largest number of values of a categorical column, with room for missing and unseen ones."""
    names = [c for c in categorical_columns(df) if c in features]
    if not names:
        return 0
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in names]).first()
    return max(counts) + 3


def _prepared(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Numeric features as doubles with the missing mark, strings with an empty mark."""
    types = dict(df.dtypes)
    columns: dict[str, Column] = {}
    for name in names:
        if types[name] == "string":
            columns[name] = F.coalesce(F.col(name), F.lit(""))
        else:
            columns[name] = F.coalesce(F.col(name).cast("double"), F.lit(MISSING))
    return df.withColumns(columns)


def feature_stages(df: DataFrame, features: Sequence[str], categories: int) -> Pipeline:
    """Strings to indices, then one vector in which every integer and string column is categorical.

    ``categories``: see :func:`most_categories`.
    """
    category = [c for c in categorical_columns(df) if c in features]
    texts = [c for c in category if dict(df.dtypes)[c] == "string"]
    coded = [f"{c}_code" if c in texts else c for c in category]
    numeric = [c for c in features if c not in category]
    stages = []
    if texts:
        stages.append(
            StringIndexer(inputCols=texts, outputCols=[f"{c}_code" for c in texts], handleInvalid="keep")
        )
    return Pipeline(
        stages=[
            *stages,
            VectorAssembler(inputCols=coded, outputCol="categories"),
            VectorIndexer(
                inputCol="categories", outputCol="coded", maxCategories=max(2, categories), handleInvalid="keep"
            ),
            VectorAssembler(inputCols=["coded", *numeric], outputCol="features"),
        ]
    )


@dataclass
class MultiHorizonForecaster:
    """One regressor per target column on a shared feature vector.

    ``make_model`` builds the regressor from parameters, so another learner can be plugged in.
    ``parallelism`` models are fitted at once, as many as the session has cores (at most one for each
    horizon) unless given.
    """

    horizons: int = HORIZONS
    params: Mapping = field(default_factory=dict)
    make_model: Callable[..., Estimator] = gbt
    parallelism: int | None = None
    features: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    encoder: PipelineModel | None = None
    models: list = field(default_factory=list)
    categories: int = 0

    def encode(
        self, train: DataFrame, valid: DataFrame | None = None, targets: Sequence[str] | None = None
    ) -> DataFrame:
        """Fit the encoder and stage the vectors of all rows: features, targets, is_valid.

        The vectors can be shared by all horizons and by all trials of a search.
        """
        self.targets = list(targets or target_columns(self.horizons))
        if len(self.targets) != self.horizons:
            raise ValueError(f"expected {self.horizons} target columns, got {len(self.targets)}")
        self.features = [c for c in train.columns if c not in (*self.targets, "c_date", "is_valid")]
        marked = train.withColumn("is_valid", F.lit(False))
        if valid is not None:
            marked = marked.unionByName(valid.withColumn("is_valid", F.lit(True)), allowMissingColumns=True)
        # categories of the validation rows are known as well: trees refuse values that the encoder has not seen
        self.categories = most_categories(marked, self.features)
        marked = _prepared(marked, self.features)
        self.encoder = feature_stages(train, self.features, self.categories).fit(marked)
        return cut_lineage(self.encoder.transform(marked).select("features", "is_valid", *self.targets))

    def fit(
        self, train: DataFrame, targets: Sequence[str] | None = None, valid: DataFrame | None = None
    ) -> MultiHorizonForecaster:
        """Fit on rows that hold features and targets; rows without a horizon's target are left out
        of that horizon only. With ``valid`` rows a model stops adding trees once they no longer help there."""
        return self.fit_encoded(self.encode(train, valid, targets), valid is not None)

    def fit_encoded(self, matrix: DataFrame, stop_early: bool = False) -> MultiHorizonForecaster:
        """Fit the models on vectors of :meth:`encode`."""
        early = {"validationIndicatorCol": "is_valid", "validationTol": STOP_TOLERANCE} if stop_early else {}
        bins = max(NUMERIC_BINS, self.categories)

        def fit_one(target: str):
            estimator = self.make_model(
                featuresCol="features", labelCol=target, predictionCol=f"pred_{target}", maxBins=bins, **early, **self.params
            )
            return estimator.fit(matrix.filter(F.col(target).isNotNull()).select("features", "is_valid", target))

        session = matrix.sparkSession
        cores = session.sparkContext.defaultParallelism
        with ThreadPoolExecutor(self.parallelism or max(1, min(self.horizons, cores))) as pool:
            jobs = [pool.submit(inheritable_thread_target(session)(fit_one), t) for t in self.targets]
            self.models = [job.result() for job in jobs]
        return self

    def scored(self, matrix: DataFrame) -> DataFrame:
        """Vectors of :meth:`encode` plus one ``pred_<target>`` column per horizon."""
        self._check_fitted()
        return reduce(lambda part, model: model.transform(part), self.models, matrix)

    def _check_fitted(self) -> None:
        if not self.models:
            raise RuntimeError("fit the forecaster before using it")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` plus one ``pred_<target>`` column per horizon."""
        self._check_fitted()
        kept = F.struct(*df.columns).alias("_row")
        vectors = self.encoder.transform(
            _prepared(df.select("*", kept), self.features)
        ).select("_row", "features")
        return self.scored(vectors).select("_row.*", *[f"pred_{t}" for t in self.targets])

    def feature_importances(self, spark: SparkSession) -> DataFrame:
        """One row per feature with its importance for every horizon."""
        self._check_fitted()
        names = _vector_names(self.encoder)
        columns = [m.featureImportances.toArray() for m in self.models]
        rows = [(n, *[float(c[i]) for c in columns]) for i, n in enumerate(names)]
        schema = ", ".join(["feature_name STRING", *[f"{t} DOUBLE" for t in self.targets]])
        return spark.createDataFrame(rows, schema)

    def save(self, path: str) -> None:
        self._check_fitted()
        self.encoder.write().overwrite().save(f"{path}/encoder")
        for target, model in zip(self.targets, self.models, strict=True):
            model.write().overwrite().save(f"{path}/{target}")
        spark = SparkSession.active()
        meta = json.dumps({"targets": self.targets, "features": self.features, "params": dict(self.params)})
        spark.createDataFrame([(meta,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MultiHorizonForecaster:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(
            horizons=len(meta["targets"]),
            params=meta["params"],
            features=meta["features"],
            targets=meta["targets"],
            encoder=PipelineModel.load(f"{path}/encoder"),
            models=[GBTRegressionModel.load(f"{path}/{t}") for t in meta["targets"]],
        )


def _vector_names(encoder: PipelineModel) -> list[str]:
    """Names of the vector slots, in order."""
    assemblers = [s for s in encoder.stages if isinstance(s, VectorAssembler)]
    category, rest = assemblers[0].getInputCols(), assemblers[1].getInputCols()[1:]
    return [c.removesuffix("_code") for c in category] + list(rest)


def ranked_importances(importances: DataFrame) -> DataFrame:
    """Features by their mean importance over the horizons, largest first."""
    horizons = [c for c in importances.columns if c.startswith("h")]
    mean = row_mean(horizons).alias("importance")
    return importances.select("feature_name", mean).orderBy(F.desc("importance"), "feature_name")


# --- evaluation --------------------------------------------------------------------------------


def evaluate(scored: DataFrame, targets: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """R² and mean squared error of every horizon, and the summed error, in two aggregates.

    ``scored`` holds each target and its ``pred_`` column; rows missing either are left out of that
    horizon. The total sum of squares comes from the variance, so no second pass over means.
    """
    def both(t: str) -> Column:
        return F.col(t).isNotNull() & F.col(f"pred_{t}").isNotNull()

    aggregates = []
    for t in targets:
        y = F.when(both(t), F.col(t))
        error = F.when(both(t), F.pow(F.col(t) - F.col(f"pred_{t}"), 2))
        spread = F.var_pop(y) * F.count(y)
        aggregates.append((F.lit(1.0) - F.try_divide(F.sum(error), spread)).alias(f"{t}_r2"))
        aggregates.append(F.avg(error).alias(f"{t}_l2"))
    result = scored.groupBy(*by).agg(*aggregates)
    total = lambda kind: reduce(lambda a, b: a + b, [F.col(f"{t}_{kind}") for t in targets])
    return result.withColumns({"sum_l2": total("l2"), "sum_r2": total("r2")})


def actual_vs_predicted(scored: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Long table (series, day, horizon, actual, predicted) in whole units."""
    parts = [
        F.struct(
            F.lit(h).alias("horizon"),
            units_from_log(F.col(t)).alias("actual"),
            units_from_log(F.col(f"pred_{t}")).alias("predicted"),
        )
        for h, t in enumerate(targets, 1)
    ]
    return scored.select(*KEY, F.inline(F.array(*parts)))


# --- search and registry -----------------------------------------------------------------------


def draw_params(n_trials: int, seed: int = 42, space: Mapping = SEARCH_SPACE) -> list[dict]:
    """Seeded random draws from the search space."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n_trials):
        params = {}
        for name, (kind, low, high, *step) in space.items():
            if kind == "uniform":
                params[name] = rng.uniform(low, high)
            else:
                params[name] = rng.randrange(low, high + 1, step[0])
        draws.append(params)
    return draws


def search(
    train: DataFrame,
    valid: DataFrame,
    n_trials: int = 30,
    fixed: Mapping = FIXED_PARAMS,
    seed: int = 42,
    horizons: int = HORIZONS,
) -> DataFrame:
    """Trials table: number, parameters (JSON), R² per horizon on train and valid, summed valid
    error ``loss`` and summed valid R² ``valid_score``.

    Encoder and vectors are made once for all trials; a trial stops adding trees early.
    """
    targets = target_columns(horizons)
    spark = train.sparkSession
    shared = MultiHorizonForecaster(horizons)
    matrix = shared.encode(train, valid, targets)
    rows = []
    for number, draw in enumerate(draw_params(n_trials, seed), 1):
        params = {**fixed, **draw}
        forecaster = replace(shared, params=params, models=[]).fit_encoded(matrix, stop_early=True)
        parts = evaluate(forecaster.scored(matrix), targets, ["is_valid"]).collect()
        scores = {"valid" if r["is_valid"] else "train": r for r in parts}
        rows.append(
            (
                number,
                json.dumps(params, sort_keys=True),
                *[scores[p][f"{t}_r2"] for p in ("train", "valid") for t in targets],
                scores["valid"]["sum_l2"],
                scores["valid"]["sum_r2"],
            )
        )
    metrics = [f"{p}_h{h}_score" for p in ("train", "valid") for h in range(1, horizons + 1)]
    schema = ["trial INT", "params STRING", *[f"{m} DOUBLE" for m in metrics], "loss DOUBLE", "valid_score DOUBLE"]
    return spark.createDataFrame(rows, ", ".join(schema))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the highest valid score; the earlier one wins a tie."""
    return trials.orderBy(F.desc("valid_score"), "trial").limit(1)


def best_params(trials: DataFrame) -> dict:
    row = best_trial(trials).first()
    return json.loads(row["params"]) if row else {}


def _model_root(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/models/{name}"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # the meta file is written last, so a half-written version does not count
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*/meta/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getParent().getName()[1:]) for s in (done or []))


def refit_and_register(
    train: DataFrame, valid: DataFrame, params: Mapping, root: str, name: str, horizons: int = HORIZONS
) -> int:
    """Fit on train and valid rows together and store the model as the next version of ``name``."""
    everything = train.unionByName(valid)
    forecaster = MultiHorizonForecaster(horizons, dict(params)).fit(everything, target_columns(horizons))
    folder = _model_root(root, name)
    version = max(_versions(train.sparkSession, folder), default=0) + 1
    forecaster.save(f"{folder}/v{version}")
    return version


def load_latest(spark: SparkSession, root: str, name: str) -> MultiHorizonForecaster:
    folder = _model_root(root, name)
    versions = _versions(spark, folder)
    if not versions:
        raise ValueError(f"no stored model {name}")
    return MultiHorizonForecaster.load(spark, f"{folder}/v{versions[-1]}")


def residual_table(scored: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(horizon, residual) of a model's predictions, rows without a target left out."""
    parts = [
        F.struct(F.lit(h).alias("horizon"), (F.col(t) - F.col(f"pred_{t}")).alias("residual"))
        for h, t in enumerate(targets, 1)
    ]
    return scored.select(F.inline(F.array(*parts))).filter(F.col("residual").isNotNull())


# --- scoring -----------------------------------------------------------------------------------


def score_day(forecaster: MultiHorizonForecaster, inputs: DataFrame, day: str) -> DataFrame:
    """Whole-unit predictions (dp_p_id, dp_s_id, dp_date, dp_mean) for the days after ``day``."""
    here = F.lit(day).cast("date")
    scored = forecaster.predict(inputs.filter(F.col("c_date") == here))
    names = [f"pred_{t}" for t in forecaster.targets]
    # demand is never negative
    whole = scored.withColumns({n: F.greatest(F.lit(0), units_from_log(F.col(n))) for n in names})
    days = F.array(*[F.date_add(here, h) for h in range(1, len(names) + 1)])
    return wide_to_long(
        whole.select(F.col("product_id").alias("dp_p_id"), F.col("store_id").alias("dp_s_id"), *names),
        ["dp_p_id", "dp_s_id"],
        names,
        days,
        "dp_date",
        "dp_mean",
    )
