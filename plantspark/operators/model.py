"""Plant power models on Spark ML: features, training, scoring, intervals, metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import partial
from itertools import product

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.functions.timefx import epoch_micros
from plantspark.operators.features import add_time_features, available_features, check_alignment, feature_hash
from plantspark.operators.quality import complete_cases, require_samples
from plantspark.operators.sensors import STANDARD_CATEGORIES
from plantspark.plans.ranks import refined_quantiles
from plantspark.plans.stored import stored

TIME_FEATURES = ["hour", "month", "day_of_week", "is_weekend"]

# ---------------------------------------------------------------- fixed values
#: Rows a kind of model needs before it is worth fitting.
MIN_SAMPLES = {"random_forest": 100, "xgboost": 500, "lightgbm": 1000}
#: Rows of a task while a model is fitted: Spark ML holds each as objects and reads them again for every level of a tree.
FIT_ROWS = 1_000_000
#: Fewer rows are not worth a task of their own.
MIN_FIT_ROWS = 50_000

DEFAULT_FEATURES = [
    "CH_0_RT", "CH_1_RT", "CH_2_RT", "CH_3_RT",
    "CHP_01_VFD_OUT", "CHP_02_VFD_OUT", "CHP_03_VFD_OUT", "CHP_04_VFD_OUT", "CHP_05_VFD_OUT",
    "CH_0_SWT", "CH_0_RWT",
    "CWP_01_VFD_OUT", "CWP_02_VFD_OUT", "CWP_03_VFD_OUT", "CWP_04_VFD_OUT", "CWP_05_VFD_OUT",
    "CW_SYS_SWT", "CW_SYS_RWT",
    "CT_01_VFD_OUT", "CT_02_VFD_OUT", "CT_03_VFD_OUT", "CT_04_VFD_OUT", "CT_05_VFD_OUT",
    "CT_SYS_OAT", "CT_SYS_OAH", "CT_SYS_WBT",
]


@dataclass(frozen=True)
class ModelConfig:
    features: Sequence[str] = tuple(DEFAULT_FEATURES)
    target: str = "CH_SYS_TOTAL_KW"
    ts: str = "timestamp"
    use_time_features: bool = True
    kind: str = "gbt"
    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    seed: int = 42
    impute: str | None = None
    scale: bool = False
    #: Columns that name a row; whether it is a test row follows from them alone.
    row_keys: Sequence[str] = ()


def config_from_mapping(mapping: DataFrame, **options) -> ModelConfig:
    """A configuration whose features are the mapped sensors that are no target, by category, then name, and whose target is the mapped one.

    ``mapping`` is a site's table of ``sensor, category, is_target`` (see ``sensors.mapping_frame``); ``options`` are further
    fields of the configuration and win over the mapping. Sensors in several categories count once, custom categories come last.
    """
    rows = mapping.select("sensor", "category", F.coalesce("is_target", F.lit(False)).alias("is_target")).distinct().collect()
    place = {c: i for i, c in enumerate(STANDARD_CATEGORIES)}
    targets = sorted(r.sensor for r in rows if r.is_target)
    if len(targets) > 1 and "target" not in options:
        raise ValueError(f"the mapping names several targets: {targets}")
    ranked = sorted((place.get(r.category, len(place)), r.category, r.sensor) for r in rows if not r.is_target)
    features = tuple(dict.fromkeys(s for _, _, s in ranked if s not in targets))
    return ModelConfig(**{"features": features} | ({"target": targets[0]} if targets else {}) | options)


def prepare(df: DataFrame, cfg: ModelConfig) -> tuple[DataFrame, list[str]]:
    """Features (text cast to numbers, time features appended) and the label, plus the feature order."""
    time_cols: list[str] = []
    if cfg.use_time_features and cfg.ts in df.columns:
        df, time_cols = add_time_features(df, cfg.ts), TIME_FEATURES
    names = available_features(df.columns, [c for c in cfg.features if c != cfg.target]) + list(time_cols)
    if not names:
        raise ValueError("no configured feature exists in the table")
    text = [c for c in names if df.schema[c].dataType.typeName() == "string"]
    out = df.withColumns({c: F.col(c).try_cast("double") for c in text}) if text else df
    if cfg.target in df.columns:
        out = out.withColumn("label", F.col(cfg.target).try_cast("double"))
    return out, names


def _estimator(cfg: ModelConfig):
    common = dict(featuresCol="features", labelCol="label", predictionCol="prediction", maxDepth=cfg.depth, seed=cfg.seed)
    if cfg.kind == "gbt":
        return GBTRegressor(maxIter=cfg.trees, stepSize=cfg.rate, **common)
    if cfg.kind == "random_forest":
        return RandomForestRegressor(numTrees=cfg.trees, **common)
    raise ValueError(f"unknown model kind {cfg.kind}")


def _stages(cfg: ModelConfig, names: Sequence[str]):
    stages, inputs = [], list(names)
    if cfg.impute in ("mean", "median"):
        inputs = [f"{c}_filled" for c in names]
        stages.append(Imputer(strategy=cfg.impute, inputCols=list(names), outputCols=inputs))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_features" if cfg.scale else "features"))
    if cfg.scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    return [*stages, _estimator(cfg)]


@contextmanager
def _vectors(rows: DataFrame, first: Sequence, names: Sequence[str], n_rows: int) -> Iterator[tuple[PipelineModel, DataFrame]]:
    """The fitted stages before the estimator, and ``features, label`` of about ``n_rows`` complete ``rows``.

    Split, features and vectors are computed once and kept on the executors' disks, in tasks of at most about ``FIT_ROWS`` rows (as many
    for each core), as an estimator reads its raw input several times. Rows of a task are put in order by a hash, so that the
    same rows give the same model however the shuffle hands them over.
    """
    shaped = Pipeline(stages=list(first)).fit(rows)
    vectors = shaped.transform(rows.withColumn("_order", F.xxhash64(*names, "label"))).select("features", "label", "_order")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores * -(-n_rows // (cores * FIT_ROWS)), -(-n_rows // MIN_FIT_ROWS)))
    spread = vectors.repartition(parts).sortWithinPartitions("_order").select("features", "label").persist(StorageLevel.DISK_ONLY)
    try:
        yield shaped, spread
    finally:
        spread.unpersist()


@dataclass
class PowerModel:
    """A fitted model with the configuration and feature order it needs for scoring."""

    model: PipelineModel
    config: ModelConfig
    features: list[str]
    metrics: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; rows with a null feature are left out unless imputed."""
        ready, names = prepare(df, self.config)
        check_alignment(self.features, names)
        if not self.config.impute:
            ready = complete_cases(ready, names)
        return self.model.transform(ready)

    def importance(self) -> list[tuple[str, float]]:
        """Features by falling importance; the weights add up to one."""
        weights = self.model.stages[-1].featureImportances.toArray()
        return sorted(zip(self.features, map(float, weights)), key=lambda x: (-x[1], x[0]))

    def importance_frame(self, spark: SparkSession, top: int | None = None) -> DataFrame:
        return spark.createDataFrame(self.importance()[:top], "feature string, importance double")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = {
            "config": asdict(self.config) | {"features": list(self.config.features)},
            "features": self.features,
            "feature_hash": feature_hash(self.features),
            "metrics": self.metrics,
        }
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PowerModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        check_alignment(meta["features"], meta["features"], meta["feature_hash"])
        return PowerModel(
            PipelineModel.load(f"{path}/model"), ModelConfig(**meta["config"]), meta["features"], meta["metrics"]
        )


def is_test(keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> Column:
    """Whether a row is for testing: the first seven hex digits of md5 of ``seed|key|...`` below the share of their range."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    limit = int(test_share * 16**7)
    # Seven lower-case digits compare as text as they do as numbers; only the full range needs an eighth.
    return F.substring(F.md5(text), 1, 7) < F.lit(f"{max(0, limit):07x}" if limit < 16**7 else "g")


def hash_split(df: DataFrame, keys: Sequence[str] = (), test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of ``keys`` (default: all columns), however the rows lie and however often they are read."""
    plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    test = is_test(keys or plain, test_share, seed)
    return df.where(~test), df.where(test)


def time_split(df: DataFrame, ts: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Earlier rows to train, later rows to test; rows without a time are in neither. See :func:`split_moment`."""
    cut = F.lit(split_moment(df, ts, test_share)).cast("bigint")
    us = epoch_micros(ts)
    return df.where(us <= cut), df.where(us > cut)


def split_moment(df: DataFrame, ts: str, test_share: float = 0.2) -> int | None:
    """Microseconds of the last training time: the exact quantile, found by refinement (see ``plans.ranks``). None without times."""
    row = refined_quantiles(df.select(epoch_micros(ts).alias("_us")), [], "_us", {"cut": 1 - test_share}, lower=True).first()
    return None if row is None else int(row["cut"])


def train(
    df: DataFrame, cfg: ModelConfig | None = None, test_share: float = 0.2, split: str = "random", min_samples: int = 10
) -> PowerModel:
    """Fit on the training part and measure on the rest; all work runs on the executors."""
    cfg = cfg or ModelConfig()
    return train_kinds(df, cfg, [cfg.kind], test_share, split, min_samples)[cfg.kind]


def train_kinds(
    df: DataFrame, cfg: ModelConfig, kinds: Sequence[str], test_share: float = 0.2, split: str = "random", min_samples: int = 10
) -> dict[str, PowerModel]:
    """Models of several kinds, each as :func:`train` gives it, fitted on vectors that are computed once for all of them."""
    ready, names = prepare(df, cfg)
    if "label" not in ready.columns:
        raise ValueError(f"target {cfg.target} is not in the table")
    n_rows = require_samples(ready, [] if cfg.impute else names, "label", min_samples)
    rows = complete_cases(ready, ["label"] if cfg.impute else [*names, "label"])
    fit_on, check_on = time_split(rows, cfg.ts, test_share) if split == "time" else hash_split(rows, cfg.row_keys, test_share, cfg.seed)
    found = {}
    with _vectors(fit_on, _stages(cfg, names)[:-1], names, n_rows) as (shaped, vectors):
        for kind in kinds:
            own = replace(cfg, kind=kind)
            found[kind] = PowerModel(PipelineModel(stages=[*shaped.stages, _estimator(own).fit(vectors)]), own, names)
    for fitted in found.values():
        m = regression_metrics(fitted.model.transform(check_on), "label", "prediction").first()
        fitted.metrics = {k: v for k, v in m.asDict().items()}
    return found


def regression_metrics(
    df: DataFrame, label: str | Column, prediction: str | Column, keys: Sequence[str] = (), eps: float = 1e-6
) -> DataFrame:
    """MAPE (rows with a non-zero label), RMSE, MAE and R2, overall or per key, in one aggregate."""
    y = F.col(label) if isinstance(label, str) else label
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    err = y - p
    sse = F.sum(err * err)
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(F.abs(y) > eps, F.abs(F.try_divide(err, y)))) * 100.0).alias("mape"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - F.try_divide(sse, spread)).alias("r2"),
    )


def predict_interval(power_model: PowerModel, df: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Mean, std and the interpolated lower and upper quantile over the trees of a forest."""
    forest = power_model.model.stages[-1]
    if not isinstance(forest, RandomForestRegressionModel):
        raise TypeError("intervals need a random forest: the trees of other models are no predictions of their own")
    ready, names = prepare(df, power_model.config)
    check_alignment(power_model.features, names)
    if not power_model.config.impute:
        ready = complete_cases(ready, names)
    out = PipelineModel(stages=power_model.model.stages[:-1]).transform(ready)
    for i, tree in enumerate(forest.trees):
        out = tree.setPredictionCol(f"_t{i}").transform(out)
    cols = [f"_t{i}" for i in range(len(forest.trees))]
    out = out.withColumn("_p", F.array_sort(F.array(*cols))).drop(*cols)
    n = len(cols)

    def quantile(q: float) -> Column:
        pos = (n - 1) * q
        lo = int(pos)
        hi = min(lo + 1, n - 1)
        return F.col("_p")[lo] + (F.col("_p")[hi] - F.col("_p")[lo]) * F.lit(pos - lo)

    zero = F.lit(0.0)
    mean = F.aggregate("_p", zero, lambda a, x: a + x) / n
    var = F.aggregate("_p", zero, lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n
    tail = (1 - confidence) / 2
    return (
        out.withColumn("mean", mean)
        .withColumn("std", F.sqrt(var))
        .withColumn("lower", quantile(tail))
        .withColumn("upper", quantile(1 - tail))
        .drop("_p", "features", "raw_features")
    )


def eligible_models(n_samples: Column) -> Column:
    """Kinds of model worth fitting for a row count, as an array."""
    return F.array_compact(F.array(*[F.when(n_samples >= need, F.lit(kind)) for kind, need in MIN_SAMPLES.items()]))


def side_by_side(spark: SparkSession, jobs: Mapping[str, Callable[[], object]], parallel: int = 4, pool: str = "fits") -> dict[str, tuple[object, str | None]]:
    """Result and error text of every job, run by ``parallel`` threads; one that fails stops no other.

    Each thread takes over the caller's local properties and gives its Spark jobs a group of their own, named after the
    job, in the scheduler pool ``pool``: with ``spark.scheduler.mode=FAIR`` small fits are not held up by large ones.
    """
    sc = spark.sparkContext

    def run(name: str) -> tuple[object, str | None]:
        sc.setLocalProperty("spark.scheduler.pool", pool)
        sc.setJobGroup(f"{pool}: {name}", name)
        try:
            return jobs[name](), None
        except Exception as e:  # one bad job must not stop the batch
            return None, str(e)

    # Wrapped once per job: each wrapper holds a copy of the caller's properties, which threads must not share.
    wrapped = {name: inheritable_thread_target(spark)(partial(run, name)) for name in jobs}
    with ThreadPoolExecutor(max(1, parallel)) as threads:
        futures = {name: threads.submit(f) for name, f in wrapped.items()}
        return {name: f.result() for name, f in futures.items()}


def train_targets(
    df: DataFrame, targets: Sequence[str], cfg: ModelConfig | None = None, parallel: int = 4
) -> tuple[dict[str, PowerModel], DataFrame]:
    """One model per target, as :func:`train` gives it, fitted side by side; a failing target is logged and skipped.

    The columns in use are written to the shared folder first, so the input is read once for all targets. Without
    ``row_keys`` all columns are in use, as the split then follows from all of them.
    """
    cfg = cfg or ModelConfig()
    wanted = {*cfg.features, *targets, cfg.ts, *cfg.row_keys}
    kept = [c for c in df.columns if c in wanted] if cfg.row_keys else df.columns
    table = stored(df.select(*kept), "training")
    done = side_by_side(df.sparkSession, {t: lambda t=t: train(table, replace(cfg, target=t)) for t in targets}, parallel)
    models = {t: m for t, (m, error) in done.items() if error is None}
    log = [(t, "ok", None, m.metrics.get("mape")) if error is None else (t, "failed", error, None) for t, (m, error) in done.items()]
    frame = df.sparkSession.createDataFrame(log, "target string, status string, message string, mape double")
    return models, frame


def search(
    df: DataFrame, cfg: ModelConfig, grid: Mapping[str, Sequence], train_share: float = 0.8, parallel: int = 4
) -> tuple[PowerModel, list[dict]]:
    """Fit every combination of ``grid`` (parameter names of the estimator), keep the best RMSE, fit it on all rows.

    Rows are split by the hash of their keys, so the same rows validate every combination however they lie; they are read
    once and written to the shared folder. Combinations are fitted side by side; one that fails is listed with its error.
    """
    ready, names = prepare(df, cfg)
    rows = stored(complete_cases(ready, ["label"] if cfg.impute else [*names, "label"]), "search")
    fit_on, check_on = hash_split(rows, cfg.row_keys, 1 - train_share, cfg.seed)
    combos = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]

    n_rows = rows.count()
    *first, estimator = _stages(cfg, names)

    def fit(combo: Mapping, shaped: PipelineModel, vectors: DataFrame) -> PipelineModel:
        own = estimator.copy({getattr(estimator, k): v for k, v in combo.items()})
        return PipelineModel(stages=[*shaped.stages, own.fit(vectors)])

    def validate(combo: Mapping) -> float:
        scored = fit(combo, *common).transform(check_on)
        return float(regression_metrics(scored, "label", "prediction").first()["rmse"])

    with _vectors(fit_on, first, names, n_rows) as common:
        done = side_by_side(df.sparkSession, {str(combo): lambda c=combo: validate(c) for combo in combos}, parallel)
    results = [{**c, "rmse": done[str(c)][0]} | ({"error": done[str(c)][1]} if done[str(c)][1] else {}) for c in combos]
    good = [r for r in results if r["rmse"] is not None]
    if not good:
        raise ValueError(f"no combination could be fitted, e.g. {results[0].get('error') if results else 'none was given'}")
    best = min(good, key=lambda r: r["rmse"])
    with _vectors(rows, first, names, n_rows) as whole:
        fitted = fit({k: v for k, v in best.items() if k != "rmse"}, *whole)
    return PowerModel(fitted, cfg, names, {"rmse": best["rmse"]}), results
