"""Model operators: standardisation, PCA, K-Means sweep and gap statistic,
classifiers (logistic, random forest, RBF-SVM over Nystroem landmarks),
cross-validation and the comparison table.

Fits run over distributed DataFrames, by MLlib or by one pass for many
models at once; evaluation reuses the DataFrame evaluation operators.  The
only driver-side values are model parameters (p x p PCA matrix, centroids,
landmarks, weights, Hessians) and samples of stated size.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import r_round
from . import cluster as CL
from . import evaluation as EV
from . import manylinear as ML
from . import manymeans as MM
from .windows import running_totals

# The PCA feature set (14) and the pre-trip classifier features (19).
PCA_FEATURES = ["actual_departure_delay_min", "actual_arrival_delay_min", "total_delay", "delay_change",
                "temperature_C", "humidity_percent", "wind_speed_kmh", "precipitation_mm",
                "event_attendance_est", "traffic_congestion_index", "weather_severity_index",
                "event_impact_score", "trip_duration_scheduled", "weekday"]
CLASS_FEATURES = ["temperature_C", "humidity_percent", "wind_speed_kmh", "precipitation_mm",
                  "weather_condition_enc", "event_type_enc", "event_attendance_est", "traffic_congestion_index",
                  "hour", "weekday", "is_weekend", "month", "weather_severity_index", "event_impact_score",
                  "trip_duration_scheduled", "feels_like_impact", "congestion_weather_combo",
                  "transport_type_enc", "season_enc"]


# Trees of a forest, starts of K-Means, costs of the SVM grid.
RF_TREES = 100
KMEANS_STARTS = MM.STARTS
SVM_COSTS = (0.25, 0.5, 1.0, 2.0, 4.0)


def standardize(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    cc = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    params = F.broadcast(cc.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)],
                                *[F.stddev_samp(c).alias(f"__s{i}") for i, c in enumerate(cols)]))
    out = cc.crossJoin(params)
    # a constant column has no scale: NULL
    return out.select(key, *[F.try_divide(F.col(c) - F.col(f"__m{i}"), F.col(f"__s{i}")).alias(c) for i, c in enumerate(cols)])


@dataclass
class PCAResult:
    variance: DataFrame
    loadings: DataFrame
    scores: DataFrame
    score_cols: list
    eigenvalues: list


def pca(df: DataFrame, cols: list[str], key: str, extra: tuple = ("delayed",)) -> PCAResult:
    spark = df.sparkSession
    cc = df.select(key, *extra, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    # constant columns have no part in a correlation
    spread = cc.agg(*[F.max(c) > F.min(c) for c in cols]).first()
    cols = [c for c, varies in zip(cols, spread) if varies]
    va = VectorAssembler(inputCols=cols, outputCol="__raw")
    sc = StandardScaler(inputCol="__raw", outputCol="__z", withMean=True, withStd=True)
    p = len(cols)
    pc = PCA(k=p, inputCol="__z", outputCol="__pc")
    model = Pipeline(stages=[va, sc, pc]).fit(cc)
    pm = model.stages[-1]
    ev = [float(v) * p for v in pm.explainedVariance.toArray()]
    tot = sum(ev)
    pct = [round(100 * v / tot, 2) for v in ev]
    cum, rows = 0.0, []
    for i, (v, q) in enumerate(zip(ev, pct)):
        cum += q
        rows.append((f"PC{i + 1}", round(v, 4), q, round(cum, 2)))
    variance = spark.createDataFrame(rows, "Component string, Eigenvalue double, Variance_Pct double, Cumulative_Pct double")
    k = max(1, sum(1 for v in ev if v > 1))
    mat = pm.pc.toArray()
    load_rows = []
    signs = []
    for j in range(k):
        colv = [mat[i][j] for i in range(p)]
        big = max(range(p), key=lambda i: abs(colv[i]))
        signs.append(1.0 if colv[big] >= 0 else -1.0)
    for i, c in enumerate(cols):
        load_rows.append((c, *[round(signs[j] * float(mat[i][j]), 4) for j in range(k)]))
    loadings = spark.createDataFrame(load_rows, "Variable string, " + ", ".join(f"PC{j + 1} double" for j in range(k)))
    arr = vector_to_array("__pc")
    score_cols = [f"PC{j + 1}" for j in range(k)]
    scores = model.transform(cc).select(key, *extra, *[(arr[j] * signs[j]).alias(f"PC{j + 1}") for j in range(k)])
    return PCAResult(variance, loadings, scores, score_cols, ev)


def pca_select(variance: DataFrame) -> DataFrame:
    return variance.agg(F.count_if(F.col("Eigenvalue") > 1).alias("kaiser_k"),
                        F.min(F.when(F.col("Cumulative_Pct") >= 85, F.regexp_extract("Component", r"(\d+)", 1).cast("int"))).alias("first_85"),
                        F.min(F.when(F.col("Cumulative_Pct") >= 90, F.regexp_extract("Component", r"(\d+)", 1).cast("int"))).alias("first_90"))


def kmeans_models(scores: DataFrame, cols: list[str], ks, seed: int = 42, starts: int = KMEANS_STARTS) -> dict[int, MM.Model]:
    """K -> the model of least within-cluster SS over ``starts`` starts, all Ks and starts fitted together."""
    data = MM.vectors(scores, cols).persist()
    models = MM.best_models(data, ks, starts, seed)
    data.unpersist()
    return models


def kmeans_assign(scores: DataFrame, cols: list[str], model: MM.Model) -> DataFrame:
    """scores with ``cluster``, the number (from 1) of the nearest centre."""
    v = F.array(*[F.col(c).cast("double") for c in cols])
    return scores.withColumn("cluster", MM.nearest_centre(v, model.centres))


def kmeans_sweep(scores: DataFrame, cols: list[str], models: dict[int, MM.Model]) -> DataFrame:
    """K, within-cluster SS (K=1: total SS), squared-Euclidean silhouette."""
    rows = []
    for k, m in sorted(models.items()):
        sil = None if k == 1 else CL.silhouette_sq(kmeans_assign(scores, cols, m), "cluster", cols).first()["silhouette"]
        rows.append((k, round(m.wss, 4), sil))
    return scores.sparkSession.createDataFrame(rows, "K int, wss double, silhouette double")


def choose_k(elbow: DataFrame, lo: int = 2, hi: int = 5) -> DataFrame:
    best = elbow.where(F.col("silhouette").isNotNull()).agg(
        F.min_by("K", F.struct((-F.col("silhouette")).alias("s"), F.col("K").alias("k"))).alias("best_k"))
    return best.select("best_k", F.least(F.greatest(F.col("best_k"), F.lit(lo)), F.lit(hi)).alias("chosen_k"))


def gap_statistic(scores: DataFrame, cols: list[str], models: dict[int, MM.Model], n_ref: int = 10, seed: int = 42,
                  starts: int = 10) -> DataFrame:
    """Gap(k) = mean_b log W*_kb - log W_k against sets drawn uniformly from the data's bounding box."""
    data = MM.vectors(scores, cols).persist()
    rows = MM.gap_statistic(data, models, n_ref, starts, seed)
    data.unpersist()
    return scores.sparkSession.createDataFrame(
        [(k, None if g is None else round(g, 6), None if e is None else round(e, 6)) for k, g, e in rows], "K int, gap double, se double")


# ---------------------------------------------------------------- classification

def classification_frame(df: DataFrame) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in CLASS_FEATURES]
    return df.select("trip_id", F.col("delayed").cast("double").alias("label"), *cols).dropna()


def split_rows(data: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): four fifths of each class, by a hash of the key."""
    split = EV.stratified_split(data.withColumn("__h", F.xxhash64("trip_id", F.lit(seed))), "label", ["__h", "trip_id"])
    return tuple(split.where(F.col("split") == part).drop("split", "__h") for part in ("train", "test"))


def imbalanced(rows: DataFrame) -> bool:
    """Whether the rare class has less than 35 % of the rows."""
    least = EV.class_shares(rows, "label").agg(F.min("pct")).first()[0]
    return least is not None and least < 35


def _scale_of(rows: DataFrame, cols: list[str], weight=None) -> tuple[list[float], list[float]]:
    """Means and deviations of the rows' inputs (of those with a positive weight)."""
    kept = rows if weight is None else rows.where(weight > 0)
    one = kept.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [one[f"m{i}"] or 0.0 for i in range(len(cols))], [one[f"s{i}"] or 0.0 for i in range(len(cols))]


def random_copies(rows: DataFrame, folds: int, upsample: bool, seed: int = 42, key: str = "trip_id") -> DataFrame:
    """rows (key, label, fold, ...) with ``w``: how often a row counts in the training part of each fold.

    0 in the fold that holds it out, else 1; with ``upsample`` the rows of a fold's rare class are drawn anew, with
    replacement, until both classes count exactly the same: draw j of fold f takes the rank hash(f, j) mod m, and ranks are
    running numbers in the order of the keys' hashes, so the draw doesn't depend on the partitioning."""
    one = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.when(f == F.col("fold"), 0.0).otherwise(1.0))
    if not upsample:
        return rows.withColumn("w", one)
    counts = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    labels = sorted({label for _, label in counts})
    ranked = running_totals(rows.withColumn("__h", F.xxhash64(key, F.lit(seed))), ["__h", key], [], partition=["label", "fold"], rn="rank_")
    # running_totals drops its own helper columns, those that begin with two underscores
    spark, draws = rows.sparkSession, None
    for f in range(folds):
        total = {c: sum(counts.get((g, c), 0) for g in range(folds) if g != f) for c in labels}
        rare, most = min(total, key=lambda c: (total[c], c)), max(total.values())
        if not total[rare] or total[rare] == most:
            continue
        rank = F.pmod(F.xxhash64("id", F.lit(f), F.lit(seed + 1)), F.lit(total[rare]))
        fold, first, before = F.lit(None).cast("int"), F.lit(0).cast("long"), 0
        for g in range(folds):
            if g != f and counts.get((g, rare)):
                fold, first = F.when(F.col("at") >= before, g).otherwise(fold), F.when(F.col("at") >= before, F.lit(before)).otherwise(first)
                before += counts[g, rare]
        part = (spark.range(most - total[rare]).select(rank.alias("at"))
                .select(F.lit(rare).alias("label"), fold.alias("fold"), (F.col("at") - first + 1).alias("rank_"), F.lit(f).alias("f")))
        draws = part if draws is None else draws.unionAll(part)
    if draws is None:
        return rows.withColumn("w", one)
    more = (draws.groupBy("label", "fold", "rank_", "f").count().groupBy("label", "fold", "rank_")
            .agg(F.map_from_entries(F.collect_list(F.struct("f", "count"))).alias("more")))
    w = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.when(f == F.col("fold"), 0.0).otherwise(
        1.0 + F.coalesce(F.try_element_at("more", f), F.lit(0)).cast("double")))
    return ranked.join(more, ["label", "fold", "rank_"], "left").withColumn("w", w).drop("rank_", "more")


def in_folds(rows: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """rows with their fold (a hash of the key) and ``w``, the rows' counts in the training part of each fold."""
    laid = rows.withColumn("fold", (F.abs(F.xxhash64("trip_id", F.lit(seed))) % folds).cast("int"))
    return random_copies(laid, folds, imbalanced(rows), seed)


def _linear_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.array(*CLASS_FEATURES).alias("x"), F.col("label").alias("y"), "w", F.col("trip_id").alias("key"))


MODELS = ("Logistic Regression", "Random Forest", "SVM (Radial)")
# Fixed value: numbers of inputs tried at a split of a forest (the least, the middle, all).
FOREST_INPUTS = ("2", "10", "19")


def _linear_specs(rows: DataFrame, places: int, wanted, costs=SVM_COSTS) -> tuple[list, list]:
    """Specifications and feature maps of the linear models: inputs scaled, and landmarks drawn, by each training part."""
    specs, maps = [], []
    kernels = "SVM (Radial)" in wanted
    sample, w = ML.sample_of(_linear_rows(rows)) if kernels else (None, None)
    for f in range(places):
        base = ML.scaled_map(*_scale_of(rows, CLASS_FEATURES, F.get("w", F.lit(f))))
        if "Logistic Regression" in wanted:
            specs.append(ML.Spec("Logistic Regression", "none", f, "logistic", map=len(maps)))
            maps.append(base)
        if kernels:
            specs += [ML.Spec("SVM (Radial)", f"C={c}", f, "svm", c, len(maps)) for c in costs]
            maps.append(ML.nystroem(base, sample[w[:, f] > 0]))
    return specs, maps


def _forest(setting: str, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=RF_TREES, maxDepth=6,
                                  featureSubsetStrategy=setting.split("=")[1], seed=seed)


def _held_out_measures(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auc (mid-ranks for ties), sens and spec (score above 0 means 1) of (keys, y, score).

    Counts of equal scores, then running totals within the keys: no model's scores go through one task."""
    s = scored.groupBy(*keys, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    cum = running_totals(s, ["score"], ["neg"], partition=keys)
    u = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return cum.groupBy(*keys).agg(
        F.try_divide(u, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        F.try_divide(F.sum(F.when(F.col("score") > 0, F.col("pos")).otherwise(0)).cast("double"), F.sum("pos")).alias("sens"),
        F.try_divide(F.sum(F.when(F.col("score") <= 0, F.col("neg")).otherwise(0)).cast("double"), F.sum("neg")).alias("spec"))


def cross_validate(rows: DataFrame, folds: int, only: str | None = None, setting: str | None = None, seed: int = 42,
                   at_once: int = 4) -> DataFrame:
    """(Model, params, auc_mean, auc_sd, sens_mean, spec_mean) over the held-out parts of ``folds`` folds, for each setting.

    Within a fold the rare class is drawn up with replacement if it has less than 35 % of all rows, inputs are scaled with the
    fold's training part, and the held-out part stays as it is.  Logistic regressions and SVMs of all folds and settings are
    fitted together; forests ``at_once`` at a time."""
    wanted = [m for m in MODELS if only in (None, m)]
    laid = in_folds(rows, folds, seed).persist()
    found = None
    if set(wanted) - {"Random Forest"}:
        specs, maps = _linear_specs(laid, folds, wanted)
        specs = [s for s in specs if setting in (None, s.params)]
        data = _linear_rows(laid)
        betas = ML.fit(data, specs, maps)
        names = rows.sparkSession.createDataFrame([(i, s.name, s.params, s.fold) for i, s in enumerate(specs)],
                                                  "no int, Model string, params string, fold int")
        found = ML.scores(data, specs, maps, betas).withColumnRenamed("model", "no").join(F.broadcast(names), "no").select("Model", "params", "fold", "y", "score")
        found = _held_out_measures(found, ["Model", "params", "fold"])
    if "Random Forest" in wanted:
        settings = [s for s in (f"mtry={m}" for m in FOREST_INPUTS) if setting in (None, s)]
        va = VectorAssembler(inputCols=CLASS_FEATURES, outputCol="features")
        trees = va.transform(laid).select("features", "label", "fold", "w").persist()

        def one(job):
            f, text = job
            part = trees.withColumn("weight", F.get("w", F.lit(f)))
            model = _forest(text, seed).fit(part.where("weight > 0"))
            held = model.transform(part.where(F.col("fold") == f))
            return held.select(F.lit("Random Forest").alias("Model"), F.lit(text).alias("params"), F.lit(f).alias("fold"),
                               F.col("label").alias("y"), (vector_to_array("probability")[1] - 0.5).alias("score"))
        with ThreadPoolExecutor(at_once) as pool:
            parts = list(pool.map(one, [(f, s) for f in range(folds) for s in settings]))
        forest = _held_out_measures(reduce(DataFrame.unionAll, parts), ["Model", "params", "fold"])
        found = forest if found is None else found.unionByName(forest)
    out = found.groupBy("Model", "params").agg(
        r_round(F.avg("auc"), 6).alias("auc_mean"), r_round(F.stddev_samp("auc"), 6).alias("auc_sd"),
        r_round(F.avg("sens"), 6).alias("sens_mean"), r_round(F.avg("spec"), 6).alias("spec_mean")).persist()
    out.count()
    laid.unpersist()
    return out


def best_setting(cv: DataFrame, model: str) -> str:
    """The setting of the largest mean AUC, the first of equal ones."""
    return cv.where(F.col("Model") == model).orderBy(F.desc("auc_mean"), "params").first()["params"]


def _predictions(scored: DataFrame, prob) -> DataFrame:
    return scored.select("trip_id", F.col("label").cast("int").alias("delayed"), F.col("prediction").cast("int").alias("prediction"),
                         r_round(prob, 6).alias("prob_yes"))


@dataclass
class KernelSVM:
    """Feature map, weights and the sigmoid that turns margins into probabilities; ``save`` writes them as one row."""
    map: ML.FeatureMap
    beta: list
    slope: float
    offset: float

    def save(self, spark, path: str) -> None:
        m = self.map
        row = ([float(v) for v in m.mean], [float(v) for v in m.scale], m.landmarks.tolist(), m.half.tolist(), float(m.gamma),
               [float(v) for v in self.beta], self.slope, self.offset)
        spark.createDataFrame([row], "mean array<double>, scale array<double>, landmarks array<array<double>>, half array<array<double>>, "
                              "gamma double, beta array<double>, slope double, offset double").write.mode("overwrite").parquet(path)


def fit_model(name: str, data: DataFrame, setting: str | None = None, seed: int = 42) -> dict:
    """{"model", "predictions"[, "importance"]}: a model with its setting, trained on four fifths of each class (the rare one
    replicated to the other's size if it has less than 35 %) and applied to the rest."""
    spark = data.sparkSession
    train, test = split_rows(data, seed)
    if imbalanced(train):
        train = EV.upsample_exact(train, "label", ["trip_id"]).drop("__rep")
    va = VectorAssembler(inputCols=CLASS_FEATURES, outputCol="features")
    if name == "Logistic Regression":
        model = Pipeline(stages=[va, LogisticRegression(featuresCol="features", labelCol="label", regParam=0.0, maxIter=100)]).fit(train)
        return {"model": model, "predictions": _predictions(model.transform(test), vector_to_array("probability")[1])}
    train = train.persist()
    if name == "Random Forest":
        model = Pipeline(stages=[va, _forest(setting or "mtry=10", seed)]).fit(train.withColumn("weight", F.lit(1.0)))
        imp = model.stages[-1].featureImportances.toArray()
        most = max(imp.max(), 1e-300)
        importance = spark.createDataFrame([(c, float(round(float(v) * 100 / float(most), 4))) for c, v in zip(CLASS_FEATURES, imp)],
                                           "feature string, importance double").orderBy(F.desc("importance"))
        out = {"model": model, "predictions": _predictions(model.transform(test), vector_to_array("probability")[1]), "importance": importance}
    else:
        rows = train.withColumn("w", F.array(F.lit(1.0)))
        cost = float((setting or "C=1.0").split("=")[1])
        specs, maps = _linear_specs(rows, 1, ("SVM (Radial)",), (cost,))
        betas = ML.fit(_linear_rows(rows), specs, maps)
        # Platt's sigmoid on the training margins
        margins = ML.scores(_linear_rows(rows), specs, maps, betas, held_out=False).persist()
        platt = LogisticRegression(featuresCol="m", labelCol="y").fit(margins.select("y", array_to_vector(F.array("score")).alias("m")))
        margins.unpersist()
        svm = KernelSVM(maps[0], betas[0], float(platt.coefficients[0]), float(platt.intercept))
        told = test.withColumn("w", F.array(F.lit(0.0)))
        scored = ML.scores(_linear_rows(told), specs, maps, betas).select(
            F.col("key").alias("trip_id"), F.col("y").alias("label"), (F.col("score") > 0).cast("int").alias("prediction"), "score")
        out = {"model": svm, "predictions": _predictions(scored, 1 / (1 + F.exp(-(F.col("score") * svm.slope + svm.offset))))}
    train.unpersist()
    return out


def fit_classifiers(data: DataFrame, settings: dict[str, str] | None = None, seed: int = 42) -> dict:
    """All three models, with the settings given (by name)."""
    return {name: fit_model(name, data, (settings or {}).get(name), seed) for name in MODELS}


def comparison(models: dict) -> DataFrame:
    rows = None
    for i, (name, m) in enumerate(models.items()):
        p = m["predictions"]
        met = EV.metrics_from_confusion(EV.confusion(p, "delayed", "prediction"))
        auc = EV.auc(p, "delayed", "prob_yes")
        r = met.crossJoin(auc).select(F.lit(i).alias("ord"), F.lit(name).alias("Model"), "*")
        rows = r if rows is None else rows.unionByName(r)
    return rows.orderBy("ord").drop("ord")


def best_by_f1(models: dict) -> str:
    """Name of the model with the largest F1 on the test rows."""
    f1 = {name: EV.metrics_from_confusion(EV.confusion(m["predictions"], "delayed", "prediction")).first()["F1_Score"] or 0.0
          for name, m in models.items()}
    return max(f1, key=f1.get)


def save_models(models: dict, path: str) -> dict[str, str]:
    """Write every fitted model below ``path``; name -> place."""
    out = {}
    for name, m in models.items():
        out[name] = f"{path}/{''.join(c if c.isalnum() else '_' for c in name)}"
        if isinstance(m["model"], KernelSVM):
            m["model"].save(m["predictions"].sparkSession, out[name])
        else:
            m["model"].write().overwrite().save(out[name])
    return out


def smote_2d(df: DataFrame, x: str, y: str, label: str, k: int = 5, seed: int = 42, cell: float = 2.0) -> DataFrame:
    """One synthetic row per minority row with a place in the plane: a choice
    among its k nearest other minority points (all of them if there are
    fewer; the point itself if there is none), interpolated with a weight.
    Choice and weight come from a hash of the key, so they are the same
    whatever the partitioning."""
    from .cluster import nearest_points, points
    counts = df.groupBy(label).count().orderBy("count", label).limit(1).collect()
    minority = counts[0][label] if counts else None
    mins = df.where(F.col(label) == F.lit(minority))
    near = nearest_points(points(mins, x, y), k, cell)
    rows = mins.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "trip_id")
    pick = F.pmod(F.xxhash64("trip_id", F.lit(seed)), F.size("near")) + 1
    u = F.pmod(F.xxhash64("trip_id", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40)
    cand = rows.join(near, ["x", "y"]).withColumn("u", u).withColumn(
        "to", F.when(F.size("near") > 0, F.element_at("near", F.when(F.size("near") > 0, pick).otherwise(1).cast("int"))))
    return cand.select("trip_id", (F.col("x") + F.col("u") * (F.coalesce("to.x2", "x") - F.col("x"))).alias(x),
                       (F.col("y") + F.col("u") * (F.coalesce("to.y2", "y") - F.col("y"))).alias(y), F.lit(minority).alias(label))
