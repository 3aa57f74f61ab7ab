"""Feature scaling, selection, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.operators import scaling, scoring, selecting
from barloom.operators.features import forward_label, temporal_split
from barloom.plans import training as tr
from barloom.session import materialize, scratch_folder
from barloom.workload import fixtures as fx
from barloom.workload.fixtures import query, sql
from barloom.workload.shape import BAR, out
from barloom.workload.windows import WS

FEATURES = ["open", "high", "low", "close", "volume", "move"]
MOVE = "close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1"


def matrix(spark, sf):
    """Hourly bars with one derived feature, a label and a split."""
    from barloom.operators.indicators import momentum

    bars = momentum(fx.bars(spark, sf), (1,)).withColumn("move", F.coalesce("momentum_1", F.lit(0.0)))
    return temporal_split(forward_label(materialize(bars.drop("momentum_1"))))


MATRIX = f"""
    mt AS (SELECT *, coalesce({MOVE}, 0) AS move,
              CAST(coalesce(lead(close) OVER ({WS}) / close - 1 > 0.001, FALSE) AS INTEGER) AS label,
              row_number() OVER ({WS}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars_1h),
    ms AS (SELECT *, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train'
               WHEN i < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'test' ELSE 'valid' END AS split FROM mt),
    lg AS (SELECT symbol, ts, split, label, feature, value FROM ms
           UNPIVOT (value FOR feature IN ({', '.join(FEATURES)})))"""
# UNPIVOT needs one type, which all of these columns share.


def msql(body: str) -> str:
    return sql("bars_1h", f"WITH {MATRIX}{body if body.startswith(',') else ' ' + body}")


@query(
    "column_profile",
    msql(
        """SELECT feature, round(avg(value), 6) + 0 AS mean, round(stddev_pop(value), 6) + 0 AS std,
        round(min(value), 6) + 0 AS min, round(max(value), 6) + 0 AS max, round(quantile_cont(value, 0.5), 6) + 0 AS median,
        round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0 AS iqr FROM lg GROUP BY feature"""
    ),
)
def column_profile(spark, sf):
    done = scaling.column_profile(matrix(spark, sf), FEATURES)
    return out(done, ["feature"], "mean", "std", "min", "max", "median", "iqr")


_SCALE = {
    "minmax": ("min(c)", "max(c) - min(c)"),
    "standard": ("avg(c)", "stddev_pop(c)"),
    "robust": ("quantile_cont(c, 0.5)", "quantile_cont(c, 0.75) - quantile_cont(c, 0.25)"),
}


def scale_ctes(kind: str) -> str:
    center, scale = _SCALE[kind]
    return f""",
    lm AS (SELECT feature, avg(value) - 2 * stddev_pop(value) AS lower, avg(value) + 2 * stddev_pop(value) AS upper
           FROM lg WHERE split = 'train' GROUP BY feature),
    cl AS (SELECT lg.*, greatest(lower, least(upper, value)) AS c, lower, upper FROM lg JOIN lm USING (feature)),
    fp AS (SELECT feature, {center} AS center, coalesce(nullif({scale}, 0), 1) AS scale, any_value(lower) AS lower,
               any_value(upper) AS upper FROM cl WHERE split = 'train' GROUP BY feature)"""


def fitted(spark, sf, kind):
    rows = materialize(matrix(spark, sf))
    return rows, scaling.fit_scaler(rows.where(F.col("split") == "train"), FEATURES, kind, outlier_std=2.0)


def _scaler(kind: str):
    params = ("center", "scale", "lower", "upper")

    @query(
        f"scale_fit_{kind}",
        msql(f"{scale_ctes(kind)} SELECT feature, {', '.join(f'round({p}, 6) + 0 AS {p}' for p in params)} FROM fp"),
    )
    def fit(spark, sf):
        return out(fitted(spark, sf, kind)[1].frame(spark), ["feature"], *params)

    @query(
        f"scale_transform_{kind}",
        msql(
            f"""{scale_ctes(kind)}, tf AS (SELECT symbol, ts, feature, round((c - center) / scale, 6) + 0 AS x FROM cl JOIN fp USING (feature))
            SELECT symbol, ts, {', '.join(f"max(CASE WHEN feature = '{f}' THEN x END) AS {f}" for f in FEATURES)} FROM tf GROUP BY 1, 2"""
        ),
    )
    def transform(spark, sf):
        rows, scaler = fitted(spark, sf, kind)
        return out(scaler.transform(rows), BAR, *FEATURES)


for _kind in scaling.KINDS:
    _scaler(_kind)


@query(
    "scale_inverse",
    msql(
        f"""{scale_ctes('standard')} SELECT symbol, ts, {', '.join(f"round(max(CASE WHEN feature = '{f}' THEN c END), 5) + 0 AS {f}" for f in FEATURES)}
        FROM cl GROUP BY 1, 2"""
    ),
)
def scale_inverse(spark, sf):
    """Back on the original scale; clipped values stay clipped."""
    rows, scaler = fitted(spark, sf, "standard")
    return out(scaler.inverse(scaler.transform(rows)), BAR, *FEATURES, digits=5)


@query(
    "variance_filter",
    msql("SELECT feature, round(var_pop(value), 4) + 0 AS variance FROM lg GROUP BY 1 HAVING var_pop(value) > 1000"),
)
def variance_filter(spark, sf):
    return out(selecting.variance_filter(matrix(spark, sf), FEATURES, 1000), ["feature"], "variance", digits=4)


@query(
    "topk_by_variance",
    msql(
        """SELECT feature, round(var_samp(value), 4) + 0 AS variance_samp FROM lg GROUP BY 1
        ORDER BY var_samp(value) DESC, feature LIMIT 3"""
    ),
)
def topk_by_variance(spark, sf):
    return out(selecting.topk_by_variance(matrix(spark, sf), FEATURES, 3), ["feature"], "variance_samp", digits=4)


AUC_CTES = """,
    rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM lg),
    au AS (SELECT feature, (sum(CASE WHEN label = 1 THEN r END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
               / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)::DOUBLE) AS auc FROM rk GROUP BY 1)"""


@query("feature_auc", msql(f"{AUC_CTES} SELECT feature, round(greatest(auc, 1 - auc), 6) AS score FROM au"))
def feature_auc(spark, sf):
    return out(selecting.feature_auc(matrix(spark, sf), FEATURES), ["feature"], "score")


@query(
    "feature_report",
    msql(
        f"""{AUC_CTES}, vr AS (SELECT feature FROM lg GROUP BY 1 HAVING var_pop(value) > 100)
        SELECT feature, CASE WHEN v.feature IS NOT NULL THEN round(greatest(auc, 1 - auc), 6) END AS score,
               CAST(coalesce(v.feature IS NOT NULL AND greatest(auc, 1 - auc) > 0.6, FALSE) AS INTEGER) AS above_threshold,
               CAST(coalesce(v.feature IS NOT NULL AND greatest(auc, 1 - auc) > 0.6, FALSE) OR feature <> 'move' AS INTEGER) AS selected
        FROM au LEFT JOIN vr v USING (feature)"""
    ).replace("SELECT feature, CASE WHEN v", "SELECT au.feature, CASE WHEN v").replace("OR feature <>", "OR au.feature <>"),
)
def feature_report(spark, sf):
    done = selecting.feature_report(materialize(matrix(spark, sf)), FEATURES, min_variance=100, threshold=0.6)
    return out(done, ["feature"], "score", "above_threshold", "selected")


@query(
    "top_features",
    msql(f"{AUC_CTES} SELECT feature, round(greatest(auc, 1 - auc), 6) AS score FROM au ORDER BY 2 DESC, 1 LIMIT 2"),
)
def top_features(spark, sf):
    report = selecting.feature_report(materialize(matrix(spark, sf)), FEATURES, min_variance=0.0)
    return out(selecting.top_features(report, 2), ["feature"], "score")


_BINS, _FOLDS = 8, 4
_EDGES = ", ".join(f"quantile_cont(value, {i / _BINS})" for i in range(1, _BINS))


@query(
    "feature_score_binned",
    msql(
        f""", fl AS (SELECT feature, value, label, hour(ts) % {_FOLDS} AS fold FROM lg),
        eg AS (SELECT feature, [{_EDGES}] AS edges FROM fl GROUP BY 1),
        bn AS (SELECT feature, label, fold, len(list_filter(edges, lambda e: e < value)) AS bin FROM fl JOIN eg USING (feature)),
        oo AS (SELECT a.feature, a.fold, a.bin, (count(*) FILTER (WHERE b.label = 1) + 1) / (count(b.label) + 2)::DOUBLE AS s
            FROM (SELECT DISTINCT feature, fold, bin FROM bn) a LEFT JOIN bn b ON a.feature = b.feature AND a.bin = b.bin AND a.fold <> b.fold GROUP BY 1, 2, 3),
        sc AS (SELECT feature, fold, label, s FROM bn JOIN oo USING (feature, fold, bin)),
        rk AS (SELECT *, rank() OVER (PARTITION BY feature, fold ORDER BY s) + (count(*) OVER (PARTITION BY feature, fold, s) - 1) / 2.0::DOUBLE AS r FROM sc),
        au AS (SELECT feature, fold, (sum(CASE WHEN label = 1 THEN r END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
            / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)::DOUBLE) AS auc FROM rk GROUP BY 1, 2)
        SELECT feature, round(avg(auc), 6) AS score FROM au GROUP BY 1"""
    ),
)
def feature_score_binned(spark, sf):
    """Features that tell the label in any shape: bins scored by the other folds; folds by the hour."""
    done = selecting.feature_score_binned(matrix(spark, sf), FEATURES, bins=_BINS, folds=_FOLDS, fold=F.hour("ts") % _FOLDS)
    return out(done, ["feature"], "score")


@query(
    "class_distribution",
    msql(
        """SELECT split, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
        FROM ms GROUP BY 1, 2"""
    ),
)
def class_distribution(spark, sf):
    return out(scoring.class_distribution(matrix(spark, sf), by=["split"]), ("split", "label"), "n", "share")


_CM = """
    cm AS (SELECT *, (close > 50)::INTEGER AS label, (probability >= 0.5)::INTEGER AS prediction FROM scored),
    rk AS (SELECT *, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS r FROM cm),
    ag AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
               (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)) AS roc_auc FROM rk)"""


@query(
    "classifier_metrics",
    sql(
        "scored",
        f"""WITH {_CM} SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy,
        round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
        round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(roc_auc, 6) AS roc_auc FROM ag""",
    ),
)
def classifier_metrics(spark, sf):
    rows = fx.scored_ticks(spark, sf).withColumns(
        {
            "label": (F.col("close") > 50).cast("int"),
            "prediction": (F.col("probability") >= 0.5).cast("int"),
        }
    )
    done = scoring.classifier_metrics(rows)
    return out(done, (), "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "roc_auc")


def _trained(spark, sf, kind="random_forest"):
    """A model with the usual number of trees, and the whole feature matrix it was trained on."""
    config = tr.TrainingConfig(model=kind)
    rows = materialize(tr.labelled_matrix(materialize(fx.bars(spark, sf)), config))
    return tr.train(rows, config), rows


def _model_metrics(kind: str):
    @query(f"train_{kind}")
    def run(spark, sf):
        return tr.evaluate(*_trained(spark, sf, kind))


for _kind in tr.MODELS:
    _model_metrics(_kind)


@query("train_pipeline")
def train_pipeline(spark, sf):
    """Bars to features, labels, split, selection, scaling, model, metrics and a saved artefact."""
    bars = materialize(fx.bars(spark, sf))
    _, metrics = tr.train_pipeline(bars, path=scratch_folder(spark, "model"))
    return metrics


@query("score_batch")
def score_batch(spark, sf):
    model, rows = _trained(spark, sf)
    return model.score(rows).select("symbol", "ts", "probability", "prediction")


@query("model_store")
def model_store(spark, sf):
    """Scores of the saved and reloaded model."""
    path = scratch_folder(spark, "model")
    model, rows = _trained(spark, sf)
    model.save(path)
    return tr.TrainedModel.load(spark, path).score(rows).select("symbol", "ts", "probability")


@query("signal_from_model")
def signal_from_model(spark, sf):
    """A model trained on the feature matrix of the bars, then bars to signals in one call."""
    bars = materialize(fx.bars(spark, sf))
    model, _ = tr.train_pipeline(bars)
    return tr.signal_from_model(bars, model, 0.55, 0.45).select("symbol", "ts", "probability", "signal")


# ------------------------------------------------------------------ what must hold for any model

#: Rows of the feature matrix by split: bars after the warm-up rows of their series.
_SPLITS = f"""
    al AS (SELECT symbol, ts, row_number() OVER ({WS}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars_1h),
    kp AS (SELECT symbol, ts, row_number() OVER ({WS}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM al WHERE i >= 60 OR n <= 60),
    sp AS (SELECT CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'test' ELSE 'valid' END AS split FROM kp)"""


@query(
    "model_invariants",
    sql(
        "bars_1h",
        f"""WITH {_SPLITS} SELECT split, count(*) AS n_rows, count(*) AS n_judged, count(*) AS n_in_range, count(*) AS n_same FROM sp GROUP BY 1
        UNION ALL SELECT 'signals', count(*), count(*), count(*), count(*) FROM bars_1h""",
    ),
)
def model_invariants(spark, sf):
    """Of every split: rows scored, rows in the confusion matrix, probabilities in [0, 1], and scores that the saved and
    reloaded model gives again. Of all bars: signals that are those of the probabilities beside them."""
    bars = materialize(fx.bars(spark, sf))
    root = scratch_folder(spark, "models")
    rows = materialize(tr.labelled_matrix(bars, tr.TrainingConfig(trees=10)))
    model = tr.train(rows, tr.TrainingConfig(trees=10))
    model.publish(root, "ALL", "random_forest", "20240301_101500")
    scored = materialize(model.score(rows))
    again = tr.TrainedModel.load_latest(spark, root, "ALL", "random_forest").score(rows)
    again = again.select("symbol", "ts", F.col("probability").alias("p"))
    inside = F.count_if(F.col("probability").between(0, 1)).alias("n_in_range")
    same = scored.join(again, ["symbol", "ts"]).groupBy("split").agg(
        F.count("*").alias("n_rows"), inside, F.count_if(F.abs(F.col("probability") - F.col("p")) < 1e-12).alias("n_same")
    )
    judged = scoring.classifier_metrics(scored, by=["split"]).select("split", F.expr("tp + fp + tn + fn").alias("n_judged"))
    parts = same.join(judged, "split").select("split", "n_rows", "n_judged", "n_in_range", "n_same")
    signals = materialize(tr.signal_from_model(bars, model, 0.55, 0.45))
    w = W.partitionBy("symbol").orderBy("ts")
    p = F.col("probability")
    held = F.coalesce(F.last(F.when(p >= 0.55, 1).when(p <= 0.45, 0), ignorenulls=True).over(w), F.lit(0))
    plain = signals.withColumn("held", held).withColumn("want", F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0)))
    n = F.count("*")
    return parts.unionByName(
        plain.agg(F.lit("signals").alias("split"), n.alias("n_rows"), F.count("signal").alias("n_judged"), inside, F.count_if(F.col("signal") == F.col("want")).alias("n_same"))
    )


@query(
    "model_latest",
    sql(
        "bars_1h",
        f"WITH {_SPLITS} SELECT 'random_forest' AS kind, 'ALL' AS key, TIMESTAMP '2024-03-01 10:15:00' AS stamp, 3 AS trees, count(*) AS n_scored FROM sp",
    ),
)
def model_latest(spark, sf):
    """Two versions of a model; the newer stamp is the one that is loaded, whichever was saved last."""
    from barloom.sources import artefacts

    root = scratch_folder(spark, "models")
    rows = materialize(tr.labelled_matrix(materialize(fx.bars(spark, sf)), tr.TrainingConfig()))
    for stamp, trees in (("20240301_101500", 3), ("20240201_090000", 2)):
        tr.train(rows, tr.TrainingConfig(trees=trees)).publish(root, "ALL", "random_forest", stamp)
    model = tr.TrainedModel.load_latest(spark, root, "ALL", "random_forest")
    n = model.score(rows).agg(F.count("probability").alias("n_scored"))
    found = artefacts.latest(spark, root, "random_forest", "ALL").select("kind", "key", "stamp")
    trees = model.model.stages[-1].getNumTrees
    return found.join(n, F.lit(True)).withColumn("trees", F.lit(trees)).select("kind", "key", "stamp", "trees", "n_scored")
