"""Model queries. Scores that are checked against SQL are simple functions of the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buylens.functions.columns import PRIORITY, flag, ordinal
from buylens.ml import drift, encoders, metrics, models, splits
from buylens.plans.features import rounded
from buylens.usecases import invoice_match as im
from buylens.usecases import sourcing

SPACE = {"regParam": ("log", 1e-8, 1.0), "elasticNetParam": ("float", 0.0, 1.0)}
FOLDS = 5
#: The whole search: every draw on all folds of all repeats, 750 fits that run until they converge.
SEARCH = models.Search(draws=50, folds=FOLDS, repeats=3, halved=(50, 50))
#: A smaller one, for the row whose twin states 12 draws.
SMALL = models.Search(draws=12, folds=FOLDS, halved=(4, 1))
FEW = ["po_total_net_value", "po_quantity", "quantity_received", "days_po_to_invoice", "v_total_po_count", "v_rejection_rate",
       "uc02_is_contract_po", "uc02_vendor_quality_score"]
KEYS = ["invoice_id", "invoice_line_number"]


def scored(t):
    """Each invoice with whether it varied and a made-up score from its amount."""
    amount = (F.col("total_net_amount") % 100).cast("double") / 100
    return t["invoice_header"].select("invoice_id", "invoice_date", flag(F.col("match_status") != "FULL_MATCH").alias("label"), amount.alias("score"))


def predicted(t):
    """Four classes: stored match class against one read off the amount."""
    return t["invoice_header"].select("invoice_id", ordinal("match_status", {
        "FULL_MATCH": 0, "PRICE_VARIANCE": 1, "QUANTITY_VARIANCE": 2, "BOTH_VARIANCE": 3}).alias("label"),
        F.floor(F.col("total_net_amount") % 4).cast("int").alias("prediction"))


def kept(t, target="target_binary"):
    """The feature matrix written once, since training reads it many times."""
    name = f"uc02_matrix_{target}"
    if name not in t.kept:
        im.feature_columns(im.uc02_table(t), target).write.mode("overwrite").parquet(f"{t.folder}/{name}")
        t.kept.add(name)
    return t.spark.read.parquet(f"{t.folder}/{name}")


def keyed(t):
    return kept(t).withColumn("key", F.concat_ws("/", "invoice_id", F.col("invoice_line_number").cast("string")))


def folded(t, k):
    """The matrix with a fold, written once."""
    name = f"uc02_matrix_folds_{k}"
    if name not in t.kept:
        splits.stratified_folds(keyed(t), "label", "key", k).write.mode("overwrite").parquet(f"{t.folder}/{name}")
        t.kept.add(name)
    return t.spark.read.parquet(f"{t.folder}/{name}")


PIPELINES = {"logistic": models.logistic, "forest": models.forest, "boosted": models.boosted}


def fitted(t, kind):
    """A model on all features, fitted once and read back for every query that scores with it."""
    name, path = f"model_{kind}", f"{t.folder}/model_{kind}"
    if name not in t.kept:
        if kind.startswith("classes_"):
            models.fit_multiclass(kept(t, "target_multiclass"), kind=kind.removeprefix("classes_"), path=path)
        else:
            models.fit(PIPELINES[kind](), kept(t), path)
        t.kept.add(name)
    return models.PipelineModel.load(path)


def lines_scored(model, df):
    return models.predictions(model, df).select("invoice_id", "invoice_line_number", "label", "prediction",
                                                 F.element_at("probabilities", 2).alias("score"))


def attribution_rows(t):
    df = kept(t)
    return models.attributions(fitted(t, "logistic"), df)


def valid(scores):
    """What holds for any fitted model: classes, probabilities and bands that fit each other."""
    p, v = F.col("probability"), F.col("variance_probability")
    fits = (p.between(0.5, 1) & v.between(0, 1) & ((F.col("prediction") == 1) == (v > 0.5)) & (F.abs(F.greatest(v, 1 - v) - p) < 1e-9)
            & (F.col("confidence") == metrics.confidence_band(p)))
    return scores.select("invoice_id", "invoice_line_number", fits.alias("valid"))


def first_invoice(t):
    return t["invoice_header"].agg(F.min("invoice_id")).first()[0]


def additive(t):
    """Contributions and base add up to the logit of the predicted probability."""
    df = kept(t)
    model, keys = fitted(t, "logistic"), KEYS
    total = models.attributions(model, df).select(*keys, (F.col("base") + F.aggregate(
        "contributions", F.lit(0.0), lambda acc, c: acc + c["contribution"])).alias("logit"))
    p = models.predictions(model, df).select(*keys, F.element_at("probabilities", 2).alias("p"))
    return total.join(p, keys).select(*keys, (F.abs(1 / (1 + F.exp(-F.col("logit"))) - F.col("p")) < 1e-6).alias("adds_up"))


def proper(scores):
    """Of any classifier: the probabilities add up to one and the prediction is the most likely class."""
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    best = F.element_at(p, F.col("prediction") + 1)
    return scores.select(*KEYS, ((F.abs(total - 1) < 1e-9) & (F.abs(best - F.array_max(p)) < 1e-9)).alias("valid"))


def better(t, kind, target="target_binary", base=None):
    """Whether the weighted F1 is above that of always the largest class, or not below that of the model ``base``."""
    df = kept(t, target)
    f1 = models.weighted_f1(models.predictions(fitted(t, kind), df))
    if base:
        least = models.weighted_f1(models.predictions(fitted(t, base), df)) - 1e-12
    else:
        top = df.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
        least = models.weighted_f1(df.select("label", F.lit(top).alias("prediction")))
    return t.spark.createDataFrame([(kind, f1 > least)], "model string, better boolean")


def searched(t, search=SEARCH, **rounds):
    """The trials of the search, written once."""
    name = f"trials_{search.draws}"
    if name not in t.kept:
        models.random_search(models.logistic(**rounds), SPACE, keyed(t), "key", search)[1].write.mode("overwrite").parquet(f"{t.folder}/{name}")
        t.kept.add(name)
    return t.spark.read.parquet(f"{t.folder}/{name}")


def summary_matches(t):
    """The summary of the attributions against the mean distance of each scaled feature times its coefficient."""
    df, model = kept(t), fitted(t, "logistic")
    scaler, lr = model.stages[-2], model.stages[-1]
    parts = {f: F.avg(F.abs((F.col(f) - float(m)) * float(c / s if s else 0.0))) for f, m, s, c in zip(im.FEATURES, scaler.mean, scaler.std, lr.coefficients)}
    one = df.agg(*[x.alias(f) for f, x in parts.items()])
    plain = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("plain")) for f in parts])).alias("p")).select("p.*")
    return models.attribution_summary(models.attributions(model, df)).join(plain, "feature", "full").select(
        "feature", (F.abs(F.col("mean_abs") - F.col("plain")) < 1e-9).alias("equal"))


def factors_ordered(t):
    """The first factor named for a row has its largest contribution."""
    rows = attribution_rows(t)
    largest = rows.select(*KEYS, F.array_max(F.transform("contributions", lambda c: F.abs(c["contribution"]))).alias("largest"))
    first = F.abs(F.regexp_replace(F.regexp_extract("top_factors", r"^\S+ ([-0-9.,]+)", 1), ",", "").cast("double"))
    return models.top_factors(rows).join(largest, KEYS).select(*KEYS, (F.abs(first - F.col("largest")) < 0.0006).alias("ordered"))


def text_rows(t):
    return t["material_master"].select("material_id", "description", "category_id")


QUERIES = {
    "m01_class_weights": lambda t: splits.class_weights(scored(t), "label"),
    "m02_fit_lr": lambda t: lines_scored(fitted(t, "logistic"), kept(t)),
    "m02_valid": lambda t: proper(models.predictions(fitted(t, "logistic"), kept(t))),
    "m02_better": lambda t: better(t, "logistic"),
    "m03_fit_rf": lambda t: lines_scored(fitted(t, "forest"), kept(t)),
    "m03_valid": lambda t: proper(models.predictions(fitted(t, "forest"), kept(t))),
    "m03_better": lambda t: better(t, "forest"),
    "m04_fit_gbt": lambda t: lines_scored(fitted(t, "boosted"), kept(t)),
    "m04_valid": lambda t: proper(models.predictions(fitted(t, "boosted"), kept(t))),
    "m04_better": lambda t: better(t, "boosted"),
    "m05_random_search": searched,
    "m05_search_complete": lambda t: searched(t, SMALL, rounds=30).agg(F.count(F.lit(1)).alias("draws"), F.sum(flag(F.col("best")).cast("bigint")).alias("best"),
                                                     F.min(F.col("mean_f1").between(0, 1)).alias("between")),
    "m06_stratified_folds": lambda t: splits.stratified_folds(scored(t), "label", "invoice_id", 5, repeat=1).select("invoice_id", "label", "fold"),
    "m06_repeated_folds": lambda t: reduce(DataFrame.unionByName, [splits.stratified_folds(scored(t), "label", "invoice_id", 5, repeat=r).select(
        "invoice_id", "label", "fold", F.lit(r).alias("repeat")) for r in (1, 2, 3)]),
    "m07_binary_metrics": lambda t: rounded(metrics.binary_metrics(scored(t)), *metrics.METRICS),
    "m07_binary_metrics_by_fold": lambda t: rounded(metrics.binary_metrics(
        scored(t).withColumn("fold", F.month("invoice_date") % 3), by="fold"), *metrics.METRICS),
    "m07_metrics_summary": lambda t: rounded(metrics.metrics_summary(metrics.binary_metrics(
        scored(t).withColumn("fold", F.month("invoice_date") % 3), by="fold")), "mean", "std"),
    "m08_fit_multiclass": lambda t: models.predictions(fitted(t, "classes_logistic"), kept(t, "target_multiclass")).select(*KEYS, "label", "prediction"),
    "m08_valid": lambda t: proper(models.predictions(fitted(t, "classes_logistic"), kept(t, "target_multiclass"))),
    "m08_boosted_valid": lambda t: proper(models.predictions(fitted(t, "classes_boosted"), kept(t, "target_multiclass"))),
    "m08_boosted_better": lambda t: better(t, "classes_boosted", "target_multiclass", "classes_logistic"),
    "m09_compare_and_fit": lambda t: models.compare_and_fit({"logistic": models.logistic(), "forest": models.forest()}, folded(t, FOLDS), FOLDS,
                                                            f"{t.folder}/best_model").table,
    "m10_importance": lambda t: models.importance(fitted(t, "forest"), t.spark),
    "m10_sums_to_one": lambda t: models.importance(fitted(t, "forest"), t.spark, top=None).agg(
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("one"), F.count(F.lit(1)).alias("features")),
    "m11_attribution_summary": lambda t: models.attribution_summary(attribution_rows(t)),
    "m11_contributions_add_up": additive,
    "m11_summary_matches": summary_matches,
    "m11_factors_ordered": factors_ordered,
    "m11_top_factors": lambda t: models.top_factors(attribution_rows(t)),
    "m12_classification_report": lambda t: metrics.classification_report(predicted(t)),
    "m13_score_batch": lambda t: models.score_batch(fitted(t, "logistic"), t),
    "m13_scores_valid": lambda t: valid(models.score_batch(fitted(t, "logistic"), t)),
    "m14_score_one": lambda t: valid(models.score_one(fitted(t, "logistic"), t, first_invoice(t))),
    "m15_confidence_band": lambda t: scored(t).select("invoice_id", metrics.confidence_band(F.col("score")).alias("confidence")),
    "m16_align": lambda t: encoders.align(t["vendor_master"].select("risk_score", "quality_score"), ["quality_score", "not_there", "risk_score"]),
    "m17_accuracy": lambda t: metrics.accuracy(predicted(t), predicted(t), "invoice_id"),
    "m18_temporal_split": lambda t: splits.temporal_split(t["invoice_header"].select("invoice_id", "invoice_date"), "invoice_date",
                                                          "2000-01-01", "2001-01-01"),
    "m19_expanding_folds": lambda t: splits.expanding_folds(t["invoice_header"].select("invoice_id", "invoice_date"), "invoice_date").groupBy(
        "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("invoice_date").alias("first_day"), F.max("invoice_date").alias("last_day")),
    "m20_regression_metrics": lambda t: rounded(metrics.regression_metrics(t["po_line_item"].select("unit_price", "material_id").join(
        t["material_master"].select("material_id", "standard_cost"), "material_id"), "unit_price", "standard_cost"), "mae", "rmse", "mape"),
    "m21_precision_recall_at_k": lambda t: metrics.precision_recall_at_k(scored(t), 500, "invoice_id"),
    "m22_weighted_kappa": lambda t: rounded(metrics.weighted_kappa(t["pr_header"].select("pr_id", ordinal("priority", PRIORITY).alias("label")).join(
        sourcing.pr_priority(sourcing.uc10_features(t)).select("pr_id", ordinal("rule_priority", PRIORITY).alias("prediction")), "pr_id"), 4), "kappa"),
    "m23_psi": lambda t: rounded(drift.psi(
        t["invoice_header"].filter("invoice_date < '1998-01-01'"), t["invoice_header"].filter("invoice_date >= '1998-01-01'"),
        ["total_net_amount", "tax_amount"]), "psi"),
    "m24_rate_drift": lambda t: rounded(drift.rate_drift(t["invoice_header"], "invoice_date", F.col("match_status") != "FULL_MATCH"), "shift"),
    "m25_encoders": lambda t: rounded(encoders.encode_onehot(encoders.encode_ordinal(encoders.encode_missing(encoders.encode_log(
        encoders.encode_minmax(encoders.encode_zscore(encoders.encode_cyclical(
            t["vendor_master"].select("vendor_id", "status", "vendor_type", "risk_score", "quality_score", "lead_time_days_typical", "esg_score"),
            "lead_time_days_typical", 12), "risk_score"), "quality_score"), "risk_score"), "esg_score"),
        "status", {"ACTIVE": 2, "CONDITIONAL": 1, "BLOCKED": 0}), "vendor_type", ["OEM", "DISTRIBUTOR"]),
        "lead_time_days_typical_sin", "lead_time_days_typical_cos", "risk_score_z", "risk_score_log"),
    "m25_median_impute": lambda t: encoders.encode_median(t["vendor_master"].select("vendor_id", "vendor_type", "esg_score"), "esg_score", "vendor_type"),
    "m26_multivariate_outliers": lambda t: rounded(drift.multivariate_outliers(
        t["po_line_item"].select("po_id", "po_line_number", "material_id", "quantity", "unit_price").join(
            t["material_master"].select("material_id", F.split("category_id", "-")[0].alias("top")), "material_id").drop("material_id"),
        "top", ["quantity", "unit_price"], 2.0), "distance").select("po_id", "po_line_number", "distance", "outlier"),
    "m26_mahalanobis": lambda t: rounded(drift.mahalanobis(
        t["po_line_item"].select("po_id", "po_line_number", "material_id", "quantity", "unit_price").join(
            t["material_master"].select("material_id", F.split("category_id", "-")[0].alias("top"), "standard_cost"), "material_id").drop("material_id"),
        "top", ["quantity", "unit_price", "standard_cost"]), "distance", places=4).select("po_id", "po_line_number", "distance"),
    "u1202_text_classifier": lambda t: models.top_classes(models.text_classifier(text_rows(t), features=1 << 12), text_rows(t)),
    "u1202_held_out": lambda t: models.text_accuracy(text_rows(t), features=1 << 12).select(
        F.col("top_1").between(0, 1).alias("a_share"), (F.col("top_3") >= F.col("top_1")).alias("top_3_not_below"), (F.col("n") > 0).alias("held_out")),
}
