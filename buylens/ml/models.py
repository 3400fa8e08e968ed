"""MLlib models for the invoice match and for text classification."""

from __future__ import annotations

import json
import math
import random
import uuid
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, IndexToString, StandardScaler, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buylens.ml.encoders import align
from buylens.ml.metrics import confidence_band
from buylens.ml.splits import stratified_folds, with_weights
from buylens.session import shared_folder
from buylens.usecases.invoice_match import FEATURES, feature_columns, uc02_table

SEED = 42


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def logistic(features: list[str] = FEATURES, multi: bool = False, rounds: int = 1000) -> Pipeline:
    """Standardised logistic regression on the weight column, until it converges or ``rounds`` are over."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=rounds,
                            family="multinomial" if multi else "binomial")
    return Pipeline(stages=[_assembler(features), scale, lr])


def forest(features: list[str] = FEATURES, trees: int = 100, depth: int = 8) -> Pipeline:
    return Pipeline(stages=[_assembler(features), RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED)])


def boosted(features: list[str] = FEATURES, rounds: int = 100, depth: int = 4, step: float = 0.1, rows: float = 0.8, columns: float = 0.8) -> Pipeline:
    """Gradient-boosted trees, each on a share of the rows and, at every split, of the columns."""
    return Pipeline(stages=[_assembler(features), GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), seed=SEED)])


def reloaded(model: PipelineModel, path: str) -> PipelineModel:
    """The model saved to ``path`` and read back.

    A model that was just fitted holds its training summary, and with it the frames and the session it came from; the one read back holds parameters only.
    """
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def fit(pipeline: Pipeline, df: DataFrame, path: str | None = None) -> PipelineModel:
    """Fit on balanced class weights; the model lies at ``path``, or in the shared folder."""
    folder = path or shared_folder(df.sparkSession)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return reloaded(pipeline.fit(with_weights(df)), path or f"{folder}/models/{uuid.uuid4().hex}")


def fit_multiclass(df: DataFrame, features: list[str] = FEATURES, kind: str = "logistic", path: str | None = None) -> PipelineModel:
    """Four match classes by multinomial regression, a forest, or boosted trees."""
    if kind == "boosted":
        return fit_boosted_classes(df, features, path)
    return fit(logistic(features, multi=True) if kind == "logistic" else forest(features), df, path)


def fit_boosted_classes(df: DataFrame, features: list[str] = FEATURES, path: str | None = None, rounds: int = 50, depth: int = 4, parallelism: int = 4) -> PipelineModel:
    """Boosted trees for several classes 0, 1, ...: each class against the rest, then one multinomial regression on all margins, so that the
    probabilities are calibrated together and add up to one."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/models/{uuid.uuid4().hex}"
    assembler = _assembler(features)
    assembler.transform(with_weights(df)).select("features", "label", "weight").write.parquet(f"{folder}-rows")
    rows = spark.read.parquet(f"{folder}-rows")
    classes = int(rows.agg(F.max("label")).first()[0]) + 1

    def one(k: int):
        trees = GBTClassifier(featuresCol="features", labelCol="mine", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=SEED,
                              predictionCol=f"class_{k}").setRawPredictionCol(f"margin_{k}").setProbabilityCol(f"share_{k}")
        return trees.fit(rows.withColumn("mine", (F.col("label") == k).cast("double")))

    with ThreadPool(parallelism) as pool:
        each = PipelineModel(stages=pool.map(one, range(classes), chunksize=1))
    each = reloaded(each, f"{folder}-trees")
    joint = Pipeline(stages=[VectorAssembler(inputCols=[f"margin_{k}" for k in range(classes)], outputCol="margins"), LogisticRegression(
        featuresCol="margins", labelCol="label", weightCol="weight", maxIter=100, family="multinomial")]).fit(each.transform(rows))
    return reloaded(PipelineModel(stages=[assembler, *each.stages, *joint.stages]), path or folder)


def predictions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Key, label where known, predicted class and the class probabilities as an array."""
    out = model.transform(df)
    keep = [c for c in ("invoice_id", "invoice_line_number", "fold", "label") if c in df.columns]
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probabilities"))


def weighted_f1(scored: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="f1").evaluate(
        scored.select(F.col("label").cast("double"), F.col("prediction").cast("double")))


@dataclass(frozen=True)
class Search:
    """``draws`` random parameters; every one is judged on the first fold, the best ``halved[0]`` on the folds of one repeat, the best
    ``halved[1]`` of those on all repeats. With both as many as the draws, every draw is judged on all folds of all repeats."""

    draws: int = 50
    folds: int = 5
    repeats: int = 3
    halved: tuple[int, int] = (10, 3)
    parallelism: int = 4


def drawn(space: dict[str, tuple], draw: random.Random) -> dict:
    """One random point: ("float", low, high), ("log", low, high), or ("int", low, high) by parameter."""
    out = {}
    for name, (kind, low, high) in sorted(space.items()):
        if kind == "int":
            out[name] = draw.randint(low, high)
        else:
            out[name] = math.exp(draw.uniform(math.log(low), math.log(high))) if kind == "log" else draw.uniform(low, high)
    return out


def random_search(pipeline: Pipeline, space: dict[str, tuple], df: DataFrame, key: str, search: Search = Search(), seed: int = SEED):
    """Best of random parameter draws by mean F1 over repeated stratified folds, by successive halving if the search asks for it.

    Gives the model refitted on all rows and one row per draw with its mean F1 and the number of folds it was judged on.
    """
    last, draw = pipeline.getStages()[-1], random.Random(seed)
    picks = [drawn(space, draw) for _ in range(search.draws)]
    spark = df.sparkSession
    folded = []
    for r in range(search.repeats):
        path = f"{shared_folder(spark)}/models/folds-{uuid.uuid4().hex}"
        with_weights(stratified_folds(df, "label", key, search.folds, repeat=r)).write.parquet(path)
        folded.append(spark.read.parquet(path))
    scores: dict[int, list[float]] = {k: [] for k in range(len(picks))}
    evaluator = MulticlassClassificationEvaluator(metricName="f1", weightCol="weight")
    columns = [last.getFeaturesCol(), "label", "weight"]

    def judged(r: int, fold: int, chosen: list[int]) -> list[float]:
        """F1 of the chosen draws on one fold. The stages before the last have no drawn parameters: they are fitted once for all draws."""
        before = Pipeline(stages=pipeline.getStages()[:-1]).fit(folded[r].filter(F.col("fold") != fold))
        train, test = (before.transform(folded[r].filter(part)).select(*columns).persist() for part in (F.col("fold") != fold, F.col("fold") == fold))

        def one(k: int) -> float:
            model = last.fit(train, {last.getParam(name): value for name, value in picks[k].items()})
            model = reloaded(PipelineModel(stages=[model]), f"{shared_folder(spark)}/models/{uuid.uuid4().hex}")
            return evaluator.evaluate(model.transform(test))

        try:
            return pool.map(one, chosen, chunksize=1)
        finally:
            train.unpersist()
            test.unpersist()

    ranked = list(scores)
    steps = [(len(picks), [(0, 0)]), (search.halved[0], [(0, f) for f in range(1, search.folds)]),
             (search.halved[1], [(r, f) for r in range(1, search.repeats) for f in range(search.folds)])]
    with ThreadPool(search.parallelism) as pool:
        for count, places in steps:
            for place in places:
                for k, score in zip(ranked[:count], judged(*place, ranked[:count])):
                    scores[k].append(score)
            ranked = sorted(ranked[:count], key=lambda k: (-sum(scores[k]) / len(scores[k]), k))
    mean = {k: sum(s) / len(s) for k, s in scores.items()}
    trials = spark.createDataFrame([(k, json.dumps(pick, sort_keys=True), float(mean[k]), len(scores[k]), k == ranked[0]) for k, pick in enumerate(picks)],
                                   "trial int, params string, mean_f1 double, folds int, best boolean")
    best = pipeline.copy({last.getParam(name): value for name, value in picks[ranked[0]].items()})
    return fit(best, df), trials


def cross_validate(pipeline: Pipeline, df: DataFrame, folds: int, parallelism: int = 4) -> DataFrame:
    """Out-of-fold scores of every row, for one fold column; some folds are fitted at a time."""
    def one(k: int) -> DataFrame:
        return predictions(fit(pipeline, df.filter(F.col("fold") != k)), df.filter(F.col("fold") == k))

    with ThreadPool(parallelism) as pool:
        parts = pool.map(one, range(folds), chunksize=1)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("score", F.element_at("probabilities", 2))


@dataclass
class Comparison:
    table: DataFrame
    best: str
    model: PipelineModel = field(repr=False)


def compare_and_fit(pipelines: dict[str, Pipeline], df: DataFrame, folds: int, path: str | None = None,
                    features: list[str] = FEATURES) -> Comparison:
    """Cross-validate each pipeline, refit the one with the best F1 on all rows, save it."""
    from buylens.ml.metrics import binary_metrics, metrics_summary
    tables, best, best_f1 = [], None, -1.0
    for name, pipeline in pipelines.items():
        summary = metrics_summary(binary_metrics(cross_validate(pipeline, df, folds), by="fold")).withColumn("model", F.lit(name))
        rows = summary.collect()  # five metrics
        f1 = next(r["mean"] for r in rows if r["metric"] == "f1")
        tables.append(df.sparkSession.createDataFrame(rows, summary.schema))
        if f1 > best_f1:
            best, best_f1 = name, f1
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    model = fit(pipelines[best], df, f"{path}/model" if path else None)
    if path:
        meta = {"model": best, "f1": best_f1, "features": features, "leak_suspect": best_f1 > 0.95}
        df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return Comparison(table, best, model)


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def importance(model: PipelineModel, spark, features: list[str] = FEATURES, top: int | None = 20) -> DataFrame:
    """Tree gain or absolute coefficient per feature, strongest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = sorted(((f, abs(float(v))) for f, v in zip(features, values.toArray())), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i + 1, *row) for i, row in enumerate(rows[:top])], "rank int, feature string, importance double")


def attributions(model: PipelineModel, df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Contribution of each feature to the logit of each row: coefficient times distance from the mean.

    The contributions and ``base`` add up to the row's logit exactly.
    """
    scaler, lr = model.stages[-2], model.stages[-1]
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), lr.coefficients.toArray()
    parts = [F.struct(F.lit(f).alias("feature"), (F.lit(float(c / s) if s else 0.0) * (F.col(f) - F.lit(float(m)))).alias("contribution"))
             for f, m, s, c in zip(features, mean, std, coef)]
    keep = [c for c in ("invoice_id", "invoice_line_number", "label") if c in df.columns]
    return df.select(*keep, F.lit(float(lr.intercept)).alias("base"), F.array(*parts).alias("contributions"))


def attribution_summary(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("contributions").alias("c")).groupBy("c.feature").agg(F.avg(F.abs("c.contribution")).alias("mean_abs"))


def top_factors(rows: DataFrame, n: int = 3) -> DataFrame:
    """The strongest factors of each row as text; the array holds one entry per feature."""
    strongest = F.slice(F.array_sort("contributions", lambda a, b: F.signum(F.abs(b["contribution"]) - F.abs(a["contribution"])).cast("int")), 1, n)
    text = F.transform(strongest, lambda c: F.concat(c["feature"], F.lit(" "), F.format_number(c["contribution"], 3)))
    keep = [c for c in ("invoice_id", "invoice_line_number") if c in rows.columns]
    return rows.select(*keep, F.concat_ws("; ", text).alias("top_factors"))


def score_batch(model: PipelineModel, t, invoice_ids: DataFrame | None = None, features: list[str] = FEATURES) -> DataFrame:
    """Predicted class, probability, variance probability and confidence of invoice lines.

    ``invoice_ids`` is applied to the fact tables before the features are joined; the
    vendor and material history still covers everything.
    """
    df = feature_columns(uc02_table(t, leave_one_out=False, invoice_ids=invoice_ids), features=features)
    scored = predictions(model, df)
    p = F.array_max("probabilities")
    return scored.select("invoice_id", "invoice_line_number", "prediction", p.alias("probability"),
                         (1 - F.element_at("probabilities", 1)).alias("variance_probability"), confidence_band(p).alias("confidence"))


def score_one(model: PipelineModel, t, invoice_id: str, features: list[str] = FEATURES) -> DataFrame:
    ids = t["invoice_header"].filter(F.col("invoice_id") == invoice_id).select("invoice_id")
    return score_batch(model, t, ids, features)


def text_classifier(materials: DataFrame, label: str = "category_id", text: str = "description", features: int = 1 << 18,
                    rounds: int = 100) -> PipelineModel:
    """Words, TF-IDF and multinomial logistic regression from a description to its class."""
    index = StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip")
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=features)
    return Pipeline(stages=[index, Tokenizer(inputCol=text, outputCol="words"), tf, IDF(inputCol="tf", outputCol="tfidf"),
                            LogisticRegression(featuresCol="tfidf", labelCol="label", maxIter=rounds)]).fit(materials)


def text_accuracy(materials: DataFrame, label: str = "category_id", k: int = 3, folds: int = 5, key: str = "material_id", **options) -> DataFrame:
    """Share of held-out texts whose class is the most likely one, and is among the ``k`` most likely, with the share of the largest class."""
    folded = stratified_folds(materials, label, key, folds)
    path = f"{shared_folder(materials.sparkSession)}/models/texts-{uuid.uuid4().hex}"
    folded.write.parquet(path)
    folded = materials.sparkSession.read.parquet(path)
    train, test = folded.filter("fold <> 0"), folded.filter("fold = 0")
    ranked = top_classes(text_classifier(train, label, **options), test, k, key)
    hit = ranked.join(test.select(key, F.col(label).alias("actual")), key).filter(F.col("class") == F.col("actual")).select(key, "rank")
    largest = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("largest")).scalar()
    return test.join(hit, key, "left").agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("double")).alias("top_1"),
                                           F.avg(F.col("rank").isNotNull().cast("double")).alias(f"top_{k}"), F.first(largest).alias("largest_class"))


def top_classes(model: PipelineModel, materials: DataFrame, k: int = 3, key: str = "material_id") -> DataFrame:
    """The k most likely classes of each text with their probabilities."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    pairs = F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("neg"), i.alias("i")))
    ranked = F.slice(F.array_sort(pairs), 1, k)
    # The input label may be unknown; only the text is used.
    rest = PipelineModel(stages=model.stages[1:])
    return rest.transform(materials).select(key, F.posexplode(ranked).alias("pos", "x")).select(
        key, (F.col("pos") + 1).alias("rank"), F.element_at(names, F.col("x.i") + 1).alias("class"), (-F.col("x.neg")).alias("probability"))
