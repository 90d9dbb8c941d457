"""Training, tuning, evaluation and prediction of text classifiers."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.stages import GaussianTextBayes, TextForest, TextMachine
from postloom.operators import bayes, evaluation, sampling
from postloom.operators.dataset import fill_text
from postloom.operators.tfidf import fit_idf, tfidf
from postloom.plans.preprocess import with_id
from postloom.session import configure, written
from postloom.sources.tables import write_results, write_weights

SEED = 42
FOLDS = 10
KINDS = ("nb", "rf", "svm")

# The grids that are searched by default.
GRIDS = {
    "nb": {"var_smoothing": bayes.SMOOTHING},
    "rf": {"trees": [100, 200, 300], "depth": [None, 10, 20], "min_split": [2, 5], "min_leaf": [1, 2]},
    "svm": {"c": [0.01, 0.1, 1.0], "tol": [1e-4, 1e-3], "iterations": [1000, 5000]},
}
DEEPEST = 30  # no limit on the depth means this one, the deepest tree that Spark grows


def parameter_sets(kind: str, grid: dict[str, list] | None = None) -> list[dict]:
    """Every combination of a grid, by the names used here; the last name varies fastest."""
    wanted = GRIDS[kind] if grid is None else grid
    names = list(GRIDS[kind])
    return [dict(zip(names, values)) for values in product(*[wanted[name] for name in names])]


def build_pipeline(kind: str, rows: int = 1, grid: dict[str, list] | None = None) -> tuple[Pipeline, list[dict]]:
    """A classifier of texts as a pipeline, and the parameter maps to search.

    `rows` is the number of training rows: balanced class weights sum up to it, and it turns the
    penalty C into Spark's regularization, 1 / (C * rows). Spark's forest has no minimum number of
    rows for a split; a split needs `min_leaf` rows on both sides, so `min_split` acts as its half:
    of the default pairs (2, 1), (2, 2), (5, 1), (5, 2) the last two come down to the same forest.
    Every combination has its own map; maps that are equal are fitted once.
    """
    if kind not in KINDS:
        raise ValueError(f"unsupported model kind: {kind}")
    sets = parameter_sets(kind, grid)
    if kind == "nb":
        model = GaussianTextBayes(labelCol="label")
        return Pipeline(stages=[model]), [{model.varSmoothing: float(one["var_smoothing"])} for one in sets]
    if kind == "rf":
        model = TextForest(labelCol="label", weightCol="weight", seed=SEED)
        maps = [
            {
                model.numTrees: one["trees"],
                model.maxDepth: one["depth"] or DEEPEST,
                model.minInstancesPerNode: max(one["min_leaf"], (one["min_split"] + 1) // 2),
            }
            for one in sets
        ]
        return Pipeline(stages=[model]), maps
    model = TextMachine(labelCol="label", weightCol="weight")
    maps = [
        {model.regParam: 1.0 / (one["c"] * max(rows, 1)), model.tol: one["tol"], model.maxIter: one["iterations"]}
        for one in sets
    ]
    return Pipeline(stages=[model]), maps


def search(classifier, maps: list[dict], rows: DataFrame, folds: int, parallelism: int) -> list[float]:
    """Mean accuracy per parameter map over the column `fold`.

    Vectorizing belongs to training, so every fold fits its own terms on its training rows. Equal
    maps are fitted once.
    """
    keys = [tuple(sorted((param.name, value) for param, value in params.items())) for params in maps]
    different = {key: params for key, params in zip(keys, maps)}
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
    totals = dict.fromkeys(different, 0.0)
    with ThreadPool(min(parallelism, len(different))) as pool:
        for number in range(folds):
            train, valid = rows.where(F.col("fold") != number), rows.where(F.col("fold") == number)

            def one(key: tuple) -> float:
                return evaluator.evaluate(classifier.fit(train, different[key]).transform(valid))

            for key, score in zip(different, pool.map(inheritable_thread_target(rows.sparkSession)(one), different)):
                totals[key] += score / folds
    return [totals[key] for key in keys]


@dataclass
class Tuned:
    model: PipelineModel
    scores: DataFrame
    best: dict


def prepare(df: DataFrame, label: str = "label_post", id_col: str = "id", seed: int = SEED) -> DataFrame:
    """Training table: filled text and label, id, and the validation mark; written down."""
    rows = with_id(fill_text(df, "text_clean", label), id_col)
    rows = written(rows.select(id_col, F.col(label).alias("label_post"), "text_clean"), "clean")
    return written(sampling.stratified_split(rows, id_col, "label_post", seed=seed), "split")


def fit_one(train: DataFrame, kind: str, grid: dict[str, list]) -> PipelineModel:
    """Fit the first parameter set of a grid on all rows, without any search."""
    indexer, rows = _indexed(train)
    pipeline, maps = build_pipeline(kind, rows.count(), grid)
    fitted = pipeline.fit(rows, maps[0])
    return PipelineModel([*fitted.stages, _label_names(indexer)])


def _indexed(train: DataFrame) -> tuple[StringIndexerModel, DataFrame]:
    """Training rows with a numeric label and a balanced weight."""
    indexer = StringIndexer(inputCol="label_post", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    return indexer, written(indexer.transform(sampling.add_weights(train, "label_post", "id")), "indexed")


def _label_names(indexer: StringIndexerModel) -> IndexToString:
    return IndexToString(inputCol="prediction", outputCol="prediction_label", labels=indexer.labels)


def tune(
    train: DataFrame,
    kind: str,
    grid: dict[str, list] | None = None,
    folds: int = FOLDS,
    seed: int = SEED,
    parallelism: int = 2,
) -> Tuned:
    """Search the grid with stratified folds by accuracy and refit the best on all rows.

    `train` has `id`, `label_post` and `text_clean`. The first of equally good parameter sets wins.
    """
    spark = train.sparkSession
    indexer, indexed = _indexed(train)
    rows = written(sampling.stratified_folds(indexed, "id", "label_post", folds, seed), "folds")
    pipeline, maps = build_pipeline(kind, rows.count(), grid)
    (classifier,) = pipeline.getStages()
    if kind == "nb":
        values = [next(iter(params.values())) for params in maps]
        means = bayes.cross_validate_bayes(rows, "label", values, folds, parallelism=parallelism).collect()
        metrics = [row.score for row in sorted(means, key=lambda row: row.grid_index)]
    else:
        metrics = search(classifier, maps, rows, folds, parallelism)
    best = max(range(len(maps)), key=lambda index: (metrics[index], -index))
    fitted = pipeline.fit(rows, maps[best])
    texts = parameter_sets(kind, grid)
    scores = spark.createDataFrame(
        [(index, str(text), float(score)) for index, (text, score) in enumerate(zip(texts, metrics))],
        "grid_index int, params string, score double",
    )
    return Tuned(PipelineModel([*fitted.stages, _label_names(indexer)]), scores, texts[best])


def best_scores(scores: DataFrame) -> DataFrame:
    """The parameter set with the highest score, the first one on ties."""
    return scores.orderBy(F.desc("score"), "grid_index").limit(1)


def with_cleaning(model: PipelineModel, cleaning: PipelineModel) -> PipelineModel:
    """The model with the cleaning it was trained with in front, so that it takes raw texts."""
    return PipelineModel([*cleaning.stages, *model.stages])


def predict(
    model: PipelineModel, texts: DataFrame, keep: tuple[str, ...] = ("text",), text: str = "text"
) -> DataFrame:
    """`prediction` (a label) for every row of `texts`, next to the columns in `keep`.

    The stages that gather words by row work on numbers given here, so ids that are null or occur
    again give exactly as many rows as there were.
    """
    carried = [name for name in keep if name != text]
    kept = [F.col(name).alias(f"_keep{k}") for k, name in enumerate(carried)]
    rows = texts.select(F.col(text).alias("text"), *kept).withColumn("_number", F.monotonically_increasing_id())
    numbered = {stage.idCol: "_number" for stage in model.stages if stage.hasParam("idCol")}
    out = model.transform(written(rows, "rows"), numbered)
    columns = {name: F.col(f"_keep{k}").alias(name) for k, name in enumerate(carried)} | {text: F.col("text").alias(text)}
    return out.select(*[columns[name] for name in keep], F.col("prediction_label").alias("prediction"))


def predict_texts(spark: SparkSession, model: PipelineModel, texts: list[str]) -> DataFrame:
    """Predictions for a handful of texts given as a list, as `(text, prediction)` rows."""
    rows = spark.createDataFrame([(str(n), text) for n, text in enumerate(texts)], "id string, text string")
    return predict(model, rows)


def train_and_evaluate(
    spark: SparkSession,
    dataset: DataFrame,
    kind: str,
    output: str,
    cleaning: PipelineModel,
    grid: dict[str, list] | None = None,
    folds: int = FOLDS,
) -> Tuned:
    """Train on 80 % of a cleaned dataset, and store the model, its TF-IDF matrix and its results.

    `cleaning` is what `preprocess_dataset` returned with the dataset; it is stored with the model.

    {output}/model holds the model with its cleaning, {output}/tfidf the weights of the training
    rows in long form, {output}/scores the grid, {output}/report and {output}/confusion the
    results on the other 20 %.
    """
    configure(spark)
    if kind not in KINDS:
        raise ValueError(f"unsupported model kind: {kind}")
    rows = prepare(dataset)
    train, valid = rows.where("NOT is_valid").drop("is_valid"), rows.where("is_valid").drop("is_valid")
    tuned = tune(train, kind, grid, folds)
    with_cleaning(tuned.model, cleaning).write().overwrite().save(f"{output}/model")
    write_weights(tfidf(train, fit_idf(train)), f"{output}/tfidf")
    scored = written(
        tuned.model.transform(valid).select(
            F.col("label_post").alias("label"), F.col("prediction_label").alias("prediction")
        ),
        "scored",
    )
    counts = evaluation.confusion_counts(scored)
    write_results(output, evaluation.classification_report(scored), evaluation.confusion_percent(counts))
    tuned.scores.write.mode("overwrite").parquet(f"{output}/scores")
    return tuned


def load_model(path: str) -> PipelineModel:
    """A saved model; a path that does not exist is an error."""
    return PipelineModel.load(path)
