"""Gaussian naive Bayes on TF-IDF weights in long form; nothing is made dense.

A weight that is absent is a zero, and a zero adds the same amount to a class score for every
document. So each class has one base score, and a document only adds what its own terms change:

    score(c) = ln(prior) + sum over all terms ln N(0; m, v) + sum over present terms (w m - w*w/2) / v
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.joins import BROADCAST_BYTES, HOT_FLOOR, lookup_join, small
from postloom.operators.tfidf import fit_idf, term_counts, tfidf
from postloom.session import materialize, written

SMOOTHING = [1e-9, 1e-8, 1e-7]


@dataclass
class BayesFit:
    """Class sizes `(class, n)`, and a row per term and class with the sums of w and w*w: `term, df, idf, class, s1, s2`.

    A class without a row for a term has only zeros there. There is no bound on terms or classes.
    """

    classes: DataFrame
    terms: DataFrame
    rows: int
    n_terms: int
    max_variance: float


def fit_bayes(docs: DataFrame, label: str, id_col: str = "id", text: str = "text_clean") -> BayesFit:
    """Class statistics of every term, combined before the one shuffle by term and class."""
    classes = written(docs.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")), "classes")
    rows = classes.agg(F.sum("n")).first()[0] or 0
    idf = fit_idf(docs, text, rows)
    # the label travels with the words, so the weights need no join with the documents afterwards
    weights = tfidf(docs, idf, id_col, text, (label,))
    w = F.col("weight")
    sums = weights.groupBy("term", F.col(label).alias("class")).agg(F.sum(w).alias("s1"), F.sum(w * w).alias("s2"))
    terms = written(idf.join(sums, "term"), "terms")
    all1, all2 = F.sum("s1") / float(rows or 1), F.sum("s2") / float(rows or 1)
    per_term = terms.groupBy("term").agg(F.greatest(all2 - all1 * all1, F.lit(0.0)).alias("variance"))
    n_terms, top = per_term.agg(F.count("*"), F.max("variance")).first()
    # without any variance the smoothing has nothing to scale with, so it stands for itself
    return BayesFit(classes, terms, rows, n_terms, top or 1.0)


def _moments(fit: BayesFit, smoothing: float) -> tuple[Column, Column]:
    mean = F.col("s1") / F.col("n")
    variance = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    return mean, variance + F.lit(smoothing * fit.max_variance)


def base_scores(fit: BayesFit, smoothing: list[float]) -> DataFrame:
    """Score of an empty document per class, `(class, base_0, rank_0, ...)`; the best class has rank 0."""
    sums = []
    for s, value in enumerate(smoothing):
        mean, variance = _moments(fit, value)
        sums.append(F.sum(-0.5 * F.log(2 * math.pi * variance) - 0.5 * mean * mean / variance).alias(f"sum_{s}"))
    known = fit.terms.join(small(fit.classes), "class").groupBy("class").agg(F.count("*").alias("known"), *sums)
    scored = fit.classes.join(small(known), "class", "left")
    absent = F.lit(fit.n_terms) - F.coalesce("known", F.lit(0))
    columns = []
    for s, value in enumerate(smoothing):
        # zeros everywhere: mean 0 and the variance that smoothing alone gives
        zero = -0.5 * math.log(2 * math.pi * value * fit.max_variance)
        score = F.log(F.col("n") / F.lit(float(fit.rows))) + F.coalesce(f"sum_{s}", F.lit(0.0)) + absent * F.lit(zero)
        columns.append(score.alias(f"base_{s}"))
    based = scored.select("class", *columns)
    # one row per class
    for s in range(len(smoothing)):
        order = Window.orderBy(F.desc(f"base_{s}"), "class")
        based = based.withColumn(f"rank_{s}", F.row_number().over(order) - 1)
    return written(based, "bases")


def predict_bayes(
    fit: BayesFit,
    docs: DataFrame,
    smoothing: list[float],
    id_col: str = "id",
    text: str = "text_clean",
    broadcast_bytes: int = BROADCAST_BYTES,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """`(id, prediction_0, prediction_1, ...)`, one prediction per smoothing value; the first class wins ties.

    All smoothing values share one pass. What a term adds to a class without it is the same for all
    such classes, so scores are counted from there: a document only adds up the classes its terms
    are known in, and the best of all other classes is the first of the base order that is not
    among them. A document without any known term gets the base order's first.
    """
    count = range(len(smoothing))
    bases = base_scores(fit, smoothing)
    changes = {}
    for s, value in enumerate(smoothing):
        mean, variance = _moments(fit, value)
        changes[f"a_{s}"] = mean / variance
        changes[f"b_{s}"] = 0.5 / variance - 0.5 / (value * fit.max_variance)
    names = list(changes)
    per_class = F.struct("class", *[changes[name].alias(name) for name in names])
    factors = fit.terms.join(small(fit.classes), "class").groupBy("term").agg(
        F.first("df").alias("n"), F.first("idf").alias("idf"), F.collect_list(per_class).alias("by_class")
    )
    factors = written(factors, "factors")
    words = lookup_join(
        term_counts(docs, id_col, text), factors.drop("n"), "term", id_col, "inner", factors.select("term", "n"),
        broadcast_bytes, floor,
    )
    # a weight is tf * idf over the length of the document; a row without a class sums up that length
    raw = F.col("tf") * F.col("idf")
    no_class = F.struct(
        F.lit(None).cast(fit.classes.schema["class"].dataType).alias("class"), *[F.lit(0.0).alias(name) for name in names]
    )
    spread = words.select(
        id_col, raw.alias("_raw"), F.explode(F.concat("by_class", F.array(no_class))).alias("_of")
    ).select(id_col, "_raw", "_of.*")
    square = F.col("_raw") * F.col("_raw")
    sums = spread.groupBy(id_col, "class").agg(
        F.sum(square).alias("q"),
        *[F.sum((F.col("_raw") if name.startswith("a") else square) * F.col(name)).alias(name) for name in names],
    )
    sums = sums.join(small(bases), "class", "left")
    found = F.struct("class", *names, *[f"base_{s}" for s in count], *[f"rank_{s}" for s in count])
    per_doc = sums.groupBy(id_col).agg(
        F.max(F.when(F.col("class").isNull(), F.col("q"))).alias("q"),
        F.collect_list(F.when(F.col("class").isNotNull(), found)).alias("found"),
    )
    everyone = docs.select(id_col).join(per_doc, id_col, "left")
    for s in count:
        score = lambda x: x[f"base_{s}"] + x[f"a_{s}"] / F.sqrt("q") - x[f"b_{s}"] / F.col("q")  # noqa: B023, E731
        scored = F.transform("found", lambda x: F.struct((-score(x)).alias("score"), x["class"].alias("class")))  # noqa: B023
        ranks = F.array_sort(F.transform("found", lambda x: x[f"rank_{s}"]))  # noqa: B023
        # the first rank that none of the classes found has
        gap = F.aggregate(ranks, F.lit(0), lambda at, rank: F.when(rank == at, at + 1).otherwise(at))
        others = bases.select(
            F.col(f"rank_{s}").alias("_rank"),
            F.struct((-F.col(f"base_{s}")).alias("score"), "class").alias("_other"),
        )
        best = everyone.withColumn("_best", F.array_min(scored)).withColumn("_gap", F.coalesce(gap, F.lit(0)))
        everyone = best.join(small(others), F.col("_gap") == F.col("_rank"), "left").withColumn(
            f"prediction_{s}", F.least("_best", "_other")["class"]
        ).drop("_best", "_gap", "_rank", "_other")
    return everyone.select(id_col, *[f"prediction_{s}" for s in count])


def cross_validate_bayes(
    docs: DataFrame,
    label: str,
    smoothing: list[float],
    folds: int,
    fold: str = "fold",
    id_col: str = "id",
    text: str = "text_clean",
    parallelism: int = 2,
) -> DataFrame:
    """`(grid_index, score)`: mean accuracy over the folds per smoothing value, all folds in one job.

    The fold is a key. Texts are split into terms once, as `(id, label, fold, term, tf)`. Model k
    learns from the rows of all other folds: document frequencies, idf, weights and class sums of
    every model come from one pass in which each row is sent to the models it trains, and each
    document of fold k is scored by model k only. Vocabulary and statistics of a model come from its
    training folds alone, exactly as a separate fit would have them. `parallelism` is not used any
    more; it is kept for callers.
    """
    del parallelism
    count = range(len(smoothing))
    counts = written(term_counts(docs, id_col, text, (label, fold)), "fold-counts")
    models = F.array(*[F.lit(k) for k in range(folds)])
    trains = F.filter(models, lambda k: k != F.col(fold))  # the models a row of this fold trains

    sizes = docs.groupBy(fold, F.col(label).alias("class")).agg(F.count("*").alias("n"))
    classes = sizes.select(F.explode(trains).alias("model"), "class", "n").groupBy("model", "class").agg(F.sum("n").alias("n"))
    classes = materialize(classes)  # folds x classes rows
    totals = classes.groupBy("model").agg(F.sum("n").alias("rows"))

    per_fold = counts.groupBy(fold, "term").agg(F.count("*").alias("df"))
    freq = per_fold.select(F.explode(trains).alias("model"), "term", "df").groupBy("model", "term").agg(F.sum("df").alias("df"))
    idf = F.log((F.lit(1.0) + F.col("rows")) / (F.lit(1.0) + F.col("df"))) + 1.0
    idfs = written(freq.join(F.broadcast(totals), "model").select("model", "term", "df", idf.alias("idf")), "fold-idf")

    train = counts.select(F.explode(trains).alias("model"), id_col, label, "term", "tf")
    known = lookup_join(train, idfs.select("model", "term", "idf"), ["model", "term"], id_col, "inner", idfs.select("model", "term", F.col("df").alias("n")))
    raw = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("model", id_col)))
    weights = known.select("model", id_col, F.col(label).alias("class"), "term", (raw / length).alias("weight"))
    w = F.col("weight")
    sums = weights.groupBy("model", "term", "class").agg(F.sum(w).alias("s1"), F.sum(w * w).alias("s2"))
    terms = written(idfs.join(sums, ["model", "term"]), "fold-terms")

    each = terms.groupBy("model", "term").agg(F.sum("s1").alias("a1"), F.sum("s2").alias("a2")).join(F.broadcast(totals), "model")
    mean_all = F.col("a1") / F.col("rows")
    variance_all = F.greatest(F.col("a2") / F.col("rows") - mean_all * mean_all, F.lit(0.0))
    spread = each.groupBy("model").agg(F.count("*").alias("n_terms"), F.max(variance_all).alias("top"))
    # without any variance the smoothing has nothing to scale with, so it stands for itself
    stats = materialize(
        totals.join(spread, "model", "left").select(
            "model", "rows", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
            F.when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0)).alias("top"),
        )
    )

    rich = terms.join(F.broadcast(classes), ["model", "class"]).join(F.broadcast(stats), "model")
    mean = F.col("s1") / F.col("n")
    raw_variance = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    variances = {s: raw_variance + F.lit(value) * F.col("top") for s, value in enumerate(smoothing)}
    per_sum = [F.sum(-0.5 * F.log(2 * math.pi * variances[s]) - 0.5 * mean * mean / variances[s]).alias(f"sum_{s}") for s in count]
    held = rich.groupBy("model", "class").agg(F.count("*").alias("known"), *per_sum)
    scored = classes.join(F.broadcast(stats), "model").join(held, ["model", "class"], "left")
    absent = F.col("n_terms") - F.coalesce("known", F.lit(0))
    based = scored.select(
        "model",
        "class",
        *[
            (
                F.log(F.col("n") / F.col("rows"))
                + F.coalesce(f"sum_{s}", F.lit(0.0))
                + absent * (-0.5 * F.log(F.lit(2 * math.pi * value) * F.col("top")))
            ).alias(f"base_{s}")
            for s, value in enumerate(smoothing)
        ],
    )
    for s in count:
        based = based.withColumn(f"rank_{s}", F.row_number().over(Window.partitionBy("model").orderBy(F.desc(f"base_{s}"), "class")) - 1)
    bases = materialize(based)

    changes = {}
    for s, value in enumerate(smoothing):
        changes[f"a_{s}"] = mean / variances[s]
        changes[f"b_{s}"] = 0.5 / variances[s] - 0.5 / (F.lit(value) * F.col("top"))
    names = list(changes)
    per_class = F.struct("class", *[changes[name].alias(name) for name in names])
    factors = written(
        rich.groupBy("model", "term").agg(F.first("df").alias("n"), F.first("idf").alias("idf"), F.collect_list(per_class).alias("by_class")),
        "fold-factors",
    )
    valid = counts.select(F.col(fold).alias("model"), id_col, "term", "tf")
    words = lookup_join(valid, factors.drop("n"), ["model", "term"], id_col, "inner", factors.select("model", "term", "n"))
    no_class = F.struct(F.lit(None).cast(classes.schema["class"].dataType).alias("class"), *[F.lit(0.0).alias(name) for name in names])
    spread_rows = words.select("model", id_col, raw.alias("_raw"), F.explode(F.concat("by_class", F.array(no_class))).alias("_of"))
    spread_rows = spread_rows.select("model", id_col, "_raw", "_of.*")
    square = F.col("_raw") * F.col("_raw")
    doc_sums = spread_rows.groupBy("model", id_col, "class").agg(
        F.sum(square).alias("q"),
        *[F.sum((F.col("_raw") if name.startswith("a") else square) * F.col(name)).alias(name) for name in names],
    )
    doc_sums = doc_sums.join(F.broadcast(bases), ["model", "class"], "left")
    found = F.struct("class", *names, *[f"base_{s}" for s in count], *[f"rank_{s}" for s in count])
    per_doc = doc_sums.groupBy("model", id_col).agg(
        F.max(F.when(F.col("class").isNull(), F.col("q"))).alias("q"),
        F.collect_list(F.when(F.col("class").isNotNull(), found)).alias("found"),
    )
    everyone = docs.select(F.col(fold).alias("model"), id_col, F.col(label).alias("label")).join(per_doc, ["model", id_col], "left")
    for s in count:
        score = lambda x: x[f"base_{s}"] + x[f"a_{s}"] / F.sqrt("q") - x[f"b_{s}"] / F.col("q")  # noqa: B023, E731
        scored_classes = F.transform("found", lambda x: F.struct((-score(x)).alias("score"), x["class"].alias("class")))  # noqa: B023
        ranks = F.array_sort(F.transform("found", lambda x: x[f"rank_{s}"]))  # noqa: B023
        gap = F.aggregate(ranks, F.lit(0), lambda at, rank: F.when(rank == at, at + 1).otherwise(at))
        others = bases.select(
            F.col("model").alias("_model"), F.col(f"rank_{s}").alias("_rank"),
            F.struct((-F.col(f"base_{s}")).alias("score"), "class").alias("_other"),
        )
        best = everyone.withColumn("_best", F.array_min(scored_classes)).withColumn("_gap", F.coalesce(gap, F.lit(0)))
        fits = (F.col("model") == F.col("_model")) & (F.col("_gap") == F.col("_rank"))
        everyone = best.join(F.broadcast(others), fits, "left").withColumn(
            f"prediction_{s}", F.least("_best", "_other")["class"]
        ).drop("_best", "_gap", "_model", "_rank", "_other")
    hits = [F.avg((F.col(f"prediction_{s}") == F.col("label")).cast("int")).alias(f"hit_{s}") for s in count]
    per_model = everyone.groupBy("model").agg(*hits)
    long = per_model.select(F.posexplode(F.array(*[f"hit_{s}" for s in count])).alias("grid_index", "score"))
    return long.groupBy("grid_index").agg(F.avg("score").alias("score"))
