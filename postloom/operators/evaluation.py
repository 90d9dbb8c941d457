"""Confusion matrices and classification reports from (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_set(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """`(label, prediction, n)` for the pairs that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_percent(counts: DataFrame) -> DataFrame:
    """Add `percent`, the share of each prediction within its true class."""
    total = F.sum("n").over(Window.partitionBy("label"))
    return counts.withColumn("percent", 100.0 * F.col("n") / total)


def confusion_matrix(counts: DataFrame, labels: list[str], value: str = "n") -> DataFrame:
    """Wide form with one column per predicted label and zeros where a pair does not occur."""
    return counts.groupBy("label").pivot("prediction", labels).agg(F.first(value)).na.fill(0).orderBy("label")


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def class_report(counts: DataFrame) -> DataFrame:
    """`(label, precision, recall, f1, support)` per class, 0 where a denominator is 0."""
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("name"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"),
                     F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("prediction").alias("name"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"),
                     F.lit(0).cast("bigint").alias("hits")),
        )
    )
    sums = counts.select(sides.alias("s")).groupBy(F.col("s.name").alias("label")).agg(
        F.sum("s.support").alias("support"), F.sum("s.claimed").alias("claimed"), F.sum("s.hits").alias("hits")
    )
    return sums.select(
        "label",
        _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
    )


def report_totals(per_class: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows `accuracy`, `macro avg` and `weighted avg` that close a report."""
    accuracy = counts.agg(
        _ratio(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)), F.sum("n")).alias("score"),
        F.sum("n").alias("support"),
    ).select(
        F.lit("accuracy").alias("label"), F.col("score").alias("precision"), F.col("score").alias("recall"),
        F.col("score").alias("f1"), "support",
    )
    measures = ["precision", "recall", "f1"]
    macro = per_class.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return accuracy.unionByName(macro.select(F.lit("macro avg").alias("label"), *measures, "support")).unionByName(
        weighted.select(F.lit("weighted avg").alias("label"), *measures, "support")
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class rows followed by the totals; labels are values, never positions."""
    counts = confusion_counts(df, label, prediction)
    counts = counts.select(F.col("label").cast("string"), F.col("prediction").cast("string"), "n")
    per_class = class_report(counts)
    return per_class.unionByName(report_totals(per_class, counts))


def report_text(report: DataFrame) -> str:
    """The printed layout of a report (one line per class and three totals)."""
    totals = ["accuracy", "macro avg", "weighted avg"]
    rows = {row.label: row for row in report.collect()}
    width = max([len(name) for name in rows] + [len("weighted avg")])
    lines = [" " * width + "  precision    recall  f1-score   support", ""]
    for name in sorted(name for name in rows if name not in totals):
        row = rows[name]
        lines.append(f"{name:>{width}} {row.precision:>10.2f}{row.recall:>10.2f}{row.f1:>10.2f}{row.support:>10}")
    lines.append("")
    for name in totals:
        row = rows[name]
        scores = (
            f"{'':>10}{'':>10}{row.f1:>10.2f}"
            if name == "accuracy"
            else f"{row.precision:>10.2f}{row.recall:>10.2f}{row.f1:>10.2f}"
        )
        lines.append(f"{name:>{width}} {scores}{row.support:>10}")
    return "\n".join(lines) + "\n"
