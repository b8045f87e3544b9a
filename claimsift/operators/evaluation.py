"""Quality reports. Everything after the confusion counts works on label pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsift.fixed_values import LABELS, UNKNOWN


def attach_ground_truth(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of (file_name, ground_truth) onto predictions."""
    return predictions.join(labels.select("file_name", "ground_truth"), "file_name", "left")


def evaluable_rows(docs: DataFrame, predicted: str = "classified_category") -> DataFrame:
    return docs.dropna(subset=[predicted, "ground_truth"])


def confusion_counts(
    predictions: DataFrame,
    truth: str = "ground_truth",
    predicted: str = "predicted_class",
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., truth, predicted, n); partial counts before the only shuffle."""
    return (
        predictions.dropna(subset=[truth, predicted])
        .groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part, whole))


def _label_counts(confusion: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., label, tp, support, predicted_n, confidence_sum, confidence_n).

    Over true and predicted labels; confidences belong to the true label.
    """
    with_confidence = "confidence_sum" in confusion.columns
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    mass = F.col("confidence_sum") if with_confidence else F.lit(None).cast("double")
    mass_n = F.col("confidence_n") if with_confidence else zero

    def side(label: str, *values: Column) -> Column:
        names = ["tp", "support", "predicted_n", "confidence_sum", "confidence_n"]
        return F.struct(F.col(label).alias("label"), *[v.alias(n) for v, n in zip(values, names)])

    sides = F.array(
        side("truth", hit, F.col("n"), zero, mass, mass_n),
        side("predicted", zero, zero, F.col("n"), F.lit(None).cast("double"), zero),
    )
    rows = confusion.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    return rows.groupBy(*by, "label").agg(
        *[
            F.sum(c).alias(c)
            for c in ["tp", "support", "predicted_n", "confidence_sum", "confidence_n"]
        ]
    )


def _ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "precision": _share(F.col("tp"), F.col("predicted_n")),
            "recall": _share(F.col("tp"), F.col("support")),
            "f1": _share(2 * F.col("tp"), F.col("predicted_n") + F.col("support")),
        }
    )


def class_report(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, precision, recall, f1, support)."""
    return _ratios(_label_counts(confusion, by)).select(
        *by, "label", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support")
    )


def accuracy(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return confusion.groupBy(*by).agg(
        F.try_divide(right, F.sum("n")).alias("accuracy"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
    )


_METRICS = ["precision", "recall", "f1"]


def _full_report(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class rows and average rows in one chain from per-label counts.

    Grouping sets give every label and the overall row of each ``by`` group; the
    overall row then becomes the three average rows. No part is computed twice.
    ``counts`` may carry ``confidence_sum`` and ``confidence_n``.
    """
    weight = F.sum("support")
    labels = [F.col(c) for c in [*by, "label"]]
    rolled = _ratios(counts).groupingSets([labels, labels[:-1]], *labels).agg(
        F.grouping("label").alias("_overall"),
        *[F.avg(m).alias(m) for m in _METRICS],
        *[
            F.try_divide(F.sum(F.col(m) * F.col("support")), weight).alias(f"_w_{m}")
            for m in _METRICS
        ],
        F.try_divide(F.sum("tp"), weight).alias("_accuracy"),
        weight.cast("bigint").alias("support"),
        F.try_divide(F.sum("confidence_sum"), F.sum("confidence_n")).alias("avg_confidence"),
    )

    def row(label: Column, values: list[Column], confidence: Column) -> Column:
        named = [v.alias(m) for v, m in zip(values, _METRICS)]
        return F.struct(
            label.alias("label"), *named, F.col("support"), confidence.alias("avg_confidence")
        )

    plain = [F.col(m) for m in _METRICS]
    none = F.lit(None).cast("double")
    overall = F.array(
        row(F.lit("accuracy"), [F.col("_accuracy")] * 3, none),
        row(F.lit("macro avg"), plain, none),
        row(F.lit("weighted avg"), [F.col(f"_w_{m}") for m in _METRICS], none),
    )
    single = F.array(row(F.col("label"), plain, F.col("avg_confidence")))
    rows = F.when(F.col("_overall") == 1, overall).otherwise(single)
    return rolled.select(*by, "_overall", F.explode_outer(rows).alias("r")).select(
        *by, "_overall", "r.*"
    )


def report_averages(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``accuracy``, ``macro avg`` and ``weighted avg`` of the report."""
    report = _full_report(_label_counts(confusion, by), by)
    return report.filter("_overall = 1").select(*by, "label", *_METRICS, "support")


def weighted_f1(confusion: DataFrame) -> DataFrame:
    return class_report(confusion).agg(
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")
    )


def report_with_confidence(
    predictions: DataFrame,
    truth: str = "ground_truth",
    predicted: str = "predicted_class",
    confidence: str = "confidence",
) -> DataFrame:
    """Class rows and average rows, with the mean confidence per true label.

    One pass over the predictions: counts and confidence sums share the shuffle,
    everything else works on at most labels x labels rows.
    """
    cells = (
        predictions.dropna(subset=[truth, predicted])
        .groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
        .agg(
            F.count("*").alias("n"),
            F.sum(confidence).alias("confidence_sum"),
            F.count(confidence).alias("confidence_n"),
        )
    )
    return _full_report(_label_counts(cells, ()), ()).select(
        "label", *_METRICS, "support", "avg_confidence"
    )


def confusion_matrix(confusion: DataFrame, labels: Sequence[str] = (*LABELS, UNKNOWN)) -> DataFrame:
    """One row per true label, one column per predicted label, and ``other``.

    ``other`` counts the predictions outside ``labels``, so a row adds up to the label's support.
    """
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("bigint")
    predicted = F.col("predicted")
    return confusion.groupBy("truth").agg(
        *[count(predicted == label).alias(label) for label in labels],
        count(~predicted.isin(list(labels))).alias("other"),
    )


def _rates(pairs: DataFrame) -> DataFrame:
    """(label, support, tpr, fpr) from (label, tp, support, predicted_n, total)."""
    negatives = F.col("total") - F.col("support")
    return pairs.select(
        "label",
        "support",
        F.try_divide(F.col("tp"), F.col("support")).alias("tpr"),
        F.try_divide(F.col("predicted_n") - F.col("tp"), negatives).alias("fpr"),
    )


def class_rates(confusion: DataFrame) -> DataFrame:
    """One-vs-rest rates of hard predictions for every true label, aligned by name."""
    # a row per label: small enough for a window over all of them
    total = F.sum("support").over(Window.partitionBy())
    return _rates(
        _label_counts(confusion, ()).withColumn("total", total).filter("support > 0")
    )


def _area(tpr: Column, fpr: Column) -> Column:
    """Area under the two-segment curve of a hard prediction."""
    return (tpr + 1.0 - fpr) / 2.0


def auc_macro(confusion: DataFrame) -> DataFrame:
    """Mean class area over true labels; with two labels only the second one counts."""
    rates = class_rates(confusion).withColumn("area", _area(F.col("tpr"), F.col("fpr")))
    return rates.agg(
        F.when(F.count("*") == 2, F.max_by("area", "label"))
        .when(F.count("*") == F.count("area"), F.avg("area"))
        .alias("auc_macro")
    )


def auc_weighted_positional(confusion: DataFrame) -> DataFrame:
    """Support-weighted class area, with the two label sets aligned by position.

    The i-th true label in alphabetical order meets the i-th predicted label. NULL
    when the sets differ in size or a class has no negatives.
    """
    # the confusion counts are labels x labels rows: windows over all of them are small
    everything = Window.partitionBy()
    placed = confusion.select(
        F.dense_rank().over(everything.orderBy("truth")).alias("row"),
        F.dense_rank().over(everything.orderBy("predicted")).alias("col"),
        "n",
    )
    hit = F.when(F.col("row") == F.col("col"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("row").alias("label"), F.col("n").alias("s"), F.lit(0).alias("p"), hit.alias("h")),
        F.struct(F.col("col").alias("label"), F.lit(0).alias("s"), F.col("n").alias("p"), F.lit(0).alias("h")),
    )
    places = (
        placed.select(F.explode(sides).alias("x"))
        .groupBy("x.label")
        .agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted_n"), F.sum("x.h").alias("tp"))
        .withColumn("total", F.sum("support").over(everything))
    )
    aligned = (F.col("support") > 0) & (F.col("predicted_n") > 0)
    rates = _rates(places.withColumn("tp", F.when(aligned, F.col("tp")))).withColumn(
        "area", _area(F.col("tpr"), F.col("fpr"))
    )
    return rates.agg(
        F.when(
            F.count("*") == F.count("area"),
            F.try_divide(F.sum(F.col("area") * F.col("support")), F.sum("support")),
        ).alias("auc_weighted")
    )


def roc_points(confusion: DataFrame) -> DataFrame:
    """(label, point, fpr, tpr, auc): the three points of every class's curve."""
    rates = class_rates(confusion)
    point = lambda i, f, t: F.struct(
        F.lit(i).cast("bigint").alias("point"), f.alias("fpr"), t.alias("tpr")
    )
    points = F.array(
        point(0, F.lit(0.0), F.lit(0.0)),
        point(1, F.col("fpr"), F.col("tpr")),
        point(2, F.lit(1.0), F.lit(1.0)),
    )
    return rates.select(
        "label", _area(F.col("tpr"), F.col("fpr")).alias("auc"), F.explode(points).alias("p")
    ).select("label", "p.point", "p.fpr", "p.tpr", "auc")


def misclassified(
    docs: DataFrame, predicted: str = "classified_category", first: int | None = None
) -> DataFrame:
    """Wrong rows; with ``first``, the top rows by id as a report shows them."""
    wrong = evaluable_rows(docs, predicted).filter(F.col(predicted) != F.col("ground_truth"))
    return wrong if first is None else wrong.orderBy("id").limit(first)


def misclassification_counts(confusion: DataFrame) -> DataFrame:
    return confusion.filter(F.col("truth") != F.col("predicted"))


def class_distributions(confusion: DataFrame) -> DataFrame:
    """(kind, label, n) of true and predicted labels."""
    sides = F.array(
        F.struct(F.lit("truth").alias("kind"), F.col("truth").alias("label")),
        F.struct(F.lit("predicted").alias("kind"), F.col("predicted").alias("label")),
    )
    return (
        confusion.select(F.explode(sides).alias("s"), "n")
        .groupBy("s.kind", "s.label")
        .agg(F.sum("n").alias("n"))
    )
