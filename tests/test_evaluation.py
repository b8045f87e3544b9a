import pytest

from claimsift.operators import evaluation as ev

PAIRS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "Unknown")] + [("c", "a")]


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [(i, t, p, 0.1 * i) for i, (t, p) in enumerate(PAIRS)] + [(99, None, "a", 1.0), (98, "a", None, 1.0)]
    return spark.createDataFrame(rows, "id bigint, ground_truth string, predicted_class string, confidence double")


def test_class_report(predictions):
    got = {r.label: r for r in ev.class_report(ev.confusion_counts(predictions)).collect()}
    assert set(got) == {"a", "b", "c", "Unknown"}
    assert got["a"].precision == pytest.approx(5 / 6) and got["a"].recall == pytest.approx(5 / 7)
    assert got["a"].f1 == pytest.approx(10 / 13) and got["a"].support == 7
    assert (got["c"].precision, got["c"].recall, got["c"].f1, got["c"].support) == (0, 0, 0, 1)
    assert (got["Unknown"].recall, got["Unknown"].support) == (0, 0)


def test_report_with_confidence(predictions):
    got = {r.label: r for r in ev.report_with_confidence(predictions).collect()}
    assert got["accuracy"].precision == pytest.approx(8 / 12) and got["accuracy"].avg_confidence is None
    assert got["macro avg"].recall == pytest.approx((5 / 7 + 3 / 4) / 4)
    assert got["weighted avg"].f1 == pytest.approx((7 * 10 / 13 + 4 * 2 * 3 / 9) / 12)
    assert got["a"].avg_confidence == pytest.approx(sum(0.1 * i for i in range(7)) / 7)
    assert got["Unknown"].avg_confidence is None
    parts = {r.label: r for r in ev.report_averages(ev.confusion_counts(predictions)).collect()}
    assert parts["macro avg"].f1 == pytest.approx(got["macro avg"].f1)
    assert ev.weighted_f1(ev.confusion_counts(predictions)).first()[0] == pytest.approx(got["weighted avg"].f1)


def test_auc(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] * 2
    df = spark.createDataFrame(rows, "ground_truth string, predicted_class string")
    confusion = ev.confusion_counts(df)
    area = (3 / 4 + 1 - 2 / 4) / 2
    assert ev.auc_macro(confusion).first()[0] == pytest.approx(area)
    assert ev.auc_weighted_positional(confusion).first()[0] == pytest.approx(area)
    three = {r.point: (r.fpr, r.tpr) for r in ev.roc_points(confusion).filter("label = 'a'").collect()}
    assert three == {0: (0.0, 0.0), 1: (0.5, 0.75), 2: (1.0, 1.0)}


def test_positional_alignment_and_undefined_areas(spark, predictions):
    shifted = spark.createDataFrame(
        [("a", "x")] * 3 + [("b", "y")] * 2 + [("b", "x")], "ground_truth string, predicted_class string"
    )
    a, b = (1 + 1 - 1 / 3) / 2, (2 / 3 + 1 - 0) / 2
    assert ev.auc_weighted_positional(ev.confusion_counts(shifted)).first()[0] == pytest.approx((3 * a + 3 * b) / 6)
    assert ev.auc_weighted_positional(ev.confusion_counts(predictions.filter("ground_truth <> 'c'"))).first()[0] is None
    one = spark.createDataFrame([("a", "a")], "ground_truth string, predicted_class string")
    assert ev.auc_macro(ev.confusion_counts(one)).first()[0] is None


def test_matrix_and_distributions(predictions):
    c = ev.confusion_counts(predictions)
    row = ev.confusion_matrix(c, ["a", "b", "Unknown"]).filter("truth = 'a'").first()
    assert (row["a"], row["b"], row["Unknown"], row["other"]) == (5, 2, 0, 0)
    row = ev.confusion_matrix(c, ["zzz"]).filter("truth = 'a'").first()
    assert (row["zzz"], row["other"]) == (0, 7)
    got = {(r.kind, r.label): r.n for r in ev.class_distributions(c).collect()}
    assert got[("truth", "a")] == 7 and got[("predicted", "Unknown")] == 1
    wrong = ev.misclassified(predictions, "predicted_class", first=2).collect()
    assert [r.id for r in wrong] == [5, 6]
