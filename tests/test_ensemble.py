import pytest
from pyspark.sql import functions as F

from taskatlas.operators import ensemble, filters, reports

PREDICTIONS = "id int, predictions array<struct<model_pos int, model string, category string, confidence double, weight int>>"


def rows_of(*cases):
    return [
        (i, [(pos, f"m{pos}", c, conf, w) for pos, (c, conf, w) in enumerate((*p, 1)[:3] for p in case)]) for i, case in enumerate(cases)
    ]


CASES = [
    [("computer vision", 0.89), ("computer vision", 0.85), ("computer vision", 0.91), ("machine learning", 0.72), ("computer vision", 0.87)],
    [("NLP", 0.82), ("NLP", 0.79), ("NLP", 0.65), ("machine learning", 0.85), ("machine learning", 0.80)],
    [("evolutionary computation", 0.78), ("evolutionary computation", 0.75), ("machine learning", 0.82), ("machine learning", 0.85), ("other", 0.70)],
    [("b", 0.5), ("a", 0.5)],
    [("a", None), (None, 0.9)],
    [("a", None), ("b", 0.2)],
]
WANT = [
    ("computer vision", 0.88, 4), ("NLP", 0.7533, 3), ("machine learning", 0.835, 2), ("b", 0.5, 1), (None, None, 0), ("b", 0.2, 1),
]


def results(df):
    return [
        (r["ensemble_category"], None if r["ensemble_confidence"] is None else round(r["ensemble_confidence"], 4), r["ensemble_votes"])
        for r in df.orderBy("id").collect()
    ]


def test_votes(spark):
    df = spark.createDataFrame(rows_of(*CASES), PREDICTIONS)
    assert results(ensemble.vote_rows(df)) == WANT
    assert results(ensemble.vote_long(ensemble.predictions_long(df).repartition(5))) == WANT


def test_weight_equals_listing_twice(spark):
    case = [("a", 0.6), ("b", 0.9), ("b", 0.2)]
    weighted = spark.createDataFrame(rows_of([(*case[0], 2), *case[1:]]), PREDICTIONS)
    twice = spark.createDataFrame(rows_of([case[0], *case]), PREDICTIONS)
    want = results(ensemble.vote_rows(twice))
    assert want == [("a", 0.6, 2)]
    assert results(ensemble.vote_rows(weighted, weighted=True)) == want
    assert results(ensemble.vote_long(ensemble.predictions_long(weighted), weighted=True)) == want


def test_combine_models(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.6), (None, "z", 0.1)], "id int, ai_category string, ai_category_confidence double")
    b = spark.createDataFrame([(1, "x", 0.7), (3, "y", 0.6), (None, "z", 0.1)], "id int, category string, confidence double")
    both = ensemble.combine_models([a, b], ["first"], "id")
    assert sorted((r["id"], r["model"], r["category"]) for r in both.collect()) == [(1, "first", "x"), (1, "model_2", "x")]
    wide = ensemble.wide_models(both, ["first", "model_2"]).first().asDict()
    assert wide == {"id": 1, "first_category": "x", "first_confidence": 0.5, "model_2_category": "x", "model_2_confidence": 0.7}
    with pytest.raises(ValueError, match="at least two"):
        ensemble.combine_models([a], None, "id")
    with pytest.raises(ValueError, match="id column"):
        ensemble.combine_models([a, b.withColumnRenamed("id", "key")], None, "id")
    with pytest.raises(ValueError, match="category column"):
        ensemble.combine_models([a, b.drop("category")], None, "id")


def test_agreement_counts_null_as_unequal(spark):
    wide = spark.createDataFrame([("x", "x", "y"), (None, None, "y"), ("x", "z", "x"), ("x", "x", "x")], "a_category string, b_category string, c_category string")
    got = {(r["model_a"], r["model_b"]): r["agreement"] for r in ensemble.pair_agreement(wide, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 0.25}


def test_quality_filter_and_report(spark):
    df = spark.createDataFrame([(0.9, 5), (0.7, 4), (0.69, 5), (None, 5), (0.8, 3)], "ensemble_confidence double, ensemble_votes int")
    assert filters.quality_filter(df, min_confidence=0.7, min_votes=4).count() == 2
    report = filters.quality_report(df, min_confidence=0.7, min_votes=4).first().asDict()
    assert report == {"total": 5, "after_confidence": 3, "removed_by_confidence": 2, "after_votes": 2, "removed_by_votes": 1, "kept_percent": 40.0}


def test_relabel_low_confidence(spark):
    df = spark.createDataFrame([(1, "a", 0.4), (2, "b", 0.4), (3, "c", 0.5)], "id int, category string, confidence double")
    second = spark.createDataFrame([(1, "z", 0.9), (2, None, None), (3, "z", 0.9)], "id int, category string, confidence double")
    rows = {r["id"]: (r["category"], r["confidence"]) for r in ensemble.relabel_low_confidence(df, second, "id").collect()}
    assert rows == {1: ("z", 0.9), 2: ("b", 0.4), 3: ("c", 0.5)}


def test_distribution_counts_nulls_in_the_share_only(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in reports.category_distribution(df, "c").collect()] == [("a", 2, 50.0), ("b", 1, 25.0)]


def test_bands_are_half_open(spark):
    df = spark.createDataFrame([(0.7,), (0.5,), (0.4999,), (None,)], "confidence double")
    assert [tuple(r) for r in reports.confidence_bands(df).collect()] == [("high", 1, 25.0), ("medium", 1, 25.0), ("low", 1, 25.0)]


def test_full_disagreement(spark):
    df = spark.createDataFrame(rows_of([("a", 0.1), ("b", 0.1)], [("a", 0.1), ("a", 0.2)]), PREDICTIONS)
    assert [r["id"] for r in ensemble.full_disagreement(df, 2).collect()] == [0]
    kept = ensemble.pick_models(df, ["m1"]).select(F.size("predictions")).distinct().collect()
    assert [tuple(r) for r in kept] == [(1,)]
