import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskatlas.functions import text as tx
from taskatlas.operators import columns, filters
from taskatlas.operators.classify import CATEGORIES

_SPARK = {}


@pytest.fixture(autouse=True)
def keep_session(spark):
    _SPARK["s"] = spark


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(["a", "B", "é", "."] + [chr(p) for p in tx.WHITE_POINTS] + ["​", "\x08", "᠎"])), min_size=30, max_size=60))
def test_clean_text_is_python_white_space(texts):
    spark = _SPARK["s"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, t string").select("i", tx.clean_text(F.col("t")).alias("c")).collect()}
    assert got == {i: re.sub(r"\s+", " ", t).strip() for i, t in rows}


def test_clean_null(spark):
    assert values(spark, [(None,)], "t string", tx.clean_text(F.col("t"))) == [("",)]


def test_combine_text(spark):
    rows = [("a", "b"), (None, "b"), ("a", None), (None, None), ("", ""), ("　a", "b\x1c")]
    title, abstract = F.col("t"), F.col("a")
    schema = "t string, a string"
    assert [v[0] for v in values(spark, rows, schema, tx.combine_text(title, abstract))] == ["a. b", ". b", "a.", "", "", "a. b"]
    loose = values(spark, rows, schema, tx.combine_text(title, abstract, empty_rule=False))
    assert [v[0] for v in loose][3:5] == [".", "."]
    plain = values(spark, rows, schema, tx.combine_text(title, abstract, empty_rule=False, strip_ends=False))
    assert [v[0] for v in plain][:4] == ["a. b", ". b", "a. ", ". "]


def test_responses(spark):
    names = [n for n, _ in CATEGORIES]
    rows = [(" NLP\n", "t", "a"), ("Machine Learning", "t", "a"), ("cooking", "t", "a"), (None, "t", "a"), ("nlp", "", None), ("nlp", None, "a")]
    cols = F.col("r"), F.col("t"), F.col("a")
    got = values(spark, rows, "r string, t string, a string", tx.normalise_response(*cols, names))
    assert [g[0] for g in got] == ["NLP", "machine learning", "unknown", "classification_failed", "missing_data", "NLP"]
    strict = values(spark, rows, "r string, t string, a string", tx.normalise_response(*cols, names, strict=True))
    assert [g[0] for g in strict][:2] == ["unknown", "machine learning"]


@pytest.mark.parametrize(
    "stem, category",
    [
        ("AI_2021to2025_abstractTitleFor_machine_learning_0.75", "machine_learning"),
        ("AI_2021.0to2025.0_abstractTitleFor_nlp_0.8", "nlp"),
        ("AI_2021to2025_abstractTitleFor_planning_and_control_high", "planning_and_control"),
        ("abstractTitleFor", ""),
        ("summary", "unknown"),
        ("AI_2021-2025_abstractTitleFor_nlp_0.75", ""),
    ],
)
def test_category_from_name(spark, stem, category):
    assert values(spark, [(stem,)], "s string", tx.category_from_name(F.col("s"))) == [(category,)]


def test_labels_and_slugs(spark):
    row = values(
        spark, [("AI Hard*ware", "planning_and_control", "x" * 41)], "c string, l string, t string",
        tx.result_name(F.col("c"), F.lit(2021), F.lit(2025), 0.75), tx.category_title(F.col("l")), tx.shorten(F.col("t"), 40),
    )
    assert row == [("AI_2021to2025_abstractTitleFor_ai_hardware_0.75", "Planning And Control", "x" * 40 + "...")]


def test_prompt_mentions_every_category(spark):
    text = values(spark, [("T", None)], "t string, a string", tx.prompt(F.col("t"), F.col("a"), CATEGORIES))[0][0]
    assert all(f"- {n}: {d}" in text for n, d in CATEGORIES)
    assert "Patent Title: T\nPatent Abstract: \n" in text and text.endswith("Category:\n")


def test_column_fallbacks(spark):
    df = spark.createDataFrame([(5, "x", "2020-03-01"), (9, "y", "never"), (7, "z", None)], "n int, name string, published_date string")
    out = columns.prepare_documents(df, "n")
    rows = {r["n"]: r for r in out.collect()}
    assert [rows[n]["application_id"] for n in (5, 7, 9)] == [0, 1, 2]
    assert [rows[n]["year"] for n in (5, 9, 7)] == [2020, None, None]
    assert rows[5]["application_title"] == "x" and rows[5]["topic_label"] == "Machine Learning"
    assert columns.with_year(df.select("n")).first()["year"] == 2021
    tasks = columns.prepare_tasks(spark.createDataFrame([("a  b",)], "`Core Tasks` string"))
    assert tuple(tasks.select("task", "title").first()) == ("a b", "Occupation")
    with pytest.raises(ValueError, match="missing columns"):
        columns.require_columns(df, ["n", "absent"])
    with pytest.raises(ValueError, match="row order"):
        columns.with_id(df)


def test_document_filters(spark):
    docs = spark.createDataFrame(
        [(1, "AI 1", "Machine Learning", 2021), (2, "AI 2", "Neural Networks", 2021), (3, "Other", "Manufacturing", 2022)],
        "id int, title string, topic_label string, year int",
    )
    topics = spark.createDataFrame([(1, "Machine Learning"), (1, "Neural Networks"), (0, "Manufacturing")], "flag int, topic string")
    assert {r["id"] for r in filters.filter_documents(docs, topics=topics).collect()} == {1, 2}
    assert filters.filter_documents(docs).count() == 3
    assert filters.in_year(docs, 2021).count() == 2
    labelled = spark.createDataFrame([("nlp",), (None,), ("unknown",), ("missing_data",), ("classification_failed",)], "c string")
    assert [r["c"] for r in filters.filter_documents(labelled, category_col="c").collect()] == ["nlp"]


def test_year_filters(spark):
    df = spark.createDataFrame([("2021.0",), ("2020",), ("soon",), (None,)], "year string")
    assert [r["year"] for r in filters.from_year(df, 2021).collect()] == [2021]
    dated = spark.createDataFrame([("2021-05-01",), ("2019-05-01",)], "published_date string")
    assert filters.from_year(dated, 2020).count() == 1
    other = spark.createDataFrame([(2021, 1990)], "Year int, grant_year int")
    assert filters.from_first_year_column(other, 2000).count() == 1
    assert filters.from_first_year_column(dated, 2030).count() == 2


def test_task_search_never_matches_null(spark):
    df = spark.createDataFrame([("Analyse DATA",), ("cook",), (None,)], "task string")
    assert [r["task"] for r in filters.task_contains(df, "data").collect()] == ["Analyse DATA"]
