import pandas as pd
import pytest
from pyspark.sql import functions as F

from taskatlas.operators import exposure as ex
from taskatlas.operators import flows, quadrants
from taskatlas.operators.columns import RESULT_COLUMNS
from taskatlas.plans.views import FIRST_YEAR, task_counts

COUNTS = "soc_code string, title string, task string, scale_name string, task_category string, data_value double, ai_category string, year int, matches long"


def row(soc, task, value, matches, *, title="T", scale="Importance", cat="ml", year=2023):
    return (soc, title, task, scale, "Core", value, cat, year, matches)


def test_documented_example(spark):
    rows = [row("15", "a", 4.5, 100), row("15", "b", 4.2, 50), row("15", "c", 3.0, 50), row("15", "d", 1.0, 900, scale="Frequency")]
    assert ex.exposure(spark.createDataFrame(rows, COUNTS)).first()["exposure"] == 4.05


def test_zero_null_and_rounding_rules(spark):
    rows = [
        row("zero", "a", 4.0, 0), row("zero", "b", 2.0, 0),
        row("nulls", "a", None, 5), row("nulls", "b", 3.0, None), row("nulls", "c", 2.0, 1),
        row(None, "a", 4.0, 3), row("no title", "a", 4.0, 3, title=None),
        row("half", "a", 2.0, 19999), row("half", "b", 3.0, 1),
    ]
    df = spark.createDataFrame(rows, COUNTS)
    got = {r["soc_code"]: r["exposure"] for r in ex.exposure(df).collect()}
    assert got == {"zero": 0.0, "nulls": 2.0, "half": 2.0}  # 2.00005 rounds to the even neighbour
    assert ex.unusable_rows(df).first().asDict() == {"rows": 9, "no_importance": 1, "no_count": 1, "no_occupation": 2}


def test_exposure_stays_within_the_ratings(spark, sf_dir):
    rows = ex.exposure(task_counts(spark, sf_dir)).agg(F.min("exposure"), F.max("exposure")).first()
    assert rows[0] >= 1.0 and rows[1] <= 5.0


def test_reports_match_pandas(spark, sf_dir):
    exposed = ex.exposure(task_counts(spark, sf_dir))
    pdf = exposed.toPandas()
    wide = pdf.pivot(index=["soc_code", "title", "ai_category"], columns="year", values="exposure").reset_index()
    years = sorted(pdf["year"].unique())
    want = wide.groupby("ai_category")[years].mean().mean(axis=1)
    got = {r["ai_category"]: r["mean_exposure"] for r in ex.mean_by_category(exposed).collect()}
    assert got == pytest.approx(want.to_dict(), abs=1e-6)
    top = wide.groupby(["soc_code", "title"])[years].mean().mean(axis=1).nlargest(10)
    assert [r["soc_code"] for r in ex.top_occupations(exposed).collect()] == [k[0] for k in top.index]


def test_growth_from_zero_is_null(spark):
    df = spark.createDataFrame([("a", "T", "ml", 2021, 0.0), ("a", "T", "ml", 2025, 2.0), ("b", "T", "ml", 2021, 2.0), ("b", "T", "ml", 2025, 3.0)],
                               "soc_code string, title string, ai_category string, year int, exposure double")
    rows = {r["soc_code"]: r["growth_percent"] for r in ex.growth(df, 2021, 2025).collect()}
    assert rows == {"a": None, "b": 50.0}
    assert ex.top_growth(df, 2021, 2025, 1).first()["soc_code"] == "b"


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.99, 1.0, 2.5, 3.0, 4.0, 5.0)], "e double")
    got = [r[0] for r in df.select(ex.exposure_band(F.col("e"))).collect()]
    assert got == ["minimal", "minimal", "low", "moderate", "high", "very high", "very high"]


def test_task_matches_fills_zeros_and_fans_out(spark):
    ratings = spark.createDataFrame([("s1", "T", "x", "Importance", "Core", 4.0), ("s2", "T", "x", "Importance", "Core", 3.0), ("s3", "T", "y", "Importance", "Core", 3.0)],
                                    ", ".join(f"{c} {'double' if c == 'data_value' else 'string'}" for c in RESULT_COLUMNS))
    counts = spark.createDataFrame([("x", "c1", 2021, 7), ("gone", "c1", 2021, 9)], "task string, category string, year int, matches long")
    rows = {(r["soc_code"], r["ai_category"], r["year"]): r["matches"] for r in ex.task_matches(ratings, counts, ["c1", "c2"], [2021, 2022]).collect()}
    assert len(rows) == 12
    assert {k: v for k, v in rows.items() if v} == {("s1", "c1", 2021): 7, ("s2", "c1", 2021): 7}


def expected_links(pdf, occupations, tasks):
    """Flow links from plain group-by steps in pandas."""
    out = set()
    for (year, cat), df in pdf.groupby(["year", "ai_category"]):
        df = df[df["task"].isin(tasks.get(cat, [])) & df["soc_code"].isin(occupations)].copy()
        if df.empty:
            continue
        total = df.groupby("soc_code")["matches"].transform("sum")
        df["c"] = (df["matches"] / total.where(total != 0)).fillna(0) * df["data_value"]
        for task, part in df.groupby("task"):
            if part["c"].sum() > 0.01:
                out.add((year, "category_task", cat, task, None, round(part["c"].sum(), 9)))
                out |= {(year, "task_occupation", cat, task, r.soc_code, round(r.c, 9)) for r in part.itertuples() if r.c > 0.01}
    return out


def test_flows_match_pandas(spark):
    rows = []
    for i in range(60):
        rows.append(row(f"o{i % 4}", f"t{i % 15}", 1.0 + i % 5, (i * 7) % 11, title=f"T{i % 4}", cat=f"c{i % 2}", year=2021 + i % 3))
    rows += [row("zero", "t1", 5.0, 0, title="Z", cat="c1", year=2021)]
    df = spark.createDataFrame(rows, COUNTS).repartition(3)
    top = flows.top_occupations(df, 2021, 3)
    tasks = flows.top_tasks(df, top, 2021, 4)
    links = {tuple(r) for r in flows.flow_links(df, top, tasks).withColumn("value", F.round("value", 9)).collect()}
    by_cat = tasks.toPandas().groupby("ai_category")["task"].apply(list).to_dict()
    assert links == expected_links(pd.DataFrame(rows, columns=df.columns), [r["soc_code"] for r in top.collect()], by_cat)
    nodes = flows.flow_nodes(df, top, tasks).orderBy("node_id").collect()
    assert [n["node_id"] for n in nodes] == list(range(len(nodes)))
    assert [n["kind"] for n in nodes] == ["category"] * 2 + ["task"] * tasks.count() + ["occupation"] * 3
    ranked = sorted((r["ai_category"], r["task_rank"], r["task"]) for r in tasks.collect())
    assert [(n["ai_category"], n["task"]) for n in nodes if n["kind"] == "task"] == [(c, t) for c, _, t in ranked]
    listed = sorted((-r["total_contribution"], r["soc_code"]) for r in top.collect())
    assert [n["soc_code"] for n in nodes if n["kind"] == "occupation"] == [c for _, c in listed]


def test_flow_nodes_of_a_null_category_and_of_no_tasks(spark):
    rows = [row("o1", f"t{i}", 3.0, 5 + i, cat=c, year=2021) for c in (None, "b") for i in range(3)]
    df = spark.createDataFrame(rows, COUNTS)
    top = flows.top_occupations(df, 2021, 2)
    tasks = spark.createDataFrame([(c, f"t{i}", 1.0, 2 - i) for c in (None, "b") for i in range(2)], "ai_category string, task string, total_contribution double, task_rank int")
    nodes = flows.flow_nodes(df, top, tasks).orderBy("node_id").collect()
    assert [(n["ai_category"], n["task"]) for n in nodes][2:6] == [(None, "t1"), (None, "t0"), ("b", "t1"), ("b", "t0")]
    assert [n["node_id"] for n in nodes] == list(range(7))
    assert [n["ai_category"] for n in nodes][:2] == [None, "b"]
    none = flows.flow_nodes(df, top, tasks.limit(0)).orderBy("node_id").collect()
    assert [n["kind"] for n in none] == ["category"] * 2 + ["occupation"] * top.count()


def test_contributions_of_an_occupation_without_matches_are_zero(spark):
    df = spark.createDataFrame([row("z", "a", 4.0, 0), row("z", "b", 3.0, 0), row("y", "a", 4.0, 2)], COUNTS)
    got = {(r["soc_code"], r["task"]): r["contribution"] for r in flows.contributions(df).collect()}
    assert got == {("z", "a"): 0.0, ("z", "b"): 0.0, ("y", "a"): 4.0}


def test_quadrants_use_the_median_of_non_zero_matches(spark):
    rows = [row("a", f"t{i}", v, m) for i, (v, m) in enumerate([(4.0, 10), (4.0, 2), (3.9, 10), (1.0, 0), (4.5, 4)])]
    df = spark.createDataFrame(rows, COUNTS)
    assert quadrants.match_cut(df).first()["cut"] == 7.0
    got = {r["quadrant"]: (r["n"], r["percent"]) for r in quadrants.quadrant_counts(df).collect()}
    assert got == {"high_concern": (1, 20.0), "protected": (2, 40.0), "routine_automation": (1, 20.0), "minimal_impact": (1, 20.0)}
    assert quadrants.importance_summary(df, high_matches=4).first().asDict() == {"year": 2023, "important_rows": 3, "many_matches": 2}
    assert [r["task"] for r in quadrants.high_concern(df).collect()] == ["t0"]


def test_task_points_drop_zeros_and_take_the_first_occupation(spark):
    rows = [row("b", "x", 4.0, 3, title="B"), row("a", "x", 4.0, 2, title="A"), row("a", "y", 4.0, 0)]
    got = [tuple(r) for r in quadrants.task_points(spark.createDataFrame(rows, COUNTS)).collect()]
    assert got == [(2023, "x", 4.0, 5, "A")]


def test_first_year_of_the_views(spark, sf_dir):
    assert task_counts(spark, sf_dir).agg(F.min("year")).first()[0] == FIRST_YEAR


def test_no_year_is_lost(spark):
    """Years far away, years without a match and null years stay; the last two have no cut."""
    rows = [row("a", "x", 4.5, 5, year=1850), row("a", "y", 2.0, 1, year=1850), row("a", "x", 4.5, 0, year=2021), row("a", "x", 4.5, 3, year=2022), row("a", "x", 4.5, 2, year=None)]
    df = spark.createDataFrame(rows, COUNTS)
    got = {}
    for r in quadrants.quadrant_counts(df).collect():
        got.setdefault(r["year"], {})[r["quadrant"]] = (r["n"], r["percent"])
    none = (0, 0.0)
    assert got[1850] == {"high_concern": (1, 50.0), "protected": none, "routine_automation": none, "minimal_impact": (1, 50.0)}
    assert got[2021] == dict.fromkeys(got[1850], none)
    assert got[2022]["high_concern"] == got[None]["high_concern"] == (1, 100.0)
    assert {r["year"] for r in quadrants.high_concern(df).collect()} == {1850, 2022, None}
    assert quadrants.match_cut(df, keys=()).first()["cut"] == 2.5
