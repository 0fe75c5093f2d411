"""Sources, sinks, streams, joins and quantiles on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskatlas.functions import text
from taskatlas.operators import dedup, filters, joins, ranking, reshape
from taskatlas.operators.quantiles import count_quantile, exact_quantiles, value_counts, values_once
from taskatlas.operators.reports import similarity_distribution
from taskatlas.sources import readers, storage, writers
from taskatlas.streaming import incremental


@pytest.mark.parametrize("suffix", ["csv", "tsv"])
def test_text_files_keep_every_character(spark, tmp_path, suffix):
    rows = [(1, 'say "hi", twice', "line one\nline two\ttab", 2021, " padded "), (2, None, "", 2022, "a\\b")]
    path = f"{tmp_path}/docs.{suffix}"
    writers.save_table(spark.createDataFrame(rows, readers.DOCUMENT_SCHEMA), path)
    got = readers.read_delimited(spark, path, readers.DOCUMENT_SCHEMA, multi_line=True)
    # An empty field is a null, quoted or not.
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], (2, None, None, 2022, "a\\b")]
    writers.save_table(got, path.replace("docs", "twice"))
    both = readers.read_documents(spark, f"{tmp_path}/{{docs,twice}}.{suffix}", multi_line=True)
    assert both.count() == 2


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="unsupported"):
        writers.save_table(spark.range(1), "/tmp/none.xlsx")


def test_ratings_need_their_columns(spark, tmp_path):
    path = f"{tmp_path}/ratings.csv"
    writers.save_table(spark.createDataFrame([("t", "x")], "Task string, Title string"), path)
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_ratings(spark, path)
    assert readers.read_ratings(spark, path, required=("task",)).columns == ["task", "title"]


def test_results_with_different_years(spark, tmp_path):
    head = "O*NET-SOC Code,Title,Task,Scale Name,Category,Data Value"
    (tmp_path / "AI_2021to2022_abstractTitleFor_nlp_0.75.csv").write_text(f"{head},2021,2022.0\n15,T,x,Importance,Core,4.5,1,2\n")
    (tmp_path / "AI_2021to2022_abstractTitleFor_ai_hardware_0.75.csv").write_text(f"{head},2023\n15,T,x,Importance,Core,bad,7\n")
    (tmp_path / "AI_2021to2022_abstractTitleFor_nlp_0.8.csv").write_text(f"{head},2021\n15,T,x,Importance,Core,4.5,9\n")
    rows = readers.read_category_results(spark, str(tmp_path), "0.75").collect()
    assert sorted((r["ai_category"], r["year"], r["matches"], r["data_value"]) for r in rows) == [
        ("ai_hardware", 2023, 7, None), ("nlp", 2021, 1, 4.5), ("nlp", 2022, 2, 4.5),
    ]
    with pytest.raises(FileNotFoundError):
        readers.read_category_results(spark, str(tmp_path), "0.99")


def test_line_breaks_in_ratings_topics_and_results(spark, tmp_path):
    task = 'first line\nsecond "line"'
    wide = spark.createDataFrame([("nlp", "15", "T", task, "Importance", "Core", 4.5, 3)], "ai_category string, soc_code string, title string, task string, scale_name string, category string, data_value double, `2021` long")
    writers.write_by_category(wide, f"{tmp_path}/results", first_year=2021, last_year=2021, threshold=0.75)
    got = readers.read_category_results(spark, f"{tmp_path}/results", multi_line=True).collect()
    assert [(r["ai_category"], r["task"], r["data_value"], r["year"], r["matches"]) for r in got] == [("nlp", task, 4.5, 2021, 3)]
    writers.save_table(spark.createDataFrame([(task, "x")], "Task string, Title string"), f"{tmp_path}/ratings.csv")
    assert [r["task"] for r in readers.read_ratings(spark, f"{tmp_path}/ratings.csv", required=("task",), multi_line=True).collect()] == [task]
    writers.save_table(spark.createDataFrame([("1", task)], "`AI topic` string, Topics string"), f"{tmp_path}/topics.csv")
    assert [tuple(r) for r in readers.read_topics(spark, f"{tmp_path}/topics.csv", multi_line=True).collect()] == [(1, task)]


def test_topics(spark, tmp_path):
    (tmp_path / "topics.csv").write_text("AI topic,Topics\n1,Machine Learning\n0,Manufacturing\n")
    assert [tuple(r) for r in readers.read_topics(spark, f"{tmp_path}/topics.csv").collect()] == [(1, "Machine Learning"), (0, "Manufacturing")]


def test_year_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`2022` long, `2021.0` long, `1899` long, name long")
    assert reshape.year_columns(df) == ["2021.0", "2022"]
    with pytest.raises(ValueError):
        reshape.years_to_long(df.select("name"))


def test_scratch_is_under_the_shared_folder(spark):
    path = storage.scratch_dir(spark, "x")
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert path.startswith(base) if base else "taskatlas" in path
    assert path != storage.scratch_dir(spark, "x")


def test_stream_picks_up_only_new_files(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = spark.range(1).schema
    spark.range(10).coalesce(1).write.mode("append").parquet(source)

    def run():
        incremental.run_append(incremental.file_stream(spark, source, schema, files_per_chunk=1), out, state)
        return spark.read.parquet(out).count()

    assert run() == 10 and run() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(source)
    assert run() == 15


def test_running_totals_grow(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.file_stream(spark, source, spark.range(1).schema, files_per_chunk=1)
        totals = stream.groupBy((F.col("id") % 2).alias("k")).agg(F.count("*").alias("n"))
        incremental.run_totals(totals, out, state)
    assert sorted(tuple(r) for r in incremental.latest_totals(spark, out).collect()) == [(0, 10), (1, 10)]


def test_spread_join_splits_a_hot_key(spark):
    facts = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, facts.join(lookup, "k", "left").collect()), key=str)
    assert sorted(map(tuple, joins.spread_join(facts, lookup, ["k"], "left").collect()), key=str) == plain
    semi = joins.spread_join(facts, lookup.select("k"), ["k"], "left_semi")
    assert semi.count() == 2500 and semi.columns == ["k", "id"]
    with pytest.raises(ValueError):
        joins.spread_join(facts, lookup, ["k"], "full")
    assert joins.hot_keys(facts, ["k"], 1000).collect()[0]["k"] == 0
    salted = joins.spread_join(facts, lookup, ["k"], "left", hot_rows=100)
    assert sorted(map(tuple, salted.collect()), key=str) == plain
    assert "__salt" in salted._jdf.queryExecution().analyzed().toString()
    assert joins.spread_join(facts, lookup.select("k"), ["k"], "left_semi", hot_rows=100).count() == 2500


def test_totals_match_a_window(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), "id")
    got = {r["id"]: r["t"] for r in joins.add_totals(df, ["g"], [F.sum("id").alias("t")]).collect()}
    want = {i: sum(j for j in range(200) if j % 3 == i % 3) for i in range(200)}
    assert got == want


def test_numbering(spark):
    ids = np.random.default_rng(0).permutation(5000) * 3
    df = spark.createDataFrame([(int(i),) for i in ids], "k long").repartition(7)
    rows = ranking.number_rows(df, "k", "n", buckets=16).collect()
    assert all(r["n"] * 3 == r["k"] for r in rows) and len(rows) == 5000
    assert ranking.number_rows(df.limit(0), "k", "n").count() == 0


def test_buckets_follow_the_row_count(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 10)
    df = spark.range(300).select(((F.col("id") * 37) % 300).alias("k")).repartition(5)
    seen = []
    cut = ranking.Bucketizer
    monkeypatch.setattr(ranking, "Bucketizer", lambda **given: seen.append(len(given["splits"])) or cut(**given))
    assert {r["k"]: r["n"] for r in ranking.number_rows(df, "k", "n").collect()} == {k: k for k in range(300)}
    assert ranking.number_rows(df.limit(15), "k", "n").count() == 15
    assert seen[0] == 31 and seen[1] == 3


def test_keep_first_and_distinct(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3), (None, "d", 4), (None, "e", 5)], "id int, t string, pos int")
    assert {r["t"] for r in dedup.keep_first(df, ["id"], "pos").collect()} == {"a", "c", "d"}
    tasks = spark.createDataFrame([("Task 1", 0), ("Task 2", 1), ("Task 1", 2)], "task string, pos int")
    assert sorted(map(tuple, dedup.distinct_tasks(tasks, "pos").collect())) == [("Task 1", 0), ("Task 2", 1)]
    left, right = spark.range(5), spark.range(3, 9).union(spark.range(3, 4))
    assert dedup.id_overlap(left, right, "id").first().asDict() == {"in_both": 2, "left_only": 3, "right_only": 4}


def test_update_merge_and_resume(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, c string, n int")
    right = spark.createDataFrame([(1, None, 9), (3, "z", 3)], "id int, c string, n int")
    assert sorted(map(tuple, joins.update_merge(left, right, "id").collect())) == [(1, "a", 9), (2, "b", 2)]
    assert [r["id"] for r in joins.remaining(left, right, "id").collect()] == [2]
    both = joins.compare_results(left, right, "id")
    assert both.columns == ["id", "c_single", "n_single", "c_ensemble", "n_ensemble"] and both.count() == 1


SAMPLES = {
    "spread": np.random.default_rng(5).normal(size=997),
    "hot": np.concatenate([np.full(400, 0.25), np.random.default_rng(6).random(601)]),
    "constant": np.full(50, 3.0),
    "far": np.array([0.0, 1e-12, 2e-12, 3e-12, 1e9]),
    "single": np.array([1.5]),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_exact_quantiles(spark, name):
    values = SAMPLES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4)
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}
    got = exact_quantiles(value_counts(df, "x"), shares, fanout=8, levels=2).first().asDict()
    assert got == pytest.approx({n: np.quantile(values, p) for n, p in shares.items()}, rel=1e-12)
    report = similarity_distribution(df, "x", digits=9).first()
    assert report["std"] == pytest.approx(values.std(), abs=1e-6, rel=1e-9) and report["mean"] == pytest.approx(values.mean())


@pytest.mark.parametrize("name", SAMPLES)
def test_quantiles_of_values_as_they_are(spark, name):
    """Values need not be counted first; equal ones meet in the last buckets only."""
    values = SAMPLES[name]
    rows = values_once(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4), "x")
    assert rows.count() == len(values)
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}
    got = exact_quantiles(rows, shares, fanout=8, levels=2).first().asDict()
    assert got == pytest.approx({n: np.quantile(values, p) for n, p in shares.items()}, rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(value_counts(df, "x"), {"median": 0.5}).first()["median"] is None


def test_count_quantile(spark):
    rows = [(y, m) for y in (1, 2) for m in np.random.default_rng(y).integers(1, 9, 101).tolist()]
    df = spark.createDataFrame(rows, "year int, matches long")
    got = {r["year"]: r["p"] for r in count_quantile(df, ["year"], "matches", 0.75, "p").collect()}
    assert got == {y: np.quantile([m for k, m in rows if k == y], 0.75) for y in (1, 2)}


def test_null_order_values_are_numbered_last(spark):
    df = spark.createDataFrame([(2.0,), (None,), (1.0,)], "o double")
    assert {r["o"]: r["n"] for r in ranking.number_rows(df, "o", "n").collect()} == {1.0: 0, 2.0: 1, None: 2}


def test_odd_year_texts_are_dropped(spark):
    df = spark.createDataFrame([("2021",), ("2022.0",), ("nan",), ("1e20",), ("x",), (None,)], "year string")
    assert sorted(r["year"] for r in filters.from_year(df, 2021).collect()) == [2021, 2022]


def test_scratch_needs_a_shared_folder_and_is_cleared(spark, monkeypatch, tmp_path):
    from taskatlas.sources import storage

    class Bare:
        """A session without any checkpoint folder."""

        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_dir(Bare, "x")
    monkeypatch.setattr(storage, "_made", [])
    kept = storage.stored(spark.range(3), "cleared")
    assert kept.count() == 3 and storage.clear_scratch(spark) == 1 and storage.clear_scratch(spark) == 0


def test_title_case_follows_every_mark(spark):
    df = spark.createDataFrame([("deep_learning",), ("a-b c*d",), ("éa_1st",), ("",), (None,)], "c string")
    got = [r[0] for r in df.select(text.category_title(F.col("c"))).collect()]
    assert got == ["Deep Learning", "A-B C*D", "Éa 1St", "", None]


def test_repeated_done_ids_do_not_repeat_documents(spark):
    from taskatlas.operators.classify import CategoryVectors
    from taskatlas.plans.runs import label_run

    docs = spark.createDataFrame([(i, "t", "words", 2020 + i) for i in range(4)], "application_id long, application_title string, application_abstract string, year int")
    done = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.9), (2, None, 0.5)], "application_id long, category string, confidence double")
    cats = CategoryVectors(("first",), np.ones((1, 64)))
    got = label_run(docs, cats, done=done).collect()
    assert len(got) == 4 and {r["category"] for r in got if r["application_id"] == 1} == {"b"}
    plan = label_run(docs, cats, years=[2021])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")
