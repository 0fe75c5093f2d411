"""Queries over match counts: exposure, flows, quadrants, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskatlas.operators import exposure as ex
from taskatlas.operators import flows, quadrants, reports, reshape
from taskatlas.operators.filters import importance_only
from taskatlas.operators.joins import spread_join
from taskatlas.plans.catalog_vectors import MATCHED_SQL, matched_vectors
from taskatlas.plans.registry import query
from taskatlas.plans.views import COUNTS_SQL, EXPOSURE_SQL, FIRST_YEAR, FLAGS, LAST_YEAR, YEARS, task_counts, with_sql
from taskatlas.sources.storage import stored

TOP_OCCUPATIONS, TOP_TASKS = 10, 5
# Match counts of the test tables stay far below the default of 50.
MANY_MATCHES = 4


def importance(spark, sf):
    return importance_only(task_counts(spark, sf))


def exposed(spark, sf):
    return ex.exposure(task_counts(spark, sf))


# ------------------------------------------------------------------ exposure


@query("a8_year_summary", with_sql(COUNTS_SQL, """SELECT ai_category, year, CAST(sum(matches) AS BIGINT) AS total_matches,
         count(*) FILTER (matches > 0) AS tasks_with_matches, round(avg(matches), 6) AS mean_matches FROM counts GROUP BY ALL"""))
def _(spark, sf):
    return reports.year_summary(task_counts(spark, sf))


@query("a8_matched_summary", with_sql(MATCHED_SQL, """SELECT ai_category, year, CAST(sum(matches) AS BIGINT) AS total_matches,
         count(*) FILTER (matches > 0) AS tasks_with_matches, round(avg(matches), 6) AS mean_matches FROM matched GROUP BY ALL"""))
def _(spark, sf):
    return reports.year_summary(matched_vectors(spark, sf))


@query("a10_exposure", with_sql(EXPOSURE_SQL, "SELECT soc_code, title, ai_category, year, exposure FROM exposed"))
def _(spark, sf):
    return exposed(spark, sf)


@query(
    "a10_matched_exposure",
    with_sql(MATCHED_SQL, """SELECT soc_code, title, ai_category, year,
        CASE WHEN sum(matches) = 0 THEN 0.0 ELSE CAST(round_even(CAST(sum(matches * data_value) / sum(matches) AS DECIMAL(18, 9)), 4) AS DOUBLE) END AS exposure FROM matched GROUP BY ALL"""),
)
def _(spark, sf):
    return ex.exposure(matched_vectors(spark, sf))


@query(
    "a10_unusable_rows",
    with_sql(COUNTS_SQL, """SELECT count(*) AS rows, count(*) FILTER (data_value IS NULL) AS no_importance,
        count(*) FILTER (matches IS NULL) AS no_count, count(*) FILTER (soc_code IS NULL OR title IS NULL) AS no_occupation FROM imp"""),
)
def _(spark, sf):
    return ex.unusable_rows(task_counts(spark, sf))


@query(
    "a10_unusable_gaps",
    with_sql(COUNTS_SQL, """SELECT count(*) AS rows, count(*) FILTER (matches % 3 = 2) AS no_importance,
        count(*) FILTER (data_value > 4.5) AS no_count, CAST(0 AS BIGINT) AS no_occupation FROM imp"""),
)
def _(spark, sf):
    """Counts with some ratings and some matches taken out."""
    counts = task_counts(spark, sf)
    gaps = {"data_value": F.when(F.col("matches") % 3 != 2, F.col("data_value")), "matches": F.when(F.col("data_value") <= 4.5, F.col("matches"))}
    return ex.unusable_rows(counts.withColumns(gaps))


_YEAR_COLUMNS = ", ".join(f"max(exposure) FILTER (year = {y}) AS \"{y}\"" for y in YEARS)


@query("a11_exposure_wide", with_sql(EXPOSURE_SQL, f"SELECT soc_code, title, ai_category, {_YEAR_COLUMNS} FROM exposed GROUP BY ALL"))
def _(spark, sf):
    return ex.exposure_wide(exposed(spark, sf), YEARS)


@query(
    "a12_mean_by_category",
    with_sql(EXPOSURE_SQL, """SELECT ai_category, round(avg(m), 6) AS mean_exposure
        FROM (SELECT ai_category, year, avg(exposure) AS m FROM exposed GROUP BY ALL) GROUP BY ai_category"""),
)
def _(spark, sf):
    return ex.mean_by_category(exposed(spark, sf))


@query(
    "a13_top_occupations",
    with_sql(EXPOSURE_SQL, """SELECT soc_code, title, round(avg(m), 6) AS mean_exposure
        FROM (SELECT soc_code, title, year, avg(exposure) AS m FROM exposed GROUP BY ALL) GROUP BY ALL
        ORDER BY mean_exposure DESC, soc_code, title LIMIT 10"""),
)
def _(spark, sf):
    return ex.top_occupations(exposed(spark, sf))


_GROWTH_SQL = EXPOSURE_SQL + f""", ends AS (
  SELECT soc_code, title, ai_category, max(exposure) FILTER (year = {FIRST_YEAR}) AS first_exposure,
         max(exposure) FILTER (year = {LAST_YEAR}) AS last_exposure FROM exposed WHERE year IN ({FIRST_YEAR}, {LAST_YEAR}) GROUP BY ALL),
grown AS (SELECT *, round((last_exposure - first_exposure) / nullif(first_exposure, 0) * 100, 6) AS growth_percent FROM ends)"""


@query("a14_growth", with_sql(_GROWTH_SQL, "SELECT * FROM grown"))
def _(spark, sf):
    return ex.growth(exposed(spark, sf), FIRST_YEAR, LAST_YEAR)


@query("a14_top_growth", with_sql(_GROWTH_SQL, "SELECT * FROM grown ORDER BY growth_percent DESC NULLS LAST, soc_code, title, ai_category LIMIT 10"))
def _(spark, sf):
    return ex.top_growth(exposed(spark, sf), FIRST_YEAR, LAST_YEAR)


@query("a15_breadth", with_sql(EXPOSURE_SQL, "SELECT ai_category, count(DISTINCT (soc_code, title)) FILTER (exposure > 0) AS occupations FROM exposed GROUP BY ai_category"))
def _(spark, sf):
    return ex.breadth(exposed(spark, sf))


@query("a16_occupation_profile", with_sql(EXPOSURE_SQL, "SELECT ai_category, exposure FROM exposed WHERE title = 'Title Brand#7' AND year = 1999"))
def _(spark, sf):
    return ex.occupation_profile(exposed(spark, sf), "Title Brand#7", 1999)


@query(
    "a17_exposure_bands",
    with_sql(EXPOSURE_SQL, """SELECT soc_code, ai_category, year, CASE WHEN exposure >= 4 THEN 'very high' WHEN exposure >= 3 THEN 'high'
        WHEN exposure >= 2 THEN 'moderate' WHEN exposure >= 1 THEN 'low' WHEN exposure >= 0 THEN 'minimal' END AS band FROM exposed"""),
)
def _(spark, sf):
    return exposed(spark, sf).select("soc_code", "ai_category", "year", ex.exposure_band(F.col("exposure")).alias("band"))


@query("a18_category_trend", with_sql(COUNTS_SQL, "SELECT ai_category, year, CAST(sum(matches) AS BIGINT) AS total_matches FROM counts GROUP BY ALL"))
def _(spark, sf):
    return ex.category_trend(task_counts(spark, sf))


@query("a18_occupation_trend", with_sql(COUNTS_SQL, "SELECT title, ai_category, year, CAST(sum(matches) AS BIGINT) AS total_matches FROM counts GROUP BY ALL"))
def _(spark, sf):
    return ex.occupation_trend(task_counts(spark, sf))


@query(
    "a18_leading_category",
    with_sql(COUNTS_SQL, """, totals AS (SELECT title, year, ai_category, CAST(sum(matches) AS BIGINT) AS total_matches FROM counts GROUP BY ALL)
        SELECT title, year, ai_category, total_matches FROM (
          SELECT *, row_number() OVER (PARTITION BY title, year ORDER BY total_matches DESC, ai_category) AS rn FROM totals) WHERE rn = 1"""),
)
def _(spark, sf):
    return ex.leading_category(task_counts(spark, sf))


@query(
    "a19_top_tasks",
    with_sql(COUNTS_SQL, "SELECT title, task, matches FROM counts WHERE ai_category = 'A' AND year = 2000 ORDER BY matches DESC, task, title LIMIT 10"),
)
def _(spark, sf):
    return ex.top_tasks(task_counts(spark, sf), "A", 2000)


@query(
    "a20_task_across_categories",
    with_sql(COUNTS_SQL, "SELECT task, title, year, " + ", ".join(f"CAST(sum(matches) FILTER (ai_category = '{c}') AS BIGINT) AS \"{c}\"" for c in FLAGS)
             + " FROM counts WHERE task ILIKE '%RED bolt%' GROUP BY ALL"),
)
def _(spark, sf):
    return ex.task_across_categories(task_counts(spark, sf), "RED bolt", FLAGS)


# --------------------------------------------------------------------- flows

_CONTRIBUTION_SQL = """share AS (
  SELECT *, CASE WHEN sum(matches) OVER w = 0 THEN 0.0 ELSE matches / sum(matches) OVER w END * data_value AS contribution
  FROM imp WINDOW w AS (PARTITION BY ai_category, year, soc_code))"""

FLOW_SQL = COUNTS_SQL + ", " + _CONTRIBUTION_SQL + f""", top_occ AS (
  SELECT soc_code, title, round(sum(contribution), 9) AS total_contribution FROM share WHERE year = {FIRST_YEAR}
  GROUP BY ALL ORDER BY total_contribution DESC, soc_code, title LIMIT {TOP_OCCUPATIONS}),
task_sums AS (
  SELECT ai_category, task, round(sum(contribution), 9) AS total_contribution FROM share
  WHERE year = {FIRST_YEAR} AND soc_code IN (SELECT soc_code FROM top_occ) GROUP BY ALL),
top_task AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ai_category ORDER BY total_contribution DESC, task) AS INTEGER) AS task_rank FROM task_sums)
  WHERE task_rank <= {TOP_TASKS})"""

LINKS_SQL = FLOW_SQL + """, kept AS (
  SELECT * FROM imp WHERE soc_code IN (SELECT soc_code FROM top_occ) AND (ai_category, task) IN (SELECT (ai_category, task) FROM top_task)),
weights AS (
  SELECT *, CASE WHEN sum(matches) OVER w = 0 THEN 0.0 ELSE matches / sum(matches) OVER w END * data_value AS contribution
  FROM kept WINDOW w AS (PARTITION BY ai_category, year, soc_code)),
parents AS (SELECT year, ai_category, task, sum(contribution) AS value FROM weights GROUP BY ALL HAVING round(sum(contribution), 9) > 0.01),
links AS (
  SELECT year, 'category_task' AS kind, ai_category, task, CAST(NULL AS VARCHAR) AS soc_code, value FROM parents
  UNION ALL
  SELECT w.year, 'task_occupation', w.ai_category, w.task, w.soc_code, w.contribution
  FROM weights w JOIN parents p USING (year, ai_category, task) WHERE round(w.contribution, 9) > 0.01)"""


@query(
    "w1_contributions",
    with_sql(COUNTS_SQL + ", " + _CONTRIBUTION_SQL, "SELECT soc_code, task, ai_category, year, matches, round(contribution, 12) AS contribution FROM share"),
)
def _(spark, sf):
    rows = flows.contributions(importance(spark, sf))
    return rows.select("soc_code", "task", "ai_category", "year", "matches", F.round("contribution", 12).alias("contribution"))


@query("w2_top_occupations", with_sql(FLOW_SQL, "SELECT soc_code, title, round(total_contribution, 6) AS total_contribution FROM top_occ"))
def _(spark, sf):
    top = flows.top_occupations(importance(spark, sf), FIRST_YEAR, TOP_OCCUPATIONS)
    return top.withColumn("total_contribution", F.round("total_contribution", 6))


def _flow_parts(spark, sf):
    """Stored match counts with their top occupations and tasks.

    Each is used several times, under different filters, so each is written once.
    """
    counts = stored(importance(spark, sf), "flow-counts")
    top = stored(flows.top_occupations(counts, FIRST_YEAR, TOP_OCCUPATIONS), "flow-occupations")
    return counts, top, stored(flows.top_tasks(counts, top, FIRST_YEAR, TOP_TASKS), "flow-tasks")


@query("w3_top_tasks", with_sql(FLOW_SQL, "SELECT ai_category, task, task_rank, round(total_contribution, 6) AS total_contribution FROM top_task"))
def _(spark, sf):
    return _flow_parts(spark, sf)[2].withColumn("total_contribution", F.round("total_contribution", 6))


@query("w4_flow_links", with_sql(LINKS_SQL, "SELECT year, kind, ai_category, task, soc_code, round(value, 12) AS value FROM links"))
def _(spark, sf):
    return flows.flow_links(*_flow_parts(spark, sf)).withColumn("value", F.round("value", 12))


@query(
    "w5_flow_nodes",
    with_sql(FLOW_SQL, """, nodes AS (
      SELECT 0 AS layer, 'category' AS kind, ai_category, CAST(NULL AS VARCHAR) AS task, CAST(NULL AS VARCHAR) AS soc_code, ai_category AS label, 0.0 AS weight, ai_category AS tie
      FROM (SELECT DISTINCT ai_category FROM imp)
      UNION ALL SELECT 1, 'task', ai_category, task, NULL, CASE WHEN length(task) > 60 THEN substring(task, 1, 60) || '...' ELSE task END, task_rank, task FROM top_task
      UNION ALL SELECT 2, 'occupation', NULL, NULL, soc_code, title, -total_contribution, soc_code FROM top_occ)
    SELECT CAST(row_number() OVER (ORDER BY layer, ai_category NULLS FIRST, weight, tie, label) - 1 AS INTEGER) AS node_id, kind, ai_category, task, soc_code, label FROM nodes"""),
)
def _(spark, sf):
    return flows.flow_nodes(*_flow_parts(spark, sf))


@query(
    "w6_flow_links_min",
    with_sql(LINKS_SQL.replace("FROM weights GROUP BY ALL", "FROM weights WHERE contribution > 0.5 GROUP BY ALL")
             .replace("WHERE round(w.contribution, 9) > 0.01", "WHERE w.contribution > 0.5"),
             "SELECT year, kind, ai_category, task, soc_code, round(value, 12) AS value FROM links"),
)
def _(spark, sf):
    return flows.flow_links(*_flow_parts(spark, sf), min_contribution=0.5).withColumn("value", F.round("value", 12))


@query(
    "w6_flow_links_large",
    with_sql(LINKS_SQL.replace("FROM weights GROUP BY ALL", "FROM weights WHERE contribution > 3.5 GROUP BY ALL")
             .replace("WHERE round(w.contribution, 9) > 0.01", "WHERE w.contribution > 3.5"),
             "SELECT year, kind, ai_category, task, soc_code, round(value, 12) AS value FROM links"),
)
def _(spark, sf):
    """A cut above the smallest contribution, which removes links."""
    return flows.flow_links(*_flow_parts(spark, sf), min_contribution=3.5).withColumn("value", F.round("value", 12))


@query("j4_top_members", with_sql(FLOW_SQL, "SELECT soc_code, task, ai_category, year, matches FROM imp WHERE soc_code IN (SELECT soc_code FROM top_occ)"))
def _(spark, sf):
    counts = importance(spark, sf)
    top = flows.top_occupations(counts, FIRST_YEAR, TOP_OCCUPATIONS)
    kept = spread_join(counts, top.select("soc_code"), ["soc_code"], "left_semi")
    return kept.select("soc_code", "task", "ai_category", "year", "matches")


# ----------------------------------------------------------------- quadrants

CUT_SQL = COUNTS_SQL + """, cuts AS (
  SELECT year, quantile_cont(matches, 0.5) AS cut, quantile_cont(matches, 0.75) AS cut75 FROM imp WHERE matches > 0 GROUP BY year)"""


@query("q1_points", with_sql(COUNTS_SQL, "SELECT year, task, data_value AS importance, matches, ai_category, title AS occupation FROM imp"))
def _(spark, sf):
    return quadrants.points(importance(spark, sf))


@query(
    "q2_task_points",
    with_sql(COUNTS_SQL, """SELECT year, task, data_value AS importance, CAST(sum(matches) AS BIGINT) AS matches, arg_min(title, (soc_code, title)) AS occupation
        FROM imp WHERE matches > 0 GROUP BY year, task, data_value"""),
)
def _(spark, sf):
    return quadrants.task_points(importance(spark, sf))


@query("q3_all_year_points", with_sql(COUNTS_SQL, "SELECT task, data_value AS importance, year, matches, ai_category FROM imp WHERE matches > 0"))
def _(spark, sf):
    return quadrants.all_year_points(importance(spark, sf))


@query("q3_all_year_points_summed", with_sql(COUNTS_SQL, "SELECT task, data_value AS importance, year, CAST(sum(matches) AS BIGINT) AS matches FROM imp WHERE matches > 0 GROUP BY ALL"))
def _(spark, sf):
    return quadrants.all_year_points(importance(spark, sf), by_category=False)


@query("q4_match_median", with_sql(CUT_SQL, "SELECT year, cut FROM cuts"))
def _(spark, sf):
    return quadrants.match_cut(importance(spark, sf))


@query("q4_match_median_all_years", with_sql(COUNTS_SQL, "SELECT quantile_cont(matches, 0.5) AS cut FROM imp WHERE matches > 0"))
def _(spark, sf):
    return quadrants.match_cut(importance(spark, sf), keys=())


def _quadrant_sql(cut: str, high: float) -> str:
    return with_sql(
        CUT_SQL + f""", named AS (SELECT year, CASE WHEN data_value >= {high} AND matches >= {cut} THEN 'high_concern'
             WHEN data_value >= {high} THEN 'protected' WHEN matches >= {cut} THEN 'routine_automation' ELSE 'minimal_impact' END AS quadrant
           FROM imp JOIN cuts USING (year))""",
        """SELECT c.year, q.quadrant, count(n.year) AS n, round(100.0 * count(n.year) / any_value(t.total), 4) AS percent
           FROM cuts c CROSS JOIN (VALUES ('high_concern'), ('protected'), ('routine_automation'), ('minimal_impact')) q(quadrant)
           JOIN (SELECT year, count(*) AS total FROM named GROUP BY year) t ON t.year = c.year
           LEFT JOIN named n ON n.year = c.year AND n.quadrant = q.quadrant GROUP BY c.year, q.quadrant""",
    )


@query("q5_quadrants", _quadrant_sql("cut", 4.0))
def _(spark, sf):
    # Read by the cuts and by the rows: counted once.
    return quadrants.quadrant_counts(stored(importance(spark, sf), "counts"))


@query("q3_matched_points", with_sql(MATCHED_SQL, "SELECT task, data_value AS importance, year, matches, ai_category FROM matched WHERE matches > 0"))
def _(spark, sf):
    """From counts that hold a row for every zero."""
    return quadrants.all_year_points(matched_vectors(spark, sf))


@query(
    "q5_matched_quadrants",
    with_sql(
        MATCHED_SQL + """, cuts AS (SELECT year, quantile_cont(matches, 0.5) AS cut FROM matched WHERE matches > 0 GROUP BY year),
named AS (SELECT year, CASE WHEN cut IS NULL THEN NULL WHEN data_value >= 4.0 AND matches >= cut THEN 'high_concern'
    WHEN data_value >= 4.0 THEN 'protected' WHEN matches >= cut THEN 'routine_automation' ELSE 'minimal_impact' END AS quadrant
  FROM matched LEFT JOIN cuts USING (year))""",
        """SELECT y.year, q.quadrant, count(n.year) AS n,
             round(CASE WHEN y.total = 0 THEN 0.0 ELSE 100.0 * count(n.year) / y.total END, 4) AS percent
           FROM (SELECT year, count(quadrant) AS total FROM named GROUP BY year) y
           CROSS JOIN (VALUES ('high_concern'), ('protected'), ('routine_automation'), ('minimal_impact')) q(quadrant)
           LEFT JOIN named n ON n.year = y.year AND n.quadrant = q.quadrant GROUP BY y.year, q.quadrant, y.total""",
    ),
)
def _(spark, sf):
    """From counts that hold a row for every zero; zeros are below every cut."""
    return quadrants.quadrant_counts(matched_vectors(spark, sf))


@query("q5_quadrants_chart", _quadrant_sql("cut", 3.5))
def _(spark, sf):
    return quadrants.quadrant_counts(importance(spark, sf), high_importance=quadrants.CHART_IMPORTANCE)


@query("q12_quadrants_p75", _quadrant_sql("cut75", 4.0))
def _(spark, sf):
    return quadrants.quadrant_counts(importance(spark, sf), share=0.75)


@query(
    "q6_outliers",
    with_sql(CUT_SQL, """SELECT year, CAST(rank AS INTEGER) AS rank, task, ai_category, title, data_value AS importance, matches FROM (
        SELECT *, row_number() OVER (PARTITION BY year ORDER BY matches DESC, task, ai_category, soc_code) AS rank
        FROM imp JOIN cuts USING (year) WHERE data_value >= 4.0 AND matches >= cut * 1.5) WHERE rank <= 10"""),
)
def _(spark, sf):
    return quadrants.outliers(importance(spark, sf))


@query(
    "q7_importance_summary",
    with_sql(COUNTS_SQL, f"""SELECT year, count(*) FILTER (data_value >= 4.0) AS important_rows,
        count(*) FILTER (data_value >= 4.0 AND matches >= {MANY_MATCHES}) AS many_matches FROM imp GROUP BY year"""),
)
def _(spark, sf):
    return quadrants.importance_summary(importance(spark, sf), high_matches=MANY_MATCHES)


@query(
    "q7_top_important",
    with_sql(COUNTS_SQL, f"""SELECT year, CAST(rank AS INTEGER) AS rank, task, ai_category, matches, data_value AS importance FROM (
        SELECT *, row_number() OVER (PARTITION BY year ORDER BY matches DESC, task, ai_category, soc_code) AS rank
        FROM imp WHERE data_value >= 4.0 AND matches >= {MANY_MATCHES}) WHERE rank <= 5"""),
)
def _(spark, sf):
    return quadrants.top_important(importance(spark, sf), high_matches=MANY_MATCHES)


@query(
    "q8_correlation",
    with_sql(COUNTS_SQL, """, base AS (SELECT year, corr(data_value, matches) AS r, count(*) AS n FROM imp GROUP BY year)
        SELECT year, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM base"""),
)
def _(spark, sf):
    return quadrants.importance_correlation(importance(spark, sf))


def _tail_sql(start: str, power: str) -> str:
    """Simpson's rule over (cos x / cos start) ** power, far enough that the rest does not count."""
    x = f"({start} + w * i / 4000.0)"
    return f"""(SELECT sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp({power} * ln(greatest(cos{x} / cos({start}), 1e-300)))) * max(w) / 12000.0
        FROM (SELECT least(pi() / 2 - {start}, 84.0 / ({power} * tan({start}) + sqrt(pow({power} * tan({start}), 2) + 84.0 * {power}))) AS w), unnest(range(0, 4001)) AS s(i))"""


@query(
    "q8_p_value",
    with_sql(COUNTS_SQL, f""", base AS (SELECT year, corr(data_value, matches) AS r, count(*) AS n FROM imp GROUP BY year),
        angle AS (SELECT *, atan(abs(r) / sqrt(1 - r * r)) AS x, CAST(n - 3 AS DOUBLE) AS m FROM base)
        SELECT year, round(r, 6) AS r, n, round(exp(m * ln(cos(x))) * {_tail_sql('x', 'm')} / {_tail_sql('0.0', 'm')}, 9) AS p FROM angle"""),
)
def _(spark, sf):
    return quadrants.correlation_test(importance(spark, sf))


@query(
    "q9_change_by_importance",
    with_sql(COUNTS_SQL, f""", moved AS (SELECT soc_code, task, ai_category, data_value,
          sum(CASE WHEN year = {LAST_YEAR} THEN matches ELSE 0 END) - sum(CASE WHEN year = {FIRST_YEAR} THEN matches ELSE 0 END) AS change FROM imp GROUP BY ALL)
        SELECT round(avg(change) FILTER (data_value >= 4.0), 6) AS important_change, round(avg(change) FILTER (data_value < 3.0), 6) AS routine_change FROM moved"""),
)
def _(spark, sf):
    return quadrants.change_by_importance(importance(spark, sf), FIRST_YEAR, LAST_YEAR)


_CONCERN_SQL = CUT_SQL + """, concern AS (SELECT year, task, title, ai_category, data_value AS importance, matches
  FROM imp JOIN cuts USING (year) WHERE data_value >= 4.0 AND matches >= cut),
scored AS (SELECT year, title, count(task) AS tasks, round(avg(importance), 6) AS mean_importance, CAST(sum(matches) AS BIGINT) AS total_matches,
    round(count(task) * avg(importance) * sum(matches), 4) AS priority FROM concern GROUP BY year, title)"""


@query("q10_high_concern", with_sql(_CONCERN_SQL, "SELECT * FROM concern"))
def _(spark, sf):
    return quadrants.high_concern(importance(spark, sf))


@query("q11_concern_by_occupation", with_sql(_CONCERN_SQL, "SELECT * FROM scored"))
def _(spark, sf):
    return quadrants.concern_by_occupation(quadrants.high_concern(importance(spark, sf)))


@query(
    "q11_top_priority",
    with_sql(_CONCERN_SQL, """SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY year ORDER BY priority DESC, title) AS rn FROM scored) WHERE rn <= 5"""),
)
def _(spark, sf):
    return quadrants.top_priority(quadrants.high_concern(importance(spark, sf)))


# ------------------------------------------------------------------- reshape

_WIDE_SQL = ", ".join(f"CAST(sum(matches) FILTER (year = {y}) AS BIGINT) AS \"{y}\"" for y in YEARS)


@query("r2_long_to_wide", with_sql(COUNTS_SQL, f"SELECT soc_code, task, ai_category, {_WIDE_SQL} FROM counts GROUP BY ALL"))
def _(spark, sf):
    return reshape.long_to_wide(task_counts(spark, sf), ["soc_code", "task", "ai_category"], "year", YEARS, F.sum("matches"))


@query(
    "r1_wide_to_long",
    with_sql(COUNTS_SQL, f""", dense AS (SELECT k.soc_code, k.task, k.ai_category, y.year FROM (SELECT DISTINCT soc_code, task, ai_category FROM counts) k
          CROSS JOIN (SELECT CAST(unnest(range({FIRST_YEAR}, {LAST_YEAR + 1})) AS INTEGER) AS year) y)
        SELECT d.soc_code, d.task, d.ai_category, d.year, CAST(sum(c.matches) AS BIGINT) AS matches FROM dense d LEFT JOIN counts c USING (soc_code, task, ai_category, year) GROUP BY ALL"""),
)
def _(spark, sf):
    wide = reshape.long_to_wide(task_counts(spark, sf), ["soc_code", "task", "ai_category"], "year", YEARS, F.sum("matches"))
    return reshape.years_to_long(wide)


@query("s5_year_columns", with_sql(COUNTS_SQL, "SELECT year, count(*) AS n, CAST(sum(matches) AS BIGINT) AS matches FROM counts GROUP BY year"))
def _(spark, sf):
    """Years found in column names, each with its non-empty cells."""
    wide = reshape.long_to_wide(task_counts(spark, sf), ["soc_code", "task", "ai_category"], "year", YEARS, F.sum("matches"))
    long = reshape.years_to_long(wide.withColumnRenamed(str(YEARS[0]), f"{YEARS[0]}.0"))
    return long.groupBy("year").agg(F.count("matches").alias("n"), F.sum("matches").alias("matches"))
