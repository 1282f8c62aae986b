"""Registered queries: poll series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import range_label
from ..operators.frames import latest_rows, latest_rows_per_group
from ..operators.polls import (
    envelope,
    interpolate,
    latest_benchmark,
    latest_per_source,
    ranked_snapshot,
    rolling_benchmark,
    rolling_error,
    rolling_mean,
    spine_with_neighbours,
    with_errors,
)
from .queries_weighting import rounded
from .registry import query
from .views import POLLS_SQL, polls

_ERR_SQL = """err AS (
  SELECT *, sqrt(anteil * (1 - anteil) / befragte) AS se,
         round(1.96 * sqrt(anteil * (1 - anteil) / befragte), 5) AS delta FROM polls)"""
_BASE_COLUMNS = ("institut", "datum", "partei", "anteil", "befragte", "delta")


@query(
    "poll_ci",
    f"""WITH {POLLS_SQL}, {_ERR_SQL}
SELECT event_id, round(se, 10) AS se, delta, round(anteil - 1.96 * se, 8) AS ci_lower, round(anteil + 1.96 * se, 8) AS ci_higher
FROM err""",
)
def poll_ci(spark, folder):
    found = with_errors(polls(spark, folder))
    return found.selectExpr(
        "event_id",
        "round(se, 10) AS se",
        "round(delta, 5) AS delta",
        "round(ci_lower, 8) AS ci_lower",
        "round(ci_higher, 8) AS ci_higher",
    )


@query(
    "rolling_mean10",
    f"""WITH {POLLS_SQL}, d AS (SELECT DISTINCT partei, datum, befragte, anteil FROM polls),
w AS (SELECT *, avg(anteil) OVER t AS m, count(*) OVER t AS k FROM d
      WINDOW t AS (PARTITION BY partei ORDER BY datum, befragte, anteil ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT partei, datum, befragte, anteil, CASE WHEN k = 10 THEN round(m, 9) END AS rolling_average FROM w""",
)
def rolling_mean10(spark, folder):
    return rounded(rolling_mean(polls(spark, folder)), 9, "rolling_average")


@query(
    "rolling_gauss_error",
    f"""WITH {POLLS_SQL}, {_ERR_SQL}, d AS (SELECT DISTINCT partei, datum, delta FROM err),
w AS (SELECT *, sqrt(sum(delta * delta) OVER t) / 10 AS e, count(*) OVER t AS k FROM d
      WINDOW t AS (PARTITION BY partei ORDER BY datum, delta ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT partei, datum, delta, CASE WHEN k = 10 THEN round(e, 9) END AS rolling_error FROM w""",
)
def rolling_gauss_error(spark, folder):
    return rounded(rolling_error(with_errors(polls(spark, folder), digits=5)), 9, "rolling_error")


@query(
    "rolling_avg_error",
    f"""WITH {POLLS_SQL}, {_ERR_SQL},
d1 AS (SELECT DISTINCT partei, datum, befragte, anteil FROM polls),
w1 AS (SELECT *, avg(anteil) OVER t AS m, count(*) OVER t AS k FROM d1
       WINDOW t AS (PARTITION BY partei ORDER BY datum, befragte, anteil ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
a AS (SELECT datum, partei, avg(CASE WHEN k = 10 THEN m END) AS rolling_average FROM w1 GROUP BY datum, partei),
d2 AS (SELECT DISTINCT partei, datum, delta FROM err),
w2 AS (SELECT *, sqrt(sum(delta * delta) OVER t) / 10 AS e, count(*) OVER t AS k FROM d2
       WINDOW t AS (PARTITION BY partei ORDER BY datum, delta ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
b AS (SELECT datum, partei, avg(CASE WHEN k = 10 THEN e END) AS rolling_error FROM w2 GROUP BY datum, partei)
SELECT datum, partei, round(rolling_average, 9) AS rolling_average, round(rolling_error, 9) AS rolling_error,
       round(rolling_average + rolling_error, 9) AS ci_higher, round(rolling_average - rolling_error, 9) AS ci_lower
FROM a LEFT JOIN b USING (datum, partei)""",
)
def rolling_avg_error(spark, folder):
    found = rolling_benchmark(polls(spark, folder))
    return rounded(found, 9, "rolling_average", "rolling_error", "ci_higher", "ci_lower")


# Written as the definition reads: for every (party, day) look back over all polls of the party.
LATEST_SQL = f"""WITH {POLLS_SQL}, {_ERR_SQL},
base AS (SELECT DISTINCT institut, datum, partei, anteil, befragte, delta FROM err),
points AS (SELECT DISTINCT partei, datum FROM base),
seen AS (SELECT points.partei, points.datum, b.anteil, b.befragte, b.delta,
                rank() OVER (PARTITION BY points.partei, points.datum, b.institut ORDER BY b.datum DESC) AS age
         FROM points JOIN base b ON b.partei = points.partei AND b.datum <= points.datum),
latest AS (SELECT * FROM seen WHERE age = 1),
series AS (SELECT partei, datum, sum(befragte * anteil) / sum(befragte) AS rolling_average,
                  sum(befragte * delta) / sum(befragte) AS err_linear,
                  sqrt(sum(befragte * befragte * delta * delta)) / sum(befragte) AS err_gauss
           FROM latest GROUP BY partei, datum)"""


def _latest(spark, folder, column: str, method: str, name: str):
    base = with_errors(polls(spark, folder)).withColumn("delta", F.round("delta", 5))
    found = latest_per_source(base, {name: (column, method)}, distinct_on=_BASE_COLUMNS)
    return rounded(found, 8, name)


@query("latest_poll_avg", LATEST_SQL + " SELECT partei, datum, round(rolling_average, 8) AS rolling_average FROM series")
def latest_poll_avg(spark, folder):
    return _latest(spark, folder, "anteil", "linear", "rolling_average")


@query("latest_poll_err_linear", LATEST_SQL + " SELECT partei, datum, round(err_linear, 8) AS poll_err FROM series")
def latest_poll_err_linear(spark, folder):
    return _latest(spark, folder, "delta", "linear", "poll_err")


@query("latest_poll_err_gauss", LATEST_SQL + " SELECT partei, datum, round(err_gauss, 8) AS poll_err FROM series")
def latest_poll_err_gauss(spark, folder):
    return _latest(spark, folder, "delta", "gauss", "poll_err")


@query(
    "latest_poll_band",
    LATEST_SQL
    + """ SELECT partei, datum, round(rolling_average, 8) AS rolling_average, round(err_linear, 8) AS poll_err,
round(rolling_average + err_linear, 8) AS ci_higher, round(rolling_average - err_linear, 8) AS ci_lower FROM series""",
)
def latest_poll_band(spark, folder):
    """Average, error and band of the latest polls in one pass."""
    found = latest_benchmark(polls(spark, folder))
    return rounded(found, 8, "rolling_average", "poll_err", "ci_higher", "ci_lower")


_SNAPSHOT_SQL = (
    LATEST_SQL
    + """, band AS (SELECT *, rolling_average - err_linear AS ci_lower, rolling_average + err_linear AS ci_higher
              FROM series WHERE datum = (SELECT max(datum) FROM series))"""
)


@query(
    "snapshot_rank",
    _SNAPSHOT_SQL
    + """ SELECT partei, datum, round(rolling_average, 8) AS rolling_average, round(ci_lower, 2) AS ci_lower,
round(ci_higher, 2) AS ci_higher, row_number() OVER (ORDER BY rolling_average DESC, partei) AS y FROM band""",
)
def snapshot_rank(spark, folder):
    """Latest day, largest party first."""
    found = ranked_snapshot(latest_benchmark(polls(spark, folder)))
    return rounded(found, 2, "ci_lower", "ci_higher").select(
        "partei", "datum", F.round("rolling_average", 8).alias("rolling_average"), "ci_lower", "ci_higher", "y"
    )


@query(
    "range_label",
    _SNAPSHOT_SQL
    + """ SELECT partei, concat(CAST(round(ci_lower * 100) AS BIGINT), '-', CAST(round(ci_higher * 100) AS BIGINT), '%') AS label
FROM band""",
)
def labels(spark, folder):
    latest = latest_rows(latest_benchmark(polls(spark, folder)), "datum")
    return latest.select("partei", range_label(F.col("ci_lower"), F.col("ci_higher")).alias("label"))


@query(
    "latest_snapshot",
    f"WITH {POLLS_SQL} SELECT event_id, datum, partei FROM polls WHERE datum = (SELECT max(datum) FROM polls)",
)
def latest_snapshot(spark, folder):
    return latest_rows(polls(spark, folder).select("event_id", "datum", "partei"), "datum")


@query(
    "group_latest",
    f"""WITH {POLLS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY institut ORDER BY datum DESC) AS k FROM polls)
SELECT institut, event_id, datum FROM r WHERE k = 1""",
)
def group_latest(spark, folder):
    """Per source all polls of its latest day."""
    found = polls(spark, folder).select("institut", "event_id", "datum")
    return latest_rows_per_group(found, ["institut"], "datum").select("institut", "event_id", "datum")


_SPINE_SQL = f"""WITH {POLLS_SQL},
obs AS (SELECT institut, partei, datum, avg(anteil) AS x FROM polls GROUP BY ALL),
spine AS (SELECT k.institut, k.partei, d.datum FROM (SELECT DISTINCT institut, partei FROM obs) k,
                 (SELECT DISTINCT datum FROM obs) d),
near AS (SELECT s.institut, s.partei, s.datum, max(CASE WHEN o.datum <= s.datum THEN o.datum END) AS prev_day,
                min(CASE WHEN o.datum > s.datum THEN o.datum END) AS next_day
         FROM spine s JOIN obs o USING (institut, partei) GROUP BY ALL),
both_sides AS (SELECT n.*, p.x AS prev_value, q.x AS next_value FROM near n
         LEFT JOIN obs p ON p.institut = n.institut AND p.partei = n.partei AND p.datum = n.prev_day
         LEFT JOIN obs q ON q.institut = n.institut AND q.partei = n.partei AND q.datum = n.next_day)"""


@query(
    "asof_prev_next",
    _SPINE_SQL
    + """ SELECT institut, partei, datum, prev_day, round(prev_value, 9) AS prev_value, next_day,
round(next_value, 9) AS next_value FROM both_sides""",
)
def asof_prev_next(spark, folder):
    found = spine_with_neighbours(polls(spark, folder), "anteil", ("institut", "partei"))
    return rounded(found, 9, "prev_value", "next_value")


@query(
    "interpolate_series",
    _SPINE_SQL
    + """ SELECT institut, partei, datum, round(CASE WHEN prev_day = datum THEN prev_value ELSE
prev_value + (next_value - prev_value) / datediff('day', prev_day, next_day) * datediff('day', prev_day, datum) END, 8) AS anteil
FROM both_sides""",
)
def interpolate_series(spark, folder):
    return rounded(interpolate(polls(spark, folder), "anteil"), 8, "anteil")


def _filled_sql(bound: str, sign: str) -> str:
    return f"""{bound}_obs AS (SELECT institut, partei, datum, avg(anteil {sign} 1.96 * se) AS x FROM err GROUP BY ALL),
{bound}_near AS (SELECT s.institut, s.partei, s.datum, max(CASE WHEN o.datum <= s.datum THEN o.datum END) AS a,
                min(CASE WHEN o.datum > s.datum THEN o.datum END) AS b
         FROM spine s JOIN {bound}_obs o USING (institut, partei) GROUP BY ALL),
{bound} AS (SELECT n.institut, n.partei, n.datum, CASE WHEN a = n.datum THEN p.x ELSE
              p.x + (q.x - p.x) / datediff('day', a, b) * datediff('day', a, n.datum) END AS x FROM {bound}_near n
         LEFT JOIN {bound}_obs p ON p.institut = n.institut AND p.partei = n.partei AND p.datum = a
         LEFT JOIN {bound}_obs q ON q.institut = n.institut AND q.partei = n.partei AND q.datum = b)"""


@query(
    "ci_envelope",
    f"""WITH {POLLS_SQL}, {_ERR_SQL},
spine AS (SELECT k.institut, k.partei, d.datum FROM (SELECT DISTINCT institut, partei FROM polls) k,
                 (SELECT DISTINCT datum FROM polls) d),
{_filled_sql("low", "-")}, {_filled_sql("high", "+")}
SELECT datum, partei, round(min(low.x), 8) AS ci_lower, round(max(high.x), 8) AS ci_higher
FROM low JOIN high USING (institut, partei, datum) GROUP BY datum, partei""",
)
def ci_envelope(spark, folder):
    return rounded(envelope(with_errors(polls(spark, folder))), 8, "ci_lower", "ci_higher")
