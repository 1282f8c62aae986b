"""Registered queries: whole analyses and readers, on survey texts, pages and files made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import null_tokens, recode
from ..operators.sizing import attach
from ..session import shared_folder
from ..sources import clean_poll_rows, read_statistics, read_two_row_header, table_rows
from ..sources.pages import PollColumns
from . import fixed_values as fixed
from .benchmark_plan import benchmark, benchmark_estimates, scored_table
from .estimate_plan import all_estimates, clean_wave, election_totals
from .queries_polls import LATEST_SQL
from .queries_weighting import rounded
from .registry import query
from .views import PARTIES, PEOPLE_SQL, POLLS_SQL, RESP_SQL, people, polls, respondents

_EDUCATION = tuple(fixed.EDUCATION)
_RELIGIONS = ("Roman Catholic", "Protestant", "Muslim", "No religious", "Orthodox Catholicism", "Shinto")
_INTENTIONS = tuple(fixed.TURNOUT)
_PAST = ("Yes, I voted for CDU/CSU", "Yes, I voted for SPD", "Yes, I voted for Bündnis 90 / Die Grünen", "No, I did not vote", "I was not able to vote", "Die Linke", "FDP")
_PAST_LABELS = ("Union", "SPD", "Gruene", "No vote", "Not able", "Linke", "FDP")
_NEXT = ("CDU/CSU", "SPD", "AfD", "I would not vote", "another party", "Die Grünen")
_NEXT_LABELS = ("Union", "SPD", "AfD", "No vote", "Other", "Gruene")


def _pick(index: str, values: tuple[str, ...]) -> str:
    """One of the texts by number, in words that Spark and DuckDB share."""
    quoted = [value.replace("'", "''") for value in values]
    return f"CASE {index} % {len(values)} " + " ".join(f"WHEN {n} THEN '{value}'" for n, value in enumerate(quoted)) + " END"


def _raw_wave(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as survey rows, in the words of the questionnaire."""
    spark_text = lambda sql: sql.replace("''", "\\'")
    return respondents(spark, folder).selectExpr(
        "concat('u', id) AS uuid",
        "CAST(1 + id % 3 AS DOUBLE) AS weight",
        "CAST(14 + id % 61 AS DOUBLE) AS age",
        "IF(nation % 5 = 0, 'FR', 'DE') AS country_code",
        "IF(id % 7 = 0, 'No', 'Yes, as a citizen') AS residency",
        "IF(id % 2 = 0, 'urban', 'rural') AS degree_of_urbanisation",
        "status AS employment_status",
        "lower(gender) AS gender",
        spark_text(_pick("id", _EDUCATION)) + " AS education_level",
        spark_text(_pick("person", _RELIGIONS)) + " AS religion",
        spark_text(_pick("(id + person)", _INTENTIONS)) + " AS vote_next_national_election",
        spark_text(_pick("person", _PAST)) + " AS voted_party_last_election_de",
        f"IF(id % 11 = 0, NULL, {_pick('(id + nation)', _NEXT)}) AS vote_nextelection_de",
    )


def _map(column: str, mapping: dict[str, str], rest: str | None = None) -> str:
    quote = lambda text: text.replace("'", "''")
    whens = " ".join(f"WHEN '{quote(k)}' THEN '{quote(v)}'" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {rest or column} END"


_RELIGION_LABELS = {"Roman Catholic": "Roman Catholicism", "Protestant": "Protestantism", "Muslim": "Other", "No religious": "None", "Orthodox Catholicism": "Other"}
_WAVE_SQL = f"""{RESP_SQL},
raw AS (
  SELECT concat('u', id) AS uuid, CAST(1 + id % 3 AS DOUBLE) AS weight, CAST(14 + id % 61 AS DOUBLE) AS age,
    CASE WHEN nation % 5 = 0 THEN 'FR' ELSE 'DE' END AS country_code, CASE WHEN id % 7 = 0 THEN 'No' ELSE 'Yes, as a citizen' END AS residency,
    CASE WHEN id % 2 = 0 THEN 'urban' ELSE 'rural' END AS degree, status AS employment_status, gender, {_pick("id", _EDUCATION)} AS education_level,
    {_pick("person", _RELIGIONS)} AS religion, {_pick("(id + person)", _INTENTIONS)} AS vote_next_national_election,
    {_pick("person", _PAST_LABELS)} AS past_vote, CASE WHEN id % 11 = 0 THEN NULL ELSE {_pick("(id + nation)", _NEXT_LABELS)} END AS next_vote
  FROM resp),
wave AS (
  SELECT row_number() OVER (ORDER BY age, gender, degree, education_level, uuid) AS identifier, uuid, weight, age, country_code, education_level,
    {_map("education_level", fixed.EDUCATION, "NULL")} AS edu_cat, gender, religion, {_map("religion", _RELIGION_LABELS)} AS religion_cat,
    employment_status, vote_next_national_election, past_vote, next_vote, {_map("vote_next_national_election", fixed.TURNOUT)} AS turnout_exp,
    CASE WHEN age < 25.5 THEN '18-25' WHEN age < 35.5 THEN '26-35' WHEN age < 45.5 THEN '36-45' WHEN age < 60.5 THEN '46-60' ELSE '60+' END AS age_group,
    CASE WHEN age < 29.5 THEN '10.29' WHEN age < 49.5 THEN '30.49' ELSE '50p' END AS age_group30
  FROM raw WHERE country_code = 'DE' AND residency = 'Yes, as a citizen' AND age > 16 AND vote_next_national_election <> 'I''m not eligible to vote')"""


@query("wave_clean", f"WITH {_WAVE_SQL} SELECT * FROM wave")
def wave_clean(spark, folder):
    """A raw wave with labels, classes and a dense number."""
    return clean_wave(_raw_wave(spark, folder)).withColumn("identifier", F.col("identifier").cast("long"))


def _weights_sql(name: str, keys: str, strata: str) -> str:
    return f"""{name}_s AS (SELECT {keys}, count(*) AS n FROM v GROUP BY {keys}),
{name} AS (SELECT {keys}, (100.0 * p.n / (SELECT sum(n) FROM {strata})) / (100.0 * s.n / (SELECT sum(n) FROM {name}_s)) AS weight
  FROM {strata} p LEFT JOIN {name}_s s USING ({keys}))"""


_ESTIMATES_SQL = f"""WITH {_WAVE_SQL},
v AS (SELECT * FROM wave WHERE past_vote NOT IN ('No vote', 'Not able') AND next_vote IS NOT NULL),
exit_poll AS (SELECT gender, age_group, past_vote, 2 * count(*) + length(past_vote) AS n FROM wave GROUP BY gender, age_group, past_vote),
census AS (SELECT gender, age_group30, religion_cat, 3 * count(*) + length(religion_cat) AS n FROM wave GROUP BY gender, age_group30, religion_cat),
{_weights_sql("we", "gender, age_group, past_vote", "exit_poll")},
{_weights_sql("wc", "gender, age_group30, religion_cat", "census")},
x AS (
  SELECT 'unweighted' AS method, next_vote AS party, CAST(count(*) AS DOUBLE) AS n FROM v WHERE next_vote <> 'No vote' GROUP BY next_vote
  UNION ALL SELECT 'exit-poll', next_vote, sum(we.weight) FROM v JOIN we USING (gender, age_group, past_vote) WHERE next_vote <> 'No vote' GROUP BY next_vote
  UNION ALL SELECT 'census', next_vote, sum(wc.weight) FROM v JOIN wc USING (gender, age_group30, religion_cat)
    WHERE next_vote <> 'No vote' AND turnout_exp = '1' GROUP BY next_vote)
SELECT method, DATE '2017-03-01' AS date, party, round(n, 5) AS n, round(100 * n / sum(n) OVER (PARTITION BY method), 7) AS pct FROM x"""


@query("all_estimates", _ESTIMATES_SQL)
def every_estimate(spark, folder):
    """Unweighted, exit-poll and census estimates of one wave."""
    wave = clean_wave(_raw_wave(spark, folder), numbered=False)
    strata = wave.groupBy("gender", "age_group", F.col("past_vote").alias("party")).agg(F.expr("2 * count(*) + length(past_vote) AS n"))
    census = wave.groupBy("gender", "age_group30", "religion_cat").agg(F.expr("3 * count(*) + length(religion_cat) AS n"))
    return rounded(all_estimates({"2017-03-01": wave}, strata, census), 5, "n").withColumn("pct", F.round("pct", 7))


# Polls on a stored page, about: pages of a source and month are dealt by the hash of the poll.
PAGE_ROWS = 500


def _page_day(column: str) -> str:
    return f"date_format({column}, 'dd.MM.yyyy')"


def _paged(rows: DataFrame, key: str, page_rows: int) -> DataFrame:
    """Rows with a number ``page``, so that a page of a key has about ``page_rows`` rows, however many the key has."""
    counts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / page_rows).alias("pages"))
    return attach(rows, counts, [key], null_safe=True).withColumn("page", F.pmod(F.xxhash64("row"), "pages")).drop("pages")


@query(
    "poll_table_rows",
    f"""WITH {POLLS_SQL}
SELECT concat(institut, strftime(datum, '-%Y-%m')) AS institut, datum, befragte, 'online' AS typ, partei,
       floor(1000 * anteil) / 1000.0 AS anteil, event_id::VARCHAR AS zeitraum FROM polls""",
)
def poll_table_rows(spark, folder):
    """Polls written as HTML tables, pages of bounded size for every source and month, and read back."""
    cells = [f"IF(partei = '{p}', concat(CAST(floor(1000 * anteil) DIV 10 AS STRING), ',', CAST(floor(1000 * anteil) % 10 AS STRING), ' %'), '')" for p in PARTIES]
    texts = [_page_day("datum"), *cells, "concat('O • ', replace(format_number(befragte, 0), ',', '.'))", "CAST(event_id AS STRING)"]
    row = "concat('<tr class=\"r\">', " + ", ".join(f"'<td>', {text}, '</td>'" for text in texts) + ", '</tr>')"
    head = "".join(f"<th>{name}</th>" for name in ("", *PARTIES, "Befragte", "Zeitraum"))
    rows = polls(spark, folder).selectExpr("concat(institut, date_format(datum, '-yyyy-MM')) AS institut", f"{row} AS row")
    pages = (
        _paged(rows, "institut", PAGE_ROWS)
        .groupBy("institut", "page")
        .agg(F.concat(F.lit(f"<table><thead>{head}</thead><tbody>"), F.array_join(F.collect_list("row"), ""), F.lit("</tbody></table>")).alias("html"))
    )
    raw = table_rows(pages, "institut", (*PARTIES, "Befragte", "Zeitraum"))
    raw = null_tokens(raw, [""])
    found = clean_poll_rows(raw, PollColumns(parties={p: p for p in PARTIES})).filter("anteil IS NOT NULL")
    return found.select("institut", "datum", "befragte", "typ", "partei", F.round("anteil", 3).alias("anteil"), "zeitraum")


def _file(spark: SparkSession, lines: DataFrame) -> str:
    """Write (place, text) lines of a small published table as one text file, in order."""
    path = f"{shared_folder(spark).rstrip('/')}/statistics-{uuid.uuid4().hex}"
    lines.coalesce(1).sortWithinPartitions("place").select("text").write.text(path)
    return path


@query(
    "statistics_reader",
    f"""WITH {PEOPLE_SQL}
SELECT CAST(nation AS VARCHAR) AS label, CASE WHEN nation = 3 THEN NULL ELSE CAST(count(*) AS DOUBLE) / 2 END AS half,
       CASE WHEN nation = 4 THEN NULL ELSE CAST(count(DISTINCT past) AS DOUBLE) END AS kinds FROM people GROUP BY nation""",
)
def statistics_reader(spark, folder):
    """A table with preamble, decimal commas and several marks for missing values."""
    counts = people(spark, folder).groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("past").alias("kinds"))
    body = counts.selectExpr(
        "10 + nation AS place",
        "concat_ws(';', nation, IF(nation = 3, '/', concat(n DIV 2, IF(n % 2 = 1, ',5', ',0'))), IF(nation = 4, '-', CAST(kinds AS STRING))) AS text",
    )
    preamble = spark.range(4).selectExpr("CAST(id AS INT) AS place", "concat('Notes; line ', id) AS text")
    table = read_statistics(spark, _file(spark, preamble.unionByName(body)), ["label", "half", "kinds"], 4, na=("/", "-", ""), numeric=["half", "kinds"])
    return table.select("label", "half", "kinds")


@query(
    "two_row_header",
    f"""WITH {PEOPLE_SQL}, c AS (SELECT past, agegroup, gender, count(*) AS n FROM people GROUP BY ALL)
SELECT past AS "Religion", sum(n) FILTER (WHERE gender = 'Male' AND agegroup = '26-35')::VARCHAR AS "Male.young",
  sum(n) FILTER (WHERE gender = 'Male' AND agegroup = '60+')::VARCHAR AS "Male.old",
  NULL::VARCHAR AS "Female.young", sum(n) FILTER (WHERE gender = 'Female' AND agegroup = '60+')::VARCHAR AS "Female.old" FROM c GROUP BY past""",
)
def two_row_header(spark, folder):
    """Column names over two lines, suppressed cells."""
    count = lambda gender, age: F.count_if((F.col("gender") == gender) & (F.col("agegroup") == age)).cast("string")
    cells = people(spark, folder).groupBy("past").agg(
        F.concat_ws(";", F.first("past"), count("Male", "26-35"), count("Male", "60+"), F.lit("/"), count("Female", "60+")).alias("text")
    )
    head = spark.createDataFrame([("0", "Title"), ("1", "Religion;Male;;Female;"), ("2", ";young;old;young;old")], "place STRING, text STRING")
    path = _file(spark, head.unionByName(cells.select(F.concat(F.lit("9"), "past").alias("place"), "text")))
    return read_two_row_header(spark, path, 1, 2, 3).drop("file", "line")


_PARTY_NAMES = ("CDU", "CSU", "SPD", "DIE LINKE", "AfD", "FDP", "GRUENE", "PIRATEN", "NPD")


@query(
    "election_totals",
    f"""WITH {PEOPLE_SQL},
r AS (SELECT {_pick("nation", _PARTY_NAMES)} AS p, count(*) AS n FROM people GROUP BY ALL)
SELECT CASE p WHEN 'DIE LINKE' THEN 'Linke' WHEN 'GRUENE' THEN 'Gruene' WHEN 'PIRATEN' THEN 'Other' WHEN 'NPD' THEN 'Other' ELSE p END AS party,
  sum(n)::BIGINT AS "Zweitstimmen_n", round(sum(100.0 * n / (SELECT sum(n) FROM r)), 8) AS "Zweitstimmen_pct",
  round(sum(50.0 * n / (SELECT sum(n) FROM r)), 8) AS "Erststimmen_pct" FROM r GROUP BY ALL""",
)
def totals_of_an_election(spark, folder):
    """Party totals; the rows that count voters and ballots are left out by name."""
    votes = people(spark, folder).groupBy(F.expr(_pick("nation", _PARTY_NAMES)).alias("Parteien")).agg(F.count(F.lit(1)).alias("Zweitstimmen_n"))
    total = people(spark, folder).agg(F.count(F.lit(1))).scalar()
    ballots = spark.createDataFrame([(name,) for name in fixed.BALLOT_ROWS], "Parteien STRING").withColumn("Zweitstimmen_n", total)
    results = votes.unionByName(ballots).withColumn("_all", total)
    results = results.selectExpr("Parteien", "Zweitstimmen_n", "100.0D * Zweitstimmen_n / _all AS Zweitstimmen_pct", "50.0D * Zweitstimmen_n / _all AS Erststimmen_pct")
    return rounded(election_totals(results), 8, "Zweitstimmen_pct", "Erststimmen_pct")


_BENCHMARK_LABELS = {"click": "CDU/CSU", "error": "SPD", "purchase": "Grüne", "signup": "Linke", "view": "AfD"}
_RESULT_LABELS = {"click": "Union", "error": "SPD", "purchase": "Gruene", "signup": "Linke", "view": "AfD"}
_DAYS = ("2024-01-20", "2024-01-25")
_SCORED_SQL = f"""{LATEST_SQL},
d1 AS (SELECT DISTINCT partei, datum, befragte, anteil FROM polls),
w1 AS (SELECT *, avg(anteil) OVER t AS m, count(*) OVER t AS k FROM d1
       WINDOW t AS (PARTITION BY partei ORDER BY datum, befragte, anteil ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
tens AS (SELECT datum, partei, avg(CASE WHEN k = 10 THEN m END) AS rolling_average FROM w1 GROUP BY datum, partei),
means AS (
  SELECT 'rolling average' AS method, partei, avg(100 * rolling_average) AS pct FROM series WHERE datum IN ('{_DAYS[0]}', '{_DAYS[1]}') GROUP BY partei
  UNION ALL SELECT 'ten polls', partei, avg(100 * rolling_average) FROM tens WHERE datum IN ('{_DAYS[0]}', '{_DAYS[1]}') GROUP BY partei),
e AS (
  SELECT method, {_map("partei", _RESULT_LABELS)} AS party, round(pct, 1) AS pct FROM means
  UNION ALL SELECT 'rolling average', 'Other', round(100 - sum(pct), 1) FROM means WHERE method = 'rolling average'),
s AS (SELECT a.method, sqrt(avg((a.pct - b.pct) * (a.pct - b.pct))) AS rmse FROM e a JOIN e b ON b.party = a.party AND b.method = 'rolling average' GROUP BY a.method)
SELECT CASE method WHEN 'ten polls' THEN 'Ten polls' ELSE method END AS "Method", 2024 AS "Year",
  {", ".join(f"max(pct) FILTER (WHERE party = '{p}') AS " + '"' + p + '"' for p in fixed.PARTIES)}, round(any_value(rmse), 6) AS "RMSE"
FROM e JOIN s USING (method) GROUP BY method"""


@query("benchmark_scored", _SCORED_SQL)
def benchmark_scored(spark, folder):
    """The mean of ten polls scored against the latest poll of every source."""
    named = polls(spark, folder).withColumn("partei", recode(F.col("partei"), _BENCHMARK_LABELS))
    reference = benchmark_estimates(benchmark(named), _DAYS)
    estimates = benchmark_estimates(benchmark(named, "rolling"), _DAYS, "ten polls")
    return rounded(scored_table(estimates, reference, {"^ten": "Ten polls"}), 6, "RMSE")
