"""Pieces of SQL that the queries' SQL is made of: the given tables as readings and payments, sums, statistics."""

from __future__ import annotations

from gridtally.functions.text import WHITESPACE
from gridtally.spec import LIMITATIONS, VEND_DATE_LIMITATION

SPACES = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(cell: str) -> str:
    return f"trim({cell}, {SPACES})"


def money(cell: str) -> str:
    return f"coalesce(cast(sum(cast({cell} AS decimal(18,2))) AS double), 0.0)"


def percent(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN cast({part} AS double) / {whole} * 100.0 ELSE 0.0 END)"


READINGS = """readings AS (
  SELECT l_suppkey AS mtrid, l_quantity AS kwh_consumption, l_extendedprice AS kvah_consumption,
         l_shipdate AS midnightdate_parsed, cast(l_shipdate AS date) AS date, l_linestatus AS source_file
  FROM lineitem)"""

PAYMENTS = """payments AS (
  SELECT o_orderkey AS payment_id, o_custkey % 40 AS servicepointno, o_custkey AS meterno,
         o_orderpriority AS categorycode, o_totalprice AS transactionamount,
         o_orderdate AS issuedate_parsed, cast(o_orderdate AS date) AS vend_date, o_orderstatus AS source_file
  FROM orders)"""

# The text extract and its typed form; amounts of the extract are typed from their definition.
RAW = """raw AS (
  SELECT event_id, ts, cast(user_id % 40 AS varchar) AS servicepointno,
         CASE WHEN event_id % 19 <> 0 THEN '  ' || cast(user_id AS varchar) END AS meterno,
         CASE WHEN event_id % 17 <> 0 THEN event_type END AS categorycode,
         CASE event_id % 13 WHEN 0 THEN 'abc' WHEN 1 THEN '1.5d'
           WHEN 2 THEN '  ' || cast(value AS varchar) || ' ' || chr(9)
           WHEN 3 THEN '-3.25' WHEN 4 THEN '0' WHEN 5 THEN '+2e1' ELSE cast(value AS varchar) END AS transactionamount,
         CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN strftime(ts, '%H:%M') WHEN 2 THEN 'bad-date'
           ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS issuedate,
         'file_' || cast(event_id % 3 AS varchar) AS source_file
  FROM events)"""

TYPED = (
    RAW
    + f""",
cleaned AS (
  SELECT event_id, ts, servicepointno, {strip('meterno')} AS meterno, categorycode, source_file,
         {strip('transactionamount')} AS amount_text, {strip('issuedate')} AS issuedate
  FROM raw),
parsed AS (
  SELECT *, CASE WHEN regexp_full_match(amount_text, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
                 THEN try_cast(ltrim(amount_text, '+') AS double) END AS transactionamount,
         try_strptime(issuedate, '%Y-%m-%d %H:%M') AS issuedate_parsed,
         regexp_full_match(issuedate, '[0-9]{{1,2}}:[0-9]{{2}}') AS issuedate_is_time_only
  FROM cleaned),
typed AS (
  SELECT *, CASE WHEN issuedate = '' THEN 'missing' WHEN issuedate_is_time_only THEN 'time_only'
                 WHEN issuedate_parsed IS NOT NULL THEN 'parsed_datetime' ELSE 'failed' END AS issuedate_parse_status,
         CASE WHEN issuedate_is_time_only THEN issuedate END AS issuedate_time_only_text,
         CASE WHEN issuedate_is_time_only THEN cast(split_part(issuedate, ':', 1) AS bigint) END AS issuedate_time_hour,
         cast(issuedate_parsed AS date) AS vend_date,
         cast(hour(issuedate_parsed) AS bigint) AS vend_hour,
         coalesce(cast(hour(issuedate_parsed) AS bigint),
                  CASE WHEN issuedate_is_time_only THEN cast(split_part(issuedate, ':', 1) AS bigint) END) AS analysis_hour
  FROM parsed)"""
)

RAW_READINGS = """raw_readings AS (
  SELECT l_orderkey, l_linenumber, cast(l_suppkey AS varchar) AS mtrid, l_quantity AS kwh_consumption,
         l_linestatus AS source_file, l_shipdate,
         CASE l_orderkey % 11 WHEN 0 THEN 'not-a-date' WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y')
           WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 06:30:00' WHEN 3 THEN NULL
           ELSE strftime(l_shipdate, '%Y-%m-%d') END AS midnightdate,
         CASE l_orderkey % 11 WHEN 0 THEN NULL WHEN 3 THEN NULL
           WHEN 2 THEN date_trunc('day', l_shipdate) + INTERVAL '6 hours 30 minutes'
           ELSE cast(date_trunc('day', l_shipdate) AS timestamp) END AS midnightdate_parsed
  FROM lineitem)"""

REPEATED = (
    PAYMENTS
    + """,
dated AS (
  SELECT payment_id, servicepointno, meterno, categorycode, transactionamount, source_file,
         CASE WHEN payment_id % 30 <> 0 THEN vend_date END AS vend_date FROM payments),
repeated AS (
  SELECT * FROM dated UNION ALL SELECT * FROM dated WHERE payment_id % 10 = 0
  UNION ALL SELECT * FROM dated WHERE payment_id % 50 = 0),
groups AS (
  SELECT payment_id, servicepointno, meterno, categorycode, transactionamount, source_file, vend_date,
         count(*) AS copies
  FROM repeated GROUP BY ALL HAVING count(*) > 1)"""
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def ranked(value: str, source: str, group: str = "0") -> str:
    """CTE of values with rank and count inside their group."""
    return f"""ranked AS (
  SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS k,
         count(*) OVER (PARTITION BY {group}) - 1 AS last
  FROM {source} WHERE {value} IS NOT NULL)"""


def quantile(share: float) -> str:
    """Linear percentile from the two neighbouring order statistics."""
    low = f"max(CASE WHEN k = floor(last * {share}) THEN v END)"
    high = f"max(CASE WHEN k = ceil(last * {share}) THEN v END)"
    place = f"(max(last) * {share}e0)"
    return (
        f"CASE WHEN {low} = {high} THEN {low} "
        f"ELSE (ceil({place}) - {place}) * {low} + ({place} - floor({place})) * {high} END"
    )


QUARTILES = f"""quartiles AS (
  SELECT g, count(*) AS n, {quantile(0.25)} AS q1, {quantile(0.5)} AS median, {quantile(0.75)} AS q3
  FROM ranked GROUP BY g),
fences AS (
  SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM quartiles)"""

BOX = """
SELECT f.n, f.q1, f.median, f.q3,
       min(CASE WHEN v BETWEEN lo AND hi THEN v END) AS lower_whisker,
       max(CASE WHEN v BETWEEN lo AND hi THEN v END) AS upper_whisker,
       count(CASE WHEN NOT v BETWEEN lo AND hi THEN 1 END) AS outlier_count{key}
FROM ranked r JOIN fences f ON r.g = f.g GROUP BY ALL"""


def kpi_rows(dataset: str, source: str, metrics: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{dataset}' AS dataset, '{m}' AS metric, cast(({e}) AS double) AS value FROM {source}"
        for m, e in metrics.items()
    )


DAILY = f"(SELECT date, {money('kwh_consumption')} AS s FROM readings WHERE date IS NOT NULL GROUP BY date)"
DAILY_MEAN = f"(SELECT cast(sum(cast(s AS decimal(18,2))) AS double) / count(*) FROM {DAILY})"


def profile_row(position: int, column: str, dtype: str, ranged: bool) -> str:
    text = f"cast({column} AS varchar)"
    first = f"(SELECT string_agg(t, ' | ' ORDER BY payment_id) FROM (SELECT payment_id, {text} AS t FROM payments WHERE {column} IS NOT NULL ORDER BY payment_id LIMIT 3))"
    low, high = (f"cast(min({column}) AS varchar)", f"cast(max({column}) AS varchar)") if ranged else ("NULL", "NULL")
    return f"""SELECT cast({position} AS bigint) AS position, '{column}' AS "column", '{dtype}' AS dtype, count({column}) AS non_null_count,
       count(*) - count({column}) AS null_count,
       round_even({percent(f'(count(*) - count({column}))', 'count(*)')}, 2) AS missing_pct,
       count(DISTINCT {column}) AS unique_count, {first} AS sample_values, {low} AS min_value, {high} AS max_value
FROM payments"""


def warning_texts(source: str, texts: list[tuple[str, str]]) -> str:
    """Ordered non-null texts with positions from 0."""
    values = "\nUNION ALL\n".join(
        f"SELECT {i} AS i, ({text}) AS warning FROM {source} WHERE {condition}" for i, (text, condition) in enumerate(texts)
    )
    return f"SELECT row_number() OVER (ORDER BY i) - 1 AS position, warning FROM ({values})"


COUNTS = """counts AS (
  SELECT count(*) AS n, count(CASE WHEN issuedate_parse_status = 'time_only' THEN 1 END) AS time_only,
         count(CASE WHEN issuedate_parse_status = 'missing' THEN 1 END) AS missing,
         count(CASE WHEN issuedate_parse_status = 'parsed_datetime' THEN 1 END) AS parsed
  FROM {source})"""


def status_texts() -> list[tuple[str, str]]:
    def number(count: str) -> str:
        return f"format('{{:,}}', {count})"

    fixed = [(f"'{t}'", "true") for t in (*LIMITATIONS, VEND_DATE_LIMITATION)]
    share = "cast(parsed AS double) / n * 100.0"
    return fixed + [
        (f"{number('time_only')} || ' vend records contain time-only issuedate values and cannot support full date analysis.'", "time_only > 0"),
        (f"{number('missing')} || ' vend records have missing issuedate values.'", "missing > 0"),
        ("'No vend rows currently contain a parsed full datetime.'", "parsed = 0 AND n > 0"),
        (
            f"'Vend full datetime coverage is ' || format('{{:.1f}}', {share}) || "
            "'% which is below the warning threshold of 70.0%. Date-based charts remain available with caution.'",
            f"n > 0 AND {share} < 70",
        ),
    ]


# The suite runs on the typed payments with every tenth row twice.
SUITE = TYPED + """,
twice AS (SELECT * FROM typed UNION ALL SELECT * FROM typed WHERE event_id % 10 = 0)"""

SUITE_COLUMNS = (
    "event_id servicepointno meterno categorycode transactionamount issuedate source_file issuedate_raw "
    "issuedate_parse_status issuedate_is_time_only issuedate_parsed issuedate_time_only_text issuedate_time_hour "
    "vend_date vend_month vend_week vend_day_of_week vend_hour analysis_hour"
).split()
# Columns whose nulls follow those of another column.
SUITE_SOURCE = {
    "issuedate_raw": "issuedate",
    "vend_month": "vend_date",
    "vend_week": "vend_date",
    "vend_day_of_week": "vend_date",
}


def suite_sql() -> str:
    def rows(check: str, item: str, source: str, metrics: dict[str, str], tail: str = "") -> list[str]:
        return [
            f"SELECT 'vend' AS dataset, '{check}' AS \"check\", {item} AS item, '{m}' AS metric, cast({e} AS double) AS value FROM {source} {tail}"
            for m, e in metrics.items()
        ]

    parts: list[str] = []
    for c in SUITE_COLUMNS:
        missing = f"(count(*) - count({SUITE_SOURCE.get(c, c)}))"
        parts += rows("missing_summary", f"'{c}'", "twice", {"missing_count": missing, "missing_pct": f"round_even({percent(missing, 'count(*)')}, 2)"})
    parts += rows("parse_summary", "issuedate_parse_status", "twice", {"count": "count(*)"}, "GROUP BY issuedate_parse_status")
    parts += rows(
        "numeric_flags",
        "'transactionamount'",
        "twice",
        {
            "null_count": "count(*) - count(transactionamount)",
            "negative_count": "count(CASE WHEN transactionamount < 0 THEN 1 END)",
            "zero_count": "count(CASE WHEN transactionamount = 0 THEN 1 END)",
        },
    )
    parts += rows(
        "outlier_summary",
        "'transactionamount'",
        "fences",
        {
            "outlier_count": "(SELECT count(*) FROM ranked, fences WHERE v < lo OR v > hi)",
            "lower_bound": "lo",
            "upper_bound": "hi",
            "iqr_multiplier": "1.5",
        },
    )
    parts += rows(
        "temporal_summary",
        "'issuedate_parsed'",
        "twice",
        {
            "parsed_rows": "count(issuedate_parsed)",
            "total_rows": "count(*)",
            "parse_coverage_pct": f"round_even({percent('count(issuedate_parsed)', 'count(*)')}, 2)",
            "future_row_count": "count(CASE WHEN issuedate_parsed > TIMESTAMP '2024-01-20 12:00:00' THEN 1 END)",
            "stale_days": "max(90)",
        },
    )
    parts += rows("duplicates_by_source", "source_file", "typed", {"duplicate_rows": "2 * count(*)"}, "WHERE event_id % 10 = 0 GROUP BY source_file")
    parts += rows(
        "duplicates_by_date",
        "coalesce(cast(vend_date AS varchar), 'unknown')",
        "typed",
        {"duplicate_rows": "2 * count(*)"},
        "WHERE event_id % 10 = 0 GROUP BY coalesce(cast(vend_date AS varchar), 'unknown')",
    )
    parts += rows("duplicate_rows", "'vend'", "typed", {"duplicate_rows": "count(*)"}, "WHERE event_id % 10 = 0")
    parts += rows(
        "categorical_summary",
        "'categorycode'",
        "twice",
        {"allowed_count": "max(2)", "invalid_count": "count(CASE WHEN categorycode NOT IN ('click', 'view') THEN 1 END)"},
    )
    return with_(SUITE, ranked("transactionamount", "twice"), QUARTILES) + "\nUNION ALL\n".join(parts)


def outlier_union() -> str:
    def one(column: str, name: str) -> str:
        own = ranked(column, "typed").replace("ranked AS", f"ranked_{name} AS")
        fences = QUARTILES.replace("ranked", f"ranked_{name}").replace("quartiles", f"quartiles_{name}").replace("fences AS", f"fences_{name} AS")
        return own + ",\n" + fences

    def row(column: str, name: str) -> str:
        return (
            f"SELECT '{column}' AS \"column\", count(CASE WHEN v < lo OR v > hi THEN 1 END) AS outlier_count, "
            f"lo AS lower_bound, hi AS upper_bound, 1.5e0 AS iqr_multiplier "
            f"FROM ranked_{name} r JOIN fences_{name} f ON r.g = f.g GROUP BY lo, hi"
        )

    return with_(TYPED, one("transactionamount", "a"), one("cast(event_id AS double)", "b")) + row("transactionamount", "a") + " UNION ALL " + row("event_id", "b")


FLAGS = ("count(*) - count({c}) AS null_count, count(CASE WHEN {c} < 0 THEN 1 END) AS negative_count, "
          "count(CASE WHEN {c} = 0 THEN 1 END) AS zero_count")
