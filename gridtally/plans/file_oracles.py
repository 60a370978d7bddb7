"""SQL of the queries about files, stored state and exports."""

from __future__ import annotations

from gridtally.plans.sql_parts import DAILY, PAYMENTS, RAW_READINGS, READINGS, TYPED, kpi_rows, money, percent, suite_sql, with_

_DISTINCT = """, kept AS (
  SELECT DISTINCT servicepointno, meterno, categorycode, transactionamount, issuedate, issuedate_parse_status FROM typed)
"""
_TOTALS = f"""SELECT issuedate_parse_status, count(*) AS "rows", count(meterno) AS meters, {money('transactionamount')} AS total_value FROM {{source}}
GROUP BY issuedate_parse_status"""

_COLUMNS = "servicepointno, meterno, categorycode, transactionamount, issuedate"
_MAPPED = ", ".join(f"{c}->{c}" for c in _COLUMNS.split(", "))
_OK = f"ok | 5 | {_COLUMNS} | {_COLUMNS} | true |  | All required columns present | {_MAPPED} | keep_all"
_LONG = "Error tokenizing data: a record has more fields than the header"
_EMPTY = "No columns to parse from file"
_POLICY = "Vend duplicate policy ''keep_all'': N duplicate rows before policy, N after policy."


def _file(policy: str, text: str, files: int, source: str | None = None) -> str:
    figures = "cast(0 AS bigint) AS rows_read, cast(0 AS bigint) AS parse_warnings"
    if source:
        figures = "count(*) AS rows_read, count(CASE WHEN issuedate_parse_status <> 'parsed_datetime' THEN 1 END) AS parse_warnings"
    tail = f" FROM typed WHERE {source}" if source else ""
    return f"SELECT '{policy}' AS policy, 'file' AS kind, '{text}' AS text, cast({files} AS bigint) AS files, {figures}{tail}"


def _note(policy: str, severity: str, text: str, times: int) -> str:
    return (f"SELECT '{policy}' AS policy, '{severity}' AS kind, '{text}' AS text, cast({times} AS bigint) AS files, "
            "cast(NULL AS bigint) AS rows_read, cast(NULL AS bigint) AS parse_warnings")


def _failed(why: str) -> str:
    return f"error | 0 |  |  | false |  | Failed to read file: {why} |  | keep_all"


_MALFORMED = "\nUNION ALL\n".join([
    _file("fail_file", _OK, 2, "event_id % 4 < 2"), _file("fail_file", _failed(_LONG), 4), _file("fail_file", _failed(_EMPTY), 1),
    _note("fail_file", "error", f"Failed to read *: {_LONG}", 4), _note("fail_file", "error", f"Failed to read *: {_EMPTY}", 1),
    _note("fail_file", "success", _POLICY, 1), _note("fail_file", "success", "Wrote table with N rows.", 1),
    _file("quarantine", _OK, 6, "event_id % 8 NOT IN (2, 3)"), _file("quarantine", _failed(_EMPTY), 1),
    _note("quarantine", "error", f"Failed to read *: {_EMPTY}", 1), _note("quarantine", "success", _POLICY, 1),
    _note("quarantine", "success", "Wrote table with N rows.", 1),
])


def _keyed(dataset: str, rollup: str, key: str, source: str, measure: str) -> str:
    return (f"SELECT '{dataset}' AS dataset, '{rollup}' AS rollup, cast({key} AS varchar) AS \"key\", {money(measure)} AS value "
            f"FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}")


def _renamed(rows: str) -> str:
    return f"SELECT dataset, 'kpi' AS rollup, metric AS \"key\", value FROM ({rows})"


_STATE = "\nUNION ALL\n".join([
    _keyed("vend", "day", "vend_date", "typed", "transactionamount"), _keyed("vend", "entity", "servicepointno", "typed", "transactionamount"),
    _keyed("vend", "source", "source_file", "typed", "transactionamount"), _keyed("vend", "hour", "analysis_hour", "typed", "transactionamount"),
    _keyed("vend", "category", "categorycode", "typed", "transactionamount"), _keyed("consumption", "day", "date", "readings", "kwh_consumption"),
    _keyed("consumption", "entity", "mtrid", "readings", "kwh_consumption"), _keyed("consumption", "source", "source_file", "readings", "kwh_consumption"),
    _renamed(kpi_rows("vend", "typed", {
        "rows": "count(*)", "transactions": "count(*)", "unique_service_points": "count(DISTINCT servicepointno)", "unique_meters": "count(DISTINCT meterno)",
        "total_transaction_amount": money("transactionamount"), "average_transaction_amount": f"{money('transactionamount')} / count(transactionamount)",
        "time_only_rows": "count(CASE WHEN issuedate_is_time_only THEN 1 END)"})),
    _renamed(kpi_rows("consumption", "readings", {
        "rows": "count(*)", "unique_meters": "count(DISTINCT mtrid)", "total_kwh_consumption": money("kwh_consumption"),
        "total_kvah_consumption": money("kvah_consumption")})),
    _renamed(kpi_rows("consumption", DAILY, {
        "average_daily_kwh": "cast(sum(cast(s AS decimal(18,2))) AS double) / count(*)", "min_daily_kwh": "min(s)", "max_daily_kwh": "max(s)"})),
])


def _sketch(column: str, source: str, numeric: bool) -> str:
    return (f"SELECT '{column}' AS \"column\", count(*) AS \"rows\", count(*) - count({source}) AS nulls, count(DISTINCT {source}) AS distinct_exact, "
            f"true AS distinct_within, {'true' if numeric else 'cast(NULL AS boolean)'} AS quartiles_within FROM typed")


def _key(dataset: str, field: str, source: str, columns: list[str]) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    names = ", ".join(columns)
    figures = f"(SELECT count(*) AS n_rows, count(CASE WHEN NOT ({whole}) THEN 1 END) AS n_null FROM {source})"
    groups = f"(SELECT count(*) AS n_keys, coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM {source} WHERE {whole} GROUP BY {names}))"
    return (f"SELECT '{dataset}' AS dataset, '{field}' AS field, n_rows AS \"rows\", n_null AS null_rows, n_keys AS distinct_keys, "
            f"{percent('n_keys', '(n_rows - n_null)')} AS distinct_pct, {percent('n_null', 'n_rows')} AS null_pct, most AS most_rows, "
            f"most = 1 AND n_null = 0 AS \"unique\" FROM {figures}, {groups}")


_STORED = ("payment_id", "servicepointno", "meterno", "categorycode", "transactionamount", "issuedate_parsed", "vend_date", "source_file")

FILE_ORACLES: dict[str, str] = {
    "incremental_dedup": with_(TYPED) + _DISTINCT + _TOTALS.format(source="kept"),
    "incremental_dedup_last": with_(TYPED) + _DISTINCT + _TOTALS.format(source="kept"),
    "incremental_replace": with_(TYPED) + _TOTALS.format(source="typed WHERE event_id % 3 = 2 OR (event_id % 3 = 1 AND event_id % 2 = 0)"),
    "rollup_state": with_(TYPED, READINGS) + _STATE,
    "stored_sketches": with_(TYPED) + "\nUNION ALL\n".join(
        _sketch(c, "issuedate" if c == "issuedate_raw" else c, c == "transactionamount")
        for c in ("servicepointno", "meterno", "categorycode", "transactionamount", "issuedate_raw")),
    "malformed_ingest": with_(TYPED) + _MALFORMED,
    "partition_rewrite": with_(PAYMENTS) + f"""SELECT strftime(vend_date, '%Y-%m') AS vend_month, count(*) AS "rows",
       {money("transactionamount + CASE WHEN strftime(vend_date, '%Y-%m') = '1996-03' THEN 1 ELSE 0 END")} AS total_value,
       strftime(vend_date, '%Y-%m') = '1996-03' AS rewritten FROM payments GROUP BY strftime(vend_date, '%Y-%m')""",
    "report_round_trip": suite_sql().replace("WITH ", f"WITH {RAW_READINGS},\n", 1) + """
UNION ALL
SELECT 'consumption', 'parse_summary', CASE WHEN midnightdate_parsed IS NULL THEN 'failed_or_missing' ELSE 'parsed_datetime' END, 'count', cast(count(*) AS double)
FROM raw_readings GROUP BY midnightdate_parsed IS NULL
UNION ALL
SELECT 'consumption', 'duplicate_rows', 'consumption', 'duplicate_rows', 
       cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, mtrid, midnightdate, kwh_consumption, source_file FROM raw_readings)) AS double)
FROM raw_readings""",
    "candidate_keys": with_(TYPED, READINGS) + "\nUNION ALL\n".join([
        _key("vend", "servicepointno", "typed", ["servicepointno"]), _key("vend", "meterno", "typed", ["meterno"]),
        _key("vend", "servicepointno + meterno", "typed", ["servicepointno", "meterno"]), _key("consumption", "mtrid", "readings", ["mtrid"])]),
    "field_snapshot": f"""SELECT 'vend' AS dataset, '{", ".join(_STORED)}' AS available_columns
UNION ALL SELECT 'consumption', 'mtrid, kwh_consumption, kvah_consumption, midnightdate_parsed, date, source_file'""",
    "bundle_summary": with_(TYPED, RAW_READINGS) + """, twice AS (
  SELECT * FROM typed UNION ALL SELECT * FROM typed WHERE event_id % 10 = 0)
SELECT 'vend' AS dataset, true AS ok, cast(5 AS bigint) AS files, cast(2 AS bigint) AS failed_files, cast(0 AS bigint) AS files_missing_columns,
       count(*) AS rows_read, count(CASE WHEN issuedate_parse_status <> 'parsed_datetime' THEN 1 END) AS parse_warnings, count(*) AS "rows",
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT servicepointno, meterno, categorycode, transactionamount, issuedate FROM twice)) AS duplicate_rows,
       cast(2 AS bigint) AS errors
FROM twice
UNION ALL
SELECT 'consumption', true, 3, 0, 0, count(*), count(*) - count(midnightdate_parsed), count(*),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT mtrid, midnightdate, kwh_consumption FROM raw_readings)), 0
FROM raw_readings""",
    "csv_export": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'say "hi", twice' WHEN 3 THEN 'line one' || chr(10) || 'line two'
         WHEN 4 THEN '  007 ' WHEN 5 THEN 'NA' ELSE lpad(cast(user_id AS varchar), 8, '0') END AS note, value AS amount, cast(ts AS date) AS day
FROM events""",
    "stored_columns": with_(PAYMENTS) + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"values\", true AS has_bytes FROM payments" for c in _STORED),
}
