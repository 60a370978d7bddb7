"""For each registered query, the same result in ANSI-style SQL over the given tables."""

from __future__ import annotations

from gridtally.plans.file_oracles import FILE_ORACLES
from gridtally.plans.sql_parts import (
    BOX,
    COUNTS,
    DAILY,
    DAILY_MEAN,
    FLAGS,
    kpi_rows,
    money,
    outlier_union,
    PAYMENTS,
    percent,
    profile_row,
    QUARTILES,
    ranked,
    RAW,
    RAW_READINGS,
    READINGS,
    REPEATED,
    status_texts,
    strip,
    SUITE,
    suite_sql,
    TYPED,
    warning_texts,
    with_,
)

ORACLES: dict[str, str] = {
    "trim_text": with_(RAW) + f"SELECT event_id, {strip('meterno')} AS meterno, {strip('issuedate')} AS issuedate FROM raw",
    "null_tokens": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NA' ELSE event_type END AS cell
FROM events""",
    "coerce_numeric": with_(TYPED) + "SELECT event_id, transactionamount FROM typed",
    "parse_dates": with_(RAW_READINGS)
    + "SELECT l_orderkey, l_linenumber, cast(midnightdate_parsed AS varchar) AS parsed FROM raw_readings",
    "parse_dates_per_file": with_(RAW_READINGS)
    + """, shaped AS (
  SELECT *, regexp_replace(regexp_replace(midnightdate, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'a', 'g') AS shape FROM raw_readings),
first_shape AS (
  SELECT source_file, arg_min(shape, l_orderkey * 100 + l_linenumber) AS shape,
         arg_min(midnightdate_parsed IS NOT NULL, l_orderkey * 100 + l_linenumber) AS known
  FROM shaped WHERE midnightdate IS NOT NULL GROUP BY source_file)
SELECT s.source_file, count(*) AS "rows",
       count(CASE WHEN NOT f.known OR s.shape = f.shape THEN midnightdate_parsed END) AS parsed
FROM shaped s JOIN first_shape f ON s.source_file = f.source_file GROUP BY s.source_file""",
    "enrich_readings": with_(RAW_READINGS)
    + """SELECT l_orderkey, l_linenumber, mtrid, kwh_consumption, midnightdate AS midnightdate_raw,
       midnightdate_parsed IS NOT NULL AS midnightdate_parse_success, cast(midnightdate_parsed AS date) AS date,
       strftime(midnightdate_parsed, '%Y-%m') AS month, cast(week(midnightdate_parsed) AS bigint) AS week,
       dayname(midnightdate_parsed) AS day_of_week
FROM raw_readings""",
    "classify_payment_dates": with_(TYPED)
    + "SELECT event_id, issuedate_parse_status, issuedate_is_time_only, issuedate_time_only_text FROM typed",
    "payment_hours": with_(TYPED)
    + """SELECT event_id, vend_date, strftime(vend_date, '%Y-%m') AS vend_month, dayname(vend_date) AS vend_day_of_week,
       issuedate_time_hour, cast(week(vend_date) AS bigint) AS vend_week, vend_hour, analysis_hour FROM typed""",
    "dup_policy_drop": with_(REPEATED)
    + "SELECT DISTINCT payment_id, meterno, transactionamount, vend_date, source_file FROM repeated",
    "dup_policy_counts": with_(REPEATED)
    + """SELECT 'drop_last' AS mode, cast(sum(copies - 1) AS bigint) AS "before", cast(0 AS bigint) AS "after" FROM groups
UNION ALL SELECT 'keep_all', cast(sum(copies - 1) AS bigint), cast(sum(copies - 1) AS bigint) FROM groups""",
    "dup_keep_last_by_key": with_(PAYMENTS)
    + """SELECT meterno, payment_id, transactionamount, source_file FROM (
  SELECT *, row_number() OVER (PARTITION BY meterno ORDER BY issuedate_parsed DESC, payment_id DESC) AS place FROM payments)
WHERE place = 1""",
    "dup_row_count": with_(REPEATED) + "SELECT cast(sum(copies - 1) AS bigint) AS duplicate_rows FROM groups",
    "dup_by_source": with_(REPEATED)
    + "SELECT source_file AS label, cast(sum(copies) AS bigint) AS duplicate_rows FROM groups GROUP BY source_file",
    "dup_by_date": with_(REPEATED)
    + """SELECT coalesce(cast(vend_date AS varchar), 'unknown') AS label, cast(sum(copies) AS bigint) AS duplicate_rows
FROM groups GROUP BY 1""",
    "distinct_values": with_(TYPED) + "SELECT DISTINCT meterno AS value FROM typed WHERE meterno IS NOT NULL",
    "value_bounds": with_(PAYMENTS)
    + """SELECT min(transactionamount) AS transactionamount_min, max(transactionamount) AS transactionamount_max,
       min(vend_date) AS vend_date_min, max(vend_date) AS vend_date_max FROM payments""",
    "filter_readings": with_(READINGS)
    + """SELECT mtrid, kwh_consumption, kvah_consumption, date, source_file FROM readings
WHERE midnightdate_parsed IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'
  AND mtrid BETWEEN 1 AND 59 AND mtrid % 2 = 1 AND kwh_consumption BETWEEN 5 AND 40""",
    "filter_payments": with_(TYPED)
    + """SELECT event_id, categorycode, transactionamount, analysis_hour FROM typed
WHERE issuedate_parse_status IN ('parsed_datetime', 'time_only') AND categorycode IN ('click', 'view', 'purchase')
  AND source_file IN ('file_0', 'file_2') AND transactionamount BETWEEN 0 AND 1000 AND analysis_hour BETWEEN 6 AND 18""",
    "filter_full_datetime": with_(TYPED)
    + """SELECT event_id, servicepointno, meterno, vend_date FROM typed
WHERE issuedate_parse_status = 'parsed_datetime' AND vend_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-12'
  AND servicepointno IN ('1', '2', '3')""",
    "drilldown_filter": with_(READINGS) + "SELECT mtrid, kwh_consumption, date FROM readings WHERE mtrid = 7",
    "safe_aggregates": with_(TYPED)
    + f"""SELECT {money('transactionamount')} AS total_value,
       {money('transactionamount')} / count(transactionamount) AS mean_value,
       count(DISTINCT meterno) AS distinct_keys FROM typed""",
    "date_span": with_(PAYMENTS) + """SELECT min(vend_date) AS "min", max(vend_date) AS "max" FROM payments""",
    "readings_kpis": with_(READINGS)
    + f"""SELECT count(*) AS "rows", count(DISTINCT mtrid) AS unique_meters,
       {money('kwh_consumption')} AS total_kwh_consumption, {money('kvah_consumption')} AS total_kvah_consumption,
       {DAILY_MEAN} AS average_daily_kwh, (SELECT min(s) FROM {DAILY}) AS min_daily_kwh,
       (SELECT max(s) FROM {DAILY}) AS max_daily_kwh, min(date) AS span_min, max(date) AS span_max FROM readings""",
    "payments_kpis": with_(TYPED)
    + f"""SELECT count(*) AS "rows", count(*) AS transactions, count(DISTINCT servicepointno) AS unique_service_points,
       count(DISTINCT meterno) AS unique_meters, {money('transactionamount')} AS total_transaction_amount,
       {money('transactionamount')} / count(transactionamount) AS average_transaction_amount,
       count(CASE WHEN issuedate_is_time_only THEN 1 END) AS time_only_rows,
       min(vend_date) AS span_min, max(vend_date) AS span_max FROM typed""",
    "overview_kpis": with_(READINGS, PAYMENTS)
    + "SELECT 'all' AS dataset, 'files' AS metric, cast((SELECT count(DISTINCT source_file) FROM readings) + (SELECT count(DISTINCT source_file) FROM payments) AS double) AS value\nUNION ALL\n"
    + kpi_rows(
        "consumption",
        "readings",
        {
            "files": "count(DISTINCT source_file)",
            "rows": "count(*)",
            "unique_meters": "count(DISTINCT mtrid)",
            "total_kwh_consumption": money("kwh_consumption"),
            "total_kvah_consumption": money("kvah_consumption"),
        },
    )
    + "\nUNION ALL\n"
    + kpi_rows(
        "consumption",
        DAILY,
        {
            "average_daily_kwh": "cast(sum(cast(s AS decimal(18,2))) AS double) / count(*)",
            "min_daily_kwh": "min(s)",
            "max_daily_kwh": "max(s)",
        },
    )
    + "\nUNION ALL\n"
    + kpi_rows(
        "vend",
        "payments",
        {
            "files": "count(DISTINCT source_file)",
            "rows": "count(*)",
            "transactions": "count(*)",
            "unique_service_points": "count(DISTINCT servicepointno)",
            "unique_meters": "count(DISTINCT meterno)",
            "total_transaction_amount": money("transactionamount"),
            "average_transaction_amount": money("transactionamount") + " / count(transactionamount)",
            "time_only_rows": "0 * count(*)",
        },
    ),
    "coverage_table": with_(READINGS, PAYMENTS)
    + """SELECT 'Consumption' AS dataset, count(DISTINCT source_file) AS files, count(*) AS "rows",
       cast(min(date) AS varchar) || ' to ' || cast(max(date) AS varchar) AS date_span FROM readings
UNION ALL
SELECT 'Vend / Recharge', count(DISTINCT source_file), count(*),
       cast(min(vend_date) AS varchar) || ' to ' || cast(max(vend_date) AS varchar) FROM payments""",
    "quality_snapshot": with_(RAW_READINGS, TYPED)
    + """, twice_read AS (SELECT * FROM raw_readings UNION ALL SELECT * FROM raw_readings WHERE l_orderkey % 10 = 0),
read_groups AS (
  SELECT count(*) AS copies FROM twice_read
  GROUP BY l_orderkey, l_linenumber, mtrid, midnightdate, kwh_consumption, source_file)
SELECT 'consumption' AS dataset, false AS schema_valid, 'kwh_abs, kvah_abs, kvah_consumption' AS missing_columns,
       (SELECT cast(sum(copies - 1) AS bigint) FROM read_groups) AS duplicate_rows,
       count(*) - count(midnightdate_parsed) AS parse_warning_count
FROM twice_read
UNION ALL
SELECT 'vend', true, 'None', count(CASE WHEN event_id % 10 = 0 THEN 1 END),
       cast(sum(CASE WHEN issuedate_parse_status <> 'parsed_datetime' THEN CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END ELSE 0 END) AS bigint)
FROM typed""",
    "parse_coverage": with_(TYPED)
    + f"""SELECT parsed_rows, total_rows, {percent('parsed_rows', 'total_rows')} AS parse_coverage_pct FROM (
  SELECT count(CASE WHEN issuedate_parse_status = 'parsed_datetime' THEN 1 END) AS parsed_rows, count(*) AS total_rows FROM typed)""",
    "meter_kpis": with_(READINGS)
    + f"""SELECT mtrid, count(*) AS "rows", {money('kwh_consumption')} AS total_value,
       min(kwh_consumption) AS min_value, max(kwh_consumption) AS max_value FROM readings GROUP BY mtrid""",
    "payer_kpis": with_(TYPED)
    + f"""SELECT servicepointno, count(*) AS "rows", {money('transactionamount')} AS total_value,
       {money('transactionamount')} / nullif(count(transactionamount), 0) AS mean_value,
       count(DISTINCT source_file) AS source_files FROM typed GROUP BY servicepointno""",
    "daily_total": with_(READINGS) + f"SELECT date, {money('kwh_consumption')} AS total_value FROM readings GROUP BY date",
    "daily_total_by_meter": with_(READINGS)
    + f"SELECT mtrid, date, {money('kwh_consumption')} AS total_value FROM readings GROUP BY mtrid, date",
    "top10_meters": with_(READINGS)
    + f"""SELECT mtrid, {money('kwh_consumption')} AS total_value FROM readings GROUP BY mtrid
ORDER BY total_value DESC, mtrid LIMIT 10""",
    "amount_by_source": with_(PAYMENTS)
    + f"SELECT source_file, {money('transactionamount')} AS total_value FROM payments GROUP BY source_file",
    "daily_amount": with_(TYPED)
    + f"SELECT vend_date, {money('transactionamount')} AS total_value FROM typed WHERE vend_date IS NOT NULL GROUP BY vend_date",
    "hourly_profile": with_(TYPED)
    + f"""SELECT analysis_hour, {money('transactionamount')} AS total_value FROM typed
WHERE analysis_hour IS NOT NULL GROUP BY analysis_hour""",
    "category_breakdown": with_(TYPED)
    + f"""SELECT categorycode, {money('transactionamount')} AS "sum", count(transactionamount) AS "count" FROM typed
WHERE categorycode IS NOT NULL GROUP BY categorycode""",
    "drilldown_sources": with_(PAYMENTS)
    + f"SELECT meterno, source_file, {money('transactionamount')} AS total_value FROM payments GROUP BY meterno, source_file",
    "histogram40": with_(PAYMENTS)
    + """, ends AS (SELECT min(transactionamount) AS lo, max(transactionamount) AS hi FROM payments),
placed AS (
  SELECT least(cast(floor(40 * (transactionamount - lo) / (hi - lo)) AS bigint) + 1, 40) AS bin FROM payments, ends),
bins AS (SELECT i AS bin FROM range(1, 41) t(i))
SELECT b.bin, lo + (b.bin - 1) * ((hi - lo) / 40) AS lower, lo + b.bin * ((hi - lo) / 40) AS upper,
       (SELECT count(*) FROM placed p WHERE p.bin = b.bin) AS "count"
FROM bins b, ends""",
    "box_stats": with_(TYPED, ranked("transactionamount", "typed"), QUARTILES) + BOX.format(key=""),
    "box_stats_by_category": with_(PAYMENTS, ranked("transactionamount", "payments", "categorycode"), QUARTILES)
    + BOX.format(key=", f.g AS categorycode"),
    "box_outliers": with_(TYPED, ranked("transactionamount", "typed"), QUARTILES)
    + "SELECT v AS transactionamount FROM ranked r JOIN fences f ON r.g = f.g WHERE v < lo OR v > hi",
    "preview": with_(PAYMENTS)
    + "SELECT payment_id, meterno, categorycode, transactionamount FROM payments ORDER BY payment_id LIMIT 1000",
    "numeric_flags": with_(TYPED)
    + f"""SELECT 'transactionamount' AS "column", {FLAGS.format(c='transactionamount')} FROM typed
UNION ALL SELECT 'event_id', {FLAGS.format(c='event_id')} FROM typed""",
    "iqr_outliers": outlier_union(),
    "missing_summary": with_(TYPED)
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
       round_even({percent(f'(count(*) - count({c}))', 'count(*)')}, 2) AS missing_pct FROM typed"""
        for c in ("event_id", "meterno", "categorycode", "transactionamount", "issuedate_parse_status", "vend_date")
    ),
    "table_overview": with_(PAYMENTS) + """SELECT count(*) AS "rows", cast(8 AS bigint) AS "columns" FROM payments""",
    "column_profile": with_(PAYMENTS)
    + "\nUNION ALL\n".join(
        profile_row(i, *row)
        for i, row in enumerate(
            (
                ("servicepointno", "bigint", True),
                ("meterno", "bigint", True),
                ("categorycode", "string", False),
                ("transactionamount", "double", True),
                ("vend_date", "date", True),
                ("source_file", "string", False),
            )
        )
    ),
    "parse_summary": with_(TYPED)
    + """SELECT issuedate_parse_status AS status, count(*) AS "count" FROM typed GROUP BY issuedate_parse_status""",
    "parse_summary_readings": with_(RAW_READINGS)
    + """SELECT 'parsed_datetime' AS status, count(midnightdate_parsed) AS "count" FROM raw_readings
UNION ALL SELECT 'failed_or_missing', count(*) - count(midnightdate_parsed) FROM raw_readings""",
    "temporal_sanity": with_(PAYMENTS)
    + f"""SELECT 'issuedate_parsed' AS date_column, count(issuedate_parsed) AS parsed_rows, count(*) AS total_rows,
       round_even({percent('count(issuedate_parsed)', 'count(*)')}, 2) AS parse_coverage_pct,
       count(CASE WHEN issuedate_parsed > TIMESTAMP '2001-01-31 00:00:00' THEN 1 END) AS future_row_count,
       cast(max(issuedate_parsed) AS date) AS latest_date, cast(min(issuedate_parsed) AS date) AS oldest_date,
       max(issuedate_parsed) < TIMESTAMP '2000-10-03 00:00:00' AS is_stale, cast(90 AS bigint) AS stale_days FROM payments""",
    "categorical_check": with_(PAYMENTS)
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", cast({n} AS bigint) AS allowed_count, count(*) AS invalid_count,
       (SELECT string_agg(v, ' | ' ORDER BY place) FROM (
          SELECT {c} AS v, min(payment_id) AS place FROM payments WHERE {c} NOT IN {allowed} GROUP BY {c} ORDER BY place LIMIT 5)
       ) AS sample_invalid_values
FROM payments WHERE {c} NOT IN {allowed}"""
        for c, n, allowed in (
            ("categorycode", 3, "('1-URGENT', '2-HIGH', '3-MEDIUM')"),
            ("source_file", 1, "('F')"),
        )
    ),
    "quality_warnings": with_(TYPED, COUNTS.format(source="typed")) + warning_texts("counts", status_texts()),
    "quality_suite": suite_sql(),
    "quality_suite_warnings": with_(
        SUITE,
        COUNTS.format(source="twice"),
        """more AS (
  SELECT count(CASE WHEN issuedate_parsed > TIMESTAMP '2024-01-20 12:00:00' THEN 1 END) AS future,
         count(CASE WHEN categorycode NOT IN ('click', 'view') THEN 1 END) AS invalid FROM twice)""",
        "known AS (SELECT * FROM counts, more)",
    )
    + warning_texts(
        "known",
        status_texts()
        + [
            ("format('{:,}', future) || ' rows have parsed dates beyond the allowed future window (0 days).'", "future > 0"),
            ("'Categorical validation found ' || format('{:,}', invalid) || ' values outside configured allow-lists.'", "invalid > 0"),
        ],
    ),
    "csv_ingest": with_(TYPED)
    + f"""SELECT issuedate_parse_status, analysis_hour, count(*) AS "rows", count(meterno) AS meters,
       {money('transactionamount')} AS total_value FROM typed GROUP BY issuedate_parse_status, analysis_hour""",
    "file_inventory": with_(TYPED)
    + """SELECT 'vend' AS dataset, 'ok' AS read_status, event_id % 2 = 0 AS schema_valid,
       cast(CASE WHEN event_id % 2 = 0 THEN 5 ELSE 3 END AS bigint) AS column_count,
       CASE WHEN event_id % 2 = 0 THEN 'servicepointno, meterno, categorycode, transactionamount, issuedate'
            ELSE 'issuedate, meterno, event_id' END AS standardized_columns,
       count(*) AS rows_read, count(CASE WHEN issuedate_parse_status <> 'parsed_datetime' THEN 1 END) AS parse_warning_count
FROM typed GROUP BY event_id % 2""",
    "incremental_ingest": with_(TYPED)
    + f"""SELECT issuedate_parse_status, count(*) AS "rows", {money('transactionamount')} AS total_value
FROM typed GROUP BY issuedate_parse_status""",
    **FILE_ORACLES,
}
