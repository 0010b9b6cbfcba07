"""DuckDB twins of the registered queries (the correctness oracle).

Written independently of the Spark plans: latest-per-key as
``QUALIFY row_number()``, upsert as ``source UNION ALL target rows without
a source match``, and so on.  Spark's 32-bit Murmur3 ``hash()`` is
re-expressed in DuckDB integer arithmetic so that ``row_hash`` is checked
value for value.  Parameters come from ``plans.fixtures``.
"""

from __future__ import annotations

import datetime as _dt

from lakewright.plans import fixtures as fx

# Murmur3 x86_32 constants (public algorithm) and Spark's seed.
_C1, _C2 = 0xCC9E2D51, 0x1B873593
_N = 0xE6546B64
_F1, _F2 = 0x85EBCA6B, 0xC2B2AE35
_M32 = 1 << 32
_MASK = _M32 - 1


def _ts(t) -> str:
    return f"TIMESTAMP '{t.isoformat(sep=' ')}'"


def _spark_hash_sql(src: str, longs: list[str], out: str) -> str:
    """SELECT over ``src`` adding ``out`` = Spark hash of BIGINT expressions.

    Values are carried as unsigned 32-bit numbers in BIGINT; products go
    through HUGEINT.  A NULL input leaves the running hash unchanged.
    """
    steps: list[tuple[str, str]] = []
    n = [0]

    def new(expr: str) -> str:
        n[0] += 1
        name = f"__m{n[0]}"
        steps.append((name, expr))
        return name

    def mul(a: str, c: int) -> str:
        return new(f"CAST((CAST({a} AS HUGEINT) * {c}) % {_M32} AS BIGINT)")

    def rotl(a: str, r: int) -> str:
        return new(f"((({a} << {r}) | ({a} >> {32 - r})) & {_MASK})")

    def mix_k1(k: str) -> str:
        return mul(rotl(mul(k, _C1), 15), _C2)

    def mix_h1(h: str, k: str) -> str:
        r = rotl(new(f"xor({h}, {k})"), 13)
        return new(f"(({r} * 5 + {_N}) % {_M32})")

    h = new("CAST(42 AS BIGINT)")
    for v in longs:
        val = new(f"CAST({v} AS BIGINT)")
        lo = new(f"({val} & {_MASK})")
        hi = new(f"(({val} >> 32) & {_MASK})")
        h1 = mix_h1(h, mix_k1(lo))
        h2 = mix_h1(h1, mix_k1(hi))
        f1 = new(f"xor({h2}, 8)")
        f2 = new(f"xor({f1}, {f1} >> 16)")
        f3 = mul(f2, _F1)
        f4 = new(f"xor({f3}, {f3} >> 13)")
        f5 = mul(f4, _F2)
        f6 = new(f"xor({f5}, {f5} >> 16)")
        h = new(f"CASE WHEN {val} IS NULL THEN {h} ELSE {f6} END")
    q = f"SELECT * FROM {src}"
    for name, expr in steps:
        q = f"SELECT *, {expr} AS {name} FROM ({q})"
    helpers = ", ".join(name for name, _ in steps)
    signed = f"CAST(CASE WHEN {h} >= {1 << 31} THEN {h} - {_M32} ELSE {h} END AS INTEGER)"
    return f"SELECT * EXCLUDE ({helpers}), {signed} AS {out} FROM ({q})"


EV = ("ev AS (SELECT event_id AS id, event_type, CAST(user_id AS VARCHAR) AS user_id, "
      "props AS event_data, ts AS event_timestamp FROM events)")
LOG = "log AS (SELECT *, CAST(day(ts) AS BIGINT) AS commit_id FROM events)"
LATEST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY commit_id DESC, ts DESC, event_id DESC) = 1"
LINE_RANK = ("QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, "
             "l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, "
             "l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1")
ENTITLED = (f"SELECT * FROM orders WHERE o_custkey IN "
            f"(SELECT c_custkey FROM customer WHERE c_nationkey = {fx.ENTITLED_NATION})")
ORDERS_T = f"t AS (SELECT * FROM orders WHERE o_orderdate < {_ts(fx.TARGET_BEFORE)})"
ORDERS_S = (f"s AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1.0 AS o_totalprice, "
            f"o_orderdate, 'U-' || o_orderpriority AS o_orderpriority FROM orders "
            f"WHERE o_orderdate >= {_ts(fx.SOURCE_FROM)})")
CUTOFF = _ts(fx.AS_OF - _dt.timedelta(days=fx.RETAIN_DAYS))
EXPIRED = (f"SELECT * FROM log WHERE ts > {CUTOFF} UNION ALL "
           f"SELECT * FROM (SELECT * FROM log WHERE ts <= {CUTOFF} {LATEST})")
LOG_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props", "commit_id"]
PAYLOAD = [c for c in LOG_COLS if c != "user_id"]


def _transform_sql(where: str = "", processed: str = _ts(fx.AS_OF)) -> str:
    hashed = _spark_hash_sql(f"(SELECT * FROM ev {where})", ["id", "epoch_us(event_timestamp)"], "row_hash")
    return (f"WITH {EV}, h AS ({hashed}) "
            f"SELECT id, coalesce(event_type, 'unknown') AS event_type, user_id, event_data, "
            f"event_timestamp, {processed} AS processed_at, "
            f"CAST(year(event_timestamp) AS VARCHAR) AS year, CAST(month(event_timestamp) AS VARCHAR) AS month, "
            f"CAST(day(event_timestamp) AS VARCHAR) AS day, row_hash FROM h")


def _fingerprint_sql() -> str:
    fields = [("id", "bigint", "CAST(id AS VARCHAR)"),
              ("event_type", "string", "event_type"),
              ("user_id", "string", "user_id"),
              ("event_data", "string", "event_data"),
              ("event_timestamp", "timestamp_ntz", "CAST(epoch_us(event_timestamp) AS VARCHAR)")]
    parts = [f"coalesce('{tag}:' || CAST(length({txt}) AS VARCHAR) || ':' || {txt}, '{tag}:N')"
             for _, tag, txt in fields]
    return f"WITH {EV} SELECT id, sha256(concat_ws('|', {', '.join(parts)})) AS fingerprint FROM ev"


def _grants_sql(exists: bool) -> str:
    p = "'cust_' || CAST(c_custkey AS VARCHAR)"
    segs = ", ".join(f"'{s}'" for s in fx.GRANT_SEGMENTS)
    db, tb = fx.GRANT_DATABASE, fx.GRANT_TABLE
    neg = "" if exists else "NOT "
    return (
        f"WITH reads AS (SELECT o_orderkey AS request_id, 'cust_' || CAST(o_custkey AS VARCHAR) AS principal, "
        f"'{db}' AS database_name, '{tb}' AS table_name FROM orders), "
        f"req AS (SELECT request_id, principal, database_name, table_name, 'SELECT' AS permission FROM reads "
        f"UNION ALL SELECT request_id, principal, database_name, '*' AS table_name, 'DESCRIBE' AS permission FROM reads), "
        f"g AS (SELECT {p} AS principal, '{db}' AS database_name, '*' AS table_name, 'DESCRIBE' AS permission "
        f"FROM customer WHERE c_acctbal >= 0 "
        f"UNION ALL SELECT {p}, '{db}', '{tb}', 'SELECT' FROM customer WHERE c_mktsegment IN ({segs}) "
        f"UNION ALL SELECT {p}, '{db}', '{tb}', 'DESCRIBE' FROM customer WHERE c_mktsegment IN ({segs})) "
        f"SELECT * FROM req r WHERE {neg}EXISTS (SELECT 1 FROM g WHERE g.principal = r.principal "
        f"AND g.database_name = r.database_name AND g.table_name = r.table_name AND g.permission = r.permission)")


def _audit_columns_sql() -> str:
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    hidden = set(fx.HIDDEN_CUSTOMER_COLUMNS)
    counts = ", ".join(f"count({c}) AS n_{c}" for c in cols if c not in hidden)
    parts = []
    for c in cols:
        val = "CAST(0 AS BIGINT)" if c in hidden else f"n_{c}"
        parts.append(f"SELECT 'customer' AS table_name, '{c}' AS column_name, "
                     f"{'true' if c in hidden else 'false'} AS hidden, {val} AS values_visible FROM agg")
    return f"WITH agg AS (SELECT {counts} FROM customer) " + " UNION ALL ".join(parts)


def _audit_rows_sql() -> str:
    parts = []
    for name, pred in fx.AUDIT_POLICIES.items():
        vis = f"CAST(count_if({pred}) AS BIGINT)" if pred else "count(*)"
        parts.append(f"SELECT '{name}' AS principal, {vis} AS visible_rows, count(*) AS total_rows, "
                     f"count(*) - {vis} AS hidden_rows FROM events")
    return " UNION ALL ".join(parts)


def _in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# (table, governed source SQL, visible column count, hidden column count, data checks)
# data check = (name, violation predicate, severity, message, recommendation)
_CHECK_TABLES = [
    ("events", f"SELECT * FROM events WHERE {fx.EVENT_ROW_POLICY}", 6, 0, [
        ("event_id not null", "event_id IS NULL", "FAIL", "rows violate the check", None),
        ("ts not null", "ts IS NULL", "FAIL", "rows violate the check", None),
        ("known event_type",
         f"NOT event_type IN ({_in_list(fx.KNOWN_EVENT_TYPES)}) OR event_type IS NULL",
         "WARNING", "rows with an unknown event type", "Map new event types before loading"),
        ("value not negative", "value < 0", "WARNING", "rows violate the check", None)]),
    ("orders", ENTITLED, 6, 0, [
        ("total price positive", "o_totalprice <= 0", "FAIL", "rows violate the check", None),
        ("known order status", f"NOT o_orderstatus IN ({_in_list(fx.KNOWN_ORDER_STATUSES)})", "WARNING",
         "rows violate the check", None)]),
    ("customer", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer", 4, 1, [
        ("market segment present", "c_mktsegment IS NULL", "FAIL", "rows violate the check", None),
        ("nation key present", "c_nationkey IS NULL", "WARNING", "rows violate the check", None)]),
]


def _lit(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"


def _check_results_sql(details: bool = False) -> str:
    """Every check row reads one aggregate row of its table, as in Spark."""
    def more(obs: str) -> str:
        text = lambda x: f"CAST({x} AS VARCHAR)"
        return (f"'{{\"rows_checked\":\"' || {text('__rows')} || '\",\"observed\":\"' || {text(obs)} || '\"}}' AS details, "
                if details else "")
    parts = []
    for table, src, _vis, hidden, data_checks in _CHECK_TABLES:
        info = [("readable rows", "__rows", "rows readable", None),
                ("hidden columns", f"CAST({hidden} AS BIGINT)", "columns hidden", None),
                ("rows behind the row policy", "__rows", "accessible rows",
                 "Hold this number against what the policy should let through")]
        agg = f"(SELECT count(*) AS __rows FROM ({src}))"
        for name, obs, msg, rec in info:
            parts.append(
                f"SELECT '{fx.RUN_ID}' AS run_id, '{table}' AS table_name, '{name}' AS check_name, "
                f"'INFO' AS status, '{msg}: ' || CAST({obs} AS VARCHAR) AS message, "
                f"CAST({obs} AS BIGINT) AS observed, {more(obs)}{_lit(rec)} AS recommendation FROM {agg}")
        for name, pred, sev, msg, rec in data_checks:
            agg = f"(SELECT count(*) AS __rows, CAST(count_if({pred}) AS BIGINT) AS obs FROM ({src}))"
            parts.append(
                f"SELECT '{fx.RUN_ID}' AS run_id, '{table}' AS table_name, '{name}' AS check_name, "
                f"CASE WHEN __rows = 0 THEN 'SKIPPED' WHEN coalesce(obs, 0) = 0 THEN 'PASS' ELSE '{sev}' END AS status, "
                f"CAST(obs AS VARCHAR) || ' of ' || CAST(__rows AS VARCHAR) || ' rows: {msg}' AS message, "
                f"obs AS observed, {more('obs')}{_lit(rec)} AS recommendation FROM {agg}")
    return " UNION ALL ".join(parts)


def _rollup_cols() -> str:
    return ("count(*) AS total_checks, CAST(count_if(status = 'PASS') AS BIGINT) AS passed, "
            "CAST(count_if(status = 'FAIL') AS BIGINT) AS failed, "
            "CAST(count_if(status = 'WARNING') AS BIGINT) AS warnings")


def _verify_sql() -> str:
    cols = ", ".join(LOG_COLS)
    at = _ts(fx.RETAIN_CHECK_AT)
    return (
        f"WITH {LOG}, expired AS ({EXPIRED}), "
        f"b AS (SELECT * FROM log WHERE ts <= {at} {LATEST}), "
        f"a AS (SELECT * FROM expired WHERE ts <= {at} {LATEST}), "
        f"tagged AS (SELECT {cols}, 1 AS l, 0 AS r FROM b UNION ALL SELECT {cols}, 0 AS l, 1 AS r FROM a), "
        f"per AS (SELECT sum(l) AS l, sum(r) AS r FROM tagged GROUP BY {cols}), "
        f"agg AS (SELECT CAST(coalesce(sum(l), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(r), 0) AS BIGINT) AS right_rows, "
        f"CAST(coalesce(sum(greatest(l - r, 0)), 0) AS BIGINT) AS left_only, "
        f"CAST(coalesce(sum(greatest(r - l, 0)), 0) AS BIGINT) AS right_only FROM per) "
        f"SELECT *, (left_only = 0 AND right_only = 0) AS equal FROM agg")


def _state_diff_sql() -> str:
    pay_o = ", ".join(f"o.{c} AS old_{c}" for c in PAYLOAD)
    pay_n = ", ".join(f"n.{c} AS new_{c}" for c in PAYLOAD)
    same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in PAYLOAD)
    return (
        f"WITH {LOG}, "
        f"o AS (SELECT *, true AS p FROM log WHERE ts <= {_ts(fx.DIFF_FROM)} {LATEST}), "
        f"n AS (SELECT *, true AS p FROM log WHERE ts <= {_ts(fx.DIFF_TO)} {LATEST}) "
        f"SELECT coalesce(o.user_id, n.user_id) AS user_id, "
        f"CASE WHEN o.p IS NULL THEN 'I' WHEN n.p IS NULL THEN 'D' ELSE 'U' END AS change, {pay_o}, {pay_n} "
        f"FROM o FULL OUTER JOIN n ON o.user_id = n.user_id "
        f"WHERE o.p IS NULL OR n.p IS NULL OR NOT ({same})")


def _commits_sql() -> str:
    return ("SELECT commit_id, max(ts) AS committed_at, count(*) AS rows_changed, "
            "lag(commit_id) OVER (ORDER BY commit_id) AS parent_id FROM log GROUP BY commit_id")


def oracle_sql() -> dict[str, str]:
    ev = f"WITH {EV} "
    line_cols = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                 "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
    return {
        "scan_table": ev + "SELECT * FROM ev",
        "scan_filtered": ev + f"SELECT * FROM ev WHERE {fx.SCAN_FILTER}",
        "scan_incremental": ev + f"SELECT * FROM ev WHERE event_timestamp > {_ts(fx.INCREMENTAL_MARK)}",
        "incremental_next_mark": ev + (f"SELECT max(event_timestamp) AS next_mark FROM ev "
                                       f"WHERE event_timestamp > {_ts(fx.INCREMENTAL_MARK)}"),
        "sample_access": ev + (
            f"SELECT count(*) AS rows_returned, CAST(5 AS INTEGER) AS column_count, "
            f"'id,event_type,user_id,event_data,event_timestamp' AS columns_visible, "
            f"CAST(count(id) + count(event_type) + count(user_id) + count(event_data) + count(event_timestamp) AS BIGINT) "
            f"AS values_read FROM (SELECT * FROM ev ORDER BY id LIMIT {fx.SAMPLE_N})"),
        "governed_rows_predicate": f"SELECT * FROM events WHERE {fx.EVENT_ROW_POLICY}",
        "governed_rows_entitled": ENTITLED,
        "governed_columns": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
        "grants_allowed": _grants_sql(True),
        "grants_denied": _grants_sql(False),
        "audit_columns": _audit_columns_sql(),
        "audit_rows": _audit_rows_sql(),
        "event_transform": _transform_sql(),
        "event_partition_columns": ev + (
            "SELECT id, CAST(year(event_timestamp) AS VARCHAR) AS year, CAST(month(event_timestamp) AS VARCHAR) AS month, "
            "CAST(day(event_timestamp) AS VARCHAR) AS day FROM ev"),
        "null_default": ev + "SELECT id, coalesce(nullif(event_type, 'error'), 'unknown') AS event_type FROM ev",
        "row_hash": (f"WITH {EV}, h AS ({_spark_hash_sql('ev', ['id', 'epoch_us(event_timestamp)'], 'row_hash')}) "
                     f"SELECT id, row_hash FROM h"),
        "row_fingerprint": _fingerprint_sql(),
        "dedup_latest": f"SELECT {line_cols} FROM lineitem {LINE_RANK}",
        "conform_schema": (
            f"WITH {EV}, h AS ({_spark_hash_sql('ev', ['id', 'epoch_us(event_timestamp)'], 'row_hash')}) "
            "SELECT id, event_type, user_id, event_data, CAST(event_timestamp AS TIMESTAMP) AS event_timestamp, "
            "CAST(NULL AS TIMESTAMP) AS processed_at, CAST(NULL AS VARCHAR) AS year, CAST(NULL AS VARCHAR) AS month, "
            "CAST(NULL AS VARCHAR) AS day, row_hash FROM h"),
        "upsert_all": (f"WITH {ORDERS_T}, {ORDERS_S} SELECT * FROM s UNION ALL "
                       f"SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)"),
        "upsert_subset": (
            f"WITH {ORDERS_T}, {ORDERS_S} "
            f"SELECT t.o_orderkey, t.o_custkey, t.o_orderstatus, "
            f"CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice, "
            f"t.o_orderdate, t.o_orderpriority FROM t LEFT JOIN s ON t.o_orderkey = s.o_orderkey "
            f"UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey)"),
        "upsert_with_deletes": (
            f"WITH {ORDERS_T}, {ORDERS_S}, "
            f"s2 AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'U' END AS op FROM s) "
            f"SELECT * EXCLUDE (op) FROM s2 WHERE op <> 'D' UNION ALL "
            f"SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.o_orderkey = t.o_orderkey)"),
        "upsert_composite": (
            f"WITH lt AS (SELECT {line_cols} FROM lineitem WHERE l_shipdate < {_ts(fx.LINE_TARGET_BEFORE)} {LINE_RANK}), "
            f"ls AS (SELECT {line_cols} FROM lineitem WHERE l_shipdate >= {_ts(fx.LINE_SOURCE_FROM)} {LINE_RANK}) "
            f"SELECT * FROM ls UNION ALL SELECT * FROM lt WHERE NOT EXISTS (SELECT 1 FROM ls "
            f"WHERE ls.l_orderkey = lt.l_orderkey AND ls.l_linenumber = lt.l_linenumber)"),
        "duplicate_keys": ("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
                           "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"),
        "as_of_version": f"WITH {LOG} SELECT * FROM log WHERE commit_id <= {fx.AS_OF_VERSION} {LATEST}",
        "as_of_timestamp": f"WITH {LOG} SELECT * FROM log WHERE ts <= {_ts(fx.AS_OF_TIME)} {LATEST}",
        "commit_list": f"WITH {LOG} " + _commits_sql(),
        "commit_history": (
            f"WITH {LOG}, c AS ({_commits_sql()}) "
            f"SELECT commit_id, parent_id, committed_at AS made_current_at, "
            f"lead(committed_at) OVER (ORDER BY commit_id) AS valid_to, "
            f"CAST(sum(rows_changed) OVER (ORDER BY commit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_rows, "
            f"lead(commit_id) OVER (ORDER BY commit_id) IS NULL AS is_current FROM c"),
        "state_diff": _state_diff_sql(),
        "expire_log": f"WITH {LOG} {EXPIRED}",
        "row_count": "SELECT count(*) AS row_count FROM events",
        "top_n": ev + f"SELECT * FROM ev ORDER BY event_timestamp DESC, id DESC LIMIT {fx.TOP_N}",
        "verify_equal": _verify_sql(),
        "verify_fingerprint": f"SELECT left_rows, right_rows, equal FROM ({_verify_sql()})",
        "check_results": _check_results_sql(),
        "status_rollup": f"WITH cr AS ({_check_results_sql()}) SELECT run_id, {_rollup_cols()} FROM cr GROUP BY run_id",
        "run_report": (
            f"WITH cr AS ({_check_results_sql()}) "
            f"SELECT '{fx.JOB_NAME}' AS job_name, run_id, '{fx.REPORT_TIME}' AS timestamp, '{fx.VERSION}' AS version, "
            f"{_rollup_cols()}, CAST(count(*) AS INTEGER) AS n_results, "
            f"first(table_name ORDER BY table_name, check_name) AS first_table, "
            f"first(check_name ORDER BY table_name, check_name) AS first_check FROM cr GROUP BY run_id"),
        "table_summary": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS visible_rows, CAST({v} AS INTEGER) AS visible_columns, "
            f"CAST({h} AS INTEGER) AS hidden_columns FROM ({src})"
            for t, src, v, h, _ in _CHECK_TABLES),
        **{f"sink_{fmt}_round_trip": ("SELECT count(*) AS left_rows, count(*) AS right_rows, "
                                      "true AS equal FROM events") for fmt in ("json", "parquet", "csv")},
        "sink_partitioned_table": ("SELECT count(*) AS left_rows, count(*) AS right_rows, "
                                   "true AS equal FROM events"),
        "merge_into_table": (
            f"WITH {ORDERS_T}, {ORDERS_S}, u AS (SELECT * FROM s UNION ALL "
            f"SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)) "
            f"SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS year FROM u"),
        "etl_job": _transform_sql(where="WHERE CAST(user_id AS BIGINT) < 50"),
        "inventory_rows": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS rows, true AS has_bytes FROM {t}" for t in fx.TABLES),
        "scan_text": "SELECT props AS value FROM events",
        "check_results_full": _check_results_sql(details=True),
        "run_report_results": (
            f"WITH cr AS ({_check_results_sql()}), head AS (SELECT run_id, {_rollup_cols()} FROM cr GROUP BY run_id) "
            f"SELECT '{fx.JOB_NAME}' AS job_name, run_id, '{fx.REPORT_TIME}' AS timestamp, '{fx.VERSION}' AS version, "
            f"total_checks, passed, failed, warnings, table_name, check_name, status, message, observed, recommendation "
            f"FROM head JOIN cr USING (run_id)"),
        **{f"sink_{fmt}_rows": ev + "SELECT * FROM ev" for fmt in ("json", "parquet", "csv")},
        "sink_append": _transform_sql(),
        "sink_overwrite_partitions": (
            f"WITH t AS ({_transform_sql()}), "
            f"new AS (SELECT * FROM t WHERE event_timestamp >= {_ts(fx.AS_OF_TIME)} AND event_type = 'purchase') "
            f"SELECT * FROM new UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM new "
            f"WHERE new.year = t.year AND new.month = t.month AND new.day = t.day)"),
        "catalog_table": _transform_sql(),
        "relocated_table": "SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders",
        "compacted_table": _transform_sql(),
        "as_of_version_stored": f"WITH {LOG} SELECT * FROM log WHERE commit_id <= {fx.AS_OF_VERSION} {LATEST}",
        "as_of_timestamp_stored": f"WITH {LOG} SELECT * FROM log WHERE ts <= {_ts(fx.AS_OF_TIME)} {LATEST}",
        "expire_log_stored": f"WITH {LOG} {EXPIRED}",
        "incremental_load_table": ("SELECT * FROM events QUALIFY row_number() OVER "
                                   "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
        "etl_stored": _transform_sql(
            where="WHERE CAST(user_id AS BIGINT) < 50",
            processed=f"CASE WHEN event_timestamp >= {_ts(fx.INCREMENTAL_MARK)} THEN {_ts(fx.AS_OF)} ELSE {_ts(fx.AS_OF_TIME)} END"),
    }
