"""The same queries as :mod:`tributary.plans.queries` in plain SQL, for an independent engine."""

from __future__ import annotations

from tributary.plans.driver_tables import TIE_BREAKS, raw_view_sql

# Words and the breaks between them, as one pattern with alternating matches.
_WORDS = r"""([\s\[\](){}/|\\<>!?@"^#$&~_,.:;*%+\-]+|[^\s\[\](){}/|\\<>!?@"^#$&~_,.:;*%+\-]+)"""


def _title(expression: str) -> str:
    words = f"regexp_extract_all({expression}, '{_WORDS}', 1)"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1:1]) || lower(w[2:])), '')"


def _newest(source: str, key: str, newest: str, tie_break: tuple[str, ...], columns: str, keep: str = "true") -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in (newest, *tie_break))
    return f"""
        SELECT {columns}
        FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS newest_first FROM ({source}) AS raw)
        WHERE newest_first = 1 AND {keep}
    """


def _cleaned(entity: str, key: str, newest: str, columns: str, keep: str = "true") -> str:
    return _newest(raw_view_sql(entity), key, newest, TIE_BREAKS[entity], columns, keep)


_SECONDS = "date_sub('second', session_start, session_end)"

CLEANERS = {
    "customers": _cleaned(
        "customers", "customer_id", "updated_at",
        f"customer_id, {_title('first_name')} AS first_name, {_title('last_name')} AS last_name, "
        "lower(email) AS email, phone, date_of_birth, gender, status, created_at, updated_at",
    ),
    "addresses": _cleaned(
        "addresses", "address_id", "created_at",
        "address_id, customer_id, upper(city) AS city, upper(state) AS state, upper(country) AS country, "
        "pincode, address_type, created_at",
        "pincode IS NOT NULL",
    ),
    "customer_preferences": _cleaned(
        "customer_preferences", "customer_id", "updated_at",
        "customer_id, preferred_language, notification_opt_in, upper(favorite_category) AS favorite_category, updated_at",
    ),
    "transactions": _cleaned(
        "transactions", "transaction_id", "transaction_date",
        "transaction_id, customer_id, CAST(amount AS DECIMAL(38,9)) AS amount, upper(currency) AS currency, "
        "transaction_date, upper(status) AS status, payment_method_id",
        "amount IS NOT NULL",
    ),
    "payment_methods": _cleaned(
        "payment_methods", "payment_method_id", "created_at",
        f"payment_method_id, customer_id, upper(method_type) AS method_type, {_title('provider')} AS provider, created_at",
    ),
    "refunds": _cleaned(
        "refunds", "refund_id", "created_at",
        "refund_id, transaction_id, CAST(refund_amount AS DECIMAL(38,9)) AS refund_amount, "
        f"{_title('refund_reason')} AS refund_reason, upper(refund_status) AS refund_status, created_at",
        "refund_amount > 0",
    ),
    "user_sessions": _cleaned(
        "user_sessions", "session_id", "session_start",
        f"session_id, customer_id, session_start, session_end, {_SECONDS} AS session_duration_seconds, "
        "upper(device_type) AS device_type, app_version",
        "session_end IS NOT NULL",
    ),
    "user_events": _cleaned(
        "user_events", "event_id", "event_timestamp",
        "event_id, session_id, customer_id, upper(event_type) AS event_type, event_timestamp, "
        f"{_title('screen_name')} AS screen_name",
    ),
    "category_engagement": _cleaned(
        "category_engagement", "engagement_id", "date",
        f"engagement_id, customer_id, {_title('category_name')} AS category_name, "
        "CAST(time_spent_seconds AS BIGINT) AS time_spent_seconds, date AS engagement_date",
        "time_spent_seconds > 0",
    ),
    "campaigns": _cleaned(
        "campaigns", "campaign_id", "end_date",
        f"campaign_id, {_title('campaign_name')} AS campaign_name, upper(channel) AS channel, "
        "CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date, "
        "date_diff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) AS campaign_duration_days, "
        "budget, upper(status) AS status",
    ),
    "ads": _cleaned(
        "ads", "ad_id", "created_at",
        f"ad_id, campaign_id, upper(creative_type) AS creative_type, {_title('headline')} AS headline, created_at",
    ),
    "impressions": _cleaned(
        "impressions", "impression_id", "impression_time",
        "impression_id, ad_id, customer_id, impression_time, upper(platform) AS platform",
    ),
    "clicks": _cleaned(
        "clicks", "click_id", "click_time",
        "click_id, ad_id, customer_id, click_time, upper(device_type) AS device_type",
    ),
    "conversions": _cleaned(
        "conversions", "conversion_id", "conversion_time",
        "conversion_id, customer_id, campaign_id, conversion_time, upper(conversion_type) AS conversion_type, revenue",
        "revenue >= 0",
    ),
}

_LATEST_EVENTS = _newest(
    "SELECT * FROM events", "user_id", "ts", ("event_id",),
    "user_id, event_id, ts, upper(event_type) AS event_type, value", "value > 100",
)

_CUSTOMERS = "SELECT c_custkey AS customer_id, c_mktsegment AS first_name, c_name AS last_name FROM customer"
_TRANSACTIONS = (
    "SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount "
    "FROM orders"
)
_SESSIONS = "SELECT event_id AS session_id, user_id AS customer_id FROM events"


def _customer_summary(customers: str, transactions: str, sessions: str) -> str:
    return f"""
        SELECT people.customer_id, people.first_name, people.last_name,
               count(DISTINCT paid.transaction_id) AS total_transactions,
               CAST(sum(paid.amount) AS DECIMAL(38,9)) AS total_spent,
               count(DISTINCT visits.session_id) AS total_sessions
        FROM ({customers}) AS people
        LEFT JOIN ({transactions}) AS paid ON paid.customer_id = people.customer_id
        LEFT JOIN ({sessions}) AS visits ON visits.customer_id = people.customer_id
        GROUP BY ALL
    """


def _customer_summary_exact(customers: str, transactions: str, sessions: str) -> str:
    return f"""
        SELECT people.customer_id, people.first_name, people.last_name,
               (SELECT count(DISTINCT transaction_id) FROM ({transactions}) AS t
                WHERE t.customer_id = people.customer_id) AS total_transactions,
               CAST((SELECT sum(amount) FROM ({transactions}) AS t
                WHERE t.customer_id = people.customer_id) AS DECIMAL(38,9)) AS total_spent,
               (SELECT count(DISTINCT session_id) FROM ({sessions}) AS s
                WHERE s.customer_id = people.customer_id) AS total_sessions
        FROM ({customers}) AS people
    """


def _campaign_summary(campaigns: str, sales: str, sales_key: str, amount: str) -> str:
    return f"""
        SELECT camp.campaign_id, camp.campaign_name, camp.channel,
               CAST(sum(sold.{amount}) AS DECIMAL(38,9)) AS total_revenue
        FROM ({campaigns}) AS camp LEFT JOIN ({sales}) AS sold ON sold.{sales_key} = camp.campaign_id
        GROUP BY ALL
    """


_CHANGED_CUSTOMERS = _newest(
    """
    SELECT c_custkey AS user_id, TIMESTAMP '2023-01-01 00:00:00' AS ts, -1 AS event_id,
           lower(c_mktsegment) AS event_type, c_acctbal AS value, 'U' AS op FROM customer
    UNION ALL
    SELECT user_id, ts, event_id, event_type, value, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END FROM events
    """,
    "user_id", "ts", ("event_id",), "user_id, ts, event_id, event_type, value", "op <> 'D'",
)


def _counted(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM ({source}) AS t) AS records_inserted, "
        "true AS updated_unknown, 'succeeded' AS status"
        for name, source in tables.items()
    )


_STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_FEEDS = ("campaigns", "ads", "impressions", "clicks", "conversions")

_TITLE_LABEL = "upper(p_name) || '-' || lower(p_brand) || '_x/(' || lower(p_type) || ')'"

ORACLE_SQL: dict[str, str] = {
    "latest_by_key": _LATEST_EVENTS,
    "dedup_lineitem": _newest(
        "SELECT * FROM lineitem", "l_orderkey, l_linenumber", "l_shipdate",
        ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"),
        "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
        "l_returnflag, l_linestatus, l_shipdate",
    ),
    "quality_filter": """
        SELECT o_orderkey, o_orderpriority, nullif(o_orderstatus, 'P') AS status,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 150000 AS DECIMAL(38,9)) AS margin
        FROM orders
        WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND CAST(o_totalprice AS DECIMAL(18,2)) >= 150000
          AND o_orderpriority = '1-URGENT'
    """,
    "key_check": """
        SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
        GROUP BY l_orderkey, l_linenumber
        HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL
    """,
    "key_check_load": """
        SELECT l_orderkey, count(*) AS occurrences FROM lineitem
        WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1998-01-01')
        GROUP BY l_orderkey HAVING count(*) > 1
    """,
    "even_ranges": "SELECT count(*) AS n_rows, CAST(16 AS BIGINT) AS n_ranges, true AS even FROM orders",
    **{f"clean_{entity}": sql for entity, sql in CLEANERS.items()},
    "title_case": f"""
        SELECT p_partkey, {_title('p_name')} AS name, {_title(_TITLE_LABEL)} AS label,
               upper(p_name) AS upper_name, lower(p_type) AS lower_type
        FROM part
    """,
    "time_functions": """
        SELECT event_id, date_sub('second', TIMESTAMP '2024-01-01 12:30:00', ts) AS seconds_after,
               date_sub('second', ts, TIMESTAMP '2024-01-01 12:30:00') AS seconds_before,
               date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days_after, CAST(ts AS DATE) AS day
        FROM events
    """,
    "file_routes": "SELECT p_partkey, lower(p_type) AS target FROM part",
    "load_stamps": """
        SELECT o_orderkey, o_orderstatus AS application_id, CAST(330 AS BIGINT) AS minutes_ahead,
               true AS same_clock, o_orderdate AS source_created_at, CAST(0 AS BIGINT) AS instant_minutes_ahead
        FROM orders
    """,
    "schema_conform": """
        SELECT CAST(o_orderkey AS BIGINT) AS transaction_id,
               CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS transaction_date,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,9)) AS amount
        FROM orders
    """,
    "customer_summary": _customer_summary(_CUSTOMERS, _TRANSACTIONS, _SESSIONS),
    "customer_summary_exact": _customer_summary_exact(_CUSTOMERS, _TRANSACTIONS, _SESSIONS),
    "campaign_summary": _campaign_summary(
        "SELECT s_suppkey AS campaign_id, s_name AS campaign_name, CAST(s_nationkey AS VARCHAR) AS channel FROM supplier",
        "SELECT l_suppkey AS payment_method_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem",
        "payment_method_id", "amount",
    ),
    "campaign_summary_by_conversion": _campaign_summary(
        "SELECT p_partkey AS campaign_id, p_name AS campaign_name, p_brand AS channel FROM part",
        "SELECT l_partkey AS campaign_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue FROM lineitem",
        "campaign_id", "revenue",
    ),
    "cdc_apply": _CHANGED_CUSTOMERS,
    "cdc_apply_stream": _CHANGED_CUSTOMERS,
    "cdc_replica_clean": _newest(
        "SELECT * FROM orders", "o_custkey", "o_orderdate", ("o_orderkey",),
        "o_custkey AS transaction_id, o_custkey AS customer_id, "
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,9)) AS amount, upper(o_orderpriority) AS currency, "
        "o_orderdate AS transaction_date, upper(o_orderstatus) AS status, o_orderkey AS payment_method_id",
        "o_orderstatus <> 'F'",
    ),
    "stream_ingest_latest": _LATEST_EVENTS,
    "csv_scan": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "file_arrivals": f"""
        SELECT conversion_id, customer_id, campaign_id, strftime(conversion_time, '%Y-%m-%dT%H:%M:%S.000') AS conversion_time,
               conversion_type, revenue
        FROM ({raw_view_sql('conversions')}) AS arrived
    """,
    "csv_scan_ranges": "SELECT * FROM documents",
    "file_outcomes": """
        SELECT CASE o_orderkey % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'broken' ELSE 'late' END AS part,
               CASE o_orderkey % 3 WHEN 1 THEN 'failed' ELSE 'succeeded' END AS status,
               CASE WHEN o_orderkey % 3 <> 1 THEN count(*) END AS records_logged, o_orderkey % 3 = 1 AS tells_why,
               CASE WHEN o_orderkey % 3 <> 1 THEN count(*) END AS records_in_ledger,
               CASE o_orderkey % 3 WHEN 1 THEN 'quarantine' ELSE 'processed' END AS folder,
               CASE WHEN o_orderkey % 3 <> 1 THEN count(*) END AS records_loaded
        FROM orders GROUP BY o_orderkey % 3
    """,
    "file_arrival_log": _counted({feed: raw_view_sql(feed) for feed in _FEEDS}),
    "table_loads": _counted({table: f"SELECT * FROM {table}" for table in _STAR_TABLES}),
    "load_failures": """
        SELECT 'customer' AS table_name, count(*) AS records_inserted, 'succeeded' AS status, NULL AS tells_why
        FROM customer
        UNION ALL SELECT 'part', count(*), 'succeeded', NULL FROM part
        UNION ALL SELECT 'supplier', NULL, 'failed', true
    """,
    "ingestion_clock": """
        SELECT upper(event_type) AS event_type, count(*) AS stamped, CAST(1 AS BIGINT) AS clocks
        FROM events GROUP BY event_type
    """,
    "snapshot_replace": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
    """,
    "append_loads": "SELECT orders.*, 2 * count(*) AS copies FROM orders GROUP BY ALL",
    "catalog_follows": """
        SELECT o_orderkey, o_custkey, o_orderpriority, DATE '2026-01-03' AS ingestion_date, CAST(1 AS BIGINT) AS partitions
        FROM orders
    """,
    "refresh_transactions": CLEANERS["transactions"],
    "refresh_customer_summary": _customer_summary(
        CLEANERS["customers"], CLEANERS["transactions"], CLEANERS["user_sessions"]
    ),
    "refresh_campaign_summary": _campaign_summary(
        CLEANERS["campaigns"], CLEANERS["transactions"], "payment_method_id", "amount"
    ),
    "refresh_customer_summary_exact": _customer_summary_exact(
        CLEANERS["customers"], CLEANERS["transactions"], CLEANERS["user_sessions"]
    ),
    "changes_customer_summary": _customer_summary(
        CLEANERS["customers"], CLEANERS["transactions"], CLEANERS["user_sessions"]
    ),
    "changes_campaign_summary_exact": _campaign_summary(
        CLEANERS["campaigns"], CLEANERS["conversions"], "campaign_id", "revenue"
    ),
    "refresh_campaign_summary_exact": _campaign_summary(
        CLEANERS["campaigns"], CLEANERS["conversions"], "campaign_id", "revenue"
    ),
}
