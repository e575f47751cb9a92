"""Column lists of every layer, as Spark DDL strings.

Fixed values: names, order and types follow the warehouse's table definitions.
``DATETIME`` is TIMESTAMP_NTZ, ``TIMESTAMP`` is TIMESTAMP, ``NUMERIC`` is
DECIMAL(38,9) and ``INT64`` is BIGINT.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

NUMERIC = "DECIMAL(38,9)"

# Relational sources, as the databases declare them.
SOURCE = {
    "customers": "customer_id INT, first_name STRING, last_name STRING, email STRING, phone STRING, "
    "date_of_birth DATE, gender STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, status STRING",
    "addresses": "address_id INT, customer_id INT, city STRING, state STRING, country STRING, pincode STRING, "
    "address_type STRING, created_at TIMESTAMP_NTZ",
    "customer_preferences": "preference_id INT, customer_id INT, preferred_language STRING, "
    "notification_opt_in BOOLEAN, favorite_category STRING, updated_at TIMESTAMP_NTZ",
    "payment_methods": "payment_method_id INT, customer_id INT, method_type STRING, provider STRING, "
    "created_at TIMESTAMP_NTZ",
    "transactions": "transaction_id INT, customer_id INT, amount DECIMAL(10,2), currency STRING, "
    "transaction_date TIMESTAMP_NTZ, status STRING, payment_method_id INT",
    "refunds": "refund_id INT, transaction_id INT, refund_amount DECIMAL(10,2), refund_reason STRING, "
    "refund_status STRING, created_at TIMESTAMP_NTZ",
    "user_sessions": "session_id INT, customer_id INT, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ, "
    "device_type STRING, app_version STRING",
    "user_events": "event_id INT, session_id INT, customer_id INT, event_type STRING, "
    "event_timestamp TIMESTAMP_NTZ, screen_name STRING",
    "category_engagement": "engagement_id INT, customer_id INT, category_name STRING, time_spent_seconds INT, "
    "date DATE",
    # Delimited feeds.  Dates stay text in the raw layer; the cleaner casts them.
    "campaigns": "campaign_id INT, campaign_name STRING, channel STRING, start_date STRING, end_date STRING, "
    "budget DECIMAL(38,9), status STRING",
    "ads": "ad_id INT, campaign_id INT, creative_type STRING, headline STRING, created_at STRING",
    "impressions": "impression_id INT, ad_id INT, customer_id INT, impression_time STRING, platform STRING",
    "clicks": "click_id INT, ad_id INT, customer_id INT, click_time STRING, device_type STRING",
    "conversions": "conversion_id INT, customer_id INT, campaign_id INT, conversion_time STRING, "
    "conversion_type STRING, revenue DECIMAL(38,9)",
}

TRANSFORMED = {
    "customers": "customer_id BIGINT, first_name STRING, last_name STRING, email STRING, phone STRING, "
    "date_of_birth DATE, gender STRING, status STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, "
    "ingestion_time TIMESTAMP",
    "addresses": "address_id BIGINT, customer_id BIGINT, city STRING, state STRING, country STRING, "
    "pincode STRING, address_type STRING, created_at TIMESTAMP_NTZ, ingestion_time TIMESTAMP",
    "customer_preferences": "customer_id BIGINT, preferred_language STRING, notification_opt_in BOOLEAN, "
    "favorite_category STRING, updated_at TIMESTAMP_NTZ, ingestion_time TIMESTAMP",
    "transactions": "transaction_id BIGINT, customer_id BIGINT, amount DECIMAL(38,9), currency STRING, "
    "transaction_date TIMESTAMP_NTZ, status STRING, payment_method_id BIGINT, ingestion_time TIMESTAMP",
    "payment_methods": "payment_method_id BIGINT, customer_id BIGINT, method_type STRING, provider STRING, "
    "created_at TIMESTAMP_NTZ, ingestion_time TIMESTAMP",
    "refunds": "refund_id BIGINT, transaction_id BIGINT, refund_amount DECIMAL(38,9), refund_reason STRING, "
    "refund_status STRING, created_at TIMESTAMP_NTZ, ingestion_time TIMESTAMP",
    "user_sessions": "session_id BIGINT, customer_id BIGINT, session_start TIMESTAMP_NTZ, "
    "session_end TIMESTAMP_NTZ, session_duration_seconds BIGINT, device_type STRING, app_version STRING, "
    "ingestion_time TIMESTAMP",
    "user_events": "event_id BIGINT, session_id BIGINT, customer_id BIGINT, event_type STRING, "
    "event_timestamp TIMESTAMP_NTZ, screen_name STRING, ingestion_time TIMESTAMP",
    "category_engagement": "engagement_id BIGINT, customer_id BIGINT, category_name STRING, "
    "time_spent_seconds BIGINT, engagement_date DATE, ingestion_time TIMESTAMP",
    "campaigns": "campaign_id BIGINT, campaign_name STRING, channel STRING, start_date DATE, end_date DATE, "
    "campaign_duration_days BIGINT, budget DECIMAL(38,9), status STRING, ingestion_time TIMESTAMP",
    "ads": "ad_id BIGINT, campaign_id BIGINT, creative_type STRING, headline STRING, created_at TIMESTAMP_NTZ, "
    "ingestion_time TIMESTAMP",
    "impressions": "impression_id BIGINT, ad_id BIGINT, customer_id BIGINT, impression_time TIMESTAMP_NTZ, "
    "platform STRING, ingestion_time TIMESTAMP",
    "clicks": "click_id BIGINT, ad_id BIGINT, customer_id BIGINT, click_time TIMESTAMP_NTZ, device_type STRING, "
    "ingestion_time TIMESTAMP",
    "conversions": "conversion_id BIGINT, customer_id BIGINT, campaign_id BIGINT, conversion_time TIMESTAMP_NTZ, "
    "conversion_type STRING, revenue DECIMAL(38,9), ingestion_time TIMESTAMP",
}

CURATED = {
    "customer_summary": "customer_id BIGINT, first_name STRING, last_name STRING, total_transactions BIGINT, "
    "total_spent DECIMAL(38,9), total_sessions BIGINT, ingestion_time TIMESTAMP",
    "campaign_summary": "campaign_id BIGINT, campaign_name STRING, channel STRING, total_revenue DECIMAL(38,9), "
    "ingestion_time TIMESTAMP",
}

# The ten log columns, then what the load's outcome adds to them.
AUDIT = (
    "SOURCE_NAME STRING, BQ_DATASET_NAME STRING, BQ_TABLE_NAME STRING, RUN_START_TIME TIMESTAMP, "
    "RUN_END_TIME TIMESTAMP, GCP_SERVICE_NAME STRING, RECORDS_INSERTED BIGINT, RECORDS_UPDATED BIGINT, "
    "RECORDS_DELETED BIGINT, INGESTION_TIME TIMESTAMP, RUN_ID STRING, STATUS STRING, ERROR STRING"
)

# What became of each arrived file.
FILES = (
    "PATH STRING, TABLE_NAME STRING, STATUS STRING, RECORDS_INSERTED BIGINT, ERROR STRING, MOVED_TO STRING, "
    "LOGGED_AT TIMESTAMP"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def columns(ddl: str) -> list[str]:
    return struct(ddl).names
