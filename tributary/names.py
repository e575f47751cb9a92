"""Canonical schema and table names, and where each table lives.

Every table is a folder ``<root>/<schema>/<table>``.  All other modules ask
here, so a name is spelled once.
"""

from __future__ import annotations

DOMAINS = {
    "customer": ("customers", "addresses", "customer_preferences"),
    "payments": ("payment_methods", "transactions", "refunds"),
    "app": ("user_sessions", "user_events", "category_engagement"),
    "marketing": ("campaigns", "ads", "impressions", "clicks", "conversions"),
}

DOMAIN_OF = {table: domain for domain, tables in DOMAINS.items() for table in tables}

# Primary keys of the relational sources and ids of the feeds.
SOURCE_KEYS = {
    "customers": "customer_id",
    "addresses": "address_id",
    "customer_preferences": "preference_id",
    "payment_methods": "payment_method_id",
    "transactions": "transaction_id",
    "refunds": "refund_id",
    "user_sessions": "session_id",
    "user_events": "event_id",
    "category_engagement": "engagement_id",
    "campaigns": "campaign_id",
    "ads": "ad_id",
    "impressions": "impression_id",
    "clicks": "click_id",
    "conversions": "conversion_id",
}

ENTITIES = tuple(DOMAIN_OF)
FEEDS = DOMAINS["marketing"]
MARTS = ("customer_summary", "campaign_summary")

CURATED = "curated"
AUDIT = "audit"
LOAD_LOG = "load_log"
ARRIVED_FILES = "arrived_files"


def raw_schema(domain: str) -> str:
    return f"raw_{domain}"


def transformed_schema(domain: str) -> str:
    return f"transformed_{domain}"


def raw_path(root: str, table: str) -> str:
    # A feed nobody declared still belongs to the file drop, i.e. to marketing.
    return f"{root}/{raw_schema(DOMAIN_OF.get(table, 'marketing'))}/{table}"


def file_drop_path(root: str, table: str) -> str:
    """Where arrived files go, whatever their name: always the file drop's own schema."""
    return f"{root}/{raw_schema('marketing')}/{table}"


def transformed_path(root: str, table: str) -> str:
    return f"{root}/{transformed_schema(DOMAIN_OF[table])}/{table}"


def curated_path(root: str, table: str) -> str:
    return f"{root}/{CURATED}/{table}"


def audit_path(root: str) -> str:
    return f"{root}/{AUDIT}/{LOAD_LOG}"


def files_path(root: str) -> str:
    return f"{root}/{AUDIT}/{ARRIVED_FILES}"
