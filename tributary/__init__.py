"""A layered warehouse on PySpark: raw, transformed and curated tables, and the loads between them."""

from tributary.functions.stamps import stamp_instant, stamp_shifted
from tributary.operators.changes import apply_changes
from tributary.operators.clean import SPECS, CleanSpec, clean, conform
from tributary.operators.latest import latest_by_key
from tributary.operators.marts import (
    campaign_summary,
    campaign_summary_by_conversion,
    customer_summary,
    customer_summary_exact,
)
from tributary.operators.quality import key_violations, require_key
from tributary.plans.changes import ChangedRefresh
from tributary.plans.ingest import TableLoad, database_loads, ingest_tables
from tributary.plans.refresh import read_curated, read_transformed, refresh
from tributary.sinks.audit import read_files_ledger, read_log, rejected_files
from tributary.sinks.layers import append_load, replace_snapshot, set_up_layers
from tributary.sources.delimited import read_delimited
from tributary.sources.jdbc import JdbcSource, read_table
from tributary.sources.quoted import read_quoted
from tributary.streaming.arrivals import ingest_arrivals
from tributary.streaming.current import CurrentTable, keep_current, replica

__all__ = [
    "SPECS",
    "ChangedRefresh",
    "CleanSpec",
    "CurrentTable",
    "JdbcSource",
    "TableLoad",
    "append_load",
    "apply_changes",
    "campaign_summary",
    "campaign_summary_by_conversion",
    "clean",
    "conform",
    "customer_summary",
    "customer_summary_exact",
    "database_loads",
    "ingest_arrivals",
    "ingest_tables",
    "keep_current",
    "key_violations",
    "latest_by_key",
    "read_curated",
    "read_delimited",
    "read_files_ledger",
    "read_log",
    "read_quoted",
    "read_table",
    "read_transformed",
    "refresh",
    "rejected_files",
    "replace_snapshot",
    "replica",
    "require_key",
    "set_up_layers",
    "stamp_instant",
    "stamp_shifted",
]
