"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one or two per group; the full set is run by the driver
NAMES = [
    "transport_fields", "flow_key", "segment_flows_replay", "segment_flows_live", "features_mixed_protocols", "active_bursts", "hot_key_flows",
    "traffic_filter", "special_ip", "apply_threshold", "apply_rules", "rule_override", "detect", "run_detection", "port_scan_candidates", "flagship", "attack_history",
    "attack_summary", "threat_level_series", "dashboard_status", "report_recommendations", "security_context", "running_counts", "dedup_alerts",
    "throttle_alerts", "alert_messages", "display_columns", "display_numbers", "repair_counts", "cleaning_audit", "stratified_split",
    "class_aware_subset", "transform", "classification_report", "confidence_histogram", "stream_traffic_stats",
    "labelled_csv", "source_rows", "validate_inputs", "file_checksums", "cleaned_round_trip", "split_round_trip", "audit_round_trip", "log_append", "log_compacted",
    "log_reset", "predictions_jsonl", "packet_stream", "leakage_check", "training_inputs", "capture_round_trip", "throttle_alerts_every_second", "stream_port_scan"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
