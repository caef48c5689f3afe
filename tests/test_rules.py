"""Filter, threshold and port-scan rules."""

import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.scalar import is_special_ip
from flowloom.operators import log as lg
from flowloom.operators import rules as ru
from flowloom.operators import running
from flowloom.operators import series as se


def flow_rows(spark, rows):
    base = dict(ip_a="10.0.0.1", port_a=1, ip_b="10.0.0.2", port_b=2, protocol=6, flow_no=0, src_ip="10.0.0.1", src_port=40000, dst_ip="10.0.0.2",
                dst_port=1000, end_us=0, packet_count=5, total_fwd_packets=1.0, total_backward_packets=0.0, total_length_of_fwd_packets=0.0,
                total_length_of_bwd_packets=0.0, ack_flag_count=0.0, fin_flag_count=0.0, psh_flag_count=0.0)
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long' if k in ('end_us', 'flow_no', 'packet_count') else 'int'}"
                       for k, v in base.items())
    return spark.createDataFrame([tuple({**base, "flow_no": i, **r}.values()) for i, r in enumerate(rows)], schema)


def test_special_addresses(spark):
    samples = ["", "abc", "1.2.3", "1.2.3.256", "01.2.3.4", "10.0.0.1", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "0.0.0.0",
               "169.254.1.1", "169.253.1.1", "::", "::1", "fe80::1", "febf::1", "fec0::1", "ff02::fb", "2001:db8::1", "2001:db8:0:0:0:0:0:1",
               "0:0:0:0:0:0:0:0", "0::0", "1::2::3", "1:2:3:4:5:6:7:8:9", "FE80::1", "fe8::1"]

    def want(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return True
        return a.is_multicast or a.is_unspecified or a.is_link_local or ip == "255.255.255.255"

    df = spark.createDataFrame([(s,) for s in samples], "ip string")
    got = {r.ip: r.s for r in df.select("ip", is_special_ip("ip").alias("s")).collect()}
    assert got == {s: want(s) for s in samples}


def test_bypass(spark):
    cases = [
        (dict(protocol=1), "ICMP bypass — model trained on TCP/UDP flows only"), (dict(protocol=2), "IGMP bypass — model trained on TCP/UDP flows only"),
        (dict(protocol=47), "proto-47 bypass — model trained on TCP/UDP flows only"), (dict(protocol=17, src_port=68, dst_port=67), "Link-local discovery protocol bypass"),
        (dict(protocol=17, dst_port=1900, dst_ip="239.255.255.250"), "Broadcast/multicast bypass — one-way traffic"),
        (dict(protocol=17, dst_port=161), "Link-local discovery protocol bypass"), (dict(src_ip="169.254.1.1"), "Broadcast/multicast bypass — one-way traffic"),
        (dict(dst_port=80), None), (dict(dst_port=443), None), (dict(protocol=17, dst_port=53), None),
        (dict(protocol=17, packet_count=1, dst_port=9999), "Single-packet flow bypass — no flow statistics"), (dict(packet_count=1), None)]
    rows = ru.traffic_filter(flow_rows(spark, [c for c, _ in cases])).orderBy("flow_no").collect()
    assert [r.bypass_reason for r in rows] == [w for _, w in cases]


def scored(df, label, confidence):
    return df.withColumns({**ru.benign_result(F.lit("")), "label": F.lit(label), "class_id": F.lit(fv.CLASSES.index(label)), "confidence": F.lit(confidence),
                           "is_attack": F.lit(label != "BENIGN"), "status": F.lit("ATTACK" if label != "BENIGN" else "BENIGN")})


@pytest.mark.parametrize("label,conf,want", [
    ("DDoS", 0.95, ("DDoS", 0.95, "kept")), ("DDoS", 0.80, ("DDoS", 0.80, "kept")), ("DoS", 0.6, ("BENIGN", 0.4, "downgraded")),
    ("BENIGN", 0.7, ("BENIGN", 0.7, "unchanged"))])
def test_threshold(spark, label, conf, want):
    quiet = flow_rows(spark, [dict(ack_flag_count=1.0)])
    r = ru.apply_rules(scored(quiet, label, conf)).first()
    assert (r.label, pytest.approx(r.confidence), r.decision) == want
    if want[2] == "downgraded":
        assert r.class_probabilities["BENIGN"] == pytest.approx(0.4) and sum(r.class_probabilities.values()) == pytest.approx(0.4)
        assert r.error == "Downgraded from DoS (confidence 60.0% < threshold 80%)"


def test_flood_and_brute_force(spark):
    cases = [(dict(total_fwd_packets=9.0), "BENIGN"), (dict(total_fwd_packets=10.0), "DoS"), (dict(total_fwd_packets=100.0), "DDoS"),
             (dict(total_fwd_packets=50.0, psh_flag_count=1.0, dst_port=22), "BruteForce"), (dict(total_fwd_packets=50.0, psh_flag_count=1.0), "BENIGN"),
             (dict(total_fwd_packets=50.0, dst_port=22), "DoS"), (dict(total_fwd_packets=50.0, ack_flag_count=1.0), "BENIGN"),
             (dict(total_fwd_packets=50.0, protocol=17), "BENIGN")]
    rows = ru.apply_rules(scored(flow_rows(spark, [c for c, _ in cases]), "BENIGN", 1.0)).orderBy("flow_no").collect()
    assert [r.label for r in rows] == [w for _, w in cases]
    for r in rows:
        if r.decision == "rule":
            assert r.confidence == 0.9 and sum(r.class_probabilities.values()) == pytest.approx(1.0)


def plain_alerts(events):
    """Plain list-based fold, as a check: [(src, time, port, ports)]."""
    history, last, out = {}, {}, []
    for src, t, port in events:
        if t - last.get(src, -10**12) < fv.SCAN_COOLDOWN_US:
            continue
        rec = [x for x in history.get(src, []) if x[0] >= t - fv.SCAN_WINDOW_US] + [(t, port)]
        history[src] = rec
        n = len({p for _, p in rec})
        if n >= fv.SCAN_MIN_PORTS:
            out.append((src, t, port, n))
            last[src], history[src] = t, []
    return sorted(out)


@pytest.fixture(params=[(64, 256), (1, 2), (1, 3)])
def slots(request, monkeypatch):
    """Slot lengths and fans: with small ones firings, rests and windows cross many slots and groups."""
    monkeypatch.setattr(running, "SLOTS", request.param[0])
    monkeypatch.setattr(running, "FAN", request.param[1])


def test_scan_alerts_equal_plain_fold(spark, slots):
    rng = random.Random(3)
    t, rows = 0, []
    for i in range(900):
        t += rng.choice([1, 1, 100_000, 200_000, 300_000, 1_500_000] if i % 50 else [4_999_999])
        rows.append(dict(src_ip=rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2"]), dst_port=1000 + rng.randrange(9), end_us=t))
    probes = ru.port_scan_probes(flow_rows(spark, rows))
    got = ru.port_scan_alerts(probes)
    want = plain_alerts([(r["src_ip"], r["end_us"], r["dst_port"]) for r in rows])
    assert len(want) > 20
    assert sorted((r.src_ip, r.end_us, r.dst_port, r.ports) for r in got.collect()) == want


def test_scan_cases(spark):
    alerts = lambda ps: [(r.end_us, r.ports) for r in ru.port_scan_alerts(ru.port_scan_probes(flow_rows(
        spark, [dict(dst_port=p, end_us=t) for t, p in ps]))).orderBy("end_us").collect()]
    assert alerts([(i, 443) for i in range(10)]) == []
    five = [(100_000_000 + i * 100_000, 1001 + i) for i in range(5)]
    assert alerts(five) == [(100_400_000, 5)]
    assert alerts(five + [(101_000_000 + i, 2000 + i) for i in range(9)] + [(106_000_000, 3000)]) == [(100_400_000, 5)]


def test_detect_order(spark):
    burst = [dict(dst_port=1001 + i, end_us=i * 1000) for i in range(5)]
    f = scored(flow_rows(spark, burst), "DoS", 0.5)
    labels = [r.label for r in ru.detect(f).orderBy("end_us").collect()]
    assert labels == ["BENIGN"] * 4 + ["PortScan"]
    kept = scored(flow_rows(spark, burst), "DoS", 0.9)
    assert {r.label for r in ru.detect(kept).collect()} == {"DoS"}


def test_throttle(spark, slots):
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([0.0, 1.0, 7.5, 29.9, 30.0, 31.0])
        rows.append((i, t, rng.choice([0, 1, 1]), rng.choice("ab")))
    log = spark.createDataFrame(rows, "id long, timestamp_utc double, is_attack int, kind string")
    want, last = [], {}
    for i, t, attack, kind in rows:
        if attack and t - last.get(kind, -1e9) >= 30:
            want.append(i)
            last[kind] = t
    got = sorted(r.id for r in se.throttle_alerts(log, 30, "kind").collect())
    assert got == want


def test_alert_per_second_takes_a_fixed_number_of_jobs(spark, monkeypatch):
    """One key, no pause: the tables of ever more slots are composed by the same jobs."""
    jobs = []
    for seconds, slots in ((500, 4), (4000, 1)):
        monkeypatch.setattr(running, "SLOTS", slots)
        log = spark.range(seconds).selectExpr("id", "cast(id as double) as timestamp_utc", "1 as is_attack")
        group = f"throttle-{seconds}"
        spark.sparkContext.setJobGroup(group, group)
        got = sorted(r.id for r in se.throttle_alerts(log, 7).collect())
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert got == list(range(0, seconds, 7))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 2


def test_scan_hits_equal_plain_windows():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(0, 40)
        t = sorted(rng.randrange(60) for _ in range(n))
        ports = [rng.randrange(6) for _ in range(n)]
        first = rng.randint(0, n)
        got = ru.scan_hits(np.array(t, dtype=float), np.array(ports, dtype=int), first, 10, 3)
        for p in range(n + 1):
            want = next((j for j in range(max(p, first), n) if len({ports[i] for i in range(p, j + 1) if t[i] >= t[j] - 10}) >= 3), n)
            assert got[p] == want


def test_log_populations(spark):
    def log(rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, attack_type string, is_attack int, timestamp_utc double, src_ip string")
    ten = log([("DDoS" if i % 2 else "BENIGN", i % 2, 100.0 + i, "10.0.0.1") for i in range(10)])
    assert tuple(lg.log_stats(ten).first()) == (10, 5, 5)
    level = lambda n, age: lg.threat_level(log([("DDoS", 1, 1000.0 - age, "a")] * n), as_of=1000.0).first().threat_level
    assert [level(3, 0), level(7, 0), level(1, 120), level(1, 60), level(6, 60), level(5, 0)] == ["ELEVATED", "CRITICAL", "SAFE", "ELEVATED", "CRITICAL", "ELEVATED"]
    report = log([("DDoS", 1, 1.0, "a"), ("DDoS", 1, 2.0, "b"), ("PortScan", 1, 3.0, "a"), ("BruteForce", 1, 4.0, "a"), ("BENIGN", 0, 5.0, "c"), ("BENIGN", 0, 6.0, "c")])
    lines = [r.advice for r in lg.report_recommendations(report, as_of=10_000.0).orderBy("line").collect()]
    assert lines[:3] == [dict(fv.TYPE_ADVICE)[t] for t in ("DDoS", "BruteForce", "PortScan")] and lines[-1] == fv.CLOSING_ADVICE
    assert [r.advice for r in lg.report_recommendations(report.filter("is_attack = 0"), as_of=1e4).orderBy("line").collect()] == [fv.CALM_ADVICE, fv.CLOSING_ADVICE]
    empty = report.limit(0)
    assert lg.threat_level(empty).first().threat_level == "SAFE" and lg.report_summary(empty).first().attack_percentage == 0.0
    assert [r.src_ip for r in lg.top_attackers(report, 1).collect()] == ["a"]
