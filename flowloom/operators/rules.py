"""Traffic filter, confidence threshold and detection rules over flow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.functions.scalar import is_special_ip
from flowloom.operators.packets import KEY
from flowloom.operators.running import cooldown_fires
from flowloom.operators.session import cut

FLOW_ID = (*KEY, "flow_no")


# --- filter ---------------------------------------------------------------------

def bypass_reason() -> Column:
    """Why a flow does not go to the model (NULL = it does); the first matching reason."""
    proto = F.col("protocol")
    name = F.when(proto == fv.ICMP, "ICMP").when(proto == fv.IGMP, "IGMP").otherwise(
        F.concat(F.lit("proto-"), proto.cast("string")))
    return (
        F.when(~proto.isin(fv.TCP, fv.UDP), F.concat(name, F.lit(" bypass — model trained on TCP/UDP flows only")))
        .when(is_special_ip("dst_ip") | is_special_ip("src_ip"), "Broadcast/multicast bypass — one-way traffic")
        .when(F.col("src_port").isin(*fv.BYPASS_PORTS) | F.col("dst_port").isin(*fv.BYPASS_PORTS),
              "Link-local discovery protocol bypass")
        .when((F.col("packet_count") <= 1) & (proto != fv.TCP), "Single-packet flow bypass — no flow statistics"))


def traffic_filter(flows: DataFrame) -> DataFrame:
    return flows.withColumn("bypass_reason", bypass_reason())


# --- prediction rows ------------------------------------------------------------------

def probabilities(hot: Column, peak=1.0, benign=0.0, rest=0.0, total=1.0) -> Column:
    """Map class -> probability with *peak* at the class named by *hot*."""
    value = lambda c: (F.when(hot == c, F.lit(peak)).when(F.lit(c == "BENIGN"), F.lit(benign)).otherwise(F.lit(rest))) / F.lit(total)
    return F.map_from_arrays(F.array(*[F.lit(c) for c in fv.CLASSES]), F.array(*[value(c) for c in fv.CLASSES]))


def _no_names() -> Column:
    return F.array().cast("array<string>")


def benign_result(reason: Column) -> dict[str, Column]:
    """Prediction columns of a flow that needs no model."""
    return {
        "status": F.lit("BENIGN"), "class_id": F.lit(0), "label": F.lit("BENIGN"), "is_attack": F.lit(False),
        "confidence": F.lit(1.0), "class_probabilities": probabilities(F.lit("BENIGN")),
        "feature_quality": F.lit("COMPLETE"), "missing_fields": _no_names(), "imputed_fields": _no_names(),
        "rejected_fields": _no_names(), "error": F.coalesce(reason, F.lit(""))}


def rejected_result(reason: Column, rejected_fields: Column | None = None) -> dict[str, Column]:
    """Prediction columns of a row that could not be scored."""
    return {
        "status": F.lit("REJECTED"), "class_id": F.lit(-1), "label": F.lit("REJECTED"), "is_attack": F.lit(False),
        "confidence": F.lit(0.0), "class_probabilities": probabilities(F.lit(""), rest=0.0),
        "feature_quality": F.lit("INVALID"), "missing_fields": _no_names(), "imputed_fields": _no_names(),
        "rejected_fields": _no_names() if rejected_fields is None else rejected_fields, "error": reason}


# --- port scan ----------------------------------------------------------------------------

def is_probe() -> Column:
    """A flow that looks like one probe of a port scan."""
    return (
        (F.col("protocol") == fv.TCP) & (F.col("src_ip") != "") & (F.col("dst_port") > 0)
        & ~F.col("dst_port").isin(*fv.SCAN_IGNORED_PORTS)
        & (F.col("total_backward_packets") == 0) & (F.col("total_fwd_packets") <= 2)
        & (F.col("total_length_of_fwd_packets") == 0) & (F.col("ack_flag_count") == 0))


def port_scan_probes(flows: DataFrame) -> DataFrame:
    return flows.filter(is_probe())


def port_scan_candidates(
    probes: DataFrame, window_us: int = fv.SCAN_WINDOW_US, min_ports: int = fv.SCAN_MIN_PORTS,
    slot_us: int = 10_000_000,
) -> DataFrame:
    """Distinct ports each source probed in the window ending at each probe time (both ends included).

    One row per (source, port, time).  Work is split by source and time slot;
    a slot also sees the window before it, so a busy source never lands in one
    task.  A port counts from its first probe until the window after its last
    one has passed: +1 and -1 steps, added up in time order.
    """
    t = F.col("end_us")
    slot = F.floor(t / slot_us)
    near_end = F.floor((t + window_us) / slot_us) > slot
    rows = probes.select("src_ip", "dst_port", "end_us").distinct().withColumn(
        "slot", F.explode(F.when(near_end, F.array(slot, slot + 1)).otherwise(F.array(slot))))
    if window_us > slot_us:
        raise ValueError("slot_us must be at least window_us")
    rows = rows.repartition("src_ip", "slot")
    per_port = W.partitionBy("src_ip", "slot", "dst_port").orderBy("end_us")
    rows = rows.withColumns({
        "opens": F.coalesce(t - F.lag(t).over(per_port) > window_us, F.lit(True)),
        "ends": F.coalesce(F.lead(t).over(per_port) - t > window_us, F.lit(True))})
    step = lambda at, by, probe: F.struct(at.alias("at_us"), by.alias("delta"), F.lit(probe).alias("probe"))
    steps = F.array_compact(F.array(
        step(t, F.col("opens").cast("int"), True),
        F.when(F.col("ends"), step(t + window_us + 1, F.lit(-1), False))))
    rows = rows.withColumn("s", F.explode(steps)).select("src_ip", "dst_port", "end_us", "slot", "s.*")
    so_far = W.partitionBy("src_ip", "slot").orderBy("at_us").rangeBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("distinct_ports", F.sum("delta").over(so_far))
        .filter(F.col("probe") & (F.col("slot") == F.floor(t / slot_us)))
        .select("src_ip", "dst_port", "end_us", "distinct_ports",
                (F.col("distinct_ports") >= min_ports).alias("is_candidate")))


def scan_step(state: dict, now: int, port: int, window_us: int, min_ports: int, cooldown_us: int) -> int | None:
    """One probe against a source's scan state; returns the port count when it raises an alert.

    The state remembers, per port, the time of its latest probe: a source that
    has not raised an alert has fewer than *min_ports* of them.
    """
    last = state.get("alert")
    if last is not None and now - last < cooldown_us:
        return None
    seen = state.setdefault("ports", {})
    seen[str(port)] = now
    for p in [p for p, at in seen.items() if at < now - window_us]:
        del seen[p]
    if len(seen) < min_ports:
        return None
    count = len(seen)
    state.clear()
    state["alert"] = now
    return count


def scan_hits(times, ports, first: int, window_us: int, min_ports: int):
    """For each start position, the first position from *first* on whose window holds *min_ports* distinct ports of the rows since the start."""
    import numpy as np

    n = len(times)
    since = np.full(n, -1, dtype=np.int64)  # the latest start from which a position's window still has enough ports
    recent: dict[int, int] = {}  # the latest *min_ports* ports and where each was probed last, oldest first
    for j, (now, port) in enumerate(zip(times.tolist(), ports.tolist())):
        recent.pop(port, None)
        recent[port] = j
        if len(recent) > min_ports:
            del recent[next(iter(recent))]
        if len(recent) == min_ports:
            oldest = next(iter(recent.values()))
            if times[oldest] >= now - window_us:
                since[j] = oldest
    hit = np.full(n + 1, n, dtype=np.int64)
    fires = np.flatnonzero(since >= 0)
    fires = fires[fires >= first]
    np.minimum.at(hit, since[fires], fires)
    return np.minimum.accumulate(hit[::-1])[::-1]


def port_scan_alerts(
    probes: DataFrame, window_us: int = fv.SCAN_WINDOW_US, min_ports: int = fv.SCAN_MIN_PORTS, cooldown_us: int = fv.SCAN_COOLDOWN_US,
) -> DataFrame:
    """Probes that raise a port-scan alert, with the ports counted.

    After an alert a source's history is forgotten and its probes are ignored
    for the cool-down, so each alert depends on the one before, in time order per
    source (ties by port and flow id).  An alert comes with the probe that makes
    the ports enough, so the count is always *min_ports*.
    """
    ids = [c for c in FLOW_ID if c in probes.columns]
    rows = probes.select("src_ip", "dst_port", "end_us", *ids)

    def hits(pdf, first):
        return scan_hits(pdf["end_us"].to_numpy(), pdf["dst_port"].to_numpy(), first, window_us, min_ports)

    fired = cooldown_fires(rows, ["src_ip"], "end_us", ["dst_port", *ids], cooldown_us, window_us, hits)
    return fired.withColumn("ports", F.lit(min_ports).cast("long"))


# --- rules and threshold -----------------------------------------------------------------------

def flood_label() -> Column:
    """``DDoS``/``DoS`` for a one-sided flood of empty TCP packets, else NULL."""
    f = lambda c: F.col(c) == 0
    flood = (
        (F.col("protocol") == fv.TCP) & (F.col("total_fwd_packets") >= fv.FLOOD_MIN_PACKETS)
        & f("total_backward_packets") & f("total_length_of_fwd_packets") & f("total_length_of_bwd_packets")
        & f("ack_flag_count") & f("fin_flag_count") & f("psh_flag_count"))
    return F.when(flood, F.when(F.col("total_fwd_packets") >= fv.FLOOD_DDOS_PACKETS, "DDoS").otherwise("DoS"))


def is_brute_force() -> Column:
    f = lambda c: F.col(c) == 0
    return (
        (F.col("protocol") == fv.TCP) & (F.col("total_fwd_packets") >= fv.BRUTE_MIN_PACKETS)
        & f("total_backward_packets") & f("total_length_of_fwd_packets") & f("ack_flag_count")
        & f("fin_flag_count") & F.col("dst_port").isin(*fv.LOGIN_PORTS))


def _decide(df: DataFrame, threshold: float, scan_ports: Column) -> DataFrame:
    """Apply threshold and rules in order; *scan_ports* is the port count of a scan alert or NULL."""
    confident = F.col("is_attack") & (F.col("confidence") >= threshold)
    flood = flood_label()
    packets = F.col("total_fwd_packets").cast("long")
    rule = F.when(~confident, F.when(scan_ports.isNotNull(), F.lit("PortScan")).otherwise(
        F.coalesce(flood, F.when(is_brute_force(), F.lit("BruteForce")))))
    reason = (
        F.when(F.col("_rule") == "PortScan", F.format_string(
            "Rule: PortScan detected (%d distinct ports targeted by %s)", scan_ports, "src_ip"))
        .when(F.col("_rule") == "BruteForce", F.format_string(
            "Rule: BruteForce (%d SYN to port %d, no response)", packets, "dst_port"))
        .otherwise(F.format_string("Rule: %s SYN flood (%d fwd pkts, 0 bwd, 0 payload)", "_rule", packets)))
    total = fv.RULE_CONFIDENCE + fv.RULE_BENIGN_WEIGHT + fv.RULE_OTHER_WEIGHT * (len(fv.CLASSES) - 2)
    lowered = F.col("_rule").isNull() & F.col("is_attack") & ~F.col("_confident")
    ruled = F.col("_rule").isNotNull()
    pick = lambda by_rule, when_low, name: F.when(ruled, by_rule).when(lowered, when_low).otherwise(F.col(name))
    left = F.lit(1.0) - F.col("confidence")
    note = F.format_string(
        "Downgraded from %s (confidence %.1f%% < threshold %.0f%%)", "label", F.col("confidence") * 100, F.lit(threshold * 100))
    class_of = lambda c: (F.array_position(F.array(*[F.lit(x) for x in fv.CLASSES]), c) - 1).cast("int")
    low_probs = probabilities(F.lit("BENIGN"), peak=left)
    df = df.withColumns({"_confident": confident, "_rule": rule})
    decided = {
        "status": pick(F.lit("ATTACK"), F.lit("BENIGN"), "status"),
        "class_id": pick(class_of(F.col("_rule")), F.lit(0), "class_id"),
        "label": pick(F.col("_rule"), F.lit("BENIGN"), "label"),
        "is_attack": pick(F.lit(True), F.lit(False), "is_attack"),
        "confidence": pick(F.lit(fv.RULE_CONFIDENCE), left, "confidence"),
        "class_probabilities": pick(
            probabilities(F.col("_rule"), fv.RULE_CONFIDENCE, fv.RULE_BENIGN_WEIGHT, fv.RULE_OTHER_WEIGHT, total),
            low_probs, "class_probabilities"),
        "error": pick(reason, note, "error"),
        "decision": F.when(F.col("_confident"), "kept").when(ruled, "rule").when(lowered, "downgraded").otherwise("unchanged"),
    }
    return df.withColumns(decided).drop("_confident", "_rule")


def apply_threshold(predicted: DataFrame, threshold: float = fv.ATTACK_THRESHOLD) -> DataFrame:
    """Downgrade attacks below the threshold to BENIGN (no rules)."""
    lowered = F.col("is_attack") & (F.col("confidence") < threshold)
    left = F.lit(1.0) - F.col("confidence")
    note = F.format_string(
        "Downgraded from %s (confidence %.1f%% < threshold %.0f%%)", "label", F.col("confidence") * 100, F.lit(threshold * 100))
    low_probs = probabilities(F.lit("BENIGN"), peak=left)
    pick = lambda low, name: F.when(lowered, low).otherwise(F.col(name))
    return predicted.withColumns({
        "status": pick(F.lit("BENIGN"), "status"), "class_id": pick(F.lit(0), "class_id"),
        "label": pick(F.lit("BENIGN"), "label"), "is_attack": pick(F.lit(False), "is_attack"),
        "confidence": pick(left, "confidence"), "class_probabilities": pick(low_probs, "class_probabilities"),
        "error": pick(note, "error")})


def apply_rules(predicted: DataFrame, threshold: float = fv.ATTACK_THRESHOLD) -> DataFrame:
    """Threshold plus the rules that look at one flow only (no port-scan memory)."""
    return _decide(predicted, threshold, F.lit(None).cast("long"))


def detect(predicted: DataFrame, threshold: float = fv.ATTACK_THRESHOLD) -> DataFrame:
    """Threshold, port-scan memory and rules, in their order, over predicted flows.  Their predictions are written once, as they are read twice."""
    predicted = cut(predicted)
    open_rows = predicted.filter(~(F.col("is_attack") & (F.col("confidence") >= threshold)))
    alerts = port_scan_alerts(port_scan_probes(open_rows))
    joined = predicted.join(alerts.select(*FLOW_ID, F.col("ports").alias("_ports")), list(FLOW_ID), "left")
    return _decide(joined, threshold, F.col("_ports")).drop("_ports")


def run_detection(flows: DataFrame, score=None, threshold: float = fv.ATTACK_THRESHOLD) -> DataFrame:
    """Filter -> model (or bypass) -> threshold and rules, one prediction row per flow.

    *score* takes the flows that pass the filter and returns them with
    prediction columns; without a model they count as benign before the rules.
    """
    checked = traffic_filter(flows)
    bypassed = checked.filter(F.col("bypass_reason").isNotNull())
    passed = checked.filter(F.col("bypass_reason").isNull())
    if score is None:
        predicted = checked.withColumns(benign_result(F.col("bypass_reason")))
    else:
        benign = bypassed.withColumns(benign_result(F.col("bypass_reason")))
        scored = score(passed)
        predicted = benign.unionByName(scored.select(*benign.columns))
    return detect(predicted, threshold).withColumn("timestamp_utc", F.col("end_us") / 1e6)
