"""Flow rows: assembly, the forty features, bursts, context and replay statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.functions.scalar import has_flag, safe_ratio
from flowloom.operators.packets import KEY, segment_flows
from flowloom.operators.running import running_total

FLOW_ID = (*KEY, "flow_no")


def _aggregates() -> dict[str, Column]:
    """Aggregates of one flow over its labelled packets.

    All of them merge, so Spark aggregates partially before a shuffle, and all
    buffers have a fixed width, so it hashes instead of sorting: "first" values
    are read off the packet that starts the flow (or the side) rather than with
    ``min_by`` over a struct.
    """
    fwd, bwd, tcp = F.col("is_fwd"), ~F.col("is_fwd"), F.col("protocol") == fv.TCP
    ts, size = F.col("timestamp_us"), F.greatest(F.col("payload_length"), F.lit(0))
    head = (F.col("ip_header_length") + F.col("transport_header_length")).cast("long")
    iat, iat_side = F.col("iat"), F.col("iat_side")
    starts, closes, side_first = F.col("starts"), F.col("closes"), F.col("iat_side").isNull()
    burst = F.when((iat > 0) & (iat < fv.BURST_GAP_US), iat)
    idle = F.when(iat >= fv.BURST_GAP_US, iat)
    syn = tcp & has_flag("tcp_flags", fv.SYN)
    fin_or_rst = tcp & (has_flag("tcp_flags", fv.FIN) | has_flag("tcp_flags", fv.RST))
    on = lambda cond, value: F.when(cond, value)
    return {
        "first_side": F.max(on(starts, F.col("side"))),
        "start_us": F.max(on(starts, ts)), "first_seq": F.max(on(starts, F.col("seq"))),
        "close_seq": F.max(on(closes, F.col("seq"))), "duration_us": F.coalesce(F.sum(iat), F.lit(0)),
        "n": F.count("*"), "n_fwd": F.count_if(fwd), "n_bwd": F.count_if(bwd),
        "fwd_bytes": F.sum(on(fwd, size)), "bwd_bytes": F.sum(on(bwd, size)),
        "fwd_max": F.max(on(fwd, size)), "fwd_min": F.min(on(fwd, size)),
        "fwd_avg": F.avg(on(fwd, size)), "fwd_std": F.stddev_pop(on(fwd, size)),
        "bwd_min": F.min(on(bwd, size)), "bwd_std": F.stddev_pop(on(bwd, size)),
        "iat_std": F.stddev_pop(iat), "iat_min": F.min(iat),
        "fwd_iat_total": F.sum(on(fwd, iat_side)), "fwd_iat_std": F.stddev_pop(on(fwd, iat_side)),
        "fwd_iat_min": F.min(on(fwd, iat_side)),
        "bwd_iat_total": F.sum(on(bwd, iat_side)), "bwd_iat_std": F.stddev_pop(on(bwd, iat_side)),
        "bwd_iat_min": F.min(on(bwd, iat_side)),
        "fwd_head": F.sum(on(fwd, head)), "bwd_head": F.sum(on(bwd, head)),
        "max_size": F.max(size), "avg_size": F.avg(size), "std_size": F.stddev_pop(size),
        "flags": F.bit_or("tcp_flags"),
        "fwd_window": F.max(on(fwd & tcp & side_first, F.col("tcp_window"))),
        "bwd_window": F.max(on(bwd & tcp & side_first, F.col("tcp_window"))),
        "fwd_data": F.count_if(fwd & tcp & (size >= 1)),
        "fwd_offset": F.min(on(fwd & tcp & (F.col("tcp_data_offset") > 0), F.col("tcp_data_offset"))),
        "active_us": F.sum(burst), "n_bursts": F.count_if("opens_burst"),
        "idle_avg": F.avg(idle), "idle_std": F.stddev_pop(idle),
        "closed": F.max(closes), "close_flags": F.max(on(closes, F.col("tcp_flags"))),
        "saw_syn": F.max(syn), "saw_end": F.max(fin_or_rst),
    }


def _features() -> dict[str, Column]:
    c, zero = F.col, F.lit(0.0)
    num = lambda name: F.coalesce(c(name).cast("double"), zero)
    seconds = c("duration_us") / 1e6
    bit = lambda b: has_flag("flags", b).cast("double")
    values = (
        c("dst_port").cast("double"), c("duration_us").cast("double"), num("n_fwd"), num("n_bwd"),
        num("fwd_bytes"), num("bwd_bytes"), num("fwd_max"), num("fwd_min"), num("fwd_avg"), num("fwd_std"),
        num("bwd_min"), num("bwd_std"),
        safe_ratio(num("fwd_bytes") + num("bwd_bytes"), seconds), safe_ratio(c("n"), seconds),
        num("iat_std"), num("iat_min"), num("fwd_iat_total"), num("fwd_iat_std"), num("fwd_iat_min"),
        num("bwd_iat_total"), num("bwd_iat_std"), num("bwd_iat_min"), num("fwd_head"), num("bwd_head"),
        safe_ratio(c("n_bwd"), seconds), num("max_size"), num("avg_size"), num("std_size"),
        bit(fv.FIN), bit(fv.PSH), bit(fv.ACK), bit(fv.URG), safe_ratio(c("n_bwd"), c("n_fwd")),
        num("fwd_window"), num("bwd_window"), num("fwd_data"), num("fwd_offset") * 4,
        safe_ratio(num("active_us"), c("n_bursts")), num("idle_avg"), num("idle_std"),
    )
    return dict(zip(fv.FEATURE_COLUMNS, values))


def assemble_flows(
    packets: DataFrame, mode: str = "replay", order: str = "time", segmented: bool = False, **limits
) -> DataFrame:
    """One row per flow: endpoints of the first packet, times, state, and the forty features.

    *packets* may already carry segmentation labels (``segmented=True``).
    Packets are expected in non-decreasing time within a key for the burst
    features (always so for ``order="time"``).
    """
    rows = packets if segmented else segment_flows(packets, mode=mode, order=order, **limits)
    flows = rows.groupBy(*FLOW_ID).agg(*[agg.alias(name) for name, agg in _aggregates().items()])
    # a flow that did not close ends by silence in live mode, else at the end of the input
    open_state = "TIMEOUT" if mode == "live" else "COMPLETED"
    from_a = F.col("first_side") == 0
    pick = lambda a, b: F.when(from_a, F.col(a)).otherwise(F.col(b))
    flows = flows.withColumns({
        "src_ip": pick("ip_a", "ip_b"), "src_port": pick("port_a", "port_b"),
        "dst_ip": pick("ip_b", "ip_a"), "dst_port": pick("port_b", "port_a")})
    return flows.select(
        *FLOW_ID, "src_ip", "src_port", "dst_ip", "dst_port", "start_us",
        (F.col("start_us") + F.col("duration_us")).alias("end_us"),
        "first_seq", "close_seq", F.col("n").alias("packet_count"),
        F.when(F.col("closed"), "COMPLETED").otherwise(open_state).alias("state"),
        # what the flow's own packets say, before eviction
        F.when(F.col("saw_end"), "CLOSING").when(F.col("saw_syn"), "ESTABLISHED").otherwise("NEW").alias("tcp_state"),
        F.when(F.col("closed") & has_flag("close_flags", fv.RST), "rst")
        .when(F.col("closed"), "fin").otherwise("timeout" if mode == "live" else "flush").alias("close_reason"),
        ((F.col("n_fwd") > 0) & (F.col("n_bwd") == 0) & ~F.col("saw_end")).alias("half_open"),
        *[value.alias(name) for name, value in _features().items()],
    )


def with_open_tail(flows: DataFrame, as_of_us: int, idle_s: float = 120, half_open_idle_s: float = 5) -> DataFrame:
    """Live flows as seen at *as_of_us*: flows still within their time limit keep their own TCP state."""
    idle = F.lit(as_of_us) - F.col("end_us")
    expired = (idle > int(idle_s * 1e6)) | (F.col("half_open") & (idle > int(half_open_idle_s * 1e6)))
    still_open = (F.col("close_reason") == "timeout") & ~expired
    return flows.withColumns({
        "state": F.when(still_open, F.col("tcp_state")).otherwise(F.col("state")),
        "close_reason": F.when(still_open, F.lit("open")).otherwise(F.col("close_reason")),
    })


def in_replay_order(flows: DataFrame) -> DataFrame:
    """Flows that closed by themselves in closing order, then the flushed ones by key (a global sort)."""
    flushed = F.col("close_reason") == "flush"
    rank = F.when(flushed, 1).otherwise(0)
    when_closed = lambda c: F.when(~flushed, F.col(c))
    return flows.orderBy(rank, when_closed("end_us"), F.col("close_seq"), *FLOW_ID)


def with_flow_context(flows: DataFrame) -> DataFrame:
    """Add ``flow_id`` text, the ``context`` struct and the partial-flow flag."""
    flow_id = F.format_string("%s:%d-%s:%d-%d", "src_ip", "src_port", "dst_ip", "dst_port", "protocol")
    done = F.col("state").isin("COMPLETED", "TIMEOUT")
    flows = flows.withColumn("flow_id", flow_id)
    return flows.withColumns({
        "context": F.struct(
            "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
            F.col("packet_count").alias("total_packets"),
            (F.col("end_us") - F.col("start_us")).cast("double").alias("flow_duration_us"),
            done.alias("is_completed")),
        "is_partial_flow": ~done,
    })


def active_bursts(segmented: DataFrame, max_flow_rows: int | None = 5_000_000) -> DataFrame:
    """One row per burst of a flow: packets, start, end, duration and the idle gap before it.

    A burst starts at the first packet of a flow and after every gap of at
    least one second.  Burst numbers are a running count inside the flow; a
    flow with more than *max_flow_rows* packets is counted in ordered chunks.
    """
    gap = F.when(F.col("iat") >= fv.BURST_GAP_US, F.col("iat"))
    breaks = F.when(gap.isNotNull(), 1).otherwise(0)
    huge = max_flow_rows is not None and not (
        segmented.groupBy(*FLOW_ID).count().filter(F.col("count") > max_flow_rows).isEmpty())
    if huge:
        numbered = running_total(segmented, FLOW_ID, ["timestamp_us", "seq"], {"burst_no": breaks})
    else:
        order = W.partitionBy(*FLOW_ID).orderBy("timestamp_us", "seq").rowsBetween(W.unboundedPreceding, 0)
        numbered = segmented.withColumn("burst_no", F.sum(breaks).over(order))
    return (
        numbered.groupBy(*FLOW_ID, "burst_no")
        .agg(F.count("*").alias("packets"), F.min("timestamp_us").alias("start_us"),
             F.max("timestamp_us").alias("end_us"), F.max(gap).alias("idle_before_us"))
        .withColumn("active_us", F.col("end_us") - F.col("start_us"))
    )


def feature_check(flows: DataFrame) -> DataFrame:
    """One row: flows, and how many feature values are missing or not finite (must be 0)."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    total = sum((F.count_if(bad(c)) for c in fv.FEATURE_COLUMNS[1:]), F.count_if(bad(fv.FEATURE_COLUMNS[0])))
    return flows.agg(F.count("*").alias("flows"), total.alias("bad_values"))


def replay_stats(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """One row of packet counters and flow counters of a replay."""
    has_status = "status" in packets.columns
    status = F.col("status") if has_status else F.lit("ok")
    p = packets.agg(
        F.count("*").alias("packets_read"), F.count_if(status == "ok").alias("packets_accepted"),
        F.count_if(status == "skipped").alias("packets_skipped"),
        F.count_if(status == "error").alias("packets_parse_error"))
    f = flows.agg(
        F.count_if(F.col("close_reason").isin("rst", "fin")).alias("flows_naturally_completed"),
        F.count_if(F.col("close_reason") == "flush").alias("flows_eof_flushed"),
        F.count("*").alias("flows_total"))
    one = F.lit(1).alias("_one")
    return p.select(one, "*").join(f.select(one, "*"), "_one").drop("_one")
