"""Queries over packets and flows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.functions.scalar import has_flag
from flowloom.operators import flows as fl
from flowloom.operators import packets as pk
from flowloom.plans import view_sql as vs
from flowloom.plans import views
from flowloom.plans.registry import query, rounded

KEY = list(pk.KEY)
FID = list(fl.FLOW_ID)
_id_sql = vs.KEY + ", flow_no"


def mixed_packets(spark, sf_dir):
    """Accepted mixed packets with transport fields and payload resolved."""
    raw = pk.with_transport_fields(pk.accept_packets(views.mixed_packets_v(spark, sf_dir)))
    return pk.with_payload_length(raw)


def _flows(spark, sf_dir, mode="replay"):
    return fl.assemble_flows(views.packets_v(spark, sf_dir), mode)


def mixed_flows(spark, sf_dir, mode="replay"):
    return fl.assemble_flows(mixed_packets(spark, sf_dir), mode)


def _feature_sql(cols):
    return ", ".join(f"round({c}, 4) + 0.0 as {c}" for c in cols)


@query(f"with {vs.MIXED} select seq, payload_length from mixed_v")
def payload_length(spark, sf_dir):
    return mixed_packets(spark, sf_dir).select("seq", "payload_length")


@query(f"with {vs.MIXED} select seq, protocol, transport_header_length, src_port, dst_port, tcp_flags, tcp_window, tcp_data_offset from mixed_fields")
def transport_fields(spark, sf_dir):
    return pk.with_transport_fields(views.mixed_packets_v(spark, sf_dir)).select(
        "seq", "protocol", "transport_header_length", "src_port", "dst_port", "tcp_flags", "tcp_window", "tcp_data_offset")


@query(f"""with {vs.MIXED_RAW} select count(*) as packets_read, count(*) filter (status = 'ok') as packets_accepted,
  count(*) filter (status = 'skipped') as packets_skipped, count(*) filter (status = 'error') as packets_parse_error from mixed_raw""")
def packet_stats(spark, sf_dir):
    return pk.packet_stats(views.mixed_packets_v(spark, sf_dir))


@query(f"with {vs.MIXED_RAW} select seq, protocol, src_ip, dst_ip from mixed_raw where status = 'ok'")
def accept_packets(spark, sf_dir):
    return pk.accept_packets(views.mixed_packets_v(spark, sf_dir)).select("seq", "protocol", "src_ip", "dst_ip")


@query(f"with {vs.MIXED}, {vs.keyed('mixed_v')} select seq, {vs.KEY}, side from keyed")
def flow_key(spark, sf_dir):
    return pk.with_flow_key(mixed_packets(spark, sf_dir)).select("seq", *KEY, "side")


@query(f"""with {vs.PACKETS} select seq, tcp_flags & 1 <> 0 as fin, tcp_flags & 2 <> 0 as syn, tcp_flags & 4 <> 0 as rst,
  tcp_flags & 8 <> 0 as psh, tcp_flags & 16 <> 0 as ack, tcp_flags & 32 <> 0 as urg from packets_v""")
def tcp_flag_tests(spark, sf_dir):
    bits = {"fin": fv.FIN, "syn": fv.SYN, "rst": fv.RST, "psh": fv.PSH, "ack": fv.ACK, "urg": fv.URG}
    return views.packets_v(spark, sf_dir).select("seq", *[has_flag("tcp_flags", b).alias(n) for n, b in bits.items()])


@query(f"""with {vs.PACKETS}, {vs.segmented('packets_v', 'replay')}
  select seq, side = first_value(side) over (partition by {_id_sql} order by timestamp_us, seq) as is_fwd from segmented""")
def packet_direction(spark, sf_dir):
    return pk.segment_flows(views.packets_v(spark, sf_dir)).select("seq", "is_fwd")


@query(f"with {vs.PACKETS}, {vs.flows('packets_v', 'replay')} select {_id_sql}, src_ip, src_port, dst_ip, dst_port from flows")
def flow_initiator(spark, sf_dir):
    return _flows(spark, sf_dir).select(*FID, "src_ip", "src_port", "dst_ip", "dst_port")


@query(f"with {vs.PACKETS}, {vs.segmented('packets_v', 'replay')} select seq, {_id_sql}, closes, starts from segmented")
def segment_flows_replay(spark, sf_dir):
    return pk.segment_flows(views.packets_v(spark, sf_dir)).select("seq", *FID, "closes", "starts")


@query(f"with {vs.PACKETS}, {vs.segmented('packets_v', 'live')} select seq, {_id_sql}, closes, starts from segmented")
def segment_flows_live(spark, sf_dir):
    return pk.segment_flows(views.packets_v(spark, sf_dir), mode="live").select("seq", *FID, "closes", "starts")


@query(f"with {vs.PACKETS}, {vs.flows('packets_v', 'live')} select {_id_sql}, start_us, end_us, packet_count, "
       f"close_reason, {_feature_sql(fv.FEATURE_COLUMNS)} from flows")
def hot_key_flows(spark, sf_dir):
    """Live flows with every large key cut into chunks (the limit is near the mean key size at any scale)."""
    packets = views.packets_v(spark, sf_dir)
    limit = max(2, packets.count() // 100)
    flows = fl.assemble_flows(packets, "live", max_key_rows=limit)
    return rounded(flows.select(*FID, "start_us", "end_us", "packet_count", "close_reason", *fv.FEATURE_COLUMNS))


@query(f"""with {vs.PACKETS}, {vs.flows('packets_v', 'replay')} select {_id_sql}, close_reason,
  cast(row_number() over (order by case when close_reason = 'flush' then 1 else 0 end,
    case when close_reason <> 'flush' then end_us end, close_seq, {_id_sql}) as bigint) as position from flows""")
def replay_order(spark, sf_dir):
    flows = fl.in_replay_order(_flows(spark, sf_dir)).select(*FID, "close_reason")
    # the rows are already range-sorted; number them as read
    return _numbered(flows)


def _numbered(df):
    """Positions of globally sorted rows: rows per partition, offsets, position inside the partition."""
    from flowloom.operators.session import cut

    parts = cut(df.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", "first", before.alias("before"))
    return parts.join(F.broadcast(starts), "_p").withColumn(
        "position", F.col("before") + F.col("_i") - F.col("first") + 1).drop("_p", "_i", "before", "first")


@query(f"with {vs.PACKETS}, {vs.flows('packets_v', 'replay')} select {_id_sql}, state, tcp_state, close_reason, half_open from flows")
def flow_states(spark, sf_dir):
    return _flows(spark, sf_dir).select(*FID, "state", "tcp_state", "close_reason", "half_open")


@query(f"""with {vs.MIXED}, {vs.flows('mixed_v', 'live')}, m as (select max(timestamp_us) as now from mixed_v)
  select {_id_sql}, half_open, case when open_ then tcp_state else state end as state,
    case when open_ then 'open' else close_reason end as close_reason from (
    select *, close_reason = 'timeout' and not (now - end_us > 120000000 or (half_open and now - end_us > 5000000)) as open_
    from flows, m) z""")
def half_open_flows(spark, sf_dir):
    packets = mixed_packets(spark, sf_dir)
    now = packets.agg(F.max("timestamp_us")).first()[0]
    return fl.with_open_tail(fl.assemble_flows(packets, "live"), now).select(*FID, "half_open", "state", "close_reason")


_ASSEMBLY = ["start_us", "end_us", "packet_count"]


@query(f"with {vs.PACKETS}, {vs.flows('packets_v', 'replay')} select {_id_sql}, start_us, end_us, packet_count, src_ip, dst_ip, "
       f"{_feature_sql(fv.FEATURE_COLUMNS[:6])} from flows")
def flow_assembly(spark, sf_dir):
    return rounded(_flows(spark, sf_dir).select(*FID, *_ASSEMBLY, "src_ip", "dst_ip", *fv.FEATURE_COLUMNS[:6]))


@query(f"""with {vs.MIXED}, {vs.flows('mixed_v', 'replay')}
  select concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol) as flow_id, flow_no, packet_count as total_packets,
    cast(end_us - start_us as double) as flow_duration_us, state in ('COMPLETED', 'TIMEOUT') as is_completed,
    state not in ('COMPLETED', 'TIMEOUT') as is_partial_flow from flows""")
def flow_context(spark, sf_dir):
    f = fl.with_flow_context(mixed_flows(spark, sf_dir))
    return f.select("flow_id", "flow_no", "context.total_packets", "context.flow_duration_us", "context.is_completed", "is_partial_flow")


@query(f"""with {vs.MIXED}, {vs.flows('mixed_v', 'replay')}, p as (
    select count(*) as packets_read, count(*) filter (status = 'ok') as packets_accepted,
      count(*) filter (status = 'skipped') as packets_skipped, count(*) filter (status = 'error') as packets_parse_error from mixed_raw),
  f as (select count(*) filter (close_reason in ('rst', 'fin')) as flows_naturally_completed,
      count(*) filter (close_reason = 'flush') as flows_eof_flushed, count(*) as flows_total from flows)
  select * from p, f""")
def replay_stats(spark, sf_dir):
    return fl.replay_stats(views.mixed_packets_v(spark, sf_dir), mixed_flows(spark, sf_dir))


_VOLUME = [fv.snake(n) for n in (
    "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Min", "Bwd Packet Length Std", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Down/Up Ratio")]
_TIMING = [fv.snake(n) for n in (
    "Flow Duration", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Std", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Std",
    "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Std", "Bwd IAT Min", "Bwd Packets/s")]
_HEADER = [fv.snake(n) for n in (
    "Destination Port", "Fwd Header Length", "Bwd Header Length", "FIN Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward")]
_ACTIVITY = ["active_mean", "idle_mean", "idle_std"]


def _register_features(name, cols, mode, source, frame):
    @query(f"with {source}, {vs.flows('packets_v' if source is vs.PACKETS else 'mixed_v', mode)} "
           f"select {_id_sql}, {_feature_sql(cols)} from flows", name=name)
    def run(spark, sf_dir):
        return rounded(frame(spark, sf_dir, mode).select(*FID, *cols))


_register_features("features_volume", _VOLUME, "replay", vs.PACKETS, _flows)
_register_features("features_timing", _TIMING, "replay", vs.PACKETS, _flows)
_register_features("features_header_flags", _HEADER, "replay", vs.PACKETS, _flows)
_register_features("features_activity", _ACTIVITY, "replay", vs.PACKETS, _flows)
_register_features("features_live", list(fv.FEATURE_COLUMNS), "live", vs.PACKETS, _flows)
_register_features("features_mixed_protocols", list(fv.FEATURE_COLUMNS), "live", vs.MIXED, mixed_flows)


@query(f"""with {vs.PACKETS}, {vs.flows('packets_v', 'replay')} select {_id_sql}, cast(burst as bigint) as burst_no, packets,
  b_start as start_us, b_end as end_us, b_end - b_start as active_us, idle_before as idle_before_us from bursts""")
def active_bursts(spark, sf_dir):
    return fl.active_bursts(pk.segment_flows(views.packets_v(spark, sf_dir)))


@query(f"with {vs.MIXED}, {vs.flows('mixed_v', 'live')} select count(*) as flows, cast(0 as bigint) as bad_values from flows")
def feature_check(spark, sf_dir):
    return fl.feature_check(mixed_flows(spark, sf_dir, "live"))
