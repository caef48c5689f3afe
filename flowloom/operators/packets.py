"""Packet rows: lengths, transport fields, keys, direction, acceptance and flow segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.functions.scalar import has_flag
from flowloom.operators.session import cut

PACKETS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("ip_total_length", T.IntegerType()),
    T.StructField("ip_header_length", T.IntegerType()),
    T.StructField("transport_header_length", T.IntegerType()),
    T.StructField("payload_length", T.LongType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("tcp_data_offset", T.IntegerType()),
])

KEY = ("ip_a", "port_a", "ip_b", "port_b", "protocol")


# --- row-level operators -------------------------------------------------------

def with_transport_fields(df: DataFrame) -> DataFrame:
    """Transport header length by protocol; ports, flags and window 0 where the protocol has none."""
    tcp, udp = F.col("protocol") == fv.TCP, F.col("protocol") == fv.UDP
    zero = F.lit(0)
    return df.withColumns({
        "transport_header_length": F.when(tcp, F.col("tcp_data_offset") * 4)
        .when(udp | (F.col("protocol") == fv.ICMP), F.lit(8)).otherwise(zero),
        "src_port": F.when(tcp | udp, F.col("src_port")).otherwise(zero),
        "dst_port": F.when(tcp | udp, F.col("dst_port")).otherwise(zero),
        "tcp_flags": F.when(tcp, F.col("tcp_flags")).otherwise(zero),
        "tcp_window": F.when(tcp, F.col("tcp_window")).otherwise(zero),
        "tcp_data_offset": F.when(tcp, F.col("tcp_data_offset")).otherwise(zero),
    })


def with_payload_length(df: DataFrame) -> DataFrame:
    """Payload bytes = IP total - IP header - transport header, never below 0."""
    left = F.col("ip_total_length") - F.col("ip_header_length") - F.col("transport_header_length")
    return df.withColumn("payload_length", F.greatest(left.cast("long"), F.lit(0).cast("long")))


def accept_packets(df: DataFrame) -> DataFrame:
    """Rows decoded as IP packets."""
    return df.filter(F.col("status") == "ok")


def packet_stats(df: DataFrame) -> DataFrame:
    """One row: packets read, accepted, skipped (not IP) and not decodable."""
    status = F.col("status")
    return df.agg(
        F.count("*").alias("packets_read"),
        F.count_if(status == "ok").alias("packets_accepted"),
        F.count_if(status == "skipped").alias("packets_skipped"),
        F.count_if(status == "error").alias("packets_parse_error"),
    )


def with_flow_key(df: DataFrame) -> DataFrame:
    """Direction-free five-part key: the smaller (ip, port) endpoint first; ``side`` 0 = sent by it."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return df.withColumns({
        "ip_a": low["ip"], "port_a": low["port"], "ip_b": high["ip"], "port_b": high["port"],
        "side": F.when(src <= dst, F.lit(0)).otherwise(F.lit(1)),
    })


# --- segmentation -----------------------------------------------------------------

def _last(value: Column, w) -> Column:
    return F.last(value, ignorenulls=True).over(w)


def _label(df: DataFrame, part: list[str], order: list[str], idle_us, half_us) -> DataFrame:
    """Window labels of packets inside one partition group, in packet order.

    Every window has the same partitioning and order, so Spark needs one
    exchange and one sort for all of them.  Needs ``real`` (0 for a context
    row that stands for the packets before the group) and the context columns
    ``ctx_side``/``ctx_ts0``/``ctx_ts1``/``ctx_kind``.

    A flow ends on RST, or when FIN was seen from both sides; a next packet of
    the key starts another one.  ``idle_us``/``half_us`` (None = never) also
    split on silence: longer than ``idle_us`` always, longer than ``half_us``
    while only one side has spoken and no FIN was sent.
    """
    w = W.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    tcp = F.col("protocol") == fv.TCP
    over = lambda limit: F.lit(False) if limit is None else F.coalesce(F.col("gap") > limit, F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c, win: F.sum(F.when(c, 1).otherwise(0)).over(win)

    df = df.withColumns({
        "rst": tcp & has_flag("tcp_flags", fv.RST),
        "fin": tcp & has_flag("tcp_flags", fv.FIN) & ~has_flag("tcp_flags", fv.RST),
        "gap": F.col("timestamp_us") - F.lag("timestamp_us").over(w),
        "prev_side": F.lag("side").over(w),
    })
    # stretches that no state crosses: after an RST or a long silence
    df = df.withColumn("seg", F.coalesce(
        count(flag(F.lag("rst").over(w)) | over(idle_us), upto), F.lit(0)))
    # FINs pair up along runs of alternating sides; every second one closes a flow
    df = df.withColumns({
        "prev_fin": _last(F.when(F.col("fin"), F.struct("seg", "side")), before),
        "fin_no": count(F.col("fin"), upto),
    })
    opens_run = F.col("fin") & (
        F.col("prev_fin").isNull() | (F.col("prev_fin.seg") != F.col("seg"))
        | (F.col("prev_fin.side") == F.col("side")))
    df = df.withColumn("run_first_fin", _last(F.when(opens_run, F.col("fin_no")), upto))
    df = df.withColumn("closes", F.col("rst") | (
        F.col("fin") & ((F.col("fin_no") - F.col("run_first_fin")) % 2 == 1)))
    # flows before the half-open rule, then that rule
    df = df.withColumn("hard", count(flag(F.lag("closes").over(w)) | over(idle_us), upto))
    df = df.withColumn("hard_first", flag(F.col("hard") != F.lag("hard").over(w)) | F.col("gap").isNull())
    two_sided = ~F.col("hard_first") & ~over(half_us) & (F.col("side") != F.col("prev_side"))
    df = df.withColumn("settled_in", _last(
        F.when(F.col("fin") | two_sided, F.col("hard")), before))
    df = df.withColumn("starts", F.col("hard_first") | (
        over(half_us) & ~flag(F.col("settled_in") == F.col("hard"))))
    df = df.withColumns({
        "flow_no": count(F.col("starts"), upto),
        "iat": F.when(~F.col("starts"), F.col("gap")),
        "settled_now": F.col("fin") | two_sided,
    })

    # what the packet looks like inside its flow
    real = F.col("real") == 1
    in_flow = lambda value: F.struct(F.col("flow_no"), value.alias("v"))
    same = lambda name: F.when(F.col(f"{name}.flow_no") == F.col("flow_no"), F.col(f"{name}.v"))
    ts = F.col("timestamp_us")
    kind = (F.when(~real, F.col("ctx_kind"))
            .when(F.col("iat") >= fv.BURST_GAP_US, 2).when(F.col("iat") > 0, 1))
    df = df.withColumn("kind", kind)
    marks = {
        "m_side": (F.when(real & F.col("starts"), F.col("side")).when(~real, F.col("ctx_side")), upto),
        "m_ts0": (F.when(real & (F.col("side") == 0), ts).when(~real, F.col("ctx_ts0")), before),
        "m_ts1": (F.when(real & (F.col("side") == 1), ts).when(~real, F.col("ctx_ts1")), before),
        "m_kind": (F.col("kind"), before),
    }
    df = df.withColumns({
        name: _last(F.when(value.isNotNull(), in_flow(value)), win) for name, (value, win) in marks.items()})
    prev_same = F.when(F.col("side") == 0, same("m_ts0")).otherwise(same("m_ts1"))
    return df.withColumns({
        "is_fwd": F.col("side") == same("m_side"),
        "iat_side": ts - prev_same,
        "opens_burst": flag((F.col("kind") == 1) & (F.coalesce(same("m_kind"), F.lit(2)) == 2)),
    })


_SCRATCH = ("rst", "fin", "gap", "prev_side", "seg", "prev_fin", "fin_no", "run_first_fin", "hard",
            "hard_first", "settled_in", "settled_now", "kind", "m_side", "m_ts0", "m_ts1", "m_kind",
            "real", "ctx_side", "ctx_ts0", "ctx_ts1", "ctx_kind")


def _plain_context(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "real": F.lit(1), "ctx_side": F.lit(None).cast("int"), "ctx_ts0": F.lit(None).cast("long"),
        "ctx_ts1": F.lit(None).cast("long"), "ctx_kind": F.lit(None).cast("int")})


def find_hot_keys(packets: DataFrame, max_rows: int) -> DataFrame:
    """Keys with more than *max_rows* packets; at most (all packets / max_rows) of them."""
    keyed = packets if "ip_a" in packets.columns else with_flow_key(packets)
    return keyed.groupBy(*KEY).count().filter(F.col("count") > max_rows)


def segment_flows(
    packets: DataFrame,
    mode: str = "replay",
    idle_s: float = fv.IDLE_TIMEOUT_US / 1e6,
    half_open_idle_s: float = fv.HALF_OPEN_TIMEOUT_US / 1e6,
    order: str = "time",
    max_key_rows: int | None = 5_000_000,
) -> DataFrame:
    """Give every packet its flow: key, ``flow_no`` within the key, and in-flow labels.

    ``mode="replay"`` ends flows on TCP closure only; ``mode="live"`` also on
    silence.  ``order="time"`` takes packets by (timestamp_us, seq),
    ``order="arrival"`` by seq alone.

    A key with more than *max_key_rows* packets is not put into one task: its
    packets are cut into ordered chunks and flow state is carried from chunk
    to chunk (``_segment_hot``).  ``None`` skips the count that finds such keys.
    """
    if mode not in ("replay", "live"):
        raise ValueError(f"unknown mode {mode!r}")
    idle = int(idle_s * 1e6) if mode == "live" else None
    half = int(half_open_idle_s * 1e6) if mode == "live" else None
    by = ["timestamp_us", "seq"] if order == "time" else ["seq"]
    keyed = with_flow_key(packets)

    hot = []
    if max_key_rows is not None and not packets.isStreaming:
        found = find_hot_keys(keyed, max_key_rows)
        hot = found.collect()  # bounded by all packets / max_key_rows
    if not hot:
        return _label(_plain_context(keyed), list(KEY), by, idle, half).drop(*_SCRATCH)

    spark = packets.sparkSession
    hot_keys = spark.createDataFrame(
        [tuple(r[k] for k in KEY) for r in hot], keyed.select(*KEY).schema)
    side_hint = F.broadcast if len(hot) <= 100_000 else (lambda d: d)
    cold = keyed.join(side_hint(hot_keys), list(KEY), "left_anti")
    rows = sum(r["count"] for r in hot)
    heavy = keyed.join(side_hint(hot_keys), list(KEY), "left_semi")
    cold_labels = _label(_plain_context(cold), list(KEY), by, idle, half).drop(*_SCRATCH)
    heavy_labels = _segment_hot(heavy, by, idle, half, -(-rows // max_key_rows) + 1)
    return cold_labels.unionByName(heavy_labels.select(*cold_labels.columns))


# --- keys too large for one task ------------------------------------------------------

# Flow states a chunk can start in, given the packet just before it:
#   closed  the packet ended its flow        solo    only its side has spoken
#   both    both sides have spoken           fin0/1  FIN seen from side 0 / 1
_STATES = ("closed", "solo", "both", "fin0", "fin1")


def _segment_hot(heavy: DataFrame, by: list[str], idle, half, chunks: int) -> DataFrame:
    """Segment hot keys chunk by chunk; same result as one window over the key.

    1. Range-partition by key and packet order: balanced ordered chunks.
    2. Summarise each chunk once per flow state it could start in (at most
       four, fixed by the packet before it).
    3. Walk the chunk summaries of a key (one small row per chunk and state)
       to find the true state at each chunk start.
    4. Label the packets of each chunk behind context rows for that state.
    """
    key = list(KEY)
    part = key + ["chunk"]
    base = cut(heavy.repartitionByRange(chunks, *key, *by).withColumn("chunk", F.spark_partition_id()))

    # last packet of every chunk, handed to the next chunk of the key
    pos = F.struct(*by)
    edge = base.groupBy(*part).agg(
        F.max_by(F.struct("timestamp_us", "seq", "side", "tcp_flags"), pos).alias("last"))
    chain = W.partitionBy(*key).orderBy("chunk")
    edge = edge.select(*part, F.lag("last").over(chain).alias("prev"))
    tcp = F.col("protocol") == fv.TCP
    rst = tcp & has_flag("prev.tcp_flags", fv.RST)
    fin = tcp & has_flag("prev.tcp_flags", fv.FIN)
    possible = (
        F.when(F.col("prev").isNull(), F.array(F.lit("first")))
        .when(rst, F.array(F.lit("closed")))
        .when(fin & (F.col("prev.side") == 0), F.array(F.lit("closed"), F.lit("fin0")))
        .when(fin, F.array(F.lit("closed"), F.lit("fin1")))
        .otherwise(F.array(*[F.lit(s) for s in _STATES[1:]])))
    starts_in = cut(edge.withColumn("state", F.explode(possible)))

    # pass 1: every possible start state (no carried positions needed yet)
    trial = base.join(starts_in.select(*part, "state"), part).unionByName(
        _context_rows(starts_in, None), allowMissingColumns=True)
    trial = trial.fillna({"real": 1})
    labelled = _label(trial, part + ["state"], ["real", *by], idle, half)
    mine = labelled.filter("real = 1")
    where_last = F.struct(*by)
    end_state = (
        F.when(F.col("closes"), "closed")
        .when(F.col("fin_open") == 0, "fin0").when(F.col("fin_open") == 1, "fin1")
        .when(F.col("settled"), "both").otherwise("solo"))
    w = W.partitionBy(*part, "state").orderBy("real", *by).rowsBetween(W.unboundedPreceding, 0)
    mine_state = labelled.withColumns({
        "fin_mark": _last(F.when(F.col("fin") & ~F.col("closes"), F.struct("flow_no", "side")), w),
        "settled_mark": _last(F.when(F.col("settled_now"), F.struct("flow_no")), w),
    }).filter("real = 1").withColumns({
        "fin_open": F.when(F.col("fin_mark.flow_no") == F.col("flow_no"), F.col("fin_mark.side")),
        "settled": F.coalesce(F.col("settled_mark.flow_no") == F.col("flow_no"), F.lit(False)),
    })
    in_last = lambda value: F.max_by(F.when(value.isNotNull(), F.struct("flow_no", value.alias("v"))),
                                     F.when(value.isNotNull(), where_last))
    ts = F.col("timestamp_us")
    summary = mine_state.groupBy(*part, "state").agg(
        F.count_if("starts").alias("n_starts"),
        F.max("flow_no").alias("last_flow"),
        F.max_by(F.when(F.col("starts"), F.col("side")), F.when(F.col("starts"), where_last)).alias("start_side"),
        F.max_by(end_state, where_last).alias("end_state"),
        in_last(F.when(F.col("side") == 0, ts)).alias("e_ts0"),
        in_last(F.when(F.col("side") == 1, ts)).alias("e_ts1"),
        in_last(F.col("kind")).alias("e_kind"),
    )
    of_last = lambda name: F.when(F.col(f"{name}.flow_no") == F.col("last_flow"), F.col(f"{name}.v"))
    summary = summary.select(
        *part, "state", "n_starts", "start_side", "end_state",
        of_last("e_ts0").alias("ts0"), of_last("e_ts1").alias("ts1"), of_last("e_kind").alias("kind"))

    carried = cut(summary.groupBy(*key).applyInPandas(_walk_chunks, _CARRY))

    # pass 2: the true start state
    true_start = starts_in.join(carried, part + ["state"])
    final = base.unionByName(_context_rows(true_start, "carry"), allowMissingColumns=True).fillna({"real": 1})
    final = _label(final, part, ["real", *by], idle, half).filter("real = 1")
    offsets = carried.select(*part, "flows_before", F.col("state").alias("start_state"))
    final = final.join(offsets, part)
    shift = F.when(F.col("start_state") == "first", 0).otherwise(F.col("flows_before") - 1)
    return final.withColumn("flow_no", F.col("flow_no") + shift).drop("chunk", *_SCRATCH)


_CARRY = ", ".join(["ip_a string", "port_a int", "ip_b string", "port_b int", "protocol int", "chunk int",
                    "state string", "flows_before long", "ctx_side int", "ctx_ts0 long", "ctx_ts1 long",
                    "ctx_kind int"])


def _walk_chunks(pdf):
    """Chunk summaries of one key -> the state each chunk really starts in (one row per chunk)."""
    import pandas as pd

    none = lambda v: None if pd.isna(v) else int(v)
    state, flows, side, ts0, ts1, kind = "first", 0, None, None, None, None
    out = []
    for chunk, rows in sorted(pdf.groupby("chunk"), key=lambda kv: kv[0]):
        row = rows[rows["state"] == state].iloc[0]
        out.append((*(row[k] for k in KEY), chunk, state, flows, side, ts0, ts1, kind))
        flows += int(row["n_starts"])
        if row["n_starts"]:
            side, ts0, ts1, kind = none(row["start_side"]), none(row["ts0"]), none(row["ts1"]), none(row["kind"])
        else:
            ts0 = ts0 if pd.isna(row["ts0"]) else int(row["ts0"])
            ts1 = ts1 if pd.isna(row["ts1"]) else int(row["ts1"])
            kind = kind if pd.isna(row["kind"]) else int(row["kind"])
        state = row["end_state"]
    cols = [*KEY, "chunk", "state", "flows_before", "ctx_side", "ctx_ts0", "ctx_ts1", "ctx_kind"]
    frame = pd.DataFrame(out, columns=cols)
    for c in ("port_a", "port_b", "protocol", "chunk", "flows_before", "ctx_side", "ctx_ts0", "ctx_ts1", "ctx_kind"):
        frame[c] = frame[c].astype("Int64")
    return frame


def _context_rows(starts_in: DataFrame, carry: str | None) -> DataFrame:
    """One or two rows, ordered before a chunk, that put a flow into the given state.

    ``closed`` = an RST; ``solo`` = a packet of the previous packet's side;
    ``both`` = a packet of the other side first; ``fin0/1`` = a FIN of that
    side first.  The last of them sits at the previous packet's time.
    """
    prev_side = F.col("prev.side")
    fin_side = F.when(F.col("state") == "fin0", 0).otherwise(1)
    is_fin = F.col("state").startswith("fin")
    prev_fin = has_flag("prev.tcp_flags", fv.FIN)
    first = F.when(F.col("state") == "both", 1 - prev_side).when(is_fin, fin_side).otherwise(prev_side)
    first_flags = F.when(F.col("state") == "closed", fv.RST).when(is_fin, fv.FIN).otherwise(0)
    second_needed = (F.col("state") == "both") | (is_fin & ~prev_fin)
    row = lambda n, side, flags: F.struct(F.lit(n).alias("n"), side.cast("int").alias("side"), flags.cast("int").alias("tcp_flags"))
    rows = F.when(second_needed, F.array(row(-2, first, first_flags), row(-1, prev_side, F.lit(0)))
                  ).otherwise(F.array(row(-1, first, first_flags)))
    ctx = ["ctx_side", "ctx_ts0", "ctx_ts1", "ctx_kind"]
    types = {"ctx_side": "int", "ctx_ts0": "long", "ctx_ts1": "long", "ctx_kind": "int"}
    values = [F.col(c).cast(types[c]).alias(c) if carry else F.lit(None).cast(types[c]).alias(c) for c in ctx]
    out = starts_in.filter("state <> 'first'").withColumn("v", F.explode(rows))
    keep = [*KEY, "chunk"] + ([] if carry else ["state"])
    # two context rows share a time; "real" (-1, 0) keeps them in order and before the packets
    return out.select(*keep, F.col("prev.timestamp_us").alias("timestamp_us"), F.col("prev.seq").alias("seq"),
                      F.col("v.side").alias("side"), F.col("v.tcp_flags").alias("tcp_flags"),
                      (F.col("v.n") + 1).alias("real"), *values)
