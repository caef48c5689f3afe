"""The derived views as SQL common table expressions for the check engine."""

EVENTS = """ev as (
  select event_id, user_id, event_type, value, epoch_us(ts) as us,
         cast(json_extract_string(props, '$.k') as int) as k from events)"""

PACKETS = EVENTS + """,
packets_v as (
  select event_id as seq, cast(floor(us / 1000) as bigint) as timestamp_us,
    case when d = 0 then c else s end as src_ip, case when d = 0 then s else c end as dst_ip,
    case when d = 0 then cp else 80 end as src_port, case when d = 0 then 80 else cp end as dst_port,
    6 as protocol, 20 as ip_header_length, 20 as transport_header_length, pl as payload_length,
    case event_type when 'signup' then 2 when 'view' then 16 when 'click' then 24 when 'purchase' then 17
      else (case when k < 20 then 4 else 16 end) end as tcp_flags,
    1000 + k as tcp_window, 5 as tcp_data_offset
  from (select *, k % 2 as d, concat('10.0.0.', cast(user_id % 100 as varchar)) as c, '10.1.0.1' as s,
          cast(50000 + user_id % 100 as int) as cp, cast(floor(value) as bigint) as pl from ev) x)"""

MIXED_RAW = EVENTS + """,
mixed_raw as (
  select event_id as seq, cast(floor(us / 10000) as bigint) as timestamp_us,
    case when back then s else c end as src_ip, case when back then c else s end as dst_ip,
    case when back then dp else sp end as src_port, case when back then sp else dp end as dst_port,
    case when k % 10 = 0 then 17 when k % 25 = 1 then 1 when k % 25 = 2 then 2 else 6 end as protocol,
    cast(case when u % 3 = 0 then 40 else 28 + floor(value) end as int) as ip_total_length,
    20 as ip_header_length,
    case when u % 9 = 0 then (case when u = 0 and k = 50 then 10 else 2 end)
         when event_type = 'error' then (case when k % 2 = 0 then 4 else 17 end)
         when u % 3 = 0 and k % 4 <> 3 then 2 when event_type = 'click' then 24
         when event_type = 'view' then 48 else 2 end as tcp_flags,
    1000 + k as tcp_window, 5 + k % 2 as tcp_data_offset,
    case when k = 97 then 'skipped' when k = 98 then 'error' else 'ok' end as status
  from (select *, user_id % 40 as u, (k % 3 = 2 and (user_id % 40) % 3 <> 0) as back,
          concat('10.0.0.', cast(user_id % 40 as varchar)) as c,
          case when (user_id % 40) % 13 = 5 then '224.0.0.251' when (user_id % 40) % 13 = 6 then '255.255.255.255'
               when (user_id % 40) % 13 = 7 then '169.254.3.4'
               else concat('10.1.0.', cast((user_id % 40) % 4 as varchar)) end as s,
          cast(40000 + user_id % 40 as int) as sp,
          cast(case when (user_id % 40) % 7 = 0 then 22 when (user_id % 40) % 7 = 1 then 5353
               when (user_id % 40) % 7 = 2 then 161 else 1000 + event_id % 9 end as int) as dp
        from ev) x)"""

# raw packets with transport fields resolved and payload computed, accepted rows only
MIXED = MIXED_RAW + """,
mixed_fields as (
  select seq, timestamp_us, src_ip, dst_ip, status, protocol, ip_total_length, ip_header_length,
    case when protocol in (6, 17) then src_port else 0 end as src_port,
    case when protocol in (6, 17) then dst_port else 0 end as dst_port,
    case when protocol = 6 then tcp_flags else 0 end as tcp_flags,
    case when protocol = 6 then tcp_window else 0 end as tcp_window,
    case when protocol = 6 then tcp_data_offset else 0 end as tcp_data_offset,
    case when protocol = 6 then tcp_data_offset * 4 when protocol in (17, 1) then 8 else 0 end as transport_header_length
  from mixed_raw),
mixed_v as (
  select *, cast(greatest(ip_total_length - ip_header_length - transport_header_length, 0) as bigint) as payload_length
  from mixed_fields where status = 'ok')"""

SCAN = EVENTS + """,
scan_v as (
  select event_id as flow_no, concat('10.0.0.', cast(user_id % 10 as varchar)) as src_ip,
    case when k < 90 then 1000 + k else 80 end as dst_port, case when k % 20 = 0 then 17 else 6 end as protocol,
    cast(floor(us / 10000) as bigint) as end_us, cast(1 + k % 3 as double) as total_fwd_packets,
    case when event_type = 'signup' then 1.0 else 0.0 end as total_backward_packets,
    case when event_type = 'purchase' then 5.0 else 0.0 end as total_length_of_fwd_packets, 0.0 as ack_flag_count from ev),
probes as (select * from scan_v where protocol = 6 and src_ip <> '' and dst_port > 0
    and dst_port not in (80, 443, 53, 3001, 8000, 5173, 137, 138, 1900, 5353, 5355)
    and total_backward_packets = 0 and total_fwd_packets <= 2 and total_length_of_fwd_packets = 0 and ack_flag_count = 0)"""

LABELLED = """labelled_base as (
  select case when l_orderkey % 97 = 0 then '70000' else cast(l_partkey % 65536 as varchar) end as destination_port,
    case when l_orderkey % 101 = 0 then '-5' when l_orderkey % 103 = 0 then 'Infinity' when l_orderkey % 107 = 0 then ''
         when l_orderkey % 109 = 0 then 'abc' else cast(cast(floor(l_extendedprice * 10) as bigint) as varchar) end as flow_duration,
    cast(cast(floor(l_quantity) as bigint) as varchar) as total_fwd_packets,
    cast(cast(floor(l_quantity) as bigint) as varchar) as subflow_fwd_packets,
    cast(cast(floor(l_extendedprice * (1 + l_linenumber)) as bigint) as varchar) as flow_bytes_per_s,
    '0' as bwd_psh_flags, cast(cast(l_linestatus = 'O' as int) as varchar) as fin_flag_count,
    case when l_orderkey % 113 = 0 then '' when l_returnflag = 'A' then ' BENIGN ' when l_returnflag = 'N' then 'DoS Hulk'
         else 'Web Attack – XSS' end as label_raw,
    case when l_linestatus = 'O' then 'Monday-a.csv' else 'Friday-b.csv' end as source_file,
    l_orderkey * 1000 + l_linenumber as source_row, l_orderkey as ok
  from lineitem),
labelled_v as (
  select * exclude (ok) from labelled_base
  union all by name select * exclude (ok) replace (source_row + 1000000000 as source_row) from labelled_base where ok % 50 = 0
  union all by name select * exclude (ok) replace (source_row + 2000000000 as source_row, 'Bot' as label_raw)
    from labelled_base where ok % 77 = 0)"""

ATTACK_LOG = EVENTS + """,
log_base as (
  select event_id as id, t as attack_type, concat('10.0.0.', cast(user_id % 100 as varchar)) as src_ip, '10.1.0.1' as dst_ip,
    cast(50000 + user_id % 100 as int) as src_port, 80 + k % 5 as dst_port,
    case when k % 10 = 0 then 17 else 6 end as protocol, value / 500 as confidence,
    case when t = 'BENIGN' then 0 else 1 end as is_attack, cast(floor(us / 1000000) as bigint) as timestamp_utc
  from (select *, case event_type when 'click' then 'DDoS' when 'error' then 'PortScan' when 'purchase' then 'BruteForce'
                  else 'BENIGN' end as t from ev) z),
attack_log_v as (
  select *, concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol) as flow_id from log_base)"""

PREDICTIONS = """predictions_v as (
  select y, cast(case when l_orderkey % 7 = 0 then l_orderkey % 9 else y end as int) as yhat, confidence from (
    select *, case l_returnflag when 'A' then 0 when 'N' then 4
                else (case when l_orderkey % 11 = 0 then 7 else 8 end) end as y,
      cast(trunc(l_extendedprice * 100) as bigint) % 1000 / 1000 as confidence from lineitem) z)"""

CLASSES = """classes as (
  select * from (values (0,'BENIGN'),(1,'Bot'),(2,'BruteForce'),(3,'DDoS'),(4,'DoS'),(5,'Heartbleed'),
    (6,'Infiltration'),(7,'PortScan'),(8,'WebAttack')) as t(class_id, label))"""

KEY = "ip_a, port_a, ip_b, port_b, protocol"


def keyed(source: str) -> str:
    return f"""keyed as (
  select *, case when row(src_ip, src_port) <= row(dst_ip, dst_port) then src_ip else dst_ip end as ip_a,
    case when row(src_ip, src_port) <= row(dst_ip, dst_port) then src_port else dst_port end as port_a,
    case when row(src_ip, src_port) <= row(dst_ip, dst_port) then dst_ip else src_ip end as ip_b,
    case when row(src_ip, src_port) <= row(dst_ip, dst_port) then dst_port else src_port end as port_b,
    case when row(src_ip, src_port) <= row(dst_ip, dst_port) then 0 else 1 end as side
  from {source})"""


def segmented(source: str, mode: str) -> str:
    """Flow numbers by nested partitions (one per kind of boundary)."""
    idle, half = (120000000, 5000000) if mode == "live" else (10**17, 10**17)
    w = f"partition by {KEY} order by timestamp_us, seq"
    return keyed(source) + f""",
s1 as (select *, (protocol = 6 and tcp_flags & 4 <> 0) as rst, (protocol = 6 and tcp_flags & 1 <> 0 and tcp_flags & 4 = 0) as fin,
  timestamp_us - lag(timestamp_us) over ({w}) as gap, lag(side) over ({w}) as pside from keyed),
s2 as (select *, sum(case when coalesce(prst, false) or coalesce(gap > {idle}, false) then 1 else 0 end) over ({w}) as seg
  from (select *, lag(rst) over ({w}) as prst from s1) z),
s3 as (select *, last_value(case when fin then side end ignore nulls) over (
    partition by {KEY}, seg order by timestamp_us, seq rows between unbounded preceding and 1 preceding) as pfd from s2),
s4 as (select *, sum(case when fin and (pfd is null or pfd = side) then 1 else 0 end) over (
    partition by {KEY}, seg order by timestamp_us, seq) as isl from s3),
s5 as (select *, (rst or (fin and (sum(case when fin then 1 else 0 end) over (
    partition by {KEY}, seg, isl order by timestamp_us, seq) - 1) % 2 = 1)) as closes from s4),
s6 as (select *, sum(case when coalesce(pcl, false) or coalesce(gap > {idle}, false) then 1 else 0 end) over ({w}) as hard
  from (select *, lag(closes) over ({w}) as pcl from s5) z),
s7 as (select *, row_number() over (partition by {KEY}, hard order by timestamp_us, seq) as rn,
    (fin or (gap <= {half} and lag(side) over (partition by {KEY}, hard order by timestamp_us, seq) <> side)) as contam from s6),
s8 as (select *, (rn = 1 or (gap > {half} and not coalesce(bool_or(contam) over (partition by {KEY}, hard
    order by timestamp_us, seq rows between unbounded preceding and 1 preceding), false))) as starts from s7),
segmented as (select *, cast(sum(case when starts then 1 else 0 end) over ({w}) as bigint) as flow_no from s8)"""


def flows(source: str, mode: str) -> str:
    """One row per flow with the forty features."""
    fid = f"{KEY}, flow_no"
    o = "timestamp_us, seq"
    open_state, open_reason = ("TIMEOUT", "timeout") if mode == "live" else ("COMPLETED", "flush")
    return segmented(source, mode) + f""",
l1 as (select *, first_value(side) over (partition by {fid} order by {o}) as fside,
    timestamp_us - lag(timestamp_us) over (partition by {fid} order by {o}) as iat, greatest(payload_length, 0) as pl,
    ip_header_length + transport_header_length as hd from segmented),
l2 as (select *, side = fside as fwd, timestamp_us - lag(timestamp_us) over (partition by {fid}, side order by {o}) as siat,
    row_number() over (partition by {fid}, side order by {o}) as srn,
    row_number() over (partition by {fid} order by {o}) as frn,
    sum(case when iat >= 1000000 then 1 else 0 end) over (partition by {fid} order by {o}) as burst from l1),
bursts as (select {fid}, burst, count(*) as packets, min(timestamp_us) as b_start, max(timestamp_us) as b_end,
    max(case when iat >= 1000000 then iat end) as idle_before from l2 group by {fid}, burst),
act as (select {fid}, avg(case when b_end > b_start then b_end - b_start end) as active_mean from bursts group by {fid}),
g as (select {fid}, max(case when frn = 1 then src_ip end) as src_ip, max(case when frn = 1 then src_port end) as src_port,
    max(case when frn = 1 then dst_ip end) as dst_ip, max(case when frn = 1 then dst_port end) as dst_port,
    min(timestamp_us) as start_us, max(timestamp_us) as end_us, max(case when frn = 1 then seq end) as first_seq,
    max(case when closes then seq end) as close_seq, count(*) as n,
    count(*) filter (fwd) as nf, count(*) filter (not fwd) as nb, sum(pl) filter (fwd) as fb, sum(pl) filter (not fwd) as bb,
    max(pl) filter (fwd) as fmax, min(pl) filter (fwd) as fmin, avg(pl) filter (fwd) as favg, stddev_pop(pl) filter (fwd) as fstd,
    min(pl) filter (not fwd) as bmin, stddev_pop(pl) filter (not fwd) as bstd, stddev_pop(iat) as istd, min(iat) as imin,
    sum(siat) filter (fwd) as fit, stddev_pop(siat) filter (fwd) as fistd, min(siat) filter (fwd) as fimin,
    sum(siat) filter (not fwd) as bit_, stddev_pop(siat) filter (not fwd) as bistd, min(siat) filter (not fwd) as bimin,
    sum(hd) filter (fwd) as fh, sum(hd) filter (not fwd) as bh, max(pl) as pmax, avg(pl) as pavg, stddev_pop(pl) as pstd,
    bit_or(tcp_flags) as fl, max(case when srn = 1 and fwd and protocol = 6 then tcp_window end) as fw,
    max(case when srn = 1 and not fwd and protocol = 6 then tcp_window end) as bw,
    count(*) filter (fwd and protocol = 6 and pl >= 1) as fdata,
    min(tcp_data_offset) filter (fwd and protocol = 6 and tcp_data_offset > 0) as foff,
    avg(iat) filter (iat >= 1000000) as idle_mean, stddev_pop(iat) filter (iat >= 1000000) as idle_std,
    bool_or(closes) as closed, max(case when closes then tcp_flags end) as cflags,
    bool_or(protocol = 6 and tcp_flags & 2 <> 0) as saw_syn, bool_or(protocol = 6 and tcp_flags & 5 <> 0) as saw_end
  from l2 group by {fid}),
flows as (select {", ".join("g." + c for c in fid.split(", "))}, src_ip, src_port, dst_ip, dst_port, start_us, end_us, first_seq, close_seq,
    n as packet_count, case when closed then 'COMPLETED' else '{open_state}' end as state,
    case when saw_end then 'CLOSING' when saw_syn then 'ESTABLISHED' else 'NEW' end as tcp_state,
    case when closed and cflags & 4 <> 0 then 'rst' when closed then 'fin' else '{open_reason}' end as close_reason,
    (nf > 0 and nb = 0 and not saw_end) as half_open,
    cast(dst_port as double) as destination_port, cast(end_us - start_us as double) as flow_duration,
    cast(nf as double) as total_fwd_packets, cast(nb as double) as total_backward_packets,
    cast(coalesce(fb, 0) as double) as total_length_of_fwd_packets, cast(coalesce(bb, 0) as double) as total_length_of_bwd_packets,
    cast(coalesce(fmax, 0) as double) as fwd_packet_length_max, cast(coalesce(fmin, 0) as double) as fwd_packet_length_min,
    coalesce(favg, 0) as fwd_packet_length_mean, coalesce(fstd, 0) as fwd_packet_length_std,
    cast(coalesce(bmin, 0) as double) as bwd_packet_length_min, coalesce(bstd, 0) as bwd_packet_length_std,
    case when end_us > start_us then (coalesce(fb, 0) + coalesce(bb, 0)) / ((end_us - start_us) / 1e6) else 0 end as flow_bytes_per_s,
    case when end_us > start_us then n / ((end_us - start_us) / 1e6) else 0 end as flow_packets_per_s,
    coalesce(istd, 0) as flow_iat_std, cast(coalesce(imin, 0) as double) as flow_iat_min,
    cast(coalesce(fit, 0) as double) as fwd_iat_total, coalesce(fistd, 0) as fwd_iat_std, cast(coalesce(fimin, 0) as double) as fwd_iat_min,
    cast(coalesce(bit_, 0) as double) as bwd_iat_total, coalesce(bistd, 0) as bwd_iat_std, cast(coalesce(bimin, 0) as double) as bwd_iat_min,
    cast(coalesce(fh, 0) as double) as fwd_header_length, cast(coalesce(bh, 0) as double) as bwd_header_length,
    case when end_us > start_us then nb / ((end_us - start_us) / 1e6) else 0 end as bwd_packets_per_s,
    cast(pmax as double) as max_packet_length, pavg as packet_length_mean, pstd as packet_length_std,
    cast(fl & 1 <> 0 as double) as fin_flag_count, cast(fl & 8 <> 0 as double) as psh_flag_count,
    cast(fl & 16 <> 0 as double) as ack_flag_count, cast(fl & 32 <> 0 as double) as urg_flag_count,
    case when nf > 0 then nb / nf else 0 end as down_up_ratio,
    cast(coalesce(fw, 0) as double) as init_win_bytes_forward, cast(coalesce(bw, 0) as double) as init_win_bytes_backward,
    cast(fdata as double) as act_data_pkt_fwd, cast(coalesce(foff, 0) * 4 as double) as min_seg_size_forward,
    coalesce(act.active_mean, 0) as active_mean, coalesce(idle_mean, 0) as idle_mean, coalesce(idle_std, 0) as idle_std
  from g join act on {" and ".join(f"g.{c} = act.{c}" for c in fid.split(", "))})"""
