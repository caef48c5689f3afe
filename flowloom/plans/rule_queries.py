"""Queries over the traffic filter, the threshold and the detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.scalar import is_special_ip
from flowloom.operators import flows as fl
from flowloom.operators import log as lg
from flowloom.operators import rules as ru
from flowloom.plans import view_sql as vs
from flowloom.plans import views
from flowloom.plans.flow_queries import FID, mixed_flows
from flowloom.plans.registry import query, rounded

_fid = vs.KEY + ", flow_no"
_MIXED_LIVE = f"{vs.MIXED}, {vs.flows('mixed_v', 'live')}"

_SPECIAL = """({0} = '255.255.255.255' or {0} = '0.0.0.0' or {0} = ''
  or cast(split_part({0}, '.', 1) as int) between 224 and 239
  or (split_part({0}, '.', 1) = '169' and split_part({0}, '.', 2) = '254'))"""

_FILTER = f"""filtered as (select *, case
    when protocol not in (6, 17) then concat(case protocol when 1 then 'ICMP' when 2 then 'IGMP' else concat('proto-', protocol) end,
      ' bypass — model trained on TCP/UDP flows only')
    when {_SPECIAL.format('dst_ip')} or {_SPECIAL.format('src_ip')} then 'Broadcast/multicast bypass — one-way traffic'
    when src_port in (67, 68, 137, 138, 161, 162, 1900, 5353, 5355) or dst_port in (67, 68, 137, 138, 161, 162, 1900, 5353, 5355)
      then 'Link-local discovery protocol bypass'
    when packet_count <= 1 and protocol <> 6 then 'Single-packet flow bypass — no flow statistics' end as bypass_reason from flows)"""

_SCORED = f"""{vs.CLASSES},
scored as (select f.*, c.class_id, c.label, c.label <> 'BENIGN' as is_attack, (start_us % 1000) / 1000 as confidence
  from flows f join classes c on c.class_id = (f.packet_count + f.src_port) % 9)"""

_RULE = """case
    when is_attack and confidence >= 0.8 then null
    when protocol = 6 and total_fwd_packets >= 10 and total_backward_packets = 0 and total_length_of_fwd_packets = 0
      and total_length_of_bwd_packets = 0 and ack_flag_count = 0 and fin_flag_count = 0 and psh_flag_count = 0
      then case when total_fwd_packets >= 100 then 'DDoS' else 'DoS' end
    when protocol = 6 and total_fwd_packets >= 50 and total_backward_packets = 0 and total_length_of_fwd_packets = 0
      and ack_flag_count = 0 and fin_flag_count = 0 and dst_port in (22, 23, 21, 3389, 5900, 445, 139, 25, 110, 143)
      then 'BruteForce' end"""

# rules after the port-scan rule, over rows with label/is_attack/confidence/error_in
_DECIDED = """decided as (select *, case when is_attack and confidence >= 0.8 then 'kept' when rule is not null then 'rule'
    when is_attack then 'downgraded' else 'unchanged' end as decision from ruled)"""
_OUT = """case decision when 'rule' then rule when 'downgraded' then 'BENIGN' else label end as label,
  case decision when 'rule' then true when 'downgraded' then false else is_attack end as is_attack,
  round(case decision when 'rule' then 0.9 when 'downgraded' then 1 - confidence else confidence end, 4) + 0.0 as confidence,
  case decision when 'rule' then (case when rule = 'BruteForce'
      then concat('Rule: BruteForce (', cast(total_fwd_packets as bigint), ' SYN to port ', dst_port, ', no response)')
      else concat('Rule: ', rule, ' SYN flood (', cast(total_fwd_packets as bigint), ' fwd pkts, 0 bwd, 0 payload)') end)
    when 'downgraded' then printf('Downgraded from %s (confidence %.1f%% < threshold 80%%)', label, confidence * 100)
    else error_in end as error"""


def scored_flows(spark, sf_dir):
    """Live mixed flows with a stand-in prediction (class and confidence derived from the flow)."""
    f = mixed_flows(spark, sf_dir, "live")
    cid = ((F.col("packet_count") + F.col("src_port")) % 9).cast("int")
    label = F.element_at(F.array(*[F.lit(c) for c in fv.CLASSES]), cid + 1)
    conf = F.col("start_us") % 1000 / 1000
    f = f.withColumns({"class_id": cid, "label": label, "confidence": conf}).withColumn("is_attack", F.col("label") != "BENIGN")
    rest = (F.lit(1.0) - F.col("confidence")) / 8
    probs = F.map_from_arrays(F.array(*[F.lit(c) for c in fv.CLASSES]), F.array(*[
        F.when(F.col("label") == c, F.col("confidence")).otherwise(rest) for c in fv.CLASSES]))
    return f.withColumns({"class_probabilities": probs, "error": F.lit(""), "status": F.when(F.col("is_attack"), "ATTACK").otherwise("BENIGN")})


@query(f"with {_MIXED_LIVE}, {_FILTER} select {_fid}, bypass_reason from filtered")
def traffic_filter(spark, sf_dir):
    return ru.traffic_filter(mixed_flows(spark, sf_dir, "live")).select(*FID, "bypass_reason")


@query(f"""with {vs.EVENTS}, ips as (select event_id, case when k % 10 = 9 then '' else
    concat(cast((user_id * 7 + k) % 256 as varchar), '.', cast(case when k % 4 = 0 then 254 else k end as varchar), '.', k, '.', user_id % 256) end as ip from ev)
  select event_id, ip, case when ip = '' then true else {_SPECIAL.format("case when ip = '' then '1.1.1.1' else ip end")} end as special from ips""")
def special_ip(spark, sf_dir):
    k = F.col("k")
    ip = F.when(k % 10 == 9, "").otherwise(F.concat_ws(
        ".", ((F.col("user_id") * 7 + k) % 256).cast("string"), F.when(k % 4 == 0, 254).otherwise(k).cast("string"),
        k.cast("string"), (F.col("user_id") % 256).cast("string")))
    return views._events(spark, sf_dir).select("event_id", ip.alias("ip"), is_special_ip(ip).alias("special"))


@query(f"with {_MIXED_LIVE} select {_fid}, src_port in (67, 68, 137, 138, 161, 162, 1900, 5353, 5355) or dst_port in "
       "(67, 68, 137, 138, 161, 162, 1900, 5353, 5355) as discovery, packet_count <= 1 and protocol <> 6 as single_packet from flows")
def bypass_ports(spark, sf_dir):
    f = mixed_flows(spark, sf_dir, "live")
    return f.select(*FID, (F.col("src_port").isin(*fv.BYPASS_PORTS) | F.col("dst_port").isin(*fv.BYPASS_PORTS)).alias("discovery"),
                    ((F.col("packet_count") <= 1) & (F.col("protocol") != fv.TCP)).alias("single_packet"))


@query(f"""with {_MIXED_LIVE}, {_FILTER} select {_fid}, 'BENIGN' as label, 0 as class_id, 1.0::double as confidence, false as is_attack,
  1.0::double as p_benign, 1.0::double as p_total, 'COMPLETE' as feature_quality, bypass_reason as error from filtered where bypass_reason is not null""")
def benign_result(spark, sf_dir):
    f = ru.traffic_filter(mixed_flows(spark, sf_dir, "live")).filter("bypass_reason is not null")
    f = f.withColumns(ru.benign_result(F.col("bypass_reason")))
    total = F.aggregate(F.map_values("class_probabilities"), F.lit(0.0), lambda a, x: a + x)
    return f.select(*FID, "label", "class_id", "confidence", "is_attack", F.element_at("class_probabilities", F.lit("BENIGN")).alias("p_benign"),
                    total.alias("p_total"), "feature_quality", "error")


@query(f"""with {_MIXED_LIVE}, {_SCORED} select {_fid}, is_attack and confidence >= 0.8 as kept,
  case when is_attack and confidence < 0.8 then 'BENIGN' else label end as label, is_attack and confidence >= 0.8 as is_attack,
  round(case when is_attack and confidence < 0.8 then 1 - confidence else confidence end, 6) + 0.0 as confidence,
  round(case when is_attack and confidence < 0.8 then 1 - confidence when label = 'BENIGN' then confidence else (1 - confidence) / 8 end, 6) + 0.0 as p_benign,
  case when is_attack and confidence < 0.8 then printf('Downgraded from %s (confidence %.1f%% < threshold 80%%)', label, confidence * 100)
    else '' end as error from scored""")
def apply_threshold(spark, sf_dir):
    scored = scored_flows(spark, sf_dir).withColumn("kept", F.col("is_attack") & (F.col("confidence") >= fv.ATTACK_THRESHOLD))
    out = ru.apply_threshold(scored)
    return rounded(out.select(*FID, "kept", "label", "is_attack", "confidence",
                              F.element_at("class_probabilities", F.lit("BENIGN")).alias("p_benign"), "error"), 6)


@query(f"with {vs.SCAN} select flow_no, src_ip, dst_port, end_us from probes")
def port_scan_probes(spark, sf_dir):
    return ru.port_scan_probes(views.scan_flows_v(spark, sf_dir)).select("flow_no", "src_ip", "dst_port", "end_us")


@query(f"""with {vs.SCAN}, p as (select distinct src_ip, dst_port, end_us from probes),
  c as (select a.src_ip, a.dst_port, a.end_us, count(distinct b.dst_port) as distinct_ports from p a join p b
    on b.src_ip = a.src_ip and b.end_us between a.end_us - 1500000 and a.end_us group by all)
  select *, distinct_ports >= 5 as is_candidate from c""")
def port_scan_candidates(spark, sf_dir):
    return ru.port_scan_candidates(ru.port_scan_probes(views.scan_flows_v(spark, sf_dir)))


def _scan_walk(ids: str) -> str:
    """CTEs over ``probes`` (sources, ports, times and *ids*): the alerts of each source one after the other, as ``scan_hits``."""
    return f"""p as (select src_ip, dst_port, end_us, {ids}, row_number() over (partition by src_ip order by end_us, dst_port, {ids}) as rn from probes),
  walk as (
    select src_ip, cast(1 as bigint) as start, cast(null as bigint) as hit, cast(null as bigint) as ports from p where rn = 1
    union all
    select n.src_ip, (select min(q.rn) from p q where q.src_ip = n.src_ip and q.rn > n.hit and q.end_us >= n.at_us + 5000000) as start, n.hit, n.ports
    from (select c.src_ip, min(c.rn) as hit, arg_min(c.end_us, c.rn) as at_us, arg_min(c.ports, c.rn) as ports from (
        select a.src_ip, b.rn, b.end_us, count(distinct e.dst_port) as ports from walk a
        join p b on b.src_ip = a.src_ip and b.rn >= a.start
        join p e on e.src_ip = a.src_ip and e.rn between a.start and b.rn and e.end_us >= b.end_us - 1500000
        where a.start is not null group by a.src_ip, b.rn, b.end_us having count(distinct e.dst_port) >= 5) c group by c.src_ip) n),
  scan_hits as (select p.src_ip, p.dst_port, p.end_us, {", ".join(f"p.{i.strip()}" for i in ids.split(","))}, walk.ports
    from walk join p on p.src_ip = walk.src_ip and p.rn = walk.hit)"""


ALERTS = f"with recursive {vs.SCAN}, {_scan_walk('flow_no')} select * from scan_hits"


@query(ALERTS)
def port_scan_alerts(spark, sf_dir):
    return ru.port_scan_alerts(ru.port_scan_probes(views.scan_flows_v(spark, sf_dir))).select("src_ip", "dst_port", "end_us", "flow_no", "ports")


@query(f"with {_MIXED_LIVE}, z as (select *, false as is_attack, 1.0::double as confidence from flows) "
       f"select {_fid}, {_RULE} as rule from z where {_RULE} is not null")
def flood_and_brute_force_rules(spark, sf_dir):
    rule = F.coalesce(ru.flood_label(), F.when(ru.is_brute_force(), F.lit("BruteForce")))
    return mixed_flows(spark, sf_dir, "live").withColumn("rule", rule).filter("rule is not null").select(*FID, "rule")


@query(f"""with {_MIXED_LIVE}, {_SCORED}, ruled as (select *, {_RULE} as rule, '' as error_in from scored), {_DECIDED}
  select {_fid}, decision, {_OUT} from decided""")
def apply_rules(spark, sf_dir):
    out = ru.apply_rules(scored_flows(spark, sf_dir))
    return rounded(out.select(*FID, "decision", "label", "is_attack", "confidence", "error"))


@query(f"""with {_MIXED_LIVE}, {_SCORED}, ruled as (select *, {_RULE} as rule from scored)
  select {_fid}, rule as label, round(0.9 / 1.05, 4) as p_label, round(0.08 / 1.05, 4) as p_benign, 1.0::double as p_total,
    cast(case rule when 'DDoS' then 3 when 'DoS' then 4 else 2 end as int) as class_id from ruled where rule is not null""")
def rule_override(spark, sf_dir):
    out = ru.apply_rules(scored_flows(spark, sf_dir)).filter("decision = 'rule'")
    total = F.aggregate(F.map_values("class_probabilities"), F.lit(0.0), lambda a, x: a + x)
    p = lambda k: F.element_at("class_probabilities", k)
    return rounded(out.select(*FID, "label", p(F.col("label")).alias("p_label"), p(F.lit("BENIGN")).alias("p_benign"),
                              total.alias("p_total"), "class_id"))


@query(f"""with {_MIXED_LIVE}, {_FILTER}, z as (select *, 'BENIGN' as label, false as is_attack, 1.0::double as confidence,
    coalesce(bypass_reason, '') as error_in from filtered), ruled as (select *, {_RULE} as rule from z), {_DECIDED}
  select {_fid}, bypass_reason, decision, {_OUT} from decided""")
def filter_then_rules(spark, sf_dir):
    """Filter, benign results and one-flow rules without a model."""
    f = ru.traffic_filter(mixed_flows(spark, sf_dir, "live"))
    out = ru.apply_rules(f.withColumns(ru.benign_result(F.col("bypass_reason"))))
    return rounded(out.select(*FID, "bypass_reason", "decision", "label", "is_attack", "confidence", "error"))


# the cascade: rows of ``judged`` that are open feed the port-scan memory, whose alerts come before the other rules
_CASCADE = f"""probes as (select * from judged where not (is_attack and confidence >= 0.8) and protocol = 6 and src_ip <> '' and dst_port > 0
    and dst_port not in (80, 443, 53, 3001, 8000, 5173, 137, 138, 1900, 5353, 5355)
    and total_backward_packets = 0 and total_fwd_packets <= 2 and total_length_of_fwd_packets = 0 and ack_flag_count = 0),
  {_scan_walk(_fid)},
  ruled as (select j.*, h.ports as scan_ports, case when h.ports is not null then 'PortScan' else {_RULE} end as rule
    from judged j left join (select {_fid}, ports from scan_hits) h using ({_fid})), {_DECIDED}"""
_CASCADE_OUT = _OUT.replace("(case when rule = 'BruteForce'", """(case when rule = 'PortScan'
      then concat('Rule: PortScan detected (', scan_ports, ' distinct ports targeted by ', src_ip, ')') when rule = 'BruteForce'""")


@query(f"""with recursive {_MIXED_LIVE}, {_SCORED}, judged as (select *, '' as error_in from scored), {_CASCADE}
  select {_fid}, decision, {_CASCADE_OUT} from decided""")
def detect(spark, sf_dir):
    """Threshold, port-scan memory and rules over scored flows."""
    out = ru.detect(scored_flows(spark, sf_dir))
    return rounded(out.select(*FID, "decision", "label", "is_attack", "confidence", "error"))


RUN_DETECTION = f"""with recursive {_MIXED_LIVE}, {_FILTER}, judged as (select *, 'BENIGN' as label, false as is_attack, 1.0::double as confidence,
    coalesce(bypass_reason, '') as error_in from filtered), {_CASCADE},
  o as (select {_CASCADE_OUT}, src_ip, dst_ip, src_port, dst_port, protocol, end_us from decided)
  select label as attack_type, src_ip, dst_ip, src_port, dst_port, protocol, confidence, cast(is_attack as int) as is_attack,
    concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol) as flow_id, ((end_us + 50) // 100) / 1e4 as timestamp_utc from o"""


@query(RUN_DETECTION)
def run_detection(spark, sf_dir):
    """The whole cascade without a model, down to log rows."""
    out = ru.run_detection(mixed_flows(spark, sf_dir, "live"))
    return rounded(lg.to_attack_log(fl.with_flow_context(out)))


@query(f"""with {vs.PACKETS}, {vs.flows('packets_v', 'live')}, {_FILTER}, z as (select *, 'BENIGN' as label, false as is_attack,
    1.0::double as confidence, coalesce(bypass_reason, '') as error_in from filtered), ruled as (select *, {_RULE} as rule from z), {_DECIDED},
  o as (select {_OUT}, close_reason, packet_count from decided)
  select label, close_reason, count(*) as flows, cast(sum(packet_count) as bigint) as packets from o group by label, close_reason""")
def flagship(spark, sf_dir):
    """Packets -> live flows -> filter -> rules -> counts per label and way of closing."""
    f = ru.traffic_filter(fl.assemble_flows(views.packets_v(spark, sf_dir), "live"))
    out = ru.apply_rules(f.withColumns(ru.benign_result(F.col("bypass_reason"))))
    return out.groupBy("label", "close_reason").agg(F.count("*").alias("flows"), F.sum("packet_count").alias("packets"))
