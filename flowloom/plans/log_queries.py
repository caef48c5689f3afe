"""Queries over the prediction log, time series, alerts and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions import scalar as sc
from flowloom.operators import flows as fl
from flowloom.operators import log as lg
from flowloom.operators import rules as ru
from flowloom.operators import series as se
from flowloom.plans import view_sql as vs
from flowloom.plans import views
from flowloom.plans.flow_queries import mixed_flows
from flowloom.plans.registry import query, rounded
from flowloom.plans.rule_queries import _DECIDED, _FILTER, _MIXED_LIVE, _OUT, _RULE

_L = vs.ATTACK_LOG
_COLS = "id, attack_type, src_ip, dst_ip, src_port, dst_port, protocol, round(confidence, 4) as confidence, is_attack, flow_id, timestamp_utc"
_LEVEL = "case when {0} >= 6 then 'CRITICAL' when {0} >= 1 then 'ELEVATED' else 'SAFE' end"


def _log(spark, sf_dir):
    return views.attack_log_v(spark, sf_dir)


@query(f"""with {_MIXED_LIVE}, {_FILTER}, z as (select *, 'BENIGN' as label, false as is_attack, 1.0::double as confidence,
    coalesce(bypass_reason, '') as error_in from filtered), ruled as (select *, {_RULE} as rule from z), {_DECIDED},
  o as (select {_OUT}, src_ip, dst_ip, src_port, dst_port, protocol, end_us from decided)
  select label as attack_type, src_ip, dst_ip, src_port, dst_port, protocol, confidence, cast(is_attack as int) as is_attack,
    concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port, '-', protocol) as flow_id, end_us / 1e6 as timestamp_utc from o""")
def to_attack_log(spark, sf_dir):
    f = ru.traffic_filter(mixed_flows(spark, sf_dir, "live"))
    out = ru.apply_rules(f.withColumns(ru.benign_result(F.col("bypass_reason"))))
    return lg.to_attack_log(fl.with_flow_context(out).withColumn("timestamp_utc", F.col("end_us") / 1e6))


@query(f"with {_L} select {_COLS} from attack_log_v where is_attack = 1 order by timestamp_utc desc, id desc limit 50 offset 100")
def attack_history(spark, sf_dir):
    return rounded(lg.attack_history(_log(spark, sf_dir), 50, 100, only_attacks=True))


@query(f"with {_L} select {_COLS} from attack_log_v where attack_type = 'DDoS' order by timestamp_utc desc, id desc limit 10000")
def attack_history_by_type(spark, sf_dir):
    return rounded(lg.attack_history(_log(spark, sf_dir), 10_000, 0, "DDoS"))


@query(f"with {_L} select count(*) as total, cast(ceil(count(*) / 50) as bigint) as pages from attack_log_v where is_attack = 1")
def attack_history_total(spark, sf_dir):
    return lg.attack_history_total(_log(spark, sf_dir), 50, only_attacks=True)


@query(f"with {_L} select count(*) as total, cast(ceil(count(*) / 20) as bigint) as pages from attack_log_v where attack_type = 'PortScan'")
def attack_history_pages_by_type(spark, sf_dir):
    return lg.attack_history_total(_log(spark, sf_dir), 20, "PortScan")


@query(f"with {_L} select count(*) as total, count(*) filter (is_attack = 0) as normal, count(*) filter (is_attack = 1) as attacks from attack_log_v")
def log_stats(spark, sf_dir):
    return lg.log_stats(_log(spark, sf_dir))


@query(f"with {_L} select attack_type, count(*) as count from attack_log_v where is_attack = 1 group by attack_type")
def attack_distribution(spark, sf_dir):
    return lg.attack_distribution(_log(spark, sf_dir))


@query(f"""with {_L}, c as (select attack_type, count(*) as count from attack_log_v where is_attack = 1 group by attack_type)
  select attack_type, count, round(count / sum(count) over () * 100, 2) as percentage from c""")
def attack_summary(spark, sf_dir):
    return lg.attack_summary(_log(spark, sf_dir))


@query(f"""with {_L}, c as (select attack_type, count(*) as count from attack_log_v where is_attack = 1 group by attack_type)
  select attack_type, count, printf('%.1f%%', round(count / sum(count) over () * 100, 1)) as share from c""")
def attack_share(spark, sf_dir):
    return lg.attack_share(_log(spark, sf_dir))


@query(f"with {_L} select src_ip, count(*) as count from attack_log_v where is_attack = 1 group by src_ip order by count desc, src_ip limit 10")
def top_attackers(spark, sf_dir):
    return lg.top_attackers(_log(spark, sf_dir), 10)


@query(f"""with {_L}, t as (select src_ip, count(*) as count from attack_log_v where is_attack = 1 group by src_ip order by count desc, src_ip limit 10)
  select src_ip, count, row_number() over (order by count desc, src_ip) as rank from t""")
def report_top_attackers(spark, sf_dir):
    return lg.report_top_attackers(_log(spark, sf_dir))


@query(f"with {_L} select {_COLS} from attack_log_v order by timestamp_utc desc, id desc limit 10")
def recent(spark, sf_dir):
    return rounded(lg.recent(_log(spark, sf_dir), 10))


@query(f"with {_L} select {_COLS} from attack_log_v where is_attack = 1 order by timestamp_utc desc, id desc limit 100")
def recent_attacks(spark, sf_dir):
    return rounded(lg.recent_attacks(_log(spark, sf_dir), 100))


@query(f"with {_L} select id, timestamp_utc, attack_type, is_attack, flow_id from attack_log_v order by timestamp_utc desc, id desc limit 50")
def feed(spark, sf_dir):
    return lg.feed(_log(spark, sf_dir))


@query(f"""with {_L}, a as (select max(timestamp_utc) as now from attack_log_v),
  c as (select count(*) as n from attack_log_v, a where is_attack = 1 and timestamp_utc >= now - 60)
  select n as attacks_60s, {_LEVEL.format('n')} as threat_level from c""")
def threat_level(spark, sf_dir):
    return lg.threat_level(_log(spark, sf_dir))


def _dense_log(spark, sf_dir):
    """The log with time 100 x faster, so that 60 s hold several attacks."""
    return _log(spark, sf_dir).withColumn("timestamp_utc", F.floor(F.col("timestamp_utc") / 100).cast("long"))


_DENSE = _L + ", dense as (select * replace (cast(floor(timestamp_utc / 100) as bigint) as timestamp_utc) from attack_log_v)"


@query(f"""with {_DENSE}, t as (select timestamp_utc, count(*) as attacks from dense where is_attack = 1 group by timestamp_utc),
  w as (select *, cast(sum(attacks) over (order by timestamp_utc range between 60 preceding and current row) as bigint) as attacks_60s from t)
  select *, {_LEVEL.format('attacks_60s')} as threat_level from w""")
def threat_level_series(spark, sf_dir):
    return lg.threat_level_series(_dense_log(spark, sf_dir))


@query(f"""with {_DENSE}, t as (select src_ip, timestamp_utc, count(*) as attacks from dense where is_attack = 1 group by src_ip, timestamp_utc),
  w as (select *, cast(sum(attacks) over (partition by src_ip order by timestamp_utc range between 60 preceding and current row) as bigint) as attacks_60s from t)
  select *, {_LEVEL.format('attacks_60s')} as threat_level from w""")
def threat_level_series_by_source(spark, sf_dir):
    return lg.threat_level_series(_dense_log(spark, sf_dir), ("src_ip",), slot_s=600)


@query(f"""with {_DENSE}, a as (select max(timestamp_utc) as now from dense),
  c as (select count(*) as total_packets, count(*) filter (is_attack = 1) as attack_count, count(*) filter (is_attack = 0) as normal_count,
      count(*) filter (is_attack = 1 and timestamp_utc >= now - 60) as n from dense, a),
  t as (select src_ip as top_attacker, count(*) as top_attacker_count from dense where is_attack = 1 group by src_ip order by 2 desc, 1 limit 1),
  k as (select count(distinct attack_type) as attack_types from dense where is_attack = 1)
  select total_packets, attack_count, normal_count, {_LEVEL.format('n')} as threat_level, top_attacker, top_attacker_count, attack_types from c, t, k""")
def dashboard_status(spark, sf_dir):
    return lg.dashboard_status(_dense_log(spark, sf_dir))


@query(f"""with {_L}, a as (select max(timestamp_utc) as now from attack_log_v),
  c as (select count(*) as total_packets, count(*) filter (is_attack = 0) as normal_count, count(*) filter (is_attack = 1) as attack_count,
      count(*) filter (is_attack = 1 and timestamp_utc >= now - 60) as n from attack_log_v, a)
  select total_packets, normal_count, attack_count, round(attack_count / total_packets * 100, 2) as attack_percentage,
    {_LEVEL.format('n')} as threat_level from c""")
def report_summary(spark, sf_dir):
    return lg.report_summary(_log(spark, sf_dir))


_ADVICE = ", ".join(f"({i}, '{t}', '{a}')" for i, (t, a) in enumerate(fv.LEVEL_ADVICE)) 
_TYPES = ", ".join(f"({100 + i}, '{t}', '{a}')" for i, (t, a) in enumerate(fv.TYPE_ADVICE))


@query(f"""with {_DENSE}, a as (select max(timestamp_utc) as now from dense),
  lv as (select {_LEVEL.format('count(*)')} as threat_level from dense, a where is_attack = 1 and timestamp_utc >= now - 60),
  la as (select * from (values {_ADVICE}) as t(pos, threat_level, advice)), ta as (select * from (values {_TYPES}) as t(pos, attack_type, advice)),
  f as (select pos, advice from la where threat_level in (select threat_level from lv)
    union all select pos, advice from ta where attack_type in (select attack_type from dense where is_attack = 1)),
  x as (select * from f union all select 1000, '{fv.CALM_ADVICE}' where not exists (select 1 from f) union all select 1001, '{fv.CLOSING_ADVICE}')
  select row_number() over (order by pos) as line, advice from x""")
def report_recommendations(spark, sf_dir):
    return lg.report_recommendations(_dense_log(spark, sf_dir))


@query("""with z as (select event_id, user_id % 50 as agent, ts, case when event_type = 'signup' then 'disconnect' else event_type end as status from events),
  r as (select *, row_number() over (partition by agent order by ts desc, event_id desc) as rn from z)
  select agent, case when status = 'disconnect' then 'OFFLINE' else status end as status, epoch_us(ts) as last_seen from r where rn = 1""")
def latest_agent_status(spark, sf_dir):
    e = views._events(spark, sf_dir).select(
        (F.col("user_id") % 50).alias("agent"), F.col("us").alias("ts"), "event_id",
        F.when(F.col("event_type") == "signup", "disconnect").otherwise(F.col("event_type")).alias("status"))
    return lg.latest_agent_status(e, order=("ts", "event_id"))


@query(f"""with {_DENSE}, a as (select max(timestamp_utc) as now from dense),
  c as (select count(*) as total_packets, count(*) filter (is_attack = 1) as attack_count, count(*) filter (is_attack = 0) as normal_count,
      count(*) filter (is_attack = 1 and timestamp_utc >= now - 60) as n from dense, a),
  d as (select attack_type, count(*) as count from dense where is_attack = 1 group by attack_type),
  s as (select string_agg(printf('  - %s: %d (%.1f%%)', attack_type, count, pct), chr(10) order by count desc, attack_type) as attack_summary
    from (select *, round(count / sum(count) over () * 100, 2) as pct from d) z),
  r as (select string_agg(printf('  - %s from %s', attack_type, src_ip), chr(10) order by timestamp_utc desc, id desc) as recent_attacks
    from (select * from dense order by timestamp_utc desc, id desc limit 5) z),
  t as (select string_agg(printf('  - %s (%d attacks)', src_ip, count), chr(10) order by count desc, src_ip) as top_attackers
    from (select src_ip, count(*) as count from dense where is_attack = 1 group by src_ip order by count desc, src_ip limit 5) z)
  select total_packets, attack_count, normal_count, {_LEVEL.format('n')} as threat_level, attack_summary, recent_attacks, top_attackers from c, s, r, t""")
def security_context(spark, sf_dir):
    return lg.security_context(_dense_log(spark, sf_dir))


@query(f"""with {_L} select id, lower(attack_type) as sort_key, row_number() over (order by lower(attack_type), id) as position from
  (select * from attack_log_v where is_attack = 1 order by timestamp_utc desc, id desc limit 200) z""")
def sort_history(spark, sf_dir):
    page = lg.attack_history(_log(spark, sf_dir), 200, only_attacks=True)
    from pyspark.sql import Window as W
    ordered = lg.sort_history(page, "attack_type", "asc")
    position = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.lower("attack_type"), "id"))  # one page
    return ordered.select("id", F.lower("attack_type").alias("sort_key"), position.cast("long").alias("position"))


@query(f"""with {_L} select id, case when id % 3 = 0 then attack_type when id % 3 = 1 then attack_type else 'BENIGN' end as attack_type,
  case when id % 2 = 0 then src_ip else dst_ip end as src_ip, case when id % 5 = 0 then 0 else src_port end as src_port from attack_log_v""")
def normalize_alerts(spark, sf_dir):
    i = F.col("id")
    mixed = _log(spark, sf_dir).select(
        "id", F.when(i % 3 == 0, F.col("attack_type")).alias("attack_type"), F.when(i % 3 == 1, F.col("attack_type")).alias("label"),
        F.when(i % 2 == 0, F.col("src_ip")).otherwise("").alias("src_ip"), F.lit(None).cast("string").alias("dst_ip"),
        F.struct(F.col("dst_ip").alias("src_ip"), "dst_ip", F.when(i % 5 != 0, F.col("src_port")).alias("src_port"),
                 "dst_port", "protocol").alias("context"))
    return lg.normalize_alerts(mixed).select("id", "attack_type", "src_ip", "src_port")


# --- series -----------------------------------------------------------------------------

@query(f"""with {_DENSE}, a as (select max(timestamp_utc) as now from dense), s as (select unnest(generate_series(now - 59, now)) as time from a)
  select time, count(*) filter (is_attack = 0) as normal, count(*) filter (is_attack = 1) as attack
  from s left join dense on timestamp_utc = time group by time""")
def traffic_series(spark, sf_dir):
    return se.traffic_series(_dense_log(spark, sf_dir))


@query(f"""with {_L} select cast(floor(timestamp_utc / 60) * 60 as bigint) as minute_utc, count(*) as total,
  count(*) filter (is_attack = 0) as normal, count(*) filter (is_attack = 1) as attack from attack_log_v group by 1""")
def traffic_stats(spark, sf_dir):
    return se.traffic_stats(_log(spark, sf_dir))


@query(f"""with {_L}, t as (select timestamp_utc, count(*) as c, count(*) filter (is_attack = 0) as n, count(*) filter (is_attack = 1) as a from attack_log_v group by 1)
  select timestamp_utc, cast(sum(c) over (order by timestamp_utc) as bigint) as total, cast(sum(n) over (order by timestamp_utc) as bigint) as normal,
    cast(sum(a) over (order by timestamp_utc) as bigint) as attack from t""")
def running_counts(spark, sf_dir):
    return se.running_counts(_log(spark, sf_dir))


@query(f"""with {_DENSE}, r as (select *, row_number() over (partition by timestamp_utc, flow_id order by id) as rn from dense where is_attack = 1)
  select id, timestamp_utc, flow_id, attack_type from r where rn = 1""")
def dedup_alerts(spark, sf_dir):
    return se.dedup_alerts(_dense_log(spark, sf_dir)).select("id", "timestamp_utc", "flow_id", "attack_type")


_THROTTLE = f"""with recursive {_DENSE}, tt as (select timestamp_utc as t, min(id) as id from dense where is_attack = 1 group by 1),
  sent as (select min(t) as t from tt union all
    select (select min(t) from tt where tt.t >= sent.t + 300) as t from sent where sent.t is not null)
  select tt.id, tt.t as timestamp_utc from tt join sent on tt.t = sent.t"""


@query(_THROTTLE)
def throttle_alerts(spark, sf_dir):
    return se.throttle_alerts(_dense_log(spark, sf_dir), fv.MAIL_COOLDOWN_S).select("id", "timestamp_utc")


@query(f"""with recursive {_DENSE}, tt as (select attack_type as k, timestamp_utc as t, min(id) as id from dense where is_attack = 1 group by 1, 2),
  sent as (select k, min(t) as t from tt group by k union all
    select k, (select min(t) from tt where tt.k = sent.k and tt.t >= sent.t + 30) as t from sent where sent.t is not null)
  select tt.id, tt.t as timestamp_utc, tt.k as attack_type from tt join sent on tt.t = sent.t and tt.k = sent.k""")
def throttle_alerts_by_type(spark, sf_dir):
    return se.throttle_alerts(_dense_log(spark, sf_dir), fv.CHAT_COOLDOWN_S, "attack_type").select("id", "timestamp_utc", "attack_type")


@query(f"""with recursive {_L}, tt as (select cast(floor(timestamp_utc / 2000) as bigint) as t, min(id) as id from attack_log_v where is_attack = 1 group by 1),
  sent as (select min(t) as t from tt union all
    select (select min(t) from tt where tt.t >= sent.t + 5) as t from sent where sent.t is not null)
  select tt.id, tt.t as timestamp_utc from tt join sent on tt.t = sent.t""")
def throttle_alerts_every_second(spark, sf_dir):
    """A log with alerts in nearly every second, so that no pause parts the alerts that are sent."""
    log = views.attack_log_v(spark, sf_dir).withColumn("timestamp_utc", F.floor(F.col("timestamp_utc") / 2000).cast("long"))
    return se.throttle_alerts(log, 5).select("id", "timestamp_utc")


@query(f"""with {_L}, m as (select *, strftime(to_timestamp(timestamp_utc) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as sent_at,
    printf('%.2f%%', confidence * 100) as share from attack_log_v where is_attack = 1)
  select id, concat('<b>⚠️ Attack Detected</b>', chr(10), '<b>Type:</b> ', attack_type, chr(10), '<b>Confidence:</b> ', share, chr(10), '<b>Source:</b> ', src_ip,
    ':', src_port, chr(10), '<b>Destination:</b> ', dst_ip, ':', dst_port, chr(10), '<b>Time (UTC):</b> ', sent_at) as chat_text,
    concat('[Alert] ', attack_type, ' Attack Detected') as mail_subject,
    concat('Attack Type: ', attack_type, '; Confidence: ', share, '; Source IP: ', src_ip, ':', src_port, '; Destination IP: ', dst_ip, ':', dst_port,
      '; Time (UTC): ', sent_at, ' UTC') as mail_details,
    concat('Warning! ', attack_type, ' detected from IP ', src_ip) as spoken_text from m""")
def alert_messages(spark, sf_dir):
    return se.alert_messages(_log(spark, sf_dir))


# --- text functions ------------------------------------------------------------------------

@query(f"""with {_L} select id, case protocol when 6 then 'TCP' when 17 then 'UDP' when 1 then 'ICMP' else concat('Proto-', protocol) end as proto,
  concat(src_ip, ':', src_port) as source, printf('%.2f%%', confidence * 100) as confidence_text,
  concat(strftime(to_timestamp(timestamp_utc) at time zone 'UTC', '%H:%M:%S'), ' UTC') as time_text,
  concat(strftime(to_timestamp(timestamp_utc) at time zone 'UTC', '%d/%m/%Y, %H:%M:%S'), ' UTC') as datetime_text from attack_log_v""")
def display_columns(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "id", sc.protocol_name("protocol").alias("proto"), sc.format_endpoint("src_ip", "src_port").alias("source"),
        sc.format_confidence("confidence").alias("confidence_text"), sc.format_time("timestamp_utc").alias("time_text"),
        sc.format_datetime("timestamp_utc").alias("datetime_text"))


@query(f"""with {vs.EVENTS}, z as (select event_id, k, us % 5000000 * (case when k % 3 = 0 then 1 when k % 3 = 1 then 0 else 0.0001 end) as d0, us from ev),
  y as (select event_id, k, cast(floor(d0) as bigint) as d, us from z)
  select event_id, case when d <= 0 then '0 μs' when d < 1000 then concat(d, ' μs')
      when d < 1000000 then concat((d + 50) // 100 // 10, '.', (d + 50) // 100 % 10, ' ms')
      else concat((d + 5000) // 10000 // 100, '.', lpad(cast((d + 5000) // 10000 % 100 as varchar), 2, '0'), ' s') end as duration_text,
    format('{{:,}}', us) as count_text,
    case when k % 7 = 0 then '—' when k * 997 >= 3600 then concat(k * 997 // 3600, 'h ', k * 997 % 3600 // 60, 'm ', k * 997 % 60, 's')
      when k * 997 >= 60 then concat(k * 997 // 60, 'm ', k * 997 % 60, 's') else concat(k * 997, 's') end as uptime_text from y""")
def display_numbers(spark, sf_dir):
    k = F.col("k")
    d = F.floor(F.col("us") % 5_000_000 * F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.0).otherwise(0.0001))
    return views._events(spark, sf_dir).select(
        "event_id", sc.format_duration(d).alias("duration_text"), sc.format_count("us").alias("count_text"),
        sc.uptime_text(F.when(k % 7 == 0, 0).otherwise(k * 997)).alias("uptime_text"))


@query("""select doc_id, case when length(text) > 24 then concat(substring(text, 1, 23), '…') else text end as short from documents""")
def truncate_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", sc.truncate_text("text", 24).alias("short"))


@query(f"""with {vs.EVENTS} select event_id, case when k % 5 = 0 then 0.0 else round(value / (k % 5), 4) end as ratio from ev""")
def safe_ratio(spark, sf_dir):
    return rounded(views._events(spark, sf_dir).select("event_id", sc.safe_ratio("value", F.col("k") % 5).alias("ratio")))


@query(f"""with {vs.EVENTS}, z as (select event_id, case k % 8 when 0 then 'abc' when 1 then ' 12.5 ' when 2 then '1e3' when 3 then 'NaN' when 4 then 'Infinity'
    when 5 then '' when 6 then '1d' else cast(event_id as varchar) end as t from ev)
  select event_id, case when regexp_full_match(trim(t), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then cast(trim(t) as double) end as number from z""")
def finite_number(spark, sf_dir):
    k = F.col("k") % 8
    t = (F.when(k == 0, "abc").when(k == 1, " 12.5 ").when(k == 2, "1e3").when(k == 3, "NaN").when(k == 4, "Infinity")
         .when(k == 5, "").when(k == 6, "1d").otherwise(F.col("event_id").cast("string")))
    return views._events(spark, sf_dir).select("event_id", sc.finite_number(t).alias("number"))


@query(f"""with {_L} select concat(strftime(to_timestamp(timestamp_utc) at time zone 'UTC', '%H:%M:%S'), ' UTC') as "Time", attack_type as "Type",
  concat(src_ip, ':', src_port) as "Source", concat(dst_ip, ':', dst_port) as "Destination",
  case protocol when 6 then 'TCP' else 'UDP' end as "Proto", printf('%.2f%%', confidence * 100) as "Confidence" from attack_log_v where is_attack = 1""")
def attack_export_columns(spark, sf_dir):
    from flowloom.sources.sinks import attack_export
    return attack_export(_log(spark, sf_dir).filter("is_attack = 1"))
