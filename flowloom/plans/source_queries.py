"""Sources and sinks as round trips: a view is written to the shared folder, read back by the operator and compared with the view's SQL."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators import clean as cl
from flowloom.operators import models as md
from flowloom.operators import packets as pk
from flowloom.operators import prep as pr
from flowloom.operators.session import shared_dir
from flowloom.plans import table_queries as tq
from flowloom.plans import view_sql as vs
from flowloom.plans import views
from flowloom.plans.registry import ORACLES, query
from flowloom.plans.stream_queries import _finish
from flowloom.sources import captures, compaction, files, sinks
from flowloom.streaming import flows as sf


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _holds(check) -> bool:
    """Whether *check* passes, where a failed one raises ValueError."""
    try:
        check()
    except ValueError:
        return False
    return True


def _csv_folder(spark, sf_dir) -> str:
    """The labelled view as CSV files with a header."""
    path = new_path(spark, "csv")
    rows = views.labelled_v(spark, sf_dir).select(*tq.RAW, F.col("label_raw").alias(fv.TARGET))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_TEXT = ", ".join(f"coalesce({c}, '') as {c}" for c in tq.RAW)


@query(f"with {vs.LABELLED} select {_TEXT}, label_raw as label, count(*) as rows from labelled_v group by all")
def labelled_csv(spark, sf_dir):
    """All files of a folder in one frame of text columns."""
    df = files.read_labelled_csv(spark, _csv_folder(spark, sf_dir))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.groupBy(*[text(c).alias(c) for c in tq.RAW], text(fv.TARGET).alias("label")).agg(F.count("*").alias("rows"))


@query(f"with {vs.LABELLED} select cast(count(*) as bigint) as rows, true as numbered from labelled_v")
def source_rows(spark, sf_dir):
    """Every row has a place of its own in its file, counted from 0 without gaps."""
    df = files.read_labelled_csv(spark, _csv_folder(spark, sf_dir))
    places = df.groupBy("_source_file").agg(
        F.count("*").alias("rows"), F.count_distinct("_source_row").alias("places"), F.max("_source_row").alias("last"), F.min("_source_row").alias("first"))
    return places.agg(F.sum("rows").alias("rows"), F.bool_and((F.col("rows") == F.col("places")) & (F.col("last") == F.col("rows") - 1) & (F.col("first") == 0)).alias("numbered"))


@query(f"""with {vs.LABELLED}, n as (select count(*) as rows from labelled_v)
  select expected, valid, rows from n, (values ('right', true), ('columns', false), ('files', false), ('target', false)) as t(expected, valid)""")
def validate_inputs(spark, sf_dir):
    """The checks of a folder of labelled files: the right expectation passes, each wrong one is refused."""
    path = _csv_folder(spark, sf_dir)
    headers, n = files.csv_headers(spark, path), len(tq.RAW) + 1
    wanted = {"right": dict(expected_cols=n), "columns": dict(expected_cols=n + 1), "files": dict(expected_files=10**9), "target": dict(target="class")}
    found = [(name, _holds(lambda o=options: files.validate_labelled(headers, **o))) for name, options in wanted.items()]
    rows = files.read_labelled_csv(spark, path, ordinals=False).agg(F.count("*").alias("rows"))
    return spark.createDataFrame(found, "expected string, valid boolean").join(rows)


@query("""select cast(strlen(t) as bigint) as bytes, sha256(t) as sha256
  from (select string_agg(s_name, chr(10) order by s_suppkey) || chr(10) as t from supplier group by s_nationkey) z""")
def file_checksums(spark, sf_dir):
    """Size and checksum of the files that hold each nation's suppliers."""
    path = new_path(spark, "files")
    named = views.table(spark, sf_dir, "supplier").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    named.select("s_nationkey", F.col("s_name").alias("value")).write.partitionBy("s_nationkey").text(path)
    return files.file_checksums(spark, path, "*.txt").select("bytes", "sha256")


@query(ORACLES["cleaned_rows"])
def cleaned_round_trip(spark, sf_dir):
    path = new_path(spark, "cleaned")
    sinks.write_cleaned(tq._clean(spark, sf_dir), path)
    return files.read_cleaned(spark, path).select(*fv.PROVENANCE, *tq.FEATURES, F.col(fv.TARGET).alias("label"))


@query(ORACLES["stratified_split"])
def split_round_trip(spark, sf_dir):
    path = new_path(spark, "split")
    sinks.write_split(tq.split(spark, sf_dir), path)
    return spark.read.parquet(path).select("_source_file", "_source_row", *tq.FEATURES, F.col(fv.TARGET).alias("label"), "part")


@query(ORACLES["cleaning_audit"])
def audit_round_trip(spark, sf_dir):
    path = new_path(spark, "audit")
    audit = cl.clean(tq.raw_rows(spark, sf_dir))[1]
    sinks.write_audit(audit, path)
    return tq.audit_text(spark.read.schema(audit.schema).json(path))


_LOG_COLUMNS = [c.name for c in sinks.ATTACK_LOG.fields[1:11]]
_LOGGED = ("select {query} as query, attack_type, is_attack, cast(make_timestamp(timestamp_utc * 1000000) as date) as day, count(*) as rows, count(*) as ids "
           "from attack_log_v {where} group by all")


def _log_rows(spark, sf_dir):
    typed = {f.name: f.dataType for f in sinks.ATTACK_LOG.fields}
    return views.attack_log_v(spark, sf_dir).select(*[F.col(c).cast(typed[c]).alias(c) for c in _LOG_COLUMNS])


def _log_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("query_id").alias("query"), "attack_type", "is_attack", "day").agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query(f"with {vs.ATTACK_LOG} " + _LOGGED.format(query="'a'", where="") + " union all " + _LOGGED.format(query="'b'", where="where is_attack = 1"))
def log_append(spark, sf_dir):
    """Two queries append, one of them repeats its batch: nothing is lost and nothing is there twice."""
    path, rows = new_path(spark, "log"), _log_rows(spark, sf_dir)
    sinks.append_predictions(rows, path, 0, "a")
    sinks.append_predictions(rows.filter("is_attack = 1"), path, 0, "b")
    sinks.append_predictions(rows, path, 0, "a")
    return _log_counts(sinks.read_log(spark, path))


@query(f"with {vs.ATTACK_LOG} " + _LOGGED.format(query="'a'", where="") + " union all " + _LOGGED.format(query="'b'", where="where is_attack = 1"))
def log_compacted(spark, sf_dir):
    """A log whose closed days were rewritten, got a late batch, were rewritten again and cleared of the old folders; one batch is repeated."""
    path, rows = new_path(spark, "log"), _log_rows(spark, sf_dir)
    last = sinks.log_rows(rows, 0, "a").agg(F.max("day")).first()[0]
    sinks.append_predictions(rows, path, 0, "a")
    sinks.compact_log(spark, path, last)
    sinks.append_predictions(rows.filter("is_attack = 1"), path, 0, "b")
    sinks.compact_log(spark, path, last)
    compaction.vacuum(spark, path)
    sinks.append_predictions(rows, path, 0, "a")
    return _log_counts(sinks.read_log(spark, path))


@query(f"with {vs.ATTACK_LOG} " + _LOGGED.format(query="'c'", where="where is_attack = 0"))
def log_reset(spark, sf_dir):
    """A log that was emptied holds what was appended afterwards."""
    path, rows = new_path(spark, "log"), _log_rows(spark, sf_dir)
    sinks.append_predictions(rows, path, 0, "a")
    sinks.reset_log(spark, path)
    sinks.append_predictions(rows.filter("is_attack = 0"), path, 1, "c")
    return _log_counts(sinks.read_log(spark, path))


@query(f"with {vs.ATTACK_LOG} select id, attack_type, flow_id, round(confidence, 6) + 0.0 as confidence from attack_log_v")
def predictions_jsonl(spark, sf_dir):
    path = new_path(spark, "jsonl")
    sinks.write_predictions_jsonl(views.attack_log_v(spark, sf_dir).withColumn("class_probabilities", F.lit(None)), path)
    return spark.read.schema("id long, attack_type string, flow_id string, confidence double").json(path)


@query(f"with {vs.PACKETS} select seq, timestamp_us, src_ip, dst_port, tcp_flags, payload_length from packets_v")
def packet_stream(spark, sf_dir):
    """Packets from a folder of arriving files, each exactly once."""
    path = new_path(spark, "packets")
    rows = views.packets_v(spark, sf_dir)
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in pk.PACKETS.fields]).write.parquet(path)
    return _finish(spark, sf.stream_packets(spark, path, files_per_batch=2).select("seq", "timestamp_us", "src_ip", "dst_port", "tcp_flags", "payload_length"))


@query(f"""with {tq._SPLIT}, n as (select count(*) filter (part = 'train') as train_rows, count(*) as all_rows from split)
  select given, fine, rows from (select 'train' as given, true as fine, train_rows as rows from n union all select 'everything', false, all_rows from n) z""")
def leakage_check(spark, sf_dir):
    """Parameters fitted on the train part pass the check after saving and loading; those of a fit that saw test rows do not."""
    parts = tq.split(spark, sf_dir)
    out = []
    for name, seen in (("train", parts.filter("part = 'train'")), ("everything", parts)):
        path = new_path(spark, "params")
        pr.save_params(spark, dataclasses.replace(pr.Params(inputs=list(tq.FEATURES)), **pr.fit_summary(seen, tq.FEATURES)), path)
        p = pr.load_params(spark, path)
        out.append((name, _holds(lambda p=p: pr.check_no_leakage(p, parts.filter("part = 'train'"))), p.fit_rows))
    return spark.createDataFrame(out, "given string, fine boolean, rows long")


@query(f"""with {tq._SPLIT}, n as (select count(*) filter (part = 'train') as train_rows, count(*) filter (part = 'test') as test_rows, 
    count(distinct "Label") filter (part = 'train') as k, count(distinct "Label") filter (part = 'test') as held from split)
  select classes, classes = k and classes = held as fine, train_rows, test_rows from n, (values (4), (5)) as t(classes)""")
def training_inputs(spark, sf_dir):
    """The check before training passes where both parts hold all classes and fails where one is missing."""
    parts = tq.split(spark, sf_dir)
    parts = pr.apply_label_index(parts, pr.fit_label_index(parts))
    rows = parts.select("part", "y", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in tq.FEATURES]).alias("vector"))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    found = [(k, _holds(lambda k=k: md.check_training_inputs(train, test, k))) for k in (4, 5)]
    sizes = rows.agg(F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"))
    return spark.createDataFrame(found, "classes int, fine boolean").join(sizes)


@query(f"""with {vs.PACKETS} select form, timestamp_us, src_ip, dst_ip, src_port, dst_port, protocol, cast(40 + payload_length as int) as ip_total_length, ip_header_length,
    transport_header_length, payload_length, tcp_flags, tcp_window, tcp_data_offset, 'ok' as status
  from packets_v, (values ('pcap'), ('pcapng')) as f(form)""")
def capture_round_trip(spark, sf_dir):
    """Packets written as capture files of both forms and read back in many byte ranges."""
    out = None
    for form in ("pcap", "pcapng"):
        path = new_path(spark, form)
        captures.write_captures(views.packets_v(spark, sf_dir), path, form)
        read = captures.read_captures(spark, f"{path}/*.{form}", range_bytes=65536).drop("file", "seq").withColumn("form", F.lit(form))
        out = read if out is None else out.unionByName(read)
    return out
