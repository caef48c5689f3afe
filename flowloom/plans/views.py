"""Packet, labelled-flow and prediction-log views derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by the hash of *key* over all cores, whatever number of row groups the table's files have."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(tasks, key)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream."""
    schema = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _events(spark, sf_dir, stream: bool = False) -> DataFrame:
    events = stream_table(spark, sf_dir, "events") if stream else spread(table(spark, sf_dir, "events"), "event_id")
    return events.select(
        "event_id", "user_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def _ip(prefix: str, n) -> F.Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def packets_v(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events as TCP packets between 100 clients and one server (time 1000 x faster)."""
    d = F.col("k") % 2
    user = F.col("user_id") % 100
    client, server = _ip("10.0.0.", user), F.lit("10.1.0.1")
    port = (50000 + user).cast("int")
    flags = (
        F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 16)
        .when(F.col("event_type") == "click", 24).when(F.col("event_type") == "purchase", 17)
        .otherwise(F.when(F.col("k") < 20, 4).otherwise(16)))
    return _events(spark, sf_dir, stream).select(
        F.col("event_id").alias("seq"), F.floor(F.col("us") / 1000).cast("long").alias("timestamp_us"),
        F.when(d == 0, client).otherwise(server).alias("src_ip"),
        F.when(d == 0, server).otherwise(client).alias("dst_ip"),
        F.when(d == 0, port).otherwise(80).alias("src_port"),
        F.when(d == 0, F.lit(80)).otherwise(port).alias("dst_port"),
        F.lit(6).alias("protocol"), F.lit(20).alias("ip_header_length"),
        F.lit(20).alias("transport_header_length"), F.floor("value").cast("long").alias("payload_length"),
        flags.alias("tcp_flags"), (1000 + F.col("k")).alias("tcp_window"), F.lit(5).alias("tcp_data_offset"))


def mixed_packets_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw packets of several protocols, ports and address kinds, header fields unresolved.

    Tenfold faster than ``packets_v``; ``status`` marks rows that were not IP
    or could not be decoded.
    """
    k, user, d = F.col("k"), F.col("user_id") % 40, F.col("k") % 3
    proto = F.when(k % 10 == 0, 17).when(k % 25 == 1, 1).when(k % 25 == 2, 2).otherwise(6)
    server = (
        F.when(user % 13 == 5, F.lit("224.0.0.251")).when(user % 13 == 6, F.lit("255.255.255.255"))
        .when(user % 13 == 7, F.lit("169.254.3.4")).otherwise(_ip("10.1.0.", user % 4)))
    sport = (40000 + user).cast("int")
    dport = (
        F.when(user % 7 == 0, 22).when(user % 7 == 1, 5353).when(user % 7 == 2, 161)
        .otherwise((1000 + F.col("event_id") % 9).cast("int")))
    client = _ip("10.0.0.", user)
    back = (d == 2) & (user % 3 != 0)
    flags = (
        F.when(user % 9 == 0, F.when((user == 0) & (k == 50), 10).otherwise(2))
        .when(F.col("event_type") == "error", F.when(k % 2 == 0, 4).otherwise(17))
        .when((user % 3 == 0) & (k % 4 != 3), 2).when(F.col("event_type") == "click", 24)
        .when(F.col("event_type") == "view", 48).otherwise(2))
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.floor(F.col("us") / 10000).cast("long").alias("timestamp_us"),
        F.when(back, server).otherwise(client).alias("src_ip"),
        F.when(back, client).otherwise(server).alias("dst_ip"),
        F.when(back, dport).otherwise(sport).alias("src_port"),
        F.when(back, sport).otherwise(dport).alias("dst_port"),
        proto.cast("int").alias("protocol"),
        (F.when(user % 3 == 0, 40).otherwise(28 + F.floor(F.col("value")))).cast("int").alias("ip_total_length"),
        F.lit(20).alias("ip_header_length"), flags.cast("int").alias("tcp_flags"),
        (1000 + k).alias("tcp_window"), (5 + k % 2).cast("int").alias("tcp_data_offset"),
        F.when(k == 97, "skipped").when(k == 98, "error").otherwise("ok").alias("status"))


def scan_flows_v(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events as one-sided flows of ten sources to many ports (time 10,000 x faster)."""
    k, kind = F.col("k"), F.col("event_type")
    return _events(spark, sf_dir, stream).select(
        _ip("10.0.0.", F.col("user_id") % 10).alias("ip_a"), (F.col("event_id") % 20000 + 20000).cast("int").alias("port_a"),
        F.lit("10.1.0.1").alias("ip_b"), F.when(k < 90, 1000 + k).otherwise(80).alias("port_b"),
        F.when(k % 20 == 0, 17).otherwise(6).alias("protocol"), F.col("event_id").alias("flow_no"),
        _ip("10.0.0.", F.col("user_id") % 10).alias("src_ip"), F.when(k < 90, 1000 + k).otherwise(80).alias("dst_port"),
        F.floor(F.col("us") / 10000).cast("long").alias("end_us"), (1 + k % 3).cast("double").alias("total_fwd_packets"),
        F.when(kind == "signup", 1.0).otherwise(0.0).alias("total_backward_packets"),
        F.when(kind == "purchase", 5.0).otherwise(0.0).alias("total_length_of_fwd_packets"),
        F.lit(0.0).alias("ack_flag_count"))


def labelled_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw labelled flows (all text), with defects, exact copies and conflicts."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    key, whole = F.col("l_orderkey"), lambda c: F.floor(c).cast("long").cast("string")
    # each row itself, an exact copy of some rows, and some rows again with another label; told before there are texts to copy
    numbers = lambda *n: F.array(*[F.lit(i) for i in n])
    copy, other = key % 50 == 0, key % 77 == 0
    variants = F.when(copy & other, numbers(0, 1, 2)).when(copy, numbers(0, 1)).when(other, numbers(0, 2)).otherwise(numbers(0))
    label = (
        F.when(F.col("_v") == 2, "Bot").when(key % 113 == 0, "").when(F.col("l_returnflag") == "A", " BENIGN ")
        .when(F.col("l_returnflag") == "N", "DoS Hulk").otherwise("Web Attack – XSS"))
    return li.withColumn("_v", F.explode(variants)).select(
        F.when(key % 97 == 0, "70000").otherwise((F.col("l_partkey") % 65536).cast("string")).alias("destination_port"),
        F.when(key % 101 == 0, "-5").when(key % 103 == 0, "Infinity").when(key % 107 == 0, "")
        .when(key % 109 == 0, "abc").otherwise(whole(F.col("l_extendedprice") * 10)).alias("flow_duration"),
        whole(F.col("l_quantity")).alias("total_fwd_packets"), whole(F.col("l_quantity")).alias("subflow_fwd_packets"),
        whole(F.col("l_extendedprice") * (1 + F.col("l_linenumber"))).alias("flow_bytes_per_s"),
        F.lit("0").alias("bwd_psh_flags"),
        (F.col("l_linestatus") == "O").cast("int").cast("string").alias("fin_flag_count"),
        label.alias("label_raw"),
        F.when(F.col("l_linestatus") == "O", "Monday-a.csv").otherwise("Friday-b.csv").alias("source_file"),
        (key * 1000 + F.col("l_linenumber") + F.col("_v") * F.lit(1_000_000_000).cast("long")).alias("source_row"))


def attack_log_v(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events as a prediction log."""
    kind = (
        F.when(F.col("event_type") == "click", "DDoS").when(F.col("event_type") == "error", "PortScan")
        .when(F.col("event_type") == "purchase", "BruteForce").otherwise("BENIGN"))
    user = F.col("user_id") % 100
    log = _events(spark, sf_dir, stream).select(
        F.col("event_id").alias("id"), kind.alias("attack_type"), _ip("10.0.0.", user).alias("src_ip"),
        F.lit("10.1.0.1").alias("dst_ip"), (50000 + user).cast("int").alias("src_port"),
        (80 + F.col("k") % 5).cast("int").alias("dst_port"),
        F.when(F.col("k") % 10 == 0, 17).otherwise(6).alias("protocol"), (F.col("value") / 500).alias("confidence"),
        F.when(kind == "BENIGN", 0).otherwise(1).alias("is_attack"),
        F.floor(F.col("us") / 1_000_000).cast("long").alias("timestamp_utc"))
    return log.withColumn("flow_id", F.format_string(
        "%s:%d-%s:%d-%d", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"))


def predictions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as true class, predicted class and confidence."""
    li = table(spark, sf_dir, "lineitem")
    y = (F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 4)
         .otherwise(F.when(F.col("l_orderkey") % 11 == 0, 7).otherwise(8)))
    key = F.col("l_orderkey")
    guess = F.when(key % 7 == 0, (key % 9).cast("int")).otherwise(y)
    return li.select(
        y.alias("y"), guess.cast("int").alias("yhat"),
        ((F.col("l_extendedprice") * 100).cast("long") % 1000 / 1000).alias("confidence"))
