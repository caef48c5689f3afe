"""Cleaning, fitting, transforming, evaluation and model helpers."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators import clean as cl
from flowloom.operators import metrics as mt
from flowloom.operators import models as md
from flowloom.operators import mutual_info as mi
from flowloom.operators import prep as pr
from flowloom.operators.running import running_total, smallest_by_hash, taken_by_hash
from flowloom.plans import views


def test_labels(spark):
    raw = [" BENIGN ", "Bot", "DoS Hulk", "FTP-Patator", "Web Attack � XSS", "Web Attack – Sql Injection", "Web Attack ï¿½ Brute Force", "", None]
    df = spark.createDataFrame([(r,) for r in raw], "Label string")
    assert [r[0] for r in cl.normalize_labels(df).collect()] == ["BENIGN", "Bot", "DoS", "BruteForce", "WebAttack", "WebAttack", "WebAttack", None, None]
    with pytest.raises(Exception, match="unknown label"):
        cl.normalize_labels(spark.createDataFrame([("UnknownAttack",)], "Label string")).collect()


def rows(spark, data, cols):
    schema = ", ".join([*(f"{c} string" for c in cols), "_source_file string, _capture_day string, _source_row long, Label string"])
    return spark.createDataFrame([(*r[:-1], "monday-x.csv", "monday", i, r[-1]) for i, r in enumerate(data)], schema)


def test_duplicates_and_conflicts(spark):
    df = rows(spark, [("1", "5", "BENIGN"), ("1", "5", "BENIGN"), ("2", "6", "BENIGN"), ("2", "6", "DDoS"), ("3", "7", "Bot")], ["a", "b"])
    out, audit = cl.clean(df)
    assert sorted((r.a, r._source_row) for r in out.collect()) == [(1.0, 0), (3.0, 4)]
    a = audit.first()
    assert (a.raw_rows, a.exact_duplicates_removed, a.conflicting_feature_rows_removed, a.output_rows) == (5, 1, 2, 2)
    assert a.output_label_counts == {"BENIGN": 1, "Bot": 1}
    kept = cl.drop_conflicts(cl.drop_exact_duplicates(cl.repair(cl.normalize_labels(df))))
    assert sorted(r._source_row for r in kept.collect()) == [0, 4]


def test_repairs(spark):
    df = rows(spark, [("70000", "-1", "-1", "BENIGN"), ("-3", "Infinity", "1d", "BENIGN"), ("80", "abc", "0x1p3", "BENIGN"), ("", "NaN", "1e3", "BENIGN"), ("9", " 7 ", "-Infinity", "")],
              ["destination_port", "flow_duration", "init_win_bytes_forward"])
    labelled = cl.normalize_labels(df)
    c = cl.repair_counts(labelled).first()
    assert (c.numeric_parse_failures, c.infinite_values_replaced, c.invalid_negative_values_replaced, c.invalid_ports_replaced, c.missing_label_rows_removed) == (3, 1, 1, 2, 1)
    got = [(r.destination_port, r.flow_duration, r.init_win_bytes_forward) for r in cl.repair(labelled).orderBy("_source_row").collect()]
    assert got == [(None, None, -1.0), (None, None, None), (80.0, None, None), (None, None, 1000.0), (9.0, 7.0, None)]


def test_equal_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (None, None, 2.0)], "fwd_header_length double, fwd_header_length_1 double, other double")
    assert cl.drop_equal_columns(df, {"fwd_header_length_1": "fwd_header_length"})[1] == ["fwd_header_length_1"]
    assert cl.drop_equal_columns(df, {"other": "fwd_header_length"})[1] == []


def test_fits(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "a double, b double")
    assert pr.fit_imputer(df, ["a", "b"]) == ([], {"a": 2.0, "b": 5.0})
    assert pr.fit_constants(df.filter("a is not null"), ["a", "b"]) == ["b"]
    data = [(float(i), 80.0 + i) for i in range(29)] + [(1e8, 200.0)]
    d = spark.createDataFrame(data, "flow_duration double, destination_port double")
    assert pr.fit_log_columns(d, d.columns) == ["flow_duration"]
    assert list(pr.fit_clip(pr.apply_log1p(d, ["flow_duration"]), d.columns)) == ["flow_duration"]
    s = pd.Series([x for x, _ in data])
    assert pr.log_column_stats(d, ["flow_duration"])["flow_duration"]["skew"] == pytest.approx(s.skew())


def test_quantiles_by_brackets(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": np.round(rng.exponential(size=3000), 2), "y": rng.integers(0, 3, 3000).astype(float)})
    pdf.loc[::7, "x"] = np.nan
    pdf.loc[:999, "y"] = 1.0  # one value holds a third of the rows
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    for bounds in ((10_000, 10_000), (10_000, 5), (20, 5)):
        got = pr.exact_quantiles(df, ["x", "y"], probs, *bounds)
        for c in ("x", "y"):
            assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist()), (bounds, c)
    assert pr.exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_running_total(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(np.arange(500) < 300, "hot", rng.choice(list("abc"), 500)), "t": np.arange(500), "v": rng.integers(0, 9, 500)})
    got = running_total(spark.createDataFrame(pdf), ["k"], ["t"], {"s": F.col("v")}, chunks=7).toPandas().sort_values("t")
    assert got["s"].tolist() == pdf.groupby("k")["v"].cumsum().tolist()


def test_split_counts(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "A").when(F.col("id") < 990, "B").otherwise("C").alias("Label"))
    s = pr.stratified_split(df, ["id"])
    assert {(r.Label, r.part): r["count"] for r in s.groupBy("Label", "part").count().collect()} == {
        ("A", "train"): 720, ("A", "test"): 180, ("B", "train"): 72, ("B", "test"): 18, ("C", "train"): 8, ("C", "test"): 2}
    again = pr.stratified_split(df.repartition(13), ["id"])
    assert s.exceptAll(again.select(*s.columns)).isEmpty()
    with pytest.raises(Exception, match="at least two rows"):
        pr.stratified_split(df.filter("id < 900 or id = 999"), ["id"]).collect()


def psi(x):
    y = np.asarray(x, float) + 10
    inv = 1 / (y * y)
    return np.log(y) - .5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240))) - sum(1 / (np.asarray(x, float) + i) for i in range(10))


def brute_mi(x, d, k=3):
    n = len(x)
    r, kk, nc = np.zeros(n), np.zeros(n), np.zeros(n)
    for label in np.unique(d):
        i = np.where(d == label)[0]
        nc[i] = len(i)
        for j in i:
            if len(i) > 1:
                q = min(k, len(i) - 1)
                dist = np.sort(np.abs(x[i] - x[j]))[1:]
                r[j], kk[j] = dist[q - 1], q
                if r[j] == 0:
                    kk[j] = np.sum(x[i] == x[j])
    keep = nc > 1
    x, r, kk, nc = x[keep], r[keep], kk[keep], nc[keep]
    m = np.array([np.sum(np.abs(x - a) < b) if b > 0 else np.sum(x == a) for a, b in zip(x, r)])
    return max(0.0, float(psi(len(x)) + psi(kk).mean() - psi(nc).mean() - psi(m).mean()))


def test_mutual_information_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 500
    d = rng.choice(list("abcd"), n, p=[.6, .25, .1, .05])
    d[0] = "alone"
    pdf = pd.DataFrame({"l": d, "f1": rng.normal(size=n) + (d == "a"), "f2": rng.integers(0, 8, n) + (d == "b") * 3.0, "f3": np.round(rng.exponential(size=n) * 64) / 64,
                        "f4": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) + (d == "c") * 4)})
    got = {r.feature: r.score for r in mi.mutual_information(spark.createDataFrame(pdf), ["f1", "f2", "f3", "f4"], "l").collect()}
    for c in got:
        assert got[c] == pytest.approx(brute_mi(pdf[c].to_numpy(float), d), abs=1e-9), c
    assert got["f2"] > 0.05


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    n = 400
    label = rng.choice(["BENIGN", "DoS", "Bot"], n, p=[.5, .3, .2])
    pdf = pd.DataFrame({"destination_port": rng.integers(1, 60000, n).astype(float), "flow_duration": rng.exponential(1e5, n) + (label == "DoS") * 5e5,
                        "total_fwd_packets": rng.integers(1, 40, n) + (label == "Bot") * 50.0, "bwd_psh_flags": np.zeros(n), "Label": label})
    df = spark.createDataFrame(pdf)
    return df, pr.fit_preprocessor(df, [c for c in pdf.columns if c != "Label"]), pdf


def test_transform_and_params(spark, fitted, new_dir):
    df, p, pdf = fitted
    assert p.constants == ["bwd_psh_flags"] and p.selected == ["destination_port", "flow_duration", "total_fwd_packets"]
    out = pr.transform(df, p).orderBy("flow_duration").toPandas()
    assert set(out["feature_quality"]) == {"COMPLETE"}
    x = np.log1p(np.sort(pdf["flow_duration"])) if "flow_duration" in p.logged else np.sort(pdf["flow_duration"])
    lo, hi = p.clip["flow_duration"]
    mid, width = p.scale["flow_duration"]
    assert np.allclose([v[1] for v in out["vector"]], (np.clip(x, lo, hi) - mid) / width, atol=1e-4)
    pr.save_params(spark, p, new_dir + "/p")
    assert pr.load_params(spark, new_dir + "/p") == p
    bad = json.loads(spark.read.text(new_dir + "/p").first()[0])
    for change in ({"version": 2}, {"fitted_on": "all"}, {"selected": ["bwd_psh_flags"]}):
        spark.createDataFrame([(json.dumps({**bad, **change}),)], "value string").write.mode("overwrite").text(new_dir + "/q")
        with pytest.raises(ValueError):
            pr.load_params(spark, new_dir + "/q")


def test_quality(spark, fitted):
    _, p, _ = fitted
    raw = spark.createDataFrame([(None, None, None), ("70000", "5", "x"), ("80", "-5", "3"), ("80", "5", "3")], "destination_port string, flow_duration string, total_fwd_packets string")
    r = pr.transform(raw, p).collect()
    assert [x.feature_quality for x in r] == ["DEGRADED", "DEGRADED", "DEGRADED", "COMPLETE"]
    assert all(x.success and len(x.vector) == 3 for x in r)
    assert r[1].rejected_fields == ["destination_port", "total_fwd_packets"] and r[2].missing_fields == ["flow_duration", "bwd_psh_flags"]
    assert r[0].imputed_fields == p.inputs


def test_live_flow_lacks_four_columns():
    gone = {fv.snake(n) for n in ("Fwd PSH Flags", "Fwd URG Flags", "RST Flag Count", "Active Std")}
    assert len(set(fv.LABELLED_COLUMNS) - set(fv.FEATURE_COLUMNS)) == 35 and gone <= set(fv.LABELLED_COLUMNS) - set(fv.FEATURE_COLUMNS)


def test_allocation():
    assert md.allocate({"a": 900, "b": 90, "c": 10}, 200) == {"a": 100, "b": 90, "c": 10}
    assert sum(md.allocate({"a": 5000, "b": 3001, "c": 50}, 777).values()) == 777
    with pytest.raises(ValueError):
        md.allocate({"a": 5}, 6)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_duplicates_tell_nulls_apart(spark, monkeypatch, broadcast_rows):
    """A NULL counts by its column, 0 equals -0, and the first row by file and number stays."""
    monkeypatch.setattr(cl, "_BROADCAST_ROWS", broadcast_rows)
    schema = "a double, b double, _source_file string, _capture_day string, _source_row long, Label string"
    df = spark.createDataFrame([
        (None, 5.0, "m-1", "m", 3, "BENIGN"), (5.0, None, "m-1", "m", 4, "BENIGN"), (None, 5.0, "f-2", "f", 9, "BENIGN"), (None, 5.0, "f-2", "f", 8, "BENIGN"),
        (0.0, 1.0, "m-1", "m", 5, "Bot"), (-0.0, 1.0, "m-1", "m", 6, "BENIGN"), (None, None, None, None, None, "Bot"), (None, None, "m-1", "m", 1, "Bot")], schema)
    rows = lambda d: {(r.a, r.b, r._source_file, r._source_row, r.Label) for r in d.collect()}
    once = cl.drop_exact_duplicates(df)
    assert rows(once) == {(None, 5.0, "f-2", 8, "BENIGN"), (5.0, None, "m-1", 4, "BENIGN"), (0.0, 1.0, "m-1", 5, "Bot"), (0.0, 1.0, "m-1", 6, "BENIGN"), (None, None, None, None, "Bot")}
    agreed = {r for r in rows(once) if r[0] != 0.0}
    assert rows(cl.drop_conflicts(once)) == agreed and rows(cl.clean_rows(cl.row_groups(df))) == agreed
    assert cl.group_counts(cl.row_groups(df)).first().asDict() == {"exact_duplicates_removed": 3, "conflicting_feature_rows_removed": 2, "output_rows": 3}
    assert cl.row_groups(df.limit(0)).count() == 0 and cl.drop_exact_duplicates(df.limit(0)).count() == 0
    assert "SortAggregate" not in cl.row_groups(df)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no row number"):
        cl.drop_exact_duplicates(df.withColumn("_source_row", F.lit(-5).cast("long"))).collect()


def test_models_learn(spark, fitted):
    df, p, _ = fitted
    data = pr.transform(pr.apply_label_index(df, p.classes), p, keep=["y", "destination_port", "flow_duration", "total_fwd_packets"]).select(
        "y", "vector", "destination_port", "flow_duration", "total_fwd_packets").cache()
    md.check_training_inputs(data, data, 3)
    with pytest.raises(ValueError):
        md.check_training_inputs(data.filter("y < 2"), data, 3)
    train = data.select("y", "vector")
    for fit in (lambda d, k: md.fit_random_forest(d, k, trees=10, depth=5), lambda d, k: md.fit_boosted_trees(d, k, rounds=3, depth=3),
                lambda d, k: md.fit_mlp(d, k, hidden=(8,), iterations=60), lambda d, k: md.fit_linear_svm(d, k, iterations=10)):
        pred = md.predict(train, fit(train, 3))
        row = mt.classification_metrics(pred).first()
        sums = pred.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
        assert row.accuracy > 0.7 and sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    model = md.fit_random_forest(train, 3, trees=5, depth=4)
    out = md.score(data, model, p, p.classes)
    assert out.count() == data.count() and out.filter("status = 'REJECTED'").isEmpty()
    report, judged = md.unseen_class_eval(train, train, lambda d, k: md.fit_random_forest(d, k, trees=5, depth=4), known=[0, 1], unseen=[2])
    assert report.first().test_attack_rows == train.filter("y = 2").count() and {r.yhat for r in judged.select("yhat").distinct().collect()} <= {0, 1}


def test_split_hashes_a_row_once_and_shuffles_no_row(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)] + [(300, None), (301, None)], "id long, Label string")
    out = pr.stratified_split(df, ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # the hash is read, not derived for each of the passes
    assert plan.count("rightHint=(strategy=broadcast)") == 2  # edge and cut-off; no row is dealt by its hash
    want = {}
    for r in df.withColumn("h", pr.row_hash(["id"])).collect():
        want.setdefault(r.Label, []).append((r.h, r.id))
    train = {i for label, found in want.items() if label for _, i in sorted(found)[:int(len(found) * fv.TRAIN_SHARE + 0.5)]}
    assert {r.id for r in out.filter("part = 'train'").collect()} == train
    assert out.count() == 302


def test_taken_by_hash_is_what_is_marked(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(200)] + [(7, 1, 7.0), (500, None, 0.0)], "id long, y int, x double")
    quota = spark.createDataFrame([(0, 5), (1, 1), (2, 66)], "y int, quota long")
    h = pr.row_hash(["id"])
    for digits in (1, 4):
        marked = smallest_by_hash(df, "y", h, quota, digits).filter("_picked").drop("_picked")
        taken = taken_by_hash(df, "y", h, quota, digits)
        assert taken.columns == marked.columns
        assert sorted(taken.collect()) == sorted(marked.collect())


def test_quantiles_and_log_stats_share_passes(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 5003), float(i % 7)) for i in range(4000)], "a double, b double")
    passes, one_row = [], pr._one_row
    monkeypatch.setattr(pr, "_one_row", lambda d, exprs: passes.extend([len(exprs)] if exprs else []) or one_row(d, exprs))
    got = pr.exact_quantiles(df, ["a", "b"], [0.01, 0.5, 0.99], accuracy=100, few=1000)
    assert len(passes) == 3  # counts with the first sketches, ranks, values
    pdf = df.toPandas()
    for c in ("a", "b"):
        assert got[c] == pytest.approx(np.quantile(pdf[c], [0.01, 0.5, 0.99]).tolist())
    assert pr.exact_quantiles(df.where("a < 0"), ["a"], [0.5]) == {"a": [None]}
    stats = pr.log_column_stats(df, ["a", "b"])
    assert (stats["a"]["continuous"], stats["b"]["continuous"], stats["b"]["low"]) == (True, False, 0.0)


def test_labels_with_other_dashes_are_in_the_table():
    table = cl._spellings(fv.LABEL_CLASSES)
    assert table["Web Attack – XSS"] == table["Web Attack � XSS"] == table["Web Attack ï¿½ XSS"] == "WebAttack"
    assert fv.LABEL_CLASSES.items() <= table.items()
    assert "FTP–Patator" not in cl._spellings({"A - B": "x", "A-B": "y"}) and cl._spellings({"A - B": "x"}) == {"A - B": "x"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repair_builds_no_texts_to_judge_a_number(spark):
    texts = ["1", " 2.5 ", "1d", "1F", "1D", "2f", "0x1p3", "0X1P3", "NaN", "-NaN", "nan", "null", "", " ", "inf", "Infinity", "-Inf", "1e3", "+7", "abc", "-0", None]
    df = rows(spark, [(t, "BENIGN") for t in texts], ["flow_iat_mean"])
    got = [r[0] for r in cl.coerce_numeric(df, ["flow_iat_mean"]).orderBy("_source_row").select("flow_iat_mean").collect()]
    inf = float("inf")
    assert got == [1.0, 2.5, *[None] * 12, inf, inf, -inf, 1000.0, 7.0, None, 0.0, None]
    c = cl.repair_counts(cl.normalize_labels(df)).first()
    assert (c.numeric_parse_failures, c.infinite_values_replaced) == (7, 3)
    plan = _plan(cl.repair(cl.normalize_labels(df)))
    assert "lower(" not in plan and "INSET" not in plan
    assert plan.count("regexp_replace") <= len(fv.LABEL_CLEANUP)


def test_origins_are_found_by_one_number(spark):
    data = [("1", "BENIGN"), ("2", "Bot"), ("3", "BENIGN")]
    df = cl.repair(cl.normalize_labels(rows(spark, data, ["a"]))).withColumn("_source_file", F.when(F.col("a") < 3, F.col("_source_file")))
    placed, origins = cl._with_place(df, ("_source_file", "_source_row"))
    assert placed.count() == 3 and origins.count() == 3
    assert "isnull(_source_file" not in _plan(placed) and "<=>" not in _plan(placed)
    kept = cl.clean_rows(cl.row_groups(df)).orderBy("a").select("_source_file", "_source_row", "Label").collect()
    assert [tuple(r) for r in kept] == [("monday-x.csv", 0, "BENIGN"), ("monday-x.csv", 1, "Bot"), (None, 2, "BENIGN")]


def test_narrowed_brackets_read_few_rows(spark, monkeypatch):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).cast("double").alias("y"))
    want = [np.quantile(v[~np.isnan(v)], [0.01, 0.5, 0.99]) for v in (df.toPandas()[c].to_numpy() for c in ("x", "y"))]
    seen, plain = [], pr._one_row
    monkeypatch.setattr(pr, "_one_row", lambda d, exprs: (seen.append((len(exprs), d.count())), plain(d, exprs))[1])
    got = pr.exact_quantiles(df, ["x", "y"], [0.01, 0.5, 0.99], accuracy=100, few=50)
    assert np.allclose(got["x"], want[0]) and np.allclose(got["y"], want[1])
    assert seen[0][1] == seen[1][1] == 20_000 and all(n in (20_000,) or n < 3_000 for _, n in seen) and seen[-1][1] < 3_000


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_parsed_in_one_projection(spark):
    df = spark.range(4).selectExpr("cast(id as string) as flow_duration", "cast(-id as string) as total_fwd_packets", "'BENIGN' as Label")
    # numbers and repairs: no projection between them carries the trimmed texts
    assert _plan(cl.repair(df)).count("Project [") <= 3  # the first one makes the texts
    rows = spark.createDataFrame([(" 12 ", "1.5"), ("0x1", "1d"), ("abc", "+Infinity"), ("", "-0"), (None, "1e3"), ("NaN", " 7")], "a string, b string")
    got = [tuple(r) for r in cl.coerce_numeric(rows, ["a", "b"]).collect()]
    assert got == [(12.0, 1.5), (None, None), (None, float("inf")), (None, -0.0), (None, 1000.0), (None, 7.0)]


def test_groups_of_many_columns_tell_nulls_apart(spark):
    n = 70
    rows = [tuple(None if j == i else 1.0 for j in range(n)) + ("BENIGN", "a.csv", "a", i) for i in range(n)]
    schema = ", ".join(f"c{j} double" for j in range(n)) + ", Label string, _source_file string, _capture_day string, _source_row long"
    df = spark.createDataFrame(rows + rows[:5], schema)
    groups = cl.row_groups(df).select("copies").collect()
    assert sorted(r[0] for r in groups) == [1] * 65 + [2] * 5


def test_split_is_a_comparison_without_a_join(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') as Label").union(spark.createDataFrame([(3000, None)], "id long, Label string"))
    out = pr.stratified_split(df.filter("Label is not null"), ["id"], settled=True)
    assert "Join" not in _plan(out)
    h = F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string")))
    want = df.filter("Label is not null").withColumn("h", h).selectExpr(
        "id", "row_number() over (partition by Label order by h) <= floor(count(*) over (partition by Label) * 0.8 + 0.5) as train")
    got = {r["id"]: r["part"] == "train" for r in out.collect()}
    assert got == {r["id"]: r["train"] for r in want.collect()}
    quota = spark.createDataFrame([("a", 10), ("b", 0)], "Label string, quota long")
    picked = smallest_by_hash(df, "Label", h, quota).filter("_picked").groupBy("Label").count().collect()
    assert [tuple(r) for r in picked] == [("a", 10)]


def test_quantiles_bring_only_wanted_values_to_the_driver(spark, monkeypatch):
    seen, one_row = [], pr._one_row
    monkeypatch.setattr(pr, "_one_row", lambda df, exprs: seen.append(one_row(df, exprs)) or seen[-1])
    df = spark.range(2000).selectExpr("cast(id as double) as a", "if(id < 1500, double('NaN'), id) as b", "cast(null as double) as c")
    got = pr.exact_quantiles(df, ["a", "b", "c"], [0.1, 0.5], accuracy=20, few=300)
    assert got["a"] == [199.9, 999.5] and got["b"][0] == 1699.9 and got["b"][1] != got["b"][1] and got["c"] == [None, None]
    assert all(not isinstance(v, list) or len(v) <= 12 for found in seen for v in found.values())


def test_neighbour_points_and_intervals_are_told_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(mi, "cut", lambda df, real=mi.cut: calls.append(df.columns) or real(df))
    df = spark.range(300).selectExpr("cast(id % 7 as double) as x", "cast(id as double) as y", "if(id < 150, 'a', 'b') as Label")
    scores = {r["feature"]: r["score"] for r in mi.mutual_information(df, ["x", "y"], "Label", method="knn").collect()}
    assert calls[0] == ["feature", "label", "value", "n"] and "copies_only" in calls[1] and len(calls) == 2 and scores["y"] > 0.6 and scores["x"] < 0.05


def test_labelled_view_repeats_rows_before_they_are_texts(spark, new_dir):
    rows = [(k, 10 + k, 1, 5.0, 100.25 * k, "N" if k % 2 else "A", "O") for k in (1, 50, 77, 3850, 113, 101)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(
        f"{new_dir}/lineitem.parquet")
    out = views.labelled_v(spark, new_dir)
    generate = next(line for line in _plan(out).splitlines() if "Generate" in line)
    assert "destination_port" not in generate and "source_row" not in generate
    got = sorted((r["source_row"], r["label_raw"]) for r in out.collect())
    big = 1_000_000_000
    assert got == sorted([(1001, "DoS Hulk"), (50001, " BENIGN "), (50001 + big, " BENIGN "), (77001, "DoS Hulk"), (77001 + 2 * big, "Bot"),
                          (3850001, " BENIGN "), (3850001 + big, " BENIGN "), (3850001 + 2 * big, "Bot"), (113001, ""), (101001, "DoS Hulk")])
