"""Queries over labelled flows: cleaning, preparation, training and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.scalar import clean_label
from flowloom.operators import clean as cl
from flowloom.operators import metrics as mt
from flowloom.operators import models as md
from flowloom.operators import mutual_info as mi
from flowloom.operators import prep as pr
from flowloom.operators import rules as ru
from flowloom.operators.session import cut
from flowloom.plans import view_sql as vs
from flowloom.plans import views
from flowloom.plans.registry import query, rounded

RAW = ["destination_port", "flow_duration", "total_fwd_packets", "subflow_fwd_packets", "flow_bytes_per_s", "bwd_psh_flags", "fin_flag_count"]
FEATURES = [c for c in RAW if c != "subflow_fwd_packets"]
_PAIRS = {fv.snake(a): fv.snake(b) for a, b in fv.COPY_COLUMNS.items()}
IDS = ["_source_file", "_source_row", *[f"_k_{c}" for c in FEATURES]]


def raw_rows(spark, sf_dir):
    """Text rows with provenance and raw label."""
    v = cl.with_provenance(views.labelled_v(spark, sf_dir), "source_file", "source_row")
    return v.select(*RAW, *fv.PROVENANCE, F.col("label_raw").alias(fv.TARGET))


def _labelled(spark, sf_dir):
    return cl.normalize_labels(raw_rows(spark, sf_dir))


def _fixed(spark, sf_dir):
    """Repaired rows with a label, equal columns dropped."""
    fixed = cut(cl.repair(_labelled(spark, sf_dir)))  # labels are told before they are asked for, so once a row
    return cl.drop_equal_columns(cl.drop_missing_labels(fixed), _PAIRS)[0]


def _clean(spark, sf_dir):
    return cl.clean_rows(cl.row_groups(_fixed(spark, sf_dir)))


def _with_ids(df):
    return df.withColumns({f"_k_{c}": F.col(c).cast("long") for c in FEATURES})


def split(spark, sf_dir):
    ids = [*IDS[:2], *[F.col(c).cast("long") for c in FEATURES]]
    return _with_ids(pr.stratified_split(_clean(spark, sf_dir), ids, settled=True))


def train_part(spark, sf_dir):
    return split(spark, sf_dir).filter("part = 'train'")


# --- SQL building blocks ------------------------------------------------------------------------

_NUM = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_t = lambda c: f"nullif(trim({c}), '')"
_parse = lambda c: f"case when regexp_full_match({_t(c)}, '{_NUM}') or regexp_full_match(lower({_t(c)}), '[+-]?inf(inity)?') then cast({_t(c)} as double) end"
_MAP = ", ".join(f"('{k}', '{v}')" for k, v in fv.LABEL_CLASSES.items())

_LABELLED = vs.LABELLED + f""",
label_map as (select * from (values {_MAP}) as t(raw, cls)),
lab0 as (select *, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(label_raw),
    '[–—]+', ' - ', 'g'), '\\s*-\\s*', '-', 'g'), '^Web Attack-', 'Web Attack - '), '\\s+', ' ', 'g')), '') as label_text from labelled_v),
lab as (select lab0.*, cls as "Label" from lab0 left join label_map on raw = label_text)"""

_REPAIRED = _LABELLED + f""",
parsed as (select * replace ({", ".join(f"{_parse(c)} as {c}" for c in RAW)}) from lab where "Label" is not null),
repaired as (select source_file as _source_file, lower(split_part(source_file, '-', 1)) as _capture_day, source_row as _source_row, "Label",
    case when destination_port between 0 and 65535 then destination_port end as destination_port,
    {", ".join(f"case when {c} >= 0 and {c} < 'infinity'::double then {c} end as {c}" for c in FEATURES[1:])} from parsed)"""

_F = ", ".join(FEATURES)
_CLEAN = _REPAIRED + f""",
dedup as (select * exclude (rn) from (select *, row_number() over (partition by {_F}, "Label" order by _source_file, _source_row) as rn from repaired) z where rn = 1),
cleaned as (select * exclude (n_labels) from (select *, count(*) over (partition by {_F}) as n_labels from dedup) z where n_labels = 1)"""

_SPLIT = _CLEAN + f""",
hashed as (select *, md5(concat_ws('|', '42', _source_file, cast(_source_row as varchar), {", ".join(f"cast(cast({c} as bigint) as varchar)" for c in FEATURES)})) as h from cleaned),
split as (select *, case when row_number() over (partition by "Label" order by h) <= floor(count(*) over (partition by "Label") * 0.8 + 0.5) then 'train' else 'test' end as part from hashed),
train as (select * from split where part = 'train')"""

_WORK = [c for c in FEATURES if c != "bwd_psh_flags"]  # not constant on the train part
_LOGGABLE = ["flow_duration", "total_fwd_packets", "flow_bytes_per_s"]
_IMPUTED = _SPLIT + f""",
med as (select {", ".join(f"quantile_cont({c}, 0.5) as {c}" for c in FEATURES)} from train),
imputed as (select s.* replace ({", ".join(f"coalesce(s.{c}, med.{c}) as {c}" for c in FEATURES)}) from split s, med)"""
_LOGGED = _IMPUTED + f""",
logstat as (select {", ".join(f"(min({c}) >= 0 and count(distinct {c}) > 20 and abs(skewness({c})) >= 1) as {c}" for c in _LOGGABLE)} from imputed where part = 'train'),
logged as (select i.* replace ({", ".join(f"case when ls.{c} then ln(1 + i.{c}) else i.{c} end as {c}" for c in _LOGGABLE)}) from imputed i, logstat ls)"""
_CLIPPED = _LOGGED + f""",
bounds as (select {", ".join(f"quantile_cont({c}, 0.001) as {c}_lo, quantile_cont({c}, 0.999) as {c}_hi, count(distinct {c}) > 20 as {c}_many" for c in _LOGGABLE)}
  from logged where part = 'train'),
clipped as (select l.* replace ({", ".join(f"case when b.{c}_many then least(greatest(l.{c}, b.{c}_lo), b.{c}_hi) else l.{c} end as {c}" for c in _LOGGABLE)}) from logged l, bounds b)"""
_SCALED = _CLIPPED + f""",
iqr as (select {", ".join(f"quantile_cont({c}, 0.5) as {c}_m, case when quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) then 1 else quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) end as {c}_w" for c in _WORK)}
  from clipped where part = 'train')"""


def _per_feature(cols, expr, source):
    return " union all ".join(f"select '{c}' as feature, {expr.format(c=c)} from {source}" for c in cols)


# --- cleaning ---------------------------------------------------------------------------------------

@query(f"""with {vs.LABELLED}, c as (select source_file as file, trim(label_raw) as label, count(*) as n from labelled_v group by all)
  select file, cast(sum(n) as bigint) as rows, cast(8 as bigint) as columns,
    string_agg(concat(label, '=', n), ';' order by label) filter (label <> '') as labels from c group by file""")
def raw_manifest(spark, sf_dir):
    m = cl.raw_manifest(raw_rows(spark, sf_dir))
    return m.withColumn("labels", F.array_join(F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"))


@query(f"with {vs.LABELLED} select source_row, source_file, lower(split_part(source_file, '-', 1)) as day from labelled_v")
def capture_day(spark, sf_dir):
    return raw_rows(spark, sf_dir).select(
        F.col("_source_row").alias("source_row"), F.col("_source_file").alias("source_file"), F.col("_capture_day").alias("day"))


@query(f'with {_LABELLED} select label_raw, label_text, "Label" as label, count(*) as rows from lab group by all')
def normalize_labels(spark, sf_dir):
    v = views.labelled_v(spark, sf_dir)
    named = v.select("label_raw", clean_label("label_raw").alias("label_text"), cl.class_of("label_raw").alias("label"))
    return named.groupBy("label_raw", "label_text", "label").agg(F.count("*").alias("rows"))


@query(f'with {_LABELLED} select source_row, "Label" as label from lab where "Label" is not null')
def drop_missing_labels(spark, sf_dir):
    return cl.drop_missing_labels(_labelled(spark, sf_dir)).select(F.col("_source_row").alias("source_row"), F.col(fv.TARGET).alias("label"))


_SHOW = "destination_port, case when flow_duration = 'infinity'::double then -999.0 else flow_duration end as flow_duration, flow_bytes_per_s"


@query(f"with {_LABELLED}, p as (select * replace ({', '.join(f'{_parse(c)} as {c}' for c in RAW)}) from lab) select source_row, {_SHOW} from p")
def coerce_numeric(spark, sf_dir):
    df = cl.coerce_numeric(raw_rows(spark, sf_dir), RAW)
    return df.select(F.col("_source_row").alias("source_row"), "destination_port",
                     F.when(F.abs("flow_duration") == float("inf"), -999.0).otherwise(F.col("flow_duration")).alias("flow_duration"), "flow_bytes_per_s")


@query(f"""with {_LABELLED}, p as (select * replace ({', '.join(f'{_parse(c)} as {c}' for c in RAW)}) from lab)
  select source_row, case when flow_duration < 'infinity'::double then flow_duration end as flow_duration from p""")
def null_infinite(spark, sf_dir):
    df = cl.null_infinite(cl.coerce_numeric(raw_rows(spark, sf_dir), RAW), RAW)
    return df.select(F.col("_source_row").alias("source_row"), "flow_duration")


@query(f"""with {_LABELLED}, p as (select * replace ({', '.join(f'{_parse(c)} as {c}' for c in RAW)}) from lab)
  select source_row, case when flow_duration >= 0 and flow_duration < 'infinity'::double then flow_duration end as flow_duration,
    case when fin_flag_count >= 0 then fin_flag_count end as fin_flag_count from p""")
def null_negative(spark, sf_dir):
    df = cl.null_negative(cl.null_infinite(cl.coerce_numeric(raw_rows(spark, sf_dir), RAW), RAW), RAW)
    return df.select(F.col("_source_row").alias("source_row"), "flow_duration", "fin_flag_count")


@query(f"""with {_LABELLED}, p as (select * replace ({', '.join(f'{_parse(c)} as {c}' for c in RAW)}) from lab)
  select source_row, case when destination_port between 0 and 65535 then destination_port end as destination_port from p""")
def null_bad_ports(spark, sf_dir):
    return cl.null_bad_ports(cl.coerce_numeric(raw_rows(spark, sf_dir), RAW)).select(F.col("_source_row").alias("source_row"), "destination_port")


_COUNTS = f"""counts as (select count(*) as raw_rows, count(*) filter ("Label" is null) as missing_label_rows_removed,
    {" + ".join(f'''count(*) filter ("Label" is not null and {_t(c)} is not null and {_parse(c)} is null)''' for c in RAW)} as numeric_parse_failures,
    {" + ".join(f'''count(*) filter ("Label" is not null and abs({_parse(c)}) = 'infinity'::double)''' for c in RAW)} as infinite_values_replaced,
    {" + ".join(f'''count(*) filter ("Label" is not null and {_parse(c)} < 0 and {_parse(c)} > '-infinity'::double)''' for c in RAW[1:])} as invalid_negative_values_replaced,
    count(*) filter ("Label" is not null and {_parse('destination_port')} not between 0 and 65535) as invalid_ports_replaced from lab)"""


@query(f"with {_LABELLED}, {_COUNTS} select * from counts")
def repair_counts(spark, sf_dir):
    return cl.repair_counts(_labelled(spark, sf_dir))


@query(f"with {_REPAIRED} select _source_file, _source_row, {_F}, \"Label\" as label from repaired")
def repair(spark, sf_dir):
    return _fixed(spark, sf_dir).select("_source_file", "_source_row", *FEATURES, F.col(fv.TARGET).alias("label"))


@query(f"""with {_LABELLED}, p as (select * replace ({', '.join(f'{_parse(c)} as {c}' for c in RAW)}) from lab where "Label" is not null)
  select 'subflow_fwd_packets' as copy, 'total_fwd_packets' as original, count(*) filter (subflow_fwd_packets is distinct from total_fwd_packets) as differing_rows from p
  union all select 'fin_flag_count', 'bwd_psh_flags', count(*) filter (fin_flag_count is distinct from bwd_psh_flags) from p""")
def equal_columns(spark, sf_dir):
    fixed = cl.repair(cl.drop_missing_labels(_labelled(spark, sf_dir)))
    return cl.equal_columns(fixed, {**_PAIRS, "fin_flag_count": "bwd_psh_flags"})


_ROW = f'_source_file, _capture_day, _source_row, {_F}, "Label" as label'


@query(f"with {_CLEAN} select {_ROW} from dedup")
def drop_exact_duplicates(spark, sf_dir):
    d = cl.drop_exact_duplicates(_fixed(spark, sf_dir))
    return d.select(*fv.PROVENANCE, *FEATURES, F.col(fv.TARGET).alias("label"))


@query(f'with {_REPAIRED} select {_ROW} from (select *, count(distinct "Label") over (partition by {_F}) as nl from repaired) z where nl = 1')
def drop_conflicts(spark, sf_dir):
    return cl.drop_conflicts(_fixed(spark, sf_dir)).select(*fv.PROVENANCE, *FEATURES, F.col(fv.TARGET).alias("label"))


@query(f"with {_CLEAN} select {_ROW} from cleaned")
def cleaned_rows(spark, sf_dir):
    return _clean(spark, sf_dir).select(*fv.PROVENANCE, *FEATURES, F.col(fv.TARGET).alias("label"))


@query(f"""with {_CLEAN}, z as ({" union all ".join(f"select '{fv.DISPLAY_NAMES[c]}' as feature, count({c}) > 0 and count(*) filter ({c} <> 0) = 0 as zero from cleaned" for c in FEATURES)})
  select feature from z where zero""")
def all_zero_columns(spark, sf_dir):
    return cl.all_zero_columns(_clean(spark, sf_dir))


@query(f'with {_CLEAN} select "Label" as label, count(*) as rows from cleaned group by 1')
def label_counts(spark, sf_dir):
    return cl.label_counts(_clean(spark, sf_dir)).withColumnRenamed(fv.TARGET, "label")


@query(f"""with {_CLEAN}, {_COUNTS}, d as (select (select count(*) from repaired) - (select count(*) from dedup) as exact_duplicates_removed,
    (select count(*) from dedup) - (select count(*) from cleaned) as conflicting_feature_rows_removed, (select count(*) from cleaned) as output_rows),
  l as (select string_agg(concat(lb, '=', n), ';' order by lb) as output_label_counts from (select "Label" as lb, count(*) as n from cleaned group by 1) z)
  select counts.*, d.*, l.*, 'Subflow Fwd Packets' as duplicate_feature_columns_removed, 'Bwd PSH Flags' as all_zero_columns_observed, 3 as version from counts, d, l""")
def cleaning_audit(spark, sf_dir):
    return audit_text(cl.clean(raw_rows(spark, sf_dir))[1])


def audit_text(audit):
    """The audit with its map and lists as text."""
    text = F.transform(F.array_sort(F.map_entries("output_label_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return audit.withColumns({
        "output_label_counts": F.array_join(text, ";"), "all_zero_columns_observed": F.array_join("all_zero_columns_observed", ";"),
        "duplicate_feature_columns_removed": F.array_join("duplicate_feature_columns_removed", ";")})


# --- preparation ---------------------------------------------------------------------------------------

@query(f"""with {_CLEAN} select "Label" as label, string_agg(distinct _capture_day, ',' order by _capture_day) as days from cleaned group by 1""")
def class_day_coverage(spark, sf_dir):
    c = pr.class_day_coverage(_clean(spark, sf_dir))
    return c.select(F.col(fv.TARGET).alias("label"), F.array_join("days", ",").alias("days"))


@query(f'with {_SPLIT} select _source_file, _source_row, {_F}, "Label" as label, part from split')
def stratified_split(spark, sf_dir):
    return split(spark, sf_dir).select("_source_file", "_source_row", *FEATURES, F.col(fv.TARGET).alias("label"), "part")


@query(f"""with {_SPLIT} select part, 'label' as kind, "Label" as value, count(*) as rows from split group by all
  union all select part, 'file', _source_file, count(*) from split group by all""")
def split_audit(spark, sf_dir):
    return pr.split_audit(split(spark, sf_dir))


@query(f'with {_SPLIT}, c as (select "Label" as label, dense_rank() over (order by "Label") - 1 as y from split) select label, cast(y as int) as y, count(*) as rows from c group by all')
def label_index(spark, sf_dir):
    s = split(spark, sf_dir)
    index = pr.fit_label_index(s.filter("part = 'train'"))
    return pr.apply_label_index(s, index).groupBy(F.col(fv.TARGET).alias("label"), "y").agg(F.count("*").alias("rows"))


@query(f"with {_SPLIT} " + _per_feature(FEATURES, "round(quantile_cont({c}, 0.5), 4) as median, count(*) - count({c}) as missing", "train"))
def fit_imputer(spark, sf_dir):
    train = train_part(spark, sf_dir)
    _, medians = pr.fit_imputer(train, FEATURES)
    missing = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in FEATURES])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(medians[c]).alias("median"), F.col(c).alias("missing")) for c in FEATURES]))
    return rounded(missing.select(rows.alias("e")).select("e.*"))


@query(f"with {_IMPUTED} select _source_file, _source_row, part, {', '.join(f'round({c}, 4) as {c}' for c in FEATURES)} from imputed")
def impute(spark, sf_dir):
    s = split(spark, sf_dir)
    _, medians = pr.fit_imputer(s.filter("part = 'train'"), FEATURES)
    return rounded(pr.impute(s, medians).select("_source_file", "_source_row", "part", *FEATURES))


@query(f"with {_IMPUTED}, t as (select * from imputed where part = 'train') " + _per_feature(FEATURES, "count(distinct {c}) <= 1 as constant", "t"))
def fit_constants(spark, sf_dir):
    s = split(spark, sf_dir).filter("part = 'train'")
    df = pr.impute(s, pr.fit_imputer(s, FEATURES)[1])
    found = pr.fit_constants(df, FEATURES)
    return spark.createDataFrame([(c, c in found) for c in FEATURES], "feature string, constant boolean")


def _imputed_train(spark, sf_dir):
    s = train_part(spark, sf_dir)
    return pr.impute(s, pr.fit_imputer(s, FEATURES)[1])


@query(f"with {_IMPUTED}, t as (select * from imputed where part = 'train') " + _per_feature(
    _LOGGABLE, "round(min({c}), 4) as low, round(skewness({c}), 4) as skew, count(distinct {c}) > 20 as continuous, "
               "min({c}) >= 0 and count(distinct {c}) > 20 and abs(skewness({c})) >= 1 as logged", "t"))
def fit_log_columns(spark, sf_dir):
    df = _imputed_train(spark, sf_dir)
    stats = pr.log_column_stats(df, _LOGGABLE)
    logged = pr.fit_log_columns(df, _LOGGABLE)
    rows = [(c, float(s["low"]), float(s["skew"]), s["continuous"], c in logged) for c, s in stats.items()]
    return rounded(spark.createDataFrame(rows, "feature string, low double, skew double, continuous boolean, logged boolean"))


@query(f"with {_IMPUTED} select _source_file, _source_row, part, {', '.join(f'round(ln(1 + {c}), 4) as {c}' for c in _LOGGABLE)} from imputed")
def apply_log1p(spark, sf_dir):
    s = split(spark, sf_dir)
    df = pr.impute(s, pr.fit_imputer(s.filter("part = 'train'"), FEATURES)[1])
    return rounded(pr.apply_log1p(df, _LOGGABLE).select("_source_file", "_source_row", "part", *_LOGGABLE))


def _prepared(spark, sf_dir):
    """(split rows after impute/log/clip, clip bounds)."""
    s = split(spark, sf_dir)
    train = s.filter("part = 'train'")
    medians = pr.fit_imputer(train, FEATURES)[1]
    df = pr.impute(s, medians)
    logged = pr.fit_log_columns(df.filter("part = 'train'"), _WORK)
    df = pr.apply_log1p(df, logged)
    bounds = pr.fit_clip(df.filter("part = 'train'"), _WORK)
    return pr.apply_clip(df, bounds), bounds


@query(f"with {_CLIPPED}, z as (" + " union all ".join(
    f"select '{c}' as feature, round({c}_lo, 4) as lower, round({c}_hi, 4) as upper, {c}_many as many from bounds" for c in _LOGGABLE)
    + ") select feature, lower, upper from z where many")
def fit_clip(spark, sf_dir):
    _, bounds = _prepared(spark, sf_dir)
    return rounded(spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in bounds.items()], "feature string, lower double, upper double"))


@query(f"with {_CLIPPED} select _source_file, _source_row, part, {', '.join(f'round({c}, 4) as {c}' for c in _WORK)} from clipped")
def apply_clip(spark, sf_dir):
    return rounded(_prepared(spark, sf_dir)[0].select("_source_file", "_source_row", "part", *_WORK))


_PAIR_LIST = [(a, b) for j, b in enumerate(_WORK) for a in _WORK[:j]]


@query(f"with {_CLIPPED}, t as (select * from clipped where part = 'train') " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) + 0.0 as r from t" for a, b in _PAIR_LIST))
def correlation_matrix(spark, sf_dir):
    return rounded(pr.correlation_matrix(_prepared(spark, sf_dir)[0].filter("part = 'train'"), _WORK))


@query(f"with {_CLIPPED}, t as (select *, flow_duration * 2 + fin_flag_count as twin from clipped where part = 'train') select 'twin' as feature from t "
       "having abs(corr(flow_duration, twin)) > 0.98")
def fit_correlated(spark, sf_dir):
    t = _prepared(spark, sf_dir)[0].filter("part = 'train'").withColumn("twin", F.col("flow_duration") * 2 + F.col("fin_flag_count"))
    return spark.createDataFrame([(c,) for c in pr.fit_correlated(t, [*_WORK, "twin"])], "feature string")


_BINNED = f"""mi_src as (select * from clipped where part = 'train'),
mi_rng as (select {", ".join(f"min({c}) as {c}_lo, max({c}) as {c}_hi" for c in _WORK)} from mi_src),
mi_long as ({" union all ".join(f'''select '{c}' as feature, "Label" as label, case when {c}_hi <= {c}_lo then 0
    else least(floor(({c} - {c}_lo) / ({c}_hi - {c}_lo) * 32), 31) end as bin from mi_src, mi_rng''' for c in _WORK)}),
mi_joint as (select feature, bin, label, count(*)::double as n from mi_long group by all),
mi_tot as (select *, sum(n) over (partition by feature) as a, sum(n) over (partition by feature, bin) as nx, sum(n) over (partition by feature, label) as ny from mi_joint),
mi as (select feature, greatest(sum(n / a * ln(n * a / (nx * ny))), 0) as score from mi_tot group by feature)"""


@query(f"with {_CLIPPED}, {_BINNED} select feature, round(score, 4) + 0.0 as score from mi")
def mutual_information_binned(spark, sf_dir):
    df = _prepared(spark, sf_dir)[0].filter("part = 'train'")
    return rounded(mi.mutual_information(df, _WORK, fv.TARGET, method="binned"))


@query()
def mutual_information_neighbours(spark, sf_dir):
    df = _prepared(spark, sf_dir)[0].filter("part = 'train'")
    return rounded(mi.mutual_information(df, _WORK, fv.TARGET, method="knn"))


@query(f"""with {_CLIPPED}, {_BINNED}, p as (select * from (values {", ".join(f"('{c}', {i})" for i, c in enumerate(_WORK))}) as t(feature, pos)),
  r as (select feature, pos, row_number() over (order by score desc, pos) as rank from mi join p using (feature)) select * from r where rank <= 3""")
def select_k_best(spark, sf_dir):
    df = _prepared(spark, sf_dir)[0].filter("part = 'train'")
    scores = mi.mutual_information(df, _WORK, fv.TARGET, method="binned")
    pos = spark.createDataFrame([(c, i) for i, c in enumerate(_WORK)], "feature string, pos int")
    return pr.select_k_best(scores.join(pos, "feature"), 3).select("feature", "pos", "rank")


@query(f"with {_SCALED} " + " union all ".join(f"select '{c}' as feature, round({c}_m, 4) as median, round({c}_w, 4) as width from iqr" for c in _WORK))
def fit_robust(spark, sf_dir):
    df = _prepared(spark, sf_dir)[0].filter("part = 'train'")
    rows = [(c, m, float(w)) for c, (m, w) in pr.fit_robust(df, _WORK).items()]
    return rounded(spark.createDataFrame(rows, "feature string, median double, width double"))


@query(f"with {_SCALED} select _source_file, _source_row, part, {', '.join(f'round(({c} - {c}_m) / {c}_w, 4) + 0.0 as {c}' for c in _WORK)} from clipped, iqr")
def apply_robust(spark, sf_dir):
    df = _prepared(spark, sf_dir)[0]
    scales = pr.fit_robust(df.filter("part = 'train'"), _WORK)
    return rounded(pr.assert_finite(pr.apply_robust(df, scales), _WORK).select("_source_file", "_source_row", "part", *_WORK))


@query(f"with {_SCALED} select _source_file, part, count(*) as rows, cast(0 as bigint) as not_finite from clipped group by all")
def finite_check(spark, sf_dir):
    df = _prepared(spark, sf_dir)[0]
    scaled = pr.apply_robust(df, pr.fit_robust(df.filter("part = 'train'"), _WORK))
    return scaled.groupBy("_source_file", "part").agg(F.count("*").alias("rows"), F.count_if(pr.not_finite(_WORK)).alias("not_finite"))


def fitted(spark, sf_dir) -> pr.Params:
    return pr.fit_preprocessor(train_part(spark, sf_dir), FEATURES)


# raw rows scored with the fitted chain: bad text and bad ports are rejected, blanks and negatives are missing
_BAD = lambda c: f"({c} is not null and (not regexp_full_match(trim({c}), '{_NUM}')" + (f" or try_cast(trim({c}) as double) not between 0 and 65535" if c == "destination_port" else "") + "))"
_NEG = {"flow_duration", "total_fwd_packets", "flow_bytes_per_s"}
_GONE = lambda c: f"({c} is null" + (f" or (regexp_full_match(trim({c}), '{_NUM}') and try_cast(trim({c}) as double) < 0)" if c in _NEG else "") + ")"
_SCORE_SRC = ", src as (select source_file, source_row, label_raw, destination_port, nullif(flow_duration, '') as flow_duration, total_fwd_packets, flow_bytes_per_s, bwd_psh_flags, fin_flag_count from labelled_v)"
_names = lambda cond: "array_to_string(list_filter([" + ", ".join(f"case when {cond(c)} then '{c}' end" for c in FEATURES) + "], lambda x: x is not null), ',')"


@query(f"with {vs.LABELLED}{_SCORE_SRC} select source_file, source_row, label_raw, {_names(_GONE)} as missing_fields, {_names(_BAD)} as rejected_fields from src")
def validate_features(spark, sf_dir):
    raw = _score_source(spark, sf_dir)
    p = pr.Params(inputs=FEATURES)
    v = pr.validate_features(raw, p)
    return v.select("source_file", "source_row", "label_raw", F.array_join("missing_fields", ",").alias("missing_fields"),
                    F.array_join("rejected_fields", ",").alias("rejected_fields"))


def _score_source(spark, sf_dir):
    v = views.labelled_v(spark, sf_dir)
    return v.select("source_file", "source_row", "label_raw", *[
        F.nullif(F.col(c), F.lit("")).alias(c) if c == "flow_duration" else F.col(c) for c in FEATURES])


_VAL = lambda c: f"case when {_GONE(c)} or {_BAD(c)} then {c}_med else try_cast(trim({c}) as double) end"
_TRANS = _SCALED + _SCORE_SRC + f""",
med_names as (select {", ".join(f"{c} as {c}_med" for c in _WORK)} from med),
log_names as (select {", ".join(f"{c} as {c}_log" for c in _LOGGABLE)} from logstat),
tv as (select source_file, source_row, label_raw, {_names(_GONE)} as missing_fields, {_names(_BAD)} as rejected_fields,
  {" + ".join(f"cast({_GONE(c)} or {_BAD(c)} as int)" for c in _WORK)} as n_bad, {", ".join(f"{_VAL(c)} as {c}" for c in _WORK)} from src, med_names),
tl as (select tv.* replace ({", ".join(f"case when {c}_log then ln(1 + greatest(tv.{c}, 0)) else tv.{c} end as {c}" for c in _LOGGABLE)}) from tv, log_names),
tc as (select tl.* replace ({", ".join(f"case when b.{c}_many then least(greatest(tl.{c}, b.{c}_lo), b.{c}_hi) else tl.{c} end as {c}" for c in _LOGGABLE)}) from tl, bounds b)"""


@query(f"""with {_TRANS} select source_file, source_row, label_raw, missing_fields, rejected_fields,
  case when n_bad = 0 then 'COMPLETE' when n_bad / 5 >= 0.2 then 'DEGRADED' else 'PARTIAL' end as feature_quality,
  {", ".join(f"round(cast(cast(({c} - {c}_m) / {c}_w as float) as double), 3) + 0.0 as v_{i}" for i, c in enumerate(_WORK))} from tc, iqr""")
def transform(spark, sf_dir):
    p = fitted(spark, sf_dir)
    out = pr.transform(_score_source(spark, sf_dir), p, keep=["source_file", "source_row", "label_raw"])
    return rounded(out.select(
        "source_file", "source_row", "label_raw", F.array_join("missing_fields", ",").alias("missing_fields"),
        F.array_join("rejected_fields", ",").alias("rejected_fields"), "feature_quality",
        *[F.col("vector")[i].cast("double").alias(f"v_{i}") for i in range(len(_WORK))]), 3)


@query(f"""with {_TRANS}, q as (select case when n_bad = 0 then 'COMPLETE' when n_bad / 5 >= 0.2 then 'DEGRADED' else 'PARTIAL' end as feature_quality from tc)
  select feature_quality, count(*) as rows from q group by 1""")
def feature_quality(spark, sf_dir):
    out = pr.transform(_score_source(spark, sf_dir), fitted(spark, sf_dir), keep=[])
    return out.groupBy("feature_quality").agg(F.count("*").alias("rows"))


# --- training and evaluation --------------------------------------------------------------------------------

@query(f"""with {_SPLIT}, n as (select "Label" as lb, count(*) as c, sum(count(*)) over () as t from train group by 1),
  a0 as (select *, cast(t // 8 as bigint) as size, case when c <= 100 then c else least(c, greatest(1, (t // 8) * c // t)) end as take from n),
  gap as (select max(size) - sum(take) as g from a0),
  more as (select lb, row_number() over (order by c * (c - take - j) desc, lb) as place from a0, generate_series(0, 8) as s(j)),
  less as (select lb, row_number() over (order by take - j desc, lb) as place from a0, generate_series(0, 199) as s(j) where c > 100),
  a as (select a0.*, take + (select count(*) from more, gap where more.lb = a0.lb and place <= g)
    - (select count(*) from less, gap where less.lb = a0.lb and place <= -g) as quota from a0),
  r as (select _source_file, _source_row, "Label" as label, row_number() over (partition by "Label" order by h) as rn from train)
  select _source_file, _source_row, label from r join a on lb = label where rn <= quota""")
def class_aware_subset(spark, sf_dir):
    train = train_part(spark, sf_dir)
    size = train.count() // 8
    return md.class_aware_subset(train, size, IDS).select("_source_file", "_source_row", F.col(fv.TARGET).alias("label"))


@query(f"""with {_SPLIT}, n as (select "Label" as label, count(*) as rows from train group by 1)
  select label, rows, round(sum(rows) over () / (count(*) over () * rows), 4) as weight from n""")
def balanced_weight(spark, sf_dir):
    w = md.with_balanced_weight(train_part(spark, sf_dir), fv.TARGET)
    return rounded(w.groupBy(F.col(fv.TARGET).alias("label"), "weight").agg(F.count("*").alias("rows")))


_P = vs.PREDICTIONS


@query(f"""with {_P}, {vs.CLASSES}, g as (select a.class_id as y, b.class_id as yhat from classes a, classes b),
  c as (select y, yhat, count(*) as n from predictions_v group by all), f as (select y, yhat, coalesce(n, 0) as n from g left join c using (y, yhat))
  select y, yhat, n, round(coalesce(n / nullif(sum(n) over (partition by y), 0), 0), 4) as share from f""")
def confusion_matrix(spark, sf_dir):
    return rounded(mt.confusion_matrix(views.predictions_v(spark, sf_dir)))


_PER = f"""{_P}, k as (select y as c from predictions_v union select yhat from predictions_v),
per as (select c, (select count(*) from predictions_v where y = c and yhat = c) as tp, (select count(*) from predictions_v where yhat = c) as np,
  (select count(*) from predictions_v where y = c) as ns from k),
prf0 as (select *, coalesce(tp / nullif(np, 0), 0) as p, coalesce(tp / nullif(ns, 0), 0) as r from per),
prf as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from prf0)"""


@query(f"""with {_PER} select round(sum(tp) / sum(ns), 4) as accuracy, round(avg(r) filter (ns > 0), 4) as balanced_accuracy, round(avg(p), 4) as macro_precision,
  round(avg(r), 4) as macro_recall, round(avg(f), 4) as macro_f1, round(sum(f * ns) / sum(ns), 4) as weighted_f1 from prf""")
def classification_metrics(spark, sf_dir):
    return rounded(mt.classification_metrics(views.predictions_v(spark, sf_dir)))


@query(f"""with {_PER}, {vs.CLASSES}, a as (select label, coalesce(p, 0) as p, coalesce(r, 0) as r, coalesce(f, 0) as f, coalesce(ns, 0) as ns from classes left join prf on c = class_id)
  select label, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1, ns as support from a
  union all select 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), cast(sum(ns) as bigint) from a
  union all select 'weighted avg', round(sum(p * ns) / sum(ns), 4), round(sum(r * ns) / sum(ns), 4), round(sum(f * ns) / sum(ns), 4), cast(sum(ns) as bigint) from a""")
def classification_report(spark, sf_dir):
    return rounded(mt.classification_report(views.predictions_v(spark, sf_dir)))


@query(f"""with {_PER}, m as (select 'derived' as model, sum(tp) / sum(ns) as accuracy, avg(f) as macro_f1 from prf),
  base as (select 0 as c, count(*) filter (y = 0) as tp, count(*) as np, count(*) filter (y = 0) as ns, count(*) as n, count(distinct y) as k from predictions_v),
  b as (select 'always benign' as model, tp / n as accuracy, (2 * (tp / np) / (tp / np + 1)) / k as macro_f1 from base),
  u as (select * from m union all select * from b)
  select model, round(accuracy, 4) as accuracy, round(macro_f1, 4) as macro_f1, macro_f1 = max(macro_f1) over () as is_winner from u""")
def compare_models(spark, sf_dir):
    pred = views.predictions_v(spark, sf_dir)
    table = mt.compare_models({"derived": pred, "always benign": pred.withColumn("yhat", F.lit(0))})
    return rounded(table.select("model", "accuracy", "macro_f1", "is_winner"))


@query(f"""with {_P} select count(*) filter (y <> 0) as test_attack_rows, count(*) filter (y = 0) as test_benign_rows,
  round(avg(cast(yhat <> 0 as int)) filter (y <> 0), 6) as detection_rate, round(avg(cast(yhat <> 0 as int)) filter (y = 0), 6) as false_alarm_rate,
  round(avg(confidence) filter (y <> 0), 6) as mean_confidence_attack, round(avg(confidence) filter (y = 0), 6) as mean_confidence_benign from predictions_v""")
def detection_report(spark, sf_dir):
    return mt.detection_report(views.predictions_v(spark, sf_dir))


@query(f"with {_P}, {vs.CLASSES} select label, count(*) as rows from predictions_v join classes on class_id = yhat where y <> 0 group by label")
def unseen_distribution(spark, sf_dir):
    return mt.unseen_distribution(views.predictions_v(spark, sf_dir))


@query(f"""with {_P}, k as (select case when y = 0 then 'benign' else 'attack' end as kind, confidence as c from predictions_v),
  s as (select kind, min(c) as lo, max(c) as hi from k group by kind), x as (select kind, unnest(generate_series(0, 29)) as bin from s),
  b as (select k.kind, cast(least(floor((c - lo) / (hi - lo) * 30), 29) as bigint) as bin, count(*) as rows from k join s on k.kind = s.kind group by all)
  select x.kind, x.bin, coalesce(rows, 0) as rows from x left join b on x.kind = b.kind and x.bin = b.bin""")
def confidence_histogram(spark, sf_dir):
    return mt.confidence_histogram(views.predictions_v(spark, sf_dir))


@query(f"with {_P}, {vs.CLASSES} select class_id, label, count(yhat) as rows from classes left join predictions_v on class_id = yhat group by class_id, label")
def prediction_counts(spark, sf_dir):
    return mt.prediction_counts(views.predictions_v(spark, sf_dir))


@query(f"with {_REPAIRED} select _source_file, _source_row, 'REJECTED' as status, -1 as class_id, 0.0::double as confidence, 'INVALID' as feature_quality, 0.0::double as p_total from repaired where flow_duration is null")
def rejected_result(spark, sf_dir):
    bad = _fixed(spark, sf_dir).filter("flow_duration is null").withColumns(ru.rejected_result(F.lit("no duration")))
    total = F.aggregate(F.map_values("class_probabilities"), F.lit(0.0), lambda a, x: a + x)
    return bad.select("_source_file", "_source_row", "status", "class_id", "confidence", "feature_quality", total.alias("p_total"))


@query(f"""with {_P} select y, yhat, round(confidence, 6) as confidence, count(*) as rows from predictions_v group by all""")
def predictions_json(spark, sf_dir):
    """JSON text and back: rounding survives and nothing is lost."""
    from flowloom.sources.sinks import predictions_json as to_json

    p = views.predictions_v(spark, sf_dir).withColumn("class_probabilities", ru.probabilities(F.lit("BENIGN")))
    parsed = to_json(p).select(F.from_json("value", "y int, yhat int, confidence double, class_probabilities map<string, double>").alias("e"))
    return parsed.select("e.y", "e.yhat", "e.confidence").groupBy("y", "yhat", "confidence").agg(F.count("*").alias("rows"))


def model_rows(spark, sf_dir):
    """(train, test) vectors with class codes of the fitted chain."""
    s = split(spark, sf_dir)
    p = pr.fit_preprocessor(s.filter("part = 'train'"), FEATURES)
    out = pr.transform(pr.apply_label_index(s, p.classes), p, keep=["y", "part", *FEATURES])
    rows = cut(out.filter("success").select("y", "part", "vector", *FEATURES))
    return rows.filter("part = 'train'"), rows.filter("part = 'test'"), p


#: Rows that ``score`` fits on at most, every class represented; the learners' own queries fit on the whole train part.
FIT_ROWS = 2000


def fit_part(train):
    rows = train.select("y", "vector", *FEATURES)
    if rows.count() > FIT_ROWS:
        rows = md.class_aware_subset(rows, FIT_ROWS, FEATURES, "y")
    return cut(rows.select("y", "vector"))


def _evaluate(spark, sf_dir, fit):
    train, test, p = model_rows(spark, sf_dir)
    model = fit(train.select("y", "vector"), len(p.classes))
    return rounded(mt.classification_metrics(md.predict(test.select("y", "vector"), model)))


@query()
def fit_random_forest(spark, sf_dir):
    return _evaluate(spark, sf_dir, md.fit_random_forest)


@query()
def fit_boosted_trees(spark, sf_dir):
    return _evaluate(spark, sf_dir, md.fit_boosted_trees)


@query()
def fit_mlp(spark, sf_dir):
    return _evaluate(spark, sf_dir, md.fit_mlp)


@query()
def fit_linear_svm(spark, sf_dir):
    return _evaluate(spark, sf_dir, md.fit_linear_svm)


@query()
def score(spark, sf_dir):
    train, test, p = model_rows(spark, sf_dir)
    model = md.fit_small_forest(fit_part(train), len(p.classes))
    out = md.score(test.select("y", *FEATURES), model, p, p.classes)
    return rounded(out.groupBy("y", "label", "status", "feature_quality").agg(
        F.count("*").alias("rows"), F.avg("confidence").alias("mean_confidence")), 6)


@query()
def unseen_class_eval(spark, sf_dir):
    """Every attack class in turn is the one not learnt; a row for each."""
    train, test, p = model_rows(spark, sf_dir)
    rows, out = train.select("y", "vector"), None
    for unseen in range(1, len(p.classes)):
        known = [c for c in range(len(p.classes)) if c != unseen]
        report, _ = md.unseen_class_eval(rows, test.select("y", "vector"), md.fit_random_forest, known, [unseen])
        report = report.withColumn("unseen_class", F.lit(unseen))
        out = report if out is None else out.unionByName(report)
    return out
