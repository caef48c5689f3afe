"""Cleaning of labelled flows, with an audit of every repair."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.scalar import capture_day, plain_number, repaired_label

# fixed values: cell texts that mean "no value"
_MISSING = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that are neither the label nor provenance, in order."""
    return [c for c in df.columns if c not in (fv.TARGET, *fv.PROVENANCE)]


def with_provenance(df: DataFrame, file_col: str, row_col: str | None = None) -> DataFrame:
    """Add source file, capture day and (when given) source row columns."""
    df = df.withColumns({"_source_file": F.col(file_col), "_capture_day": capture_day(file_col)})
    return df.withColumn("_source_row", F.col(row_col).cast("long")) if row_col else df


def raw_manifest(df: DataFrame, label: str = fv.TARGET, file_col: str = "_source_file") -> DataFrame:
    """Per file: rows, columns, and a map of trimmed raw label -> rows."""
    n_columns = len([c for c in df.columns if c not in fv.PROVENANCE])
    counts = df.groupBy(F.col(file_col).alias("file"), F.trim(F.col(label)).alias("label")).count()
    pair = F.when(F.col("label") != "", F.struct("label", "count"))
    return counts.groupBy("file").agg(
        F.sum("count").alias("rows"), F.lit(n_columns).cast("long").alias("columns"),
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("labels"))


def _spellings(mapping: Mapping[str, str]) -> dict[str, str]:
    """The table and its labels with other dashes, where the text repair leads back to the label."""
    def repaired(text):
        for pattern, repl in fv.LABEL_CLEANUP:
            text = re.sub(pattern, repl, text)
        return text.strip(" ")

    others = {label.replace("-", dash): label for label in mapping for dash in ("–", "—", "\ufffd", "ï¿½")}
    return {**{text: mapping[label] for text, label in others.items() if repaired(text) == label}, **mapping}


def class_of(raw, mapping: Mapping[str, str] = fv.LABEL_CLASSES) -> Column:
    """Raw label -> class; blank -> NULL; an unknown label stops the job when it is read.

    Labels that are already in the table, or there but for the kind of dash, skip the text repair.
    """
    trimmed = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    table = F.create_map(*[F.lit(x) for kv in _spellings(mapping).items() for x in kv])
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), trimmed)).cast("string")
    return F.when(trimmed != "", F.coalesce(
        F.try_element_at(table, trimmed), F.try_element_at(table, repaired_label(raw)), unknown))


def normalize_labels(df: DataFrame, raw: str = fv.TARGET, mapping: Mapping[str, str] = fv.LABEL_CLASSES) -> DataFrame:
    out = df.withColumn(fv.TARGET, class_of(raw, mapping))
    return out if raw == fv.TARGET else out.drop(raw)


def drop_missing_labels(df: DataFrame) -> DataFrame:
    return df.filter(F.col(fv.TARGET).isNotNull())


def _parse_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``_t_<c>`` (trimmed text, NULL when it means no value) and ``_p_<c>`` (its number) per column.

    One projection: the parts that expressions share are evaluated once a row, so
    every text is trimmed and parsed once however many conditions look at it, and
    texts that nobody asks for are not copied.  Texts that mean "no value" are no
    plain number anyway, so they are only looked up where ``_t_<c>`` is asked for.
    """
    trimmed = {c: F.trim(F.col(c).cast("string")) for c in cols}
    return df.withColumns({
        **{f"_t_{c}": F.when(~t.isin(*_MISSING), t) for c, t in trimmed.items()},
        **{f"_p_{c}": plain_number(t, t.try_cast("double")) for c, t in trimmed.items()}})


def _repairs(c: str) -> dict[str, Column]:
    """Conditions under which the parsed value of column *c* is given up, first one wins."""
    name = fv.DISPLAY_NAMES.get(c, c)
    value, text = F.col(f"_p_{c}"), F.col(f"_t_{c}")
    infinite = F.coalesce(F.abs(value) == float("inf"), F.lit(False))
    checks = {"parse": text.isNotNull() & value.isNull(), "infinite": infinite}
    negative = F.lit(False)
    if fv.nonnegative_columns([name]):
        negative = ~infinite & F.coalesce(value < 0, F.lit(False))
        checks["negative"] = negative
    if name == "Destination Port":
        checks["port"] = ~infinite & ~negative & F.coalesce(~value.between(0, 65535), F.lit(False))
    return checks


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; unreadable text becomes NULL, infinities stay."""
    parsed = _parse_columns(df, cols).withColumns({c: F.col(f"_p_{c}") for c in cols})
    return parsed.select(*df.columns)


def null_infinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when((F.abs(c) != float("inf")) & ~F.isnan(c), F.col(c)) for c in cols})


def null_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative values become NULL in the columns whose name says they cannot be negative."""
    hit = set(fv.nonnegative_columns([fv.DISPLAY_NAMES.get(c, c) for c in cols]))
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols if fv.DISPLAY_NAMES.get(c, c) in hit})


def null_bad_ports(df: DataFrame, col: str = "destination_port") -> DataFrame:
    return df.withColumn(col, F.when(F.col(col).between(0, 65535), F.col(col)))


_COUNTERS = {"parse": "numeric_parse_failures", "infinite": "infinite_values_replaced", "negative": "invalid_negative_values_replaced", "port": "invalid_ports_replaced"}


def mark_repairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``repair`` with the values given up per row and kind beside it, so that rows and counters come from one pass."""
    cols = list(cols or feature_columns(df))
    kept, hits = {}, {kind: F.lit(0) for kind in _COUNTERS}
    for c in cols:
        keep = F.lit(True)
        for kind, cond in _repairs(c).items():
            hits[kind] = hits[kind] + cond.cast("int")
            keep = keep if kind == "parse" else keep & ~cond  # unreadable text is NULL already
        kept[c] = F.when(keep, F.col(f"_p_{c}"))
    return _parse_columns(df, cols).withColumns({**kept, **{f"_n_{k}": n for k, n in hits.items()}}).select(
        *df.columns, *[f"_n_{k}" for k in _COUNTERS])


def sum_repairs(marked: DataFrame) -> DataFrame:
    """From ``mark_repairs``: one row of repair counters over the labelled rows."""
    labelled = F.col(fv.TARGET).isNotNull()
    return marked.agg(
        F.count("*").alias("raw_rows"),
        *[F.coalesce(F.sum(F.when(labelled, F.col(f"_n_{k}"))), F.lit(0)).alias(name) for k, name in _COUNTERS.items()],
        F.count_if(~labelled).alias("missing_label_rows_removed"))


def repair(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """All value repairs of the text columns in one projection."""
    return mark_repairs(df, cols).select(*df.columns)


def repair_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row of repair counters, from a single aggregate over the unrepaired rows."""
    return sum_repairs(mark_repairs(df, cols))


def equal_columns(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Per (copy, original): rows where they differ (NULL equals NULL); one pass for all pairs."""
    pairs = {a: b for a, b in pairs.items() if a in df.columns and b in df.columns}
    row = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(a) for a, b in pairs.items()])
    entries = [F.struct(F.lit(a).alias("copy"), F.lit(b).alias("original"), F.col(a).alias("differing_rows"))
               for a, b in pairs.items()]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def drop_equal_columns(df: DataFrame, pairs: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Drop every copy that equals its original in all rows; also returns the dropped names."""
    if not any(a in df.columns and b in df.columns for a, b in pairs.items()):
        return df, []
    dropped = [r["copy"] for r in equal_columns(df, pairs).filter("differing_rows = 0").collect()]
    order = [a for a in pairs if a in dropped]
    return df.drop(*order), order


def _label_bit(labels: Sequence[str]) -> Column:
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(fv.TARGET))
    return F.pow(F.lit(2.0), position.cast("double")).cast("long")


_ROW_BITS = 40  # rows of one file; the other 23 bits number the origins
_SALTS = 16
_BROADCAST_ROWS = 100_000  # origins sent to every executor; more are joined by a shuffle


def _hash_pair(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """``_h1`` and ``_h2``: 128 bits that tell rows apart by *cols*.  NULLs are equal to each other and to nothing else, 0 equals -0.

    Two of 10^12 different rows agree with a chance of about 10^-15.
    """
    types = dict(df.dtypes)
    nulls = F.array(*[F.isnull(c) for c in cols])
    values = [F.col(c) + F.lit(0.0) if types[c] in ("double", "float") else F.col(c) for c in cols]
    return {"_h1": F.xxhash64(nulls, *values), "_h2": F.xxhash64(F.lit(fv.SEED), nulls, *values)}


def _with_place(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Add ``_place``, one number that sorts rows of one label by *order*, and its key back to texts: (rows, origins).

    The last column of *order* is a row number below 2^40; the distinct values of
    the others, of provenance and label are one row a file and label, as few as
    the list of files that Spark keeps anyway.
    """
    *outer, row = order
    names = list(dict.fromkeys([*outer, *[c for c in fv.PROVENANCE if c != row], fv.TARGET]))
    hashed = lambda side: F.xxhash64(*[F.col(f"{side}.{c}") for c in names])
    found = [tuple(r) for r in df.alias("l").select(*names, hashed("l").alias("_hash")).distinct().collect()]
    one_each = len({r[-1] for r in found}) == len(found)
    found = sorted((r[:-1] for r in found), key=lambda r: [(v is not None, v) for v in r])
    schema = "_origin long, " + ", ".join(f"`{c}` {t}" for c, t in df.select(*names).dtypes)
    origins = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(found)], schema)
    origins = F.broadcast(origins) if len(found) <= _BROADCAST_ROWS else origins
    number = F.coalesce(F.col(row).cast("long") + 1, F.lit(0))
    number = F.when(number.between(0, 2**_ROW_BITS - 1), number).otherwise(F.raise_error(F.lit(f"{row} is no row number")))
    if one_each:  # every row's origin is in the list, so one number finds it
        on = hashed("l") == hashed("o")
    else:
        on = functools.reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names])
    out = df.alias("l").join(origins.alias("o"), on).select("l.*", (F.shiftleft("o._origin", _ROW_BITS) + number).alias("_place"))
    return out, origins


def _place_back(groups: DataFrame, origins: DataFrame, row: str) -> DataFrame:
    """Add ``first``: provenance and label of the row at ``_place``."""
    number = F.col("_place").bitwiseAND(2**_ROW_BITS - 1)
    texts = [F.nullif(number, F.lit(0)) - 1 if c == row else F.col(f"o.{c}") for c in (*fv.PROVENANCE, fv.TARGET)]
    first = F.struct(*[t.alias(c) for t, c in zip(texts, (*fv.PROVENANCE, fv.TARGET))])
    return groups.alias("g").join(origins.alias("o"), F.shiftright("g._place", _ROW_BITS) == F.col("o._origin")).select("g.*", first.alias("first")).drop("_place")


def row_groups(df: DataFrame, labels: Sequence[str] = fv.CLASSES, order: Sequence[str] = ("_source_file", "_source_row")) -> DataFrame:
    """Rows grouped by equal features: first row in *order*, copies, and how many labels they carry.

    A hash aggregate on two numbers with buffers of fixed width: copies collapse
    before the shuffle however many there are, and nothing is sorted.  NULLs are
    equal.  ``first`` is meant for groups of one label.
    """
    features = feature_columns(df)
    placed, origins = _with_place(df, order)
    grouped = placed.withColumns(_hash_pair(df, features)).groupBy("_h1", "_h2").agg(
        *[F.first(c).alias(c) for c in features], F.min("_place").alias("_place"), F.count("*").alias("copies"),
        F.bit_count(F.bit_or(_label_bit(labels))).cast("long").alias("n_labels"))
    return _place_back(grouped, origins, order[-1]).drop("_h1", "_h2")


def clean_rows(groups: DataFrame) -> DataFrame:
    """From ``row_groups``: the first row of every group whose rows agree on the label."""
    features = [c for c in groups.columns if c not in ("first", "copies", "n_labels")]
    return groups.filter("n_labels = 1").select(
        *features, *[F.col(f"first.{c}").alias(c) for c in (*fv.PROVENANCE, fv.TARGET)])


def group_counts(groups: DataFrame) -> DataFrame:
    """From ``row_groups``: copies removed, rows of contradicting groups removed, rows kept."""
    z = F.lit(0).cast("long")
    return groups.agg(
        F.coalesce(F.sum(F.col("copies") - F.col("n_labels")), z).alias("exact_duplicates_removed"),
        F.coalesce(F.sum(F.when(F.col("n_labels") > 1, F.col("n_labels"))), z).alias("conflicting_feature_rows_removed"),
        F.count_if(F.col("n_labels") == 1).alias("output_rows"))


def drop_exact_duplicates(df: DataFrame, order: Sequence[str] = ("_source_file", "_source_row")) -> DataFrame:
    """Keep the first row in *order* among rows with equal features and label."""
    features = feature_columns(df)
    placed, origins = _with_place(df, order)
    grouped = placed.withColumns(_hash_pair(df, [*features, fv.TARGET])).groupBy("_h1", "_h2").agg(
        *[F.first(c).alias(c) for c in features], F.min("_place").alias("_place"))
    return _place_back(grouped, origins, order[-1]).select(*features, *[F.col(f"first.{c}").alias(c) for c in (*fv.PROVENANCE, fv.TARGET)])


def drop_conflicts(df: DataFrame, labels: Sequence[str] = fv.CLASSES) -> DataFrame:
    """Remove every row whose features also occur with another label (rows otherwise kept as they are)."""
    hashed = df.withColumns(_hash_pair(df, feature_columns(df)))
    bad = (
        hashed.groupBy("_h1", "_h2").agg(F.bit_count(F.bit_or(_label_bit(labels))).alias("n")).filter("n > 1")
        .select("_h1", "_h2", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")))
    # copies of one feature row, however many, are dealt over the salts
    salt = F.pmod(F.xxhash64(*[c for c in fv.PROVENANCE if c in df.columns], F.lit(fv.SEED)), F.lit(_SALTS)).cast("int")
    return hashed.withColumn("_salt", salt).join(bad, ["_h1", "_h2", "_salt"], "left_anti").select(*df.columns)


def all_zero_columns(df: DataFrame) -> DataFrame:
    """Features that hold at least one value and nothing but 0 (NULL counts as 0), by name."""
    cols = feature_columns(df)
    row = df.agg(*[
        ((F.count(c) > 0) & (F.count_if(F.col(c) != 0) == 0)).alias(c) for c in cols])
    entries = [F.when(F.col(c), F.lit(fv.DISPLAY_NAMES.get(c, c))) for c in cols]
    return row.select(F.explode(F.array_sort(F.array_compact(F.array(*entries)))).alias("feature"))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(fv.TARGET).agg(F.count("*").alias("rows"))


def clean(df: DataFrame, pairs: Mapping[str, str] | None = None, cut_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole cleaning job: labelled text rows -> (clean rows, one-row audit).

    *df* has text features, provenance columns and a raw ``Label``.  Repaired
    rows feed the counters, the column comparison and the grouping, grouped rows feed both
    results; each is materialised once in the shared folder unless
    ``cut_groups=False``.
    """
    from flowloom.operators.session import cut

    pairs = {fv.snake(a): fv.snake(b) for a, b in fv.COPY_COLUMNS.items()} if pairs is None else pairs
    labelled = normalize_labels(df)
    keep = cut if cut_groups else (lambda d: d)
    marked = keep(mark_repairs(labelled))
    counts = sum_repairs(marked)
    fixed, dropped = drop_equal_columns(drop_missing_labels(marked).drop(*[f"_n_{k}" for k in _COUNTERS]), pairs)
    groups = row_groups(fixed)
    groups = keep(groups)
    rows = clean_rows(groups)
    zero = all_zero_columns(rows).agg(F.array_sort(F.collect_list("feature")).alias("all_zero_columns_observed"))
    by_label = label_counts(rows).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(fv.TARGET, "rows")))).alias("output_label_counts"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    audit = one(counts)
    for part in (group_counts(groups), zero, by_label):
        audit = audit.join(one(part), "_one")
    audit = audit.drop("_one").withColumns({
        "version": F.lit(fv.PREPROCESSING_VERSION),
        "duplicate_feature_columns_removed": F.array(*[F.lit(fv.DISPLAY_NAMES.get(c, c)) for c in dropped]).cast("array<string>")})
    return rows, audit
