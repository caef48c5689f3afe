"""Scalar column functions (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom import fixed_values as fv

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_flag(flags, bit: int) -> Column:
    """True when a TCP flag bit is set."""
    return _c(flags).bitwiseAND(F.lit(bit)) != 0


def safe_ratio(num, den) -> Column:
    """``num / den`` as double; 0 on a zero or missing denominator."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


def plain_number(text: Column, value: Column) -> Column:
    """*value* (the cast of *text*) unless the text uses a type suffix, hexadecimal notation or NaN.

    Only comparisons of bytes, no text is built.
    """
    ends = [F.endswith(text, F.lit(s)) for s in "dfDF"]
    suffix = (ends[0] | ends[1] | ends[2] | ends[3]) & (F.abs(value) != F.lit(float("inf")))
    return F.when(~(suffix | F.contains(text, F.lit("x")) | F.contains(text, F.lit("X")) | F.isnan(value)), value)


def finite_number(x, is_text: bool = True) -> Column:
    """Any value to a finite double, else NULL (text is trimmed; only plain decimal notation counts)."""
    if is_text:
        text = F.trim(_c(x).cast("string"))
        value = plain_number(text, text.try_cast("double"))
    else:
        value = _c(x).cast("double")
    return F.when((F.abs(value) != F.lit(float("inf"))) & ~F.isnan(value), value)


def null_if_not_finite(x) -> Column:
    """NaN and infinities become NULL."""
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def capture_day(file_name) -> Column:
    """Lower-case text before the first dash of a file name."""
    return F.lower(F.substring_index(_c(file_name), "-", 1))


def repaired_label(label) -> Column:
    """Repair dashes and spacing of a raw label; blank becomes the empty text."""
    text = F.trim(_c(label))
    for pattern, repl in fv.LABEL_CLEANUP:
        text = F.regexp_replace(text, pattern, repl)
    return F.trim(text)


def clean_label(label) -> Column:
    """Repair dashes and spacing of a raw label; blank becomes NULL."""
    text = repaired_label(label)
    return F.when(text != "", text)


def protocol_name(p) -> Column:
    c = _c(p)
    return (
        F.when(c == fv.TCP, "TCP").when(c == fv.UDP, "UDP").when(c == fv.ICMP, "ICMP")
        .otherwise(F.concat(F.lit("Proto-"), F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit("?"))))
    )


def format_time(seconds) -> Column:
    """``HH:MM:SS UTC`` (session time zone must be UTC); placeholder for empty or 0."""
    c = F.nullif(_c(seconds).cast("double"), F.lit(0.0))
    return F.coalesce(
        F.concat(F.date_format(F.timestamp_seconds(c), "HH:mm:ss"), F.lit(" UTC")), F.lit("--:--:--"))


def format_datetime(seconds) -> Column:
    """``dd/MM/yyyy, HH:mm:ss UTC``; ``N/A`` for empty or 0."""
    c = F.nullif(_c(seconds).cast("double"), F.lit(0.0))
    return F.coalesce(
        F.concat(F.date_format(F.timestamp_seconds(c), "dd/MM/yyyy, HH:mm:ss"), F.lit(" UTC")), F.lit("N/A"))


def format_count(n) -> Column:
    """Thousands separators; ``0`` for NULL."""
    return F.coalesce(F.format_number(_c(n), 0), F.lit("0"))


def format_confidence(c) -> Column:
    """Share 0..1 to ``95.43%``; ``0.00%`` for NULL."""
    return F.coalesce(F.format_string("%.2f%%", _c(c) * 100), F.lit("0.00%"))


def truncate_text(s, max_len: int) -> Column:
    c = _c(s)
    return F.coalesce(
        F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, max_len - 1), F.lit("…"))).otherwise(c),
        F.lit(""))


def format_duration(us) -> Column:
    """Microseconds to ``N μs`` / ``N.N ms`` / ``N.NN s`` (decimal half-up)."""
    c = F.coalesce(_c(us).cast("long"), F.lit(0).cast("long"))
    tenths = F.floor((c + 50) / 100)
    hundredths = F.floor((c + 5000) / 10000)
    return (
        F.when(c <= 0, "0 μs")
        .when(c < 1000, F.concat(c.cast("string"), F.lit(" μs")))
        .when(c < 1_000_000, F.format_string("%d.%d ms", F.floor(tenths / 10), F.pmod(tenths, F.lit(10))))
        .otherwise(F.format_string("%d.%02d s", F.floor(hundredths / 100), F.pmod(hundredths, F.lit(100))))
    )


def format_endpoint(ip, port) -> Column:
    i, p = F.nullif(_c(ip), F.lit("")), F.nullif(_c(port), F.lit(0))
    return (
        F.when(i.isNull(), "unknown").when(p.isNull(), i)
        .otherwise(F.concat(i, F.lit(":"), p.cast("string")))
    )


def uptime_text(seconds) -> Column:
    """Seconds to ``Xh Ym Zs`` (hours left out when 0, then minutes)."""
    c = F.floor(F.coalesce(_c(seconds).cast("double"), F.lit(0.0)))
    h, m, s = F.floor(c / 3600), F.floor(F.pmod(c, F.lit(3600)) / 60), F.pmod(c, F.lit(60))
    return (
        F.when(c <= 0, "—").when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
    )


def is_special_ip(ip) -> Column:
    """True for empty, invalid, multicast, unspecified, link-local or limited-broadcast addresses.

    IPv4 is judged on its four octets (no leading zeros, 0..255); IPv6 on its
    leading group, after a shape check.
    """
    c = F.coalesce(_c(ip), F.lit(""))
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = c.rlike(rf"^{octet}([.]{octet}){{3}}$")
    first = F.split_part(c, F.lit("."), F.lit(1)).try_cast("int")
    second = F.split_part(c, F.lit("."), F.lit(2)).try_cast("int")
    v4_special = (
        first.between(224, 239) | ((first == 169) & (second == 254))
        | c.isin("0.0.0.0", "255.255.255.255"))
    low = F.lower(c)
    v6 = low.rlike(_V6_FULL) | (
        low.rlike(_V6_SHORT) & ~low.rlike(r"::.*::") & (F.length(low) - F.length(F.replace(low, F.lit(":"), F.lit(""))) <= 7))
    v6_special = low.rlike(r"^ff[0-9a-f]{2}:") | low.rlike(r"^fe[89ab][0-9a-f]:") | low.rlike(r"^[0:]+$")
    return ~(v4 | v6) | (v4 & v4_special) | (v6 & v6_special)


_V6_FULL = r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
_V6_SHORT = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"
