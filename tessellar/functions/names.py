"""Names as queries see them, and numbers as label values."""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
_METRIC = re.compile(r"[A-Za-z_:][A-Za-z0-9_:]*")
_LABEL = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _changed(name: str, clean: str) -> str:
    return name if clean == name else f"{clean}_x{xxhash.xxh64_hexdigest(name.encode())}"


def metric_name(name: str) -> str:
    """A name of letters, digits, _ and : stays; others get _ for what is not allowed, and a hash of the original."""
    clean = re.sub(r"[^A-Za-z0-9_:]", "_", name)
    return _changed(name, clean if _METRIC.match(clean) else f"_{clean}")


def label_name(name: str) -> str:
    if name == NAME:
        return name
    clean = re.sub(r"[^A-Za-z0-9_]", "_", name)
    clean = clean if _LABEL.match(clean) else f"_{clean}"
    return _changed(name, f"otel_{clean}" if clean.startswith("__") else clean)


def series_id(labels: list[tuple[str, str]]) -> int:
    return xxhash.xxh64_intdigest(b"".join(n.encode() + b"\0" + v.encode() + b"\xff" for n, v in sorted(labels)))


def float_text(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-4 <= abs(x) < 1e6:
        text = repr(x)
        if "e" in text:
            text = f"{x:.20f}".rstrip("0")
        return text.removesuffix(".0")
    return "".join(_scientific(x))


def _scientific(x: float) -> tuple[str, str, str]:
    digits, exponent = repr(abs(x)), 0
    if "e" in digits:
        digits, _, e = digits.partition("e")
        exponent = int(e)
    whole, _, part = digits.partition(".")
    exponent += len(whole) - 1
    figures = whole + part
    while figures.startswith("0"):
        figures, exponent = figures[1:], exponent - 1
    figures = figures.rstrip("0") or "0"
    mantissa = figures[0] + (f".{figures[1:]}" if len(figures) > 1 else "")
    return ("-" if x < 0 else "") + mantissa, "e", f"{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def float_column(x: Column) -> Column:
    """float_text as a Column expression, from Spark's own text of a double."""
    text = F.abs(x).cast("string")
    mantissa = F.split(text, "E")
    exponent = F.when(F.contains(text, F.lit("E")), F.get(mantissa, F.lit(1)).cast("int")).otherwise(0)
    parts = F.split(F.get(mantissa, F.lit(0)), r"\.")
    whole, part = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    figures = F.concat(whole, part)
    shown = F.regexp_replace(figures, "^0+", "")
    power = exponent + F.length(whole) - 1 - (F.length(figures) - F.length(shown))
    shown = F.regexp_replace(shown, "0+$", "")
    n = F.length(shown)
    plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), shown)).when(n <= power + 1, F.concat(shown, F.repeat(F.lit("0"), power + 1 - n))).otherwise(F.concat(shown.substr(F.lit(1), power + 1), F.lit("."), shown.substr(power + 2, n)))
    sign = F.when(x < 0, "-").otherwise("")
    scientific = F.concat(shown.substr(1, 1), F.when(n > 1, F.concat(F.lit("."), shown.substr(F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    scientific = F.when(F.abs(power) > 99, F.regexp_replace(F.concat(shown.substr(1, 1), F.when(n > 1, F.concat(F.lit("."), shown.substr(F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string")), " ", "")).otherwise(scientific)
    negative_zero = (x == 0.0) & F.startswith(x.cast("string"), F.lit("-"))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "+Inf").otherwise("-Inf")).when(negative_zero, "-0").when(x == 0.0, "0").when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e6), F.concat(sign, plain)).otherwise(F.concat(sign, scientific))
