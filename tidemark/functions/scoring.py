"""Value functions: bands, messages, labels, clamps, display rounding, errors."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Upper bound of each band (closed), its category and its message.
BANDS = [
    (50, "Good", "Air quality is satisfactory."),
    (100, "Moderate", "Air quality is acceptable for most people."),
    (150, "Unhealthy for Sensitive Groups", "Sensitive groups may experience health effects."),
    (200, "Unhealthy", "Everyone may begin to experience health effects."),
    (300, "Very Unhealthy", "Health alert: increased risk of health effects."),
    (None, "Hazardous", "Health warning: emergency conditions possible."),
]
# Strict lower bound of each alert.
ALERTS = [
    (300, "hazardous"),
    (200, "very_unhealthy"),
    (150, "unhealthy"),
    (100, "sensitive_groups"),
]
NO_ALERT = "none"
# Display names by code.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def known(x) -> Column:
    """NULL for both NULL and NaN, else the value."""
    c = _c(x).cast("double")
    return F.when(~F.isnan(c), c)


def _banded(x, texts: list[str]) -> Column:
    v = known(x)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for (upper, _, _), text in zip(BANDS[:-1], texts):
        out = out.when(v <= upper, text)
    return out.otherwise(texts[-1])


def category(x) -> Column:
    return _banded(x, [b[1] for b in BANDS])


def health_message(x) -> Column:
    return _banded(x, [b[2] for b in BANDS])


def alert_level(x) -> Column:
    v = known(x)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for lower, text in ALERTS:
        out = out.when(v > lower, text)
    return out.otherwise(NO_ALERT)


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``aqi_category(x)`` callable from SQL text, as a native CASE expression."""
    whens = " ".join(f"WHEN x <= {u} THEN '{n}'" for u, n, _ in BANDS[:-1])
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION aqi_category(x DOUBLE) RETURNS STRING RETURN "
        f"CASE WHEN x IS NULL OR isnan(x) THEN NULL {whens} ELSE '{BANDS[-1][1]}' END"
    )


def label_of(code, labels: list[str], first: int = 0) -> Column:
    """Name of a small integer code; codes outside the list give NULL."""
    names = F.array(*[F.lit(n) for n in labels])
    return F.get(names, (_c(code) - first).cast("int"))


def clamp_min(x, low: float = 0.0) -> Column:
    """At least ``low``; NaN counts as ``low`` and NULL stays NULL."""
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.nanvl(c, F.lit(low))))


def round_display(x, digits: int) -> Column:
    """Half-even rounding on the binary value, as array libraries do it for display tables."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(x) * scale) / scale


def format_number(x, digits: int) -> Column:
    """Fixed decimals; the exact binary value decides, and exact ties go to the even digit.

    ``x * 10^digits`` is itself rounded, so where it looks like a tie the rounding error of the
    product (exact, from the two halves of ``x``) tells on which side the true value lies.
    """
    c = _c(x).cast("double")
    scale = F.lit(float(10 ** digits))
    product = c * scale
    high = c.cast("float").cast("double")
    error = (high * scale - product) + (c - high) * scale
    tie = F.abs(product - F.floor(product) - 0.5) == 0
    whole = (F.when(tie & (error > 0), F.ceil(product).cast("double"))
             .when(tie & (error < 0), F.floor(product).cast("double"))
             .otherwise(F.rint(product)))
    return F.format_string(f"%.{digits}f", whole / scale)


def abs_error(y, yhat) -> Column:
    return F.abs(_c(y) - _c(yhat))


def sq_error(y, yhat) -> Column:
    e = _c(y) - _c(yhat)
    return e * e
