"""Column expressions for the formulas of the library."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def depth(node: Column | str) -> Column:
    """Depth of a heap index: ceil(log2(i + 2)) - 1."""
    return (F.ceil(F.log2(_c(node).cast("double") + 2)) - 1).cast("int")


def log_p_split(d: Column, alpha: float = 0.95, beta: float = 2.0, quick_decay: bool = False) -> Column:
    """Log chance that a node of depth d splits: alpha (1 + d)^-beta, or alpha^d."""
    d = d.cast("double")
    return d * F.ln(F.lit(alpha)) if quick_decay else F.ln(F.lit(alpha)) - F.lit(beta) * F.ln(d + 1)


def p_split(d: Column, alpha: float = 0.95, beta: float = 2.0, quick_decay: bool = False) -> Column:
    p = F.pow(F.lit(alpha), d.cast("double")) if quick_decay else F.lit(alpha) / F.pow(d.cast("double") + 1, F.lit(beta))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * z)
    # fixed values of the approximation
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.when(x < 0, -erf).otherwise(erf))


NORMAL_CDF_SQL = (
    "0.5 * (1.0 + CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1.0 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-({x}) * ({x}) / 2.0)))"
)


# The rational approximations of Wichura's algorithm AS 241 (1988), highest power first
QUANTILE_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
QUANTILE_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
QUANTILE_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.2426609473880784386e-3, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(both: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    def polynomial(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for v in c[1:]:
            out = out * x + F.lit(v)
        return out

    return polynomial(both[0]) / polynomial(both[1])


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function for p in (0, 1), to about 16 digits."""
    q = p - F.lit(0.5)
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= 5, _ratio(QUANTILE_TAIL, r - F.lit(1.6))).otherwise(_ratio(QUANTILE_FAR, r - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * _ratio(QUANTILE_MIDDLE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * tail)


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def softmax(score: Column, *keys: str) -> Column:
    """Softmax over the rows that share the keys, shifted by the largest."""
    w = Window.partitionBy(*keys)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


#: Fixed values.  Schedules of model refreshes: for t up to a bound, ceil(shift + a ln t + b sqrt t) as (bound, a, b, shift).
REFRESH: dict[str, list[tuple[int | None, float, float, float]]] = {
    "log": [(None, 8.0, 0.0, 0.0)],
    "sqrt": [(None, 0.0, 0.57, 0.0)],
    "hybrid": [(100, 0.0, 1.848, 0.0), (None, 9.240, 0.0, -24.072)],
    "rev_hybrid": [(200, 3.620, 0.0, 0.0), (None, 0.0, 0.512, 11.940)],
}
SCHEDULES = tuple(REFRESH)


def refresh_index(t: Column, schedule: str) -> Column:
    """A refresh is due when the index grows."""
    if schedule not in REFRESH:
        raise ValueError(f"unknown refresh schedule {schedule!r}")
    t, out = t.cast("double"), None
    for upto, by_log, by_root, shift in reversed(REFRESH[schedule]):
        terms = [w * f(t) for w, f in ((by_log, F.ln), (by_root, F.sqrt)) if w]
        value = F.ceil(sum(terms, F.lit(shift)))
        out = value if upto is None else F.when(t <= upto, value).otherwise(out)
    return out.cast("long")


#: The same in SQL, written out.
REFRESH_SQL = {
    "log": "ceil(8.0 * ln({t}))",
    "sqrt": "ceil(0.57 * sqrt({t}))",
    "hybrid": "CASE WHEN {t} <= 100 THEN ceil(1.848 * sqrt({t})) ELSE ceil(9.240 * ln({t}) - 24.072) END",
    "rev_hybrid": "CASE WHEN {t} <= 200 THEN ceil(3.620 * ln({t})) ELSE ceil(0.512 * sqrt({t}) + 11.940) END",
}


def max_bins(t: Column) -> Column:
    """Bins that grow with the data: min(2000, max(100, ceil(0.2 t)))."""
    return F.least(F.lit(2000), F.greatest(F.lit(100), F.ceil(0.2 * t))).cast("int")


def draws_needed(steps: Column, choices: Column, most: int) -> Column:
    return F.greatest(F.lit(100), F.least(F.lit(most), steps * (choices + 1))).cast("int")


def local_hour(stamp: Column, zone: str = "UTC", shift_hours: int = 0) -> Column:
    """Hour of a time, some hours later, in a time zone."""
    later = F.timestamp_seconds(F.unix_timestamp(stamp) + shift_hours * 3600)
    return F.hour(F.from_utc_timestamp(later, zone))


def days_after(stamp: Column, days: int) -> Column:
    return F.date_add(F.to_date(stamp), days)


def parsed_time(text: Column, pattern: str = "dd/MM/yyyy HH:mm") -> Column:
    """A time from text, without a zone."""
    return F.to_timestamp_ntz(text, F.lit(pattern))
