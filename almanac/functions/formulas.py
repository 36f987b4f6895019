"""Closed-form column expressions of the transformations and their inverses (MTH1-MTH15).

All take Columns (or numbers) for their parameters, so a parameter can be a literal
(one series) or a column joined from a per-series state table (many series)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LAMBDA_EPS = 1e-10


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fourier(idx: Column, period: float, harmonic: int) -> tuple[Column, Column]:
    """sin/cos(2*pi*h*idx/period). For integer periods the angle is reduced first:
    (h*idx mod period) keeps full precision at very large positions."""
    if float(period).is_integer():
        phase = (idx * F.lit(harmonic)) % F.lit(int(period))
    else:
        phase = idx * F.lit(harmonic)
    angle = F.lit(2 * math.pi / period) * phase.cast("double")
    return F.sin(angle), F.cos(angle)


def log_offset_feature(min_value, offset) -> Column:
    """Safe-log offset of the feature step: offset if min > 0 else abs(min) + offset (MTH2)."""
    m, o = _c(min_value), _c(offset)
    return F.when(m <= 0, F.abs(m) + o).otherwise(o)


def log_offset_transform(min_value, offset) -> Column:
    """Offset of the invertible log: the given one, but abs(min) + 1 if min <= 0 (MTH4)."""
    m = _c(min_value)
    return F.when(m <= 0, F.abs(m) + F.lit(1.0)).otherwise(_c(offset))


def sqrt_offset_transform(min_value, offset) -> Column:
    """Offset of sqrt: the given one, but abs(min) + 0.01 if min < 0 (MTH5)."""
    m = _c(min_value)
    return F.when(m < 0, F.abs(m) + F.lit(0.01)).otherwise(_c(offset))


def box_cox_offset(min_value) -> Column:
    m = _c(min_value)
    return F.when(m <= 0, F.abs(m) + F.lit(1.0)).otherwise(F.lit(0.0))


def standardize(c: Column, mean, sd, with_mean: bool = True, with_std: bool = True) -> Column:
    """z-score with the population sd; zero sd divides by 1 (MTH6)."""
    out = c - _c(mean) if with_mean else c
    if with_std:
        s = _c(sd)
        out = out / F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
    return out


def normalize(c: Column, lo, hi) -> Column:
    """Min-max to [0, 1]; a constant column maps to 0 (MTH7)."""
    lo, hi = _c(lo), _c(hi)
    rng = hi - lo
    return (c - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)


def box_cox(x: Column, lam) -> Column:
    """Box-Cox of a positive x (offset already added) (MTH8)."""
    lam = _c(lam)
    return F.when(F.abs(lam) < LAMBDA_EPS, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def box_cox_by_lambda(x: Column, lam: Column) -> Column:
    """Derivative of Box-Cox by lambda; near 0 by its series in ln x."""
    ln = F.log(x)
    near = ln * ln * (F.lit(0.5) + lam * ln * (F.lit(1 / 3) + lam * ln / 8))
    return F.when(F.abs(lam) < 1e-4, near).otherwise((F.pow(x, lam) * (lam * ln - 1) + 1) / (lam * lam))


def yeo_johnson(x: Column, lam) -> Column:
    """Yeo-Johnson of any real x (MTH9)."""
    lam = _c(lam)
    pos = F.when(F.abs(lam) < LAMBDA_EPS, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    two = F.lit(2.0) - lam
    neg = F.when(F.abs(two) < LAMBDA_EPS, -F.log1p(-x)).otherwise(-(F.pow(F.lit(1.0) - x, two) - 1) / two)
    return F.when(x.isNull(), F.lit(None)).when(x >= 0, pos).otherwise(neg)


def inv_log(y: Column, offset) -> Column:
    return F.exp(y) - _c(offset)


def inv_sqrt(y: Column, offset) -> Column:
    return y * y - _c(offset)


def inv_standardize(y: Column, mean, sd, with_mean: bool = True, with_std: bool = True) -> Column:
    out = y
    if with_std:
        s = _c(sd)
        out = out * F.when((s == 0) | s.isNull(), F.lit(1.0)).otherwise(s)
    if with_mean:
        out = out + _c(mean)
    return out


def inv_normalize(y: Column, lo, hi) -> Column:
    lo, hi = _c(lo), _c(hi)
    rng = hi - lo
    return y * F.when(rng == 0, F.lit(1.0)).otherwise(rng) + lo


def inv_box_cox(y: Column, lam, offset) -> Column:
    lam = _c(lam)
    base = F.when(F.abs(lam) < LAMBDA_EPS, F.exp(y)).otherwise(F.pow(lam * y + 1, F.lit(1.0) / lam))
    return base - _c(offset)


def inv_yeo_johnson(y: Column, lam) -> Column:
    """Inverse Yeo-Johnson with the correct formula on both branches (MTH15)."""
    lam = _c(lam)
    pos = F.when(F.abs(lam) < LAMBDA_EPS, F.exp(y) - 1).otherwise(F.pow(lam * y + 1, F.lit(1.0) / lam) - 1)
    two = F.lit(2.0) - lam
    neg = F.when(F.abs(two) < LAMBDA_EPS, F.lit(1.0) - F.exp(-y)).otherwise(
        F.lit(1.0) - F.pow(F.lit(1.0) - two * y, F.lit(1.0) / two)
    )
    return F.when(y.isNull(), F.lit(None)).when(y >= 0, pos).otherwise(neg)


# ------------------------------------------------------------------ normal quantile (WIN14)
# Coefficients of Wichura's algorithm AS241 (Applied Statistics 37, 1988), highest power first.
AS241_CENTRE_NUM = (2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
                    1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0)
AS241_CENTRE_DEN = (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
                    5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0)
AS241_MIDDLE_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
                    3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0)
AS241_MIDDLE_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
                    6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0)
AS241_TAIL_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
                  2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0)
AS241_TAIL_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
                  1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def _horner(coefs, x: str) -> str:
    out = f"{coefs[0]:.17e}"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c:.17e})"
    return out


def normal_ppf_sql(p: str) -> str:
    """Standard normal quantile of the SQL expression ``p``; NULL outside (0, 1)."""
    q = f"({p} - 5e-1)"
    c = f"(1.80625e-1 - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    m, f = f"({t} - 1.6e0)", f"({t} - 5e0)"
    return (f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL "
            f"WHEN abs({q}) <= 4.25e-1 THEN {q} * {_horner(AS241_CENTRE_NUM, c)} / {_horner(AS241_CENTRE_DEN, c)} "
            f"ELSE sign({q}) * CASE WHEN {t} <= 5 THEN {_horner(AS241_MIDDLE_NUM, m)} / {_horner(AS241_MIDDLE_DEN, m)} "
            f"ELSE {_horner(AS241_TAIL_NUM, f)} / {_horner(AS241_TAIL_DEN, f)} END END")
