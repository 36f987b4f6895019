"""DuckDB SQL of fits that need more than one aggregate: normal equations, likelihood searches.

Only text; :mod:`almanac.catalog` puts the texts beside the queries they check."""

from __future__ import annotations

from collections.abc import Sequence


def linear_fit(rows: str, p: int, penalty: Sequence[float] | None = None, keys: Sequence[str] = (), tag: str = "lf",
               inverse: bool = False) -> str:
    """CTEs that fit ``y`` on ``f0..f{p-1}`` of the CTE ``rows`` per key: centred cross-products, then
    Gauss-Jordan elimination with one CTE per pivot. The last one, ``{tag}``, has keys, ``w0..``, ``b``, and with ``inverse`` the
    means ``m0..`` and the inverse of the penalised cross-products ``v0_0..``."""
    pen = list(penalty or [0.0] * p)
    kc = "".join(f"{k}, " for k in keys)
    rk = "".join(f"r.{k}, " for k in keys)
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    rgrp = f" GROUP BY {', '.join(f'r.{k}' for k in keys)}" if keys else ""
    on = " AND ".join(f"r.{k} = m.{k}" for k in keys) or "TRUE"
    cols = [f"f{i}" for i in range(p)] + ["y"]
    means = ", ".join(f"AVG({c}) AS m{i}" for i, c in enumerate(cols))
    prods = []
    for i in range(p):
        for j in range(p + 1):
            ridge = f" + {pen[i]!r}::DOUBLE" if i == j and pen[i] else ""
            prods.append(f"SUM((r.{cols[i]} - m.m{i}) * (r.{cols[j]} - m.m{j})){ridge} AS a{i}_{j}")
        if inverse:
            prods += [f"{float(i == m)!r}::DOUBLE AS a{i}_{p + 1 + m}" for m in range(p)]
    mk = ", ".join(f"ANY_VALUE(m.m{i}) AS m{i}" for i in range(p + 1))
    out = [f"{tag}_m AS (SELECT {kc}{means} FROM {rows}{grp})",
           f"{tag}_0 AS MATERIALIZED (SELECT {rk}{mk}, {', '.join(prods)} FROM {rows} r JOIN {tag}_m m ON {on}{rgrp})"]
    mcols = ", ".join(f"m{i}" for i in range(p + 1))
    for k in range(p):
        cells = []
        for i in range(p):
            for j in range(2 * p + 1 if inverse else p + 1):
                a = f"a{i}_{j}"
                cells.append(a if i == k else f"{a} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS {a}")
        out.append(f"{tag}_{k + 1} AS MATERIALIZED (SELECT {kc}{mcols}, {', '.join(cells)} FROM {tag}_{k})")
    w = ", ".join(f"a{i}_{p} / a{i}_{i} AS w{i}" for i in range(p))
    b = f"m{p}" + "".join(f" - a{i}_{p} / a{i}_{i} * m{i}" for i in range(p))
    more = ", " + mcols + "".join(f", a{i}_{p + 1 + j} / a{i}_{i} AS v{i}_{j}" for i in range(p) for j in range(p)) if inverse else ""
    out.append(f"{tag} AS (SELECT {kc}{w}, {b} AS b{more} FROM {tag}_{p})")
    return ",\n".join(out)


def predicted(p: int, coef: str = "c", row: str = "r") -> str:
    return f"{coef}.b" + "".join(f" + {coef}.w{i} * {row}.f{i}" for i in range(p))


def metrics(y: str = "y", p: str = "prediction", ybar: str = "ybar") -> dict[str, str]:
    """Aggregate expressions of the regression metrics."""
    return {"rmse": f"SQRT(AVG(({y} - {p}) * ({y} - {p})))", "mae": f"AVG(abs({y} - {p}))",
            "mape": f"AVG(CASE WHEN {y} != 0 THEN abs(({y} - {p}) / {y}) END) * 100",
            "r2": f"1 - SUM(({y} - {p}) * ({y} - {p})) / SUM(({y} - {ybar}) * ({y} - {ybar}))"}


def erf(z: str, terms: int = 200) -> str:
    """Error function of a non-negative expression by its positive series."""
    return (f"(CASE WHEN {z} = 0 THEN 0 WHEN {z} > 6 THEN 1 ELSE 2 / sqrt(pi()) * exp(-({z}) * ({z})) * list_sum(list_transform("
            f"range(0, {terms}), lambda k: exp(2 * k * ln(2) + lgamma(k + 1) + (2 * k + 1) * ln({z}) - lgamma(2 * k + 2)))) END)")


def best_lambda(rows: str, kind: str, keys: Sequence[str] = (), half: float = 10.0, points: int = 25, passes: int = 6) -> str:
    """CTEs that search the lambda of greatest likelihood for ``x`` of the CTE ``rows`` on ever finer grids;
    the last one, ``lam``, has keys and ``lam``."""
    kc = "".join(f"{k}, " for k in keys)
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    using = f" JOIN {{}} USING ({', '.join(keys)})" if keys else " CROSS JOIN {}"
    if kind == "box_cox":
        val = "CASE WHEN abs(lam) < 1e-8 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END"
        jac = "SUM(ln(x))"
    else:
        val = ("CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-8 THEN ln(x + 1) ELSE (pow(x + 1, lam) - 1) / lam END "
               "ELSE CASE WHEN abs(2 - lam) < 1e-8 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END")
        jac = "SUM(sign(x) * ln(1 + abs(x)))"
    out = [f"l0 AS (SELECT DISTINCT {kc}0.0::DOUBLE AS lam FROM {rows})"]
    step = half / points
    for n in range(passes):
        out.append(f"g{n} AS (SELECT {kc}lam + {step!r}::DOUBLE * i AS lam FROM l{n}, range({-points}, {points + 1}) t(i))")
        out.append(f"s{n} AS (SELECT {kc}lam, (lam - 1) * {jac} - COUNT(x) / 2.0 * ln(var_pop({val})) AS ll FROM {rows}"
                   f"{using.format(f'g{n}')} WHERE x IS NOT NULL GROUP BY {kc}lam)")
        out.append(f"l{n + 1} AS MATERIALIZED (SELECT {kc}arg_max(lam, ll) AS lam FROM s{n}{grp})")
        step /= points / 2
    out.append(f"lam AS (SELECT * FROM l{passes})")
    return ",\n".join(out)
