"""Positions: latitude bands, ellipsoidal distance and speed, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Ellipsoid axes (m), flattening, metres in a nautical mile.
SEMI_MAJOR_M = 6378137.0
SEMI_MINOR_M = 6356752.3142
FLATTENING = 1 / 298.257222101
METRES_PER_NM = 1852.0

# Latitude band of each complex (south, north).
AREA_BANDS = {"Dusky": (-45.82, -45.48), "Doubtful": (-45.5, -45.15)}

# Each round shrinks the error by the flattening, so six reach double precision, but near
# the antipode, where the rounds may not converge at all.
VINCENTY_ROUNDS = 6
CONVERGED = 1e-12


def _vincenty_steps(lon1: str, lat1: str, lon2: str, lat2: str) -> dict[str, str]:
    """Named steps of Vincenty's inverse formula, each using the ones before it."""
    a, b, f = f"{SEMI_MAJOR_M!r}D", f"{SEMI_MINOR_M!r}D", f"{FLATTENING!r}D"
    steps = {
        "dl": f"radians({lon2} - {lon1})",
        "u1": f"atan((1 - {f}) * tan(radians({lat1})))",
        "u2": f"atan((1 - {f}) * tan(radians({lat2})))",
        "s1": "sin(@u1)", "c1": "cos(@u1)", "s2": "sin(@u2)", "c2": "cos(@u2)",
        "lam0": "@dl",
    }
    for i in range(VINCENTY_ROUNDS + 1):
        sphere = {
            "p#": "@c2 * sin(@lam#)",
            "q#": "@c1 * @s2 - @s1 * @c2 * cos(@lam#)",
            "ss#": "sqrt(@p# * @p# + @q# * @q#)",
            "cs#": "@s1 * @s2 + @c1 * @c2 * cos(@lam#)",
            "arc#": "atan2(@ss#, @cs#)",
            "sa#": "try_divide(@c1 * @c2 * sin(@lam#), @ss#)",
            "ca#": "1 - @sa# * @sa#",
            # along the equator the mid-point term drops out
            "mid#": "coalesce(@cs# - try_divide(2 * @s1 * @s2, @ca#), 0D)",
        }
        if i < VINCENTY_ROUNDS:
            sphere["k#"] = f"{f} / 16 * @ca# * (4 + {f} * (4 - 3 * @ca#))"
            sphere[f"lam{i + 1}"] = (
                f"@dl + (1 - @k#) * {f} * @sa# * (@arc# + @k# * @ss# * "
                "(@mid# + @k# * @cs# * (2 * @mid# * @mid# - 1)))"
            )
        steps.update({n.replace("#", str(i)): e.replace("#", str(i)) for n, e in sphere.items()})
    last = str(VINCENTY_ROUNDS)
    closing = {
        "usq": f"@ca# * (({a} * {a} - {b} * {b}) / ({b} * {b}))",
        "ba": "1 + @usq / 16384 * (4096 + @usq * (-768 + @usq * (320 - 175 * @usq)))",
        "bb": "@usq / 1024 * (256 + @usq * (-128 + @usq * (74 - 47 * @usq)))",
        "tail": "@bb / 6 * @mid# * (4 * @ss# * @ss# - 3) * (4 * @mid# * @mid# - 3)",
        "turn": "@bb * @ss# * (@mid# + @bb / 4 * (@cs# * (2 * @mid# * @mid# - 1) - @tail))",
        "metres": f"CASE WHEN {lon1} = {lon2} AND {lat1} = {lat2} THEN 0D "
        f"WHEN abs(@lam# - @lam{VINCENTY_ROUNDS - 1}) <= {CONVERGED!r}D THEN {b} * @ba * (@arc# - @turn) END",
    }
    steps.update({n: e.replace("#", last) for n, e in closing.items()})
    return steps


def with_metres(
    df: DataFrame, out: str, lon1: str, lat1: str, lon2: str, lat2: str
) -> DataFrame:
    """Add the ellipsoidal distance in metres between two positions of each row.

    NULL in, NULL out; coincident positions give 0; nearly antipodal ones, on which the
    rounds do not agree, NULL. The steps are lateral aliases of
    one select: Catalyst stacks them as projections, so every step is computed once
    inside whole-stage codegen, without lambdas or UDFs.
    """
    steps = _vincenty_steps(lon1, lat1, lon2, lat2)
    texts = [f"{e.replace('@', '__v_')} AS __v_{n}" for n, e in steps.items()]
    return df.selectExpr("*", *texts).withColumn(out, F.col("__v_metres")).drop(
        *[f"__v_{n}" for n in steps]
    )


def with_nautical_miles(
    df: DataFrame, out: str, lon1: str, lat1: str, lon2: str, lat2: str
) -> DataFrame:
    measured = with_metres(df, out, lon1, lat1, lon2, lat2)
    return measured.withColumn(out, F.col(out) / METRES_PER_NM)


def speed_kts(dist_nm: Column, seconds: Column) -> Column:
    return F.try_divide(dist_nm, seconds) * 3600


def in_band(latitude: Column, area: str) -> Column:
    south, north = AREA_BANDS[area]
    return latitude.between(south, north)
