"""Orbit models as column expressions.

A model says which columns of an element row it needs (``columns``), derives them
once per element (``prepare``), and turns them into a state at a time
(``state_at``). Every step is a plain projection, so Catalyst keeps propagation
inside whole-stage code generation and no Python worker is started.

A model's ``state_at`` reads ``{prefix}{column}`` and adds ``{out}x .. {out}vz``
(km, km/s) and ``{out}error`` (null when the state is valid).
"""

from __future__ import annotations

from math import pi
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K

STATE = ("x", "y", "z", "vx", "vy", "vz")
TWO_PI = 2.0 * pi
NEWTON_STEPS = 5
#: A larger error of the eccentric anomaly (radians) makes a state invalid.
RESIDUAL_LIMIT = 1e-10
# Mean sidereal angle: turns at 2000-01-01 12:00 UTC and turns per day.
SIDEREAL_AT_J2000 = 0.7790572732640
SIDEREAL_RATE = 1.00273781191135448
J2000_SECONDS = 946728000.0


class OrbitModel(Protocol):
    columns: tuple[str, ...]
    minimum_radius_km: float

    def prepare(self, elements: DataFrame) -> DataFrame: ...

    def state_at(self, df: DataFrame, at_us: str, prefix: str = "", out: str = "") -> DataFrame: ...


class KeplerJ2:
    """Kepler motion with the secular J2 drift of node, perigee and mean anomaly."""

    columns = (
        "k_epoch_us", "k_e", "k_a", "k_b", "k_n", "k_m0", "k_mdot",
        "k_node0", "k_nodedot", "k_peri0", "k_peridot", "k_cosi", "k_sini",
    )
    minimum_radius_km = K.WGS72_RADIUS_KM

    def prepare(self, elements: DataFrame) -> DataFrame:
        ecc, inc = F.col("eccentricity"), F.radians("inclination")
        valid = (ecc >= 0.0) & (ecc < 1.0) & (F.col("mean_motion") > 0.0)
        n = F.col("k_n")
        return (
            elements.withColumns(
                {
                    "k_epoch_us": F.unix_micros("epoch"),
                    "k_e": F.when(valid, ecc),
                    "k_n": F.when(valid, F.col("mean_motion") * (TWO_PI / 86400.0)),
                    "k_cosi": F.cos(inc),
                    "k_sini": F.sin(inc),
                    "k_m0": F.radians("mean_anomaly"),
                    "k_node0": F.radians("ra_of_asc_node"),
                    "k_peri0": F.radians("arg_of_pericenter"),
                }
            )
            .withColumn("k_a", F.pow(K.WGS72_MU_KM3_S2 / (n * n), F.lit(1.0 / 3.0)))
            .withColumn("k_b", F.sqrt(1.0 - F.col("k_e") * F.col("k_e")))
            .withColumn(
                "_drift",
                1.5 * K.WGS72_J2 * n
                * F.pow(K.WGS72_RADIUS_KM / (F.col("k_a") * F.col("k_b") * F.col("k_b")), F.lit(2.0)),
            )
            .withColumns(
                {
                    "k_nodedot": -F.col("_drift") * F.col("k_cosi"),
                    "k_peridot": F.col("_drift") * (2.0 - 2.5 * F.col("k_sini") * F.col("k_sini")),
                    "k_mdot": n
                    + F.col("_drift") * F.col("k_b") * (1.0 - 1.5 * F.col("k_sini") * F.col("k_sini")),
                }
            )
            .drop("_drift")
        )

    def state_at(self, df: DataFrame, at_us: str, prefix: str = "", out: str = "") -> DataFrame:
        """Each step is an alias that later steps of the same ``select`` refer to.

        ``$name`` is a model column of the element row.
        """
        steps = [
            f"({at_us} - $k_epoch_us) / 1e6D AS _dt",
            "$k_m0 + $k_mdot * _dt AS _turned",
            "$k_node0 + $k_nodedot * _dt AS _node",
            "$k_peri0 + $k_peridot * _dt AS _peri",
            f"_turned - {TWO_PI!r}D * floor(_turned / {TWO_PI!r}D) AS _m",
            "_m + $k_e * sin(_m) AS _e0",
        ]
        for i in range(NEWTON_STEPS):
            steps.append(f"_e{i} - (_e{i} - $k_e * sin(_e{i}) - _m) / (1.0D - $k_e * cos(_e{i})) AS _e{i + 1}")
        steps += [
            f"abs(_e{NEWTON_STEPS} - $k_e * sin(_e{NEWTON_STEPS}) - _m) AS _residual",
            f"cos(_e{NEWTON_STEPS}) AS _ce",
            f"sin(_e{NEWTON_STEPS}) AS _se",
            "cos(_peri) AS _cw",
            "sin(_peri) AS _sw",
            "cos(_node) AS _cn",
            "sin(_node) AS _sn",
            "$k_a * (1.0D - $k_e * _ce) AS _r",
            "$k_a * $k_n / (1.0D - $k_e * _ce) AS _rate",
            "$k_a * (_ce - $k_e) AS _px",
            "$k_a * $k_b * _se AS _py",
            "-_rate * _se AS _pvx",
            "_rate * $k_b * _ce AS _pvy",
            "_cn * _cw - _sn * _sw * $k_cosi AS _xa",
            "-_cn * _sw - _sn * _cw * $k_cosi AS _xb",
            "_sn * _cw + _cn * _sw * $k_cosi AS _ya",
            "-_sn * _sw + _cn * _cw * $k_cosi AS _yb",
            "_sw * $k_sini AS _za",
            "_cw * $k_sini AS _zb",
        ]
        fields = [
            f"_{axis}a * _p{kind}x + _{axis}b * _p{kind}y AS _out_{kind}{axis}"
            for kind in ("", "v")
            for axis in "xyz"
        ]
        fields.append(
            "CASE WHEN _r IS NULL THEN 'elements outside the model''s range' "
            f"WHEN NOT _residual <= {RESIDUAL_LIMIT!r}D THEN 'anomaly did not converge' "
            f"WHEN _r < {K.WGS72_RADIUS_KM!r}D THEN 'object has decayed' END AS _out_error"
        )
        # The state comes out of a one-row generator. A filter on a state column
        # then stays above it; pushed down through the steps, it would be rewritten
        # over all of them at once and grow beyond any use. Its fields are worked out
        # before, as a generator outside of whole-stage code is interpreted.
        kept = df.columns
        worked = df.selectExpr("*", *[step.replace("$", prefix) for step in steps]).selectExpr(*kept, *fields)
        named = ", ".join(f"_out_{c} AS {out}{c}" for c in (*STATE, "error"))
        return worked.selectExpr(*kept, f"inline(array(struct({named})))")


class StraightLine:
    """Constant velocity from a position at epoch: ``x0 .. vz0`` at ``epoch``."""

    columns = ("k_epoch_us", "x0", "y0", "z0", "vx0", "vy0", "vz0")

    def __init__(self, minimum_radius_km: float = 0.0) -> None:
        self.minimum_radius_km = minimum_radius_km

    def prepare(self, elements: DataFrame) -> DataFrame:
        return elements.withColumn("k_epoch_us", F.unix_micros("epoch"))

    def state_at(self, df: DataFrame, at_us: str, prefix: str = "", out: str = "") -> DataFrame:
        dt = (F.col(at_us) - F.col(prefix + "k_epoch_us")) / F.lit(1e6)
        position = {
            f"{out}{axis}": F.col(f"{prefix}{axis}0") + F.col(f"{prefix}v{axis}0") * dt for axis in "xyz"
        }
        velocity = {f"{out}v{axis}": F.col(f"{prefix}v{axis}0") for axis in "xyz"}
        return df.withColumns(position).withColumns(velocity).withColumn(
            f"{out}error",
            F.when(F.col(f"{out}x").isNull(), F.lit("elements outside the model's range")),
        )


def earth_fixed(df: DataFrame, at_us: str) -> DataFrame:
    """Rotate ``x .. vz`` from the inertial to the earth-fixed frame.

    The rotation angle is the mean sidereal time of the instant; the velocity also
    loses the frame's own rotation.
    """
    turn = TWO_PI * SIDEREAL_RATE / 86400.0
    kept = [c for c in df.columns if c not in STATE]
    turned = df.selectExpr(
        *kept,
        *[f"{c} AS _{c}" for c in STATE],
        f"{SIDEREAL_AT_J2000!r}D + {SIDEREAL_RATE!r}D * (({at_us} / 1e6D - {J2000_SECONDS!r}D) / 86400.0D) AS _turns",
        f"{TWO_PI!r}D * (_turns - floor(_turns)) AS _theta",
        "cos(_theta) AS _c",
        "sin(_theta) AS _s",
        "_c * _x + _s * _y AS _fx",
        "_c * _y - _s * _x AS _fy",
        f"_c * _vx + _s * _vy + {turn!r}D * _fy AS _fvx",
        f"_c * _vy - _s * _vx - {turn!r}D * _fx AS _fvy",
    )
    return turned.selectExpr(
        *kept, "_fx AS x", "_fy AS y", "_z AS z", "_fvx AS vx", "_fvy AS vy", "_vz AS vz"
    )
