"""The general perturbation model of published element sets (SGP4 and SDP4), after Hoots and
Roehrich (1980) and the revision of Vallado, Crawford, Hujsak and Kelso (2006), with the
constants of 1972, as column expressions.

The formulas stand below as blocks of named steps in plain SQL arithmetic. ``levels`` sorts
the steps of a block by what they need, so that a block becomes a short chain of
projections. Constants of an element are worked out once (``prepare``) and travel in two
structs: ``k_near``, and ``k_deep``, which is null for periods below 225 minutes. Steps that
read a null ``k_deep`` are null and cost nothing; where they join the others, null counts as
no change. No Python worker is started.

A state that the model refuses has its published error number and text in ``error``.
"""

from __future__ import annotations

import re
from collections import Counter
from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe import constants as K

TWO_PI = 2.0 * pi
RADIUS = K.WGS72_RADIUS_KM
XKE = 60.0 / (RADIUS**3 / K.WGS72_MU_KM3_S2) ** 0.5
J2, J3, J4 = K.WGS72_J2, K.WGS72_J3, K.WGS72_J4
#: Newton steps for the eccentric longitude; each is at most 0.95.
NEWTON_STEPS = 10
#: Minutes of one step of the resonance integration.
RESONANCE_STEP = 720.0
#: Letters up to which a step is written out where it is used: if used once, and in all
#: places together if used more often.
MOST_ONCE, MOST_OFTEN = 1500, 240
#: Radians the earth turns in a minute.
EARTH_RATE = 4.37526908801129966e-3

# Fixed values of the model: mean motions and eccentricities of sun and moon, resonance
# coefficients and phases.
ZNS, ZES, ZNL, ZEL = 1.19459e-5, 0.01675, 1.5835218e-4, 0.05490
PHASES = {"1": 0.13130908, "2": 2.8843198, "3": 0.37448087, "22": 5.7686396, "32": 0.95240898, "44": 1.8014998, "52": 1.0508330, "54": 4.4108898}
ERRORS = {
    1: "mean eccentricity is outside the range 0.0 to 1.0",
    2: "nm is less than zero",
    3: "perturbed eccentricity is outside the range 0.0 to 1.0",
    4: "semilatus rectum is less than zero",
    6: "mrt is less than 1.0 which indicates the satellite has decayed",
}

#: Resonance terms: (coefficient, multiple of the perigee, multiple of the longitude, phase).
SYNCHRONOUS = [("del1", 0, 1, PHASES["1"]), ("del2", 0, 2, 2 * PHASES["2"]), ("del3", 0, 3, 3 * PHASES["3"])]
HALF_DAY = [
    ("d2201", 2, 1, PHASES["22"]), ("d2211", 0, 1, PHASES["22"]), ("d3210", 1, 1, PHASES["32"]),
    ("d3222", -1, 1, PHASES["32"]), ("d4410", 2, 2, PHASES["44"]), ("d4422", 0, 2, PHASES["44"]),
    ("d5220", 1, 1, PHASES["52"]), ("d5232", -1, 1, PHASES["52"]), ("d5421", 1, 2, PHASES["54"]),
    ("d5433", -1, 2, PHASES["54"]),
]
TERMS = SYNCHRONOUS + HALF_DAY

Steps = list[tuple[str, str]]

# From an element set to its constants. Angles in radians, time in minutes, lengths in earth
# radii. A null e or n (outside the model's range) makes all constants null.
NEAR_CONSTANTS = f"""
e2 = e * e
beta2 = 1 - e2
beta = sqrt(beta2)
ci = cos(inc)
si = sin(inc)
ci2 = ci * ci
a1 = pow({XKE!r} / n_mean, 2.0 / 3)
drift = 0.75 * {J2} * (3 * ci2 - 1) / (beta * beta2)
step1 = drift / (a1 * a1)
a0 = a1 * (1 - step1 * step1 - step1 * (1.0 / 3 + 134 * step1 * step1 / 81))
step0 = drift / (a0 * a0)
no = n_mean / (1 + step0)
deep = CASE WHEN {TWO_PI!r} / no >= 225 THEN 1 ELSE 0 END
ao = pow({XKE!r} / no, 2.0 / 3)
po = ao * beta2
con42 = 1 - 5 * ci2
con41 = 3 * ci2 - 1
x1mth2 = 1 - ci2
perigee = (ao * (1 - e) - 1) * {RADIUS}
low = CASE WHEN deep = 1 OR perigee < 220 THEN 1 ELSE 0 END
s_km = CASE WHEN perigee < 98 THEN 20 WHEN perigee < 156 THEN perigee - 78 ELSE 78 END
sfour = 1 + s_km / {RADIUS}
qzms = pow((120 - s_km) / {RADIUS}, 4)
tsi = 1 / (ao - sfour)
eta = ao * e * tsi
eta2 = eta * eta
eeta = e * eta
psi2 = abs(1 - eta2)
coef = qzms * pow(tsi, 4)
coef1 = coef / pow(psi2, 3.5)
cc2 = coef1 * no * (ao * (1 + 1.5 * eta2 + eeta * (4 + eta2)) + 0.375 * {J2} * tsi / psi2 * con41 * (8 + 3 * eta2 * (8 + eta2)))
cc1 = bstar * cc2
cc3 = CASE WHEN e > 0.0001 THEN -2 * coef * tsi * {J3 / J2!r} * no * si / e ELSE 0 END
cc4 = 2 * no * coef1 * ao * beta2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - {J2} * tsi / (ao * psi2) * (-3 * con41 * (1 - 2 * eeta + eta2 * (1.5 - 0.5 * eeta)) + 0.75 * x1mth2 * (2 * eta2 - eeta * (1 + eta2)) * cos(2 * argpo)))
cc5 = CASE WHEN low = 1 THEN 0 ELSE 2 * coef1 * ao * beta2 * (1 + 2.75 * (eta2 + eeta) + eeta * eta2) END
ci4 = ci2 * ci2
h1 = 1.5 * {J2} * no / (po * po)
h2 = 0.5 * h1 * {J2} / (po * po)
h3 = -0.46875 * {J4} * no / pow(po, 4)
mdot = no + 0.5 * h1 * beta * con41 + 0.0625 * h2 * beta * (13 - 78 * ci2 + 137 * ci4)
argpdot = -0.5 * h1 * con42 + 0.0625 * h2 * (7 - 114 * ci2 + 395 * ci4) + h3 * (3 - 36 * ci2 + 49 * ci4)
xhdot1 = -h1 * ci
nodedot = xhdot1 + (0.5 * h2 * (4 - 19 * ci2) + 2 * h3 * (3 - 7 * ci2)) * ci
omgcof = CASE WHEN low = 1 THEN 0 ELSE bstar * cc3 * cos(argpo) END
xmcof = CASE WHEN low = 1 OR e <= 0.0001 THEN 0 ELSE -2.0 / 3 * coef * bstar / eeta END
nodecf = 3.5 * beta2 * xhdot1 * cc1
t2cof = 1.5 * cc1
delmo = pow(1 + eta * cos(mo), 3)
sinmao = sin(mo)
f1 = CASE WHEN low = 1 THEN 0 ELSE cc1 END
d2 = 4 * ao * tsi * f1 * f1
d3 = (17 * ao + sfour) * d2 * tsi * f1 / 3
d4 = 0.5 * d2 * tsi * f1 / 3 * ao * tsi * (221 * ao + 31 * sfour) * f1
t3cof = d2 + 2 * f1 * f1
t4cof = 0.25 * (3 * d3 + f1 * (12 * d2 + 10 * f1 * f1))
t5cof = 0.2 * (3 * d4 + 12 * f1 * d3 + 6 * d2 * d2 + 15 * f1 * f1 * (2 * d2 + f1 * f1))
bcc4 = bstar * cc4
bcc5 = bstar * cc5
"""
NEAR = (
    "e inc nodeo argpo mo no eta mdot argpdot nodedot nodecf omgcof xmcof cc1 bcc4 bcc5 "
    "t2cof t3cof t4cof t5cof d2 d3 d4 delmo sinmao"
).split()


def _third_body(p: str, cosg: str, sing: str, cosi: str, sini: str, cosh: str, sinh: str, strength: str) -> str:
    """Coefficients of the pull of sun or moon; the arguments give its orbit's attitude."""
    return f"""
{p}a1 = {cosg} * {cosh} + {sing} * {cosi} * {sinh}
{p}a3 = -{sing} * {cosh} + {cosg} * {cosi} * {sinh}
{p}a7 = -{cosg} * {sinh} + {sing} * {cosi} * {cosh}
{p}a8 = {sing} * {sini}
{p}a9 = {sing} * {sinh} + {cosg} * {cosi} * {cosh}
{p}a10 = {cosg} * {sini}
{p}a2 = ci * {p}a7 + si * {p}a8
{p}a4 = ci * {p}a9 + si * {p}a10
{p}a5 = -si * {p}a7 + ci * {p}a8
{p}a6 = -si * {p}a9 + ci * {p}a10
{p}x1 = {p}a1 * cosw + {p}a2 * sinw
{p}x2 = {p}a3 * cosw + {p}a4 * sinw
{p}x3 = -{p}a1 * sinw + {p}a2 * cosw
{p}x4 = -{p}a3 * sinw + {p}a4 * cosw
{p}x5 = {p}a5 * sinw
{p}x6 = {p}a6 * sinw
{p}x7 = {p}a5 * cosw
{p}x8 = {p}a6 * cosw
{p}z31 = 12 * {p}x1 * {p}x1 - 3 * {p}x3 * {p}x3
{p}z32 = 24 * {p}x1 * {p}x2 - 6 * {p}x3 * {p}x4
{p}z33 = 12 * {p}x2 * {p}x2 - 3 * {p}x4 * {p}x4
{p}z1 = 6 * ({p}a1 * {p}a1 + {p}a2 * {p}a2) + {p}z31 * (1 + e2)
{p}z2 = 12 * ({p}a1 * {p}a3 + {p}a2 * {p}a4) + {p}z32 * (1 + e2)
{p}z3 = 6 * ({p}a3 * {p}a3 + {p}a4 * {p}a4) + {p}z33 * (1 + e2)
{p}z11 = -6 * {p}a1 * {p}a5 + e2 * (-24 * {p}x1 * {p}x7 - 6 * {p}x3 * {p}x5)
{p}z12 = -6 * ({p}a1 * {p}a6 + {p}a3 * {p}a5) + e2 * (-24 * ({p}x2 * {p}x7 + {p}x1 * {p}x8) - 6 * ({p}x3 * {p}x6 + {p}x4 * {p}x5))
{p}z13 = -6 * {p}a3 * {p}a6 + e2 * (-24 * {p}x2 * {p}x8 - 6 * {p}x4 * {p}x6)
{p}z21 = 6 * {p}a2 * {p}a5 + e2 * (24 * {p}x1 * {p}x5 - 6 * {p}x3 * {p}x7)
{p}z22 = 6 * ({p}a4 * {p}a5 + {p}a2 * {p}a6) + e2 * (24 * ({p}x2 * {p}x5 + {p}x1 * {p}x6) - 6 * ({p}x4 * {p}x7 + {p}x3 * {p}x8))
{p}z23 = 6 * {p}a4 * {p}a6 + e2 * (24 * {p}x2 * {p}x6 - 6 * {p}x4 * {p}x8)
{p}s3 = {strength} / no
{p}s2 = -0.5 * {p}s3 / beta
{p}s4 = {p}s3 * beta
{p}s1 = -15 * e * {p}s4
{p}s5 = {p}x1 * {p}x3 + {p}x2 * {p}x4
{p}s6 = {p}x2 * {p}x3 + {p}x1 * {p}x4
{p}s7 = {p}x2 * {p}x4 - {p}x1 * {p}x3
"""


def _periodics(p: str, ecc: float) -> str:
    """Coefficients of the periodic terms of sun or moon."""
    return f"""
{p}e2 = 2 * {p}s1 * {p}s6
{p}e3 = 2 * {p}s1 * {p}s7
{p}i2 = 2 * {p}s2 * {p}z12
{p}i3 = 2 * {p}s2 * ({p}z13 - {p}z11)
{p}l2 = -2 * {p}s3 * {p}z2
{p}l3 = -2 * {p}s3 * ({p}z3 - {p}z1)
{p}l4 = -2 * {p}s3 * (-21 - 9 * e2) * {ecc}
{p}g2 = 2 * {p}s4 * {p}z32
{p}g3 = 2 * {p}s4 * ({p}z33 - {p}z31)
{p}g4 = -18 * {p}s4 * {ecc}
{p}h2 = -2 * {p}s2 * {p}z22
{p}h3 = -2 * {p}s2 * ({p}z23 - {p}z21)
"""


PERIODIC = "e2 e3 i2 i3 l2 l3 l4 g2 g3 g4 h2 h3".split()

DEEP_CONSTANTS = (
    f"""
day = days_1950 + 18261.5
cosn = cos(nodeo)
sinn = sin(nodeo)
cosw = cos(argpo)
sinw = sin(argpo)
xnodce = (4.5236020 - 9.2422029e-4 * day) % {TWO_PI!r}
stem = sin(xnodce)
ctem = cos(xnodce)
zcosil = 0.91375164 - 0.03568096 * ctem
zsinil = sqrt(1 - zcosil * zcosil)
zsinhl = 0.089683511 * stem / zsinil
zcoshl = sqrt(1 - zsinhl * zsinhl)
gam = 5.8351514 + 0.0019443680 * day
zx = gam + atan2(0.39785416 * stem / zsinil, zcoshl * ctem + 0.91744867 * zsinhl * stem) - xnodce
zcosgl = cos(zx)
zsingl = sin(zx)
zcosh = zcoshl * cosn + zsinhl * sinn
zsinh = sinn * zcoshl - cosn * zsinhl
zmol = (4.7199672 + 0.22997150 * day - gam) % {TWO_PI!r}
zmos = (6.2565837 + 0.017201977 * day) % {TWO_PI!r}
"""
    + _third_body("s_", "0.1945905", "(-0.98088458)", "0.91744867", "0.39785416", "cosn", "sinn", "2.9864797e-6")
    + _third_body("l_", "zcosgl", "zsingl", "zcosil", "zsinil", "zcosh", "zsinh", "4.7968065e-7")
    + _periodics("s_", ZES)
    + _periodics("l_", ZEL)
    + f"""
polar = CASE WHEN inc < 5.2359877e-2 OR inc > {pi!r} - 5.2359877e-2 THEN 1 ELSE 0 END
dedt = s_s1 * {ZNS} * s_s5 + l_s1 * {ZNL} * l_s5
didt = s_s2 * {ZNS} * (s_z11 + s_z13) + l_s2 * {ZNL} * (l_z11 + l_z13)
dmdt = -{ZNS} * s_s3 * (s_z1 + s_z3 - 14 - 6 * e2) - {ZNL} * l_s3 * (l_z1 + l_z3 - 14 - 6 * e2)
s_h = CASE WHEN polar = 1 THEN 0 WHEN si = 0 THEN -{ZNS} * s_s2 * (s_z21 + s_z23) ELSE -{ZNS} * s_s2 * (s_z21 + s_z23) / si END
l_h = CASE WHEN polar = 1 OR si = 0 THEN 0 ELSE -{ZNL} * l_s2 * (l_z21 + l_z23) / si END
dnodt = s_h + l_h
domdt = s_s4 * {ZNS} * (s_z31 + s_z33 - 6) - ci * s_h + l_s4 * {ZNL} * (l_z31 + l_z33 - 6) - ci * l_h
turns = days_1950 - 18263.5
tut1 = turns / 36525
gst = ((-6.2e-6 * tut1 * tut1 * tut1 + 0.093104 * tut1 * tut1 + (3155760000 + 8640184.812866) * tut1 + 67310.54841) * {pi / 180 / 240!r}) % {TWO_PI!r}
gsto = CASE WHEN gst < 0 THEN gst + {TWO_PI!r} ELSE gst END
irez = CASE WHEN no > 0.0034906585 AND no < 0.0052359877 THEN 1 WHEN no >= 0.00826 AND no <= 0.00924 AND e >= 0.5 THEN 2 ELSE 0 END
aonv = pow(no / {XKE!r}, 2.0 / 3)
whole = 3 * no * no * aonv * aonv
del1 = CASE WHEN irez = 1 THEN whole * (0.9375 * si * si * (1 + 3 * ci) - 0.75 * (1 + ci)) * (1 + 2 * e2) * 2.1460748e-6 * aonv ELSE 0 END
del2 = CASE WHEN irez = 1 THEN 2 * whole * 0.75 * (1 + ci) * (1 + ci) * (1 + e2 * (-2.5 + 0.8125 * e2)) * 1.7891679e-6 ELSE 0 END
del3 = CASE WHEN irez = 1 THEN 3 * whole * 1.875 * pow(1 + ci, 3) * (1 + e2 * (-6 + 6.60937 * e2)) * 2.2123015e-7 * aonv ELSE 0 END
e3 = e * e2
g201 = -0.306 - (e - 0.64) * 0.440
g211 = CASE WHEN e <= 0.65 THEN 3.616 - 13.2470 * e + 16.2900 * e2 ELSE -72.099 + 331.819 * e - 508.738 * e2 + 266.724 * e3 END
g310 = CASE WHEN e <= 0.65 THEN -19.302 + 117.3900 * e - 228.4190 * e2 + 156.5910 * e3 ELSE -346.844 + 1582.851 * e - 2415.925 * e2 + 1246.113 * e3 END
g322 = CASE WHEN e <= 0.65 THEN -18.9068 + 109.7927 * e - 214.6334 * e2 + 146.5816 * e3 ELSE -342.585 + 1554.908 * e - 2366.899 * e2 + 1215.972 * e3 END
g410 = CASE WHEN e <= 0.65 THEN -41.122 + 242.6940 * e - 471.0940 * e2 + 313.9530 * e3 ELSE -1052.797 + 4758.686 * e - 7193.992 * e2 + 3651.957 * e3 END
g422 = CASE WHEN e <= 0.65 THEN -146.407 + 841.8800 * e - 1629.014 * e2 + 1083.4350 * e3 ELSE -3581.690 + 16178.110 * e - 24462.770 * e2 + 12422.520 * e3 END
g520 = CASE WHEN e <= 0.65 THEN -532.114 + 3017.977 * e - 5740.032 * e2 + 3708.2760 * e3 WHEN e > 0.715 THEN -5149.66 + 29936.92 * e - 54087.36 * e2 + 31324.56 * e3 ELSE 1464.74 - 4664.75 * e + 3763.64 * e2 END
g533 = CASE WHEN e < 0.7 THEN -919.22770 + 4988.6100 * e - 9064.7700 * e2 + 5542.21 * e3 ELSE -37995.780 + 161616.52 * e - 229838.20 * e2 + 109377.94 * e3 END
g521 = CASE WHEN e < 0.7 THEN -822.71072 + 4568.6173 * e - 8491.4146 * e2 + 5337.524 * e3 ELSE -51752.104 + 218913.95 * e - 309468.16 * e2 + 146349.42 * e3 END
g532 = CASE WHEN e < 0.7 THEN -853.66600 + 4690.2500 * e - 8624.7700 * e2 + 5341.4 * e3 ELSE -40023.880 + 170470.89 * e - 242699.48 * e2 + 115605.82 * e3 END
si2 = si * si
f220 = 0.75 * (1 + 2 * ci + ci2)
f221 = 1.5 * si2
f321 = 1.875 * si * (1 - 2 * ci - 3 * ci2)
f322 = -1.875 * si * (1 + 2 * ci - 3 * ci2)
f441 = 35 * si2 * f220
f442 = 39.3750 * si2 * si2
f522 = 9.84375 * si * (si2 * (1 - 2 * ci - 5 * ci2) + 0.33333333 * (-2 + 4 * ci + 6 * ci2))
f523 = si * (4.92187512 * si2 * (-2 - 4 * ci + 10 * ci2) + 6.56250012 * (1 + 2 * ci - 3 * ci2))
f542 = 29.53125 * si * (2 - 8 * ci + ci2 * (-12 + 8 * ci + 10 * ci2))
f543 = 29.53125 * si * (-2 - 8 * ci + ci2 * (12 + 8 * ci - 10 * ci2))
r2 = CASE WHEN irez = 2 THEN whole * 1.7891679e-6 ELSE 0 END
r3 = CASE WHEN irez = 2 THEN whole * aonv * 3.7393792e-7 ELSE 0 END
r4 = CASE WHEN irez = 2 THEN 2 * whole * aonv * aonv * 7.3636953e-9 ELSE 0 END
r52 = CASE WHEN irez = 2 THEN whole * pow(aonv, 3) * 1.1428639e-7 ELSE 0 END
r54 = CASE WHEN irez = 2 THEN 2 * whole * pow(aonv, 3) * 2.1765803e-9 ELSE 0 END
d2201 = r2 * f220 * g201
d2211 = r2 * f221 * g211
d3210 = r3 * f321 * g310
d3222 = r3 * f322 * g322
d4410 = r4 * f441 * g410
d4422 = r4 * f442 * g422
d5220 = r52 * f522 * g520
d5232 = r52 * f523 * g532
d5421 = r54 * f542 * g521
d5433 = r54 * f543 * g533
theta0 = gsto % {TWO_PI!r}
xlamo = CASE irez WHEN 1 THEN (mo + nodeo + argpo - theta0) % {TWO_PI!r} WHEN 2 THEN (mo + 2 * nodeo - 2 * theta0) % {TWO_PI!r} END
xfact = CASE irez WHEN 1 THEN mdot + argpdot + nodedot - {EARTH_RATE!r} + dmdt + domdt + dnodt - no WHEN 2 THEN mdot + dmdt + 2 * (nodedot + dnodt - {EARTH_RATE!r}) - no END
"""
)
DEEP = (
    [f"{p}{x}" for p in ("s_", "l_") for x in PERIODIC]
    + "zmos zmol dedt didt dmdt domdt dnodt gsto irez xlamo xfact".split()
    + [t[0] for t in TERMS]
)


def _angles(longitude: str, minutes: str) -> list[tuple[str, int, str]]:
    """(coefficient, multiple of the longitude, angle) of each resonance term."""
    perigee = f"(n.argpo + n.argpdot * {minutes})"
    return [(f"d.{c}", m, f"({w} * {perigee} + {m} * {longitude} - {phase!r})") for c, w, m, phase in TERMS]


def pull(longitude: str, minutes: str) -> str:
    """Change of the mean motion by resonance."""
    return "(" + " + ".join(f"{c} * sin({angle})" for c, _, angle in _angles(longitude, minutes)) + ")"


def pull_rate(longitude: str, minutes: str) -> str:
    """Its derivative by the longitude."""
    return "(" + " + ".join(f"{m} * {c} * cos({angle})" for c, m, angle in _angles(longitude, minutes)) + ")"


def next_longitude(longitude: str, motion: str, minutes: str) -> tuple[str, str]:
    """One step of the resonance integration, ``width`` minutes long."""
    rate = f"({motion} + d.xfact)"
    half = RESONANCE_STEP**2 / 2
    return (
        f"{longitude} + {rate} * width + {pull(longitude, minutes)} * {half!r}",
        f"{motion} + {pull(longitude, minutes)} * width + {pull_rate(longitude, minutes)} * {rate} * {half!r}",
    )


def _body_terms(p: str, start: str, rate: float, ecc: float) -> str:
    """Periodic changes by sun or moon."""
    pull_of = lambda x: f"d.{p}{x}2 * {p}f2 + d.{p}{x}3 * {p}f3"
    return f"""
{p}zm = {start} + {rate} * t
{p}zf = {p}zm + 2 * {ecc} * sin({p}zm)
{p}sin = sin({p}zf)
{p}f2 = 0.5 * {p}sin * {p}sin - 0.25
{p}f3 = -0.5 * {p}sin * cos({p}zf)
{p}pe = {pull_of("e")}
{p}pi = {pull_of("i")}
{p}pl = {pull_of("l")} + d.{p}l4 * {p}sin
{p}pg = {pull_of("g")} + d.{p}g4 * {p}sin
{p}ph = {pull_of("h")}
"""


# From the constants (n. and d.) to a state t minutes after the epoch.
SECULAR = """
xmdf = n.mo + n.mdot * t
turn = n.omgcof * t + n.xmcof * (pow(1 + n.eta * cos(xmdf), 3) - n.delmo)
mm1 = xmdf + turn
argpm = n.argpo + n.argpdot * t - turn + coalesce(d.domdt * t, 0)
nodem = n.nodeo + n.nodedot * t + n.nodecf * t * t + coalesce(d.dnodt * t, 0)
tempa = 1 - n.cc1 * t - t * t * (n.d2 + t * (n.d3 + t * n.d4))
tempe = n.bcc4 * t + n.bcc5 * (sin(mm1) - n.sinmao)
templ = t * t * (n.t2cof + t * (n.t3cof + t * (n.t4cof + t * n.t5cof)))
mm2 = mm1 + coalesce(d.dmdt * t, 0)
inclm = n.inc + coalesce(d.didt * t, 0)
em0 = n.e + coalesce(d.dedt * t, 0) - tempe
width = CASE WHEN t < 0 THEN -720 ELSE 720 END
"""
RESONANCE = f"""
since = whole_steps * width
rest = t - since
xndt = {pull("xli", "since")}
xldot = xni + d.xfact
xnddt = {pull_rate("xli", "since")} * xldot
nm_pulled = xni + xndt * rest + xnddt * rest * rest * 0.5
xl_pulled = xli + xldot * rest + xndt * rest * rest * 0.5
theta = (d.gsto + t * {EARTH_RATE!r}) % {TWO_PI!r}
mm3 = CASE d.irez WHEN 1 THEN xl_pulled - nodem - argpm + theta WHEN 2 THEN xl_pulled - 2 * nodem + 2 * theta ELSE mm2 END
nm0 = coalesce(nm_pulled, n.no)
"""
LONG_PERIOD = (
    f"""
am = pow({XKE!r} / nm0, 2.0 / 3) * tempa * tempa
nm = {XKE!r} / pow(am, 1.5)
em = CASE WHEN em0 < 0.000001 THEN 0.000001 ELSE em0 END
mm4 = mm3 + n.no * templ
node1 = nodem % {TWO_PI!r}
argp1 = argpm % {TWO_PI!r}
mm5 = ((mm4 + argpm + nodem) % {TWO_PI!r} - argp1 - node1) % {TWO_PI!r}
"""
    + _body_terms("s_", "d.zmos", ZNS, ZES)
    + _body_terms("l_", "d.zmol", ZNL, ZEL)
    + f"""
ep = em + coalesce(s_pe + l_pe, 0)
dinc = s_pi + l_pi
inc1 = inclm + coalesce(dinc, 0)
ph = s_ph + l_ph
pg = s_pg + l_pg
pl = s_pl + l_pl
si1 = sin(inc1)
ci1 = cos(inc1)
wide = CASE WHEN inc1 >= 0.2 THEN 1 ELSE 0 END
cosn1 = cos(node1)
sinn1 = sin(node1)
alf = si1 * sinn1 + ph * cosn1 + dinc * ci1 * sinn1
bet = si1 * cosn1 - ph * sinn1 + dinc * ci1 * cosn1
xls = mm5 + argp1 + ci1 * node1 + pl + pg - dinc * node1 * si1
node2 = atan2(alf, bet)
node3 = CASE WHEN abs(node1 - node2) <= {pi!r} THEN node2 WHEN node2 < node1 THEN node2 + {TWO_PI!r} ELSE node2 - {TWO_PI!r} END
mp = mm5 + coalesce(pl, 0)
node4 = CASE WHEN ph IS NULL THEN node1 WHEN wide = 1 THEN node1 + ph / si1 ELSE node3 END
argp4 = CASE WHEN ph IS NULL THEN argp1 WHEN wide = 1 THEN argp1 + pg - ci1 * ph / si1 ELSE xls - mp - ci1 * node3 END
nodep = CASE WHEN inc1 < 0 THEN node4 + {pi!r} ELSE node4 END
argpp = CASE WHEN inc1 < 0 THEN argp4 - {pi!r} ELSE argp4 END
incp = abs(inc1)
sip = sin(incp)
cip = cos(incp)
axnl = ep * cos(argpp)
inv = 1 / (am * (1 - ep * ep))
aynl = ep * sin(argpp) + inv * {-0.5 * J3 / J2!r} * sip
safe = CASE WHEN abs(cip + 1) > 1.5e-12 THEN 1 + cip ELSE 1.5e-12 END
xl = mp + argpp + nodep + inv * {-0.25 * J3 / J2!r} * sip * (3 + 5 * cip) / safe * axnl
u = (xl - nodep) % {TWO_PI!r}
"""
)
KEPLER = "eo0 = u\n" + "".join(
    f"eo{i + 1} = eo{i} + greatest(-0.95, least(0.95, (u - aynl * cos(eo{i}) + axnl * sin(eo{i}) - eo{i})"
    f" / (1 - axnl * cos(eo{i}) - aynl * sin(eo{i}))))\n"
    for i in range(NEWTON_STEPS)
)
SHORT_PERIOD = f"""
seo = sin(eo{NEWTON_STEPS})
ceo = cos(eo{NEWTON_STEPS})
ecose = axnl * ceo + aynl * seo
esine = axnl * seo - aynl * ceo
el2 = axnl * axnl + aynl * aynl
plat = am * (1 - el2)
rl = am * (1 - ecose)
betal = sqrt(1 - el2)
fold = esine / (1 + betal)
sinu = am / rl * (seo - aynl - axnl * fold)
cosu = am / rl * (ceo - axnl + aynl * fold)
sin2u = 2 * cosu * sinu
cos2u = 1 - 2 * sinu * sinu
k1 = 0.5 * {J2} / plat
k2 = k1 / plat
cip2 = cip * cip
mrt = rl * (1 - 1.5 * k2 * betal * (3 * cip2 - 1)) + 0.5 * k1 * (1 - cip2) * cos2u
su = atan2(sinu, cosu) - 0.25 * k2 * (7 * cip2 - 1) * sin2u
xnode = nodep + 1.5 * k2 * cip * sin2u
xinc = incp + 1.5 * k2 * cip * sip * cos2u
mvt = sqrt(am) * esine / rl - nm * k1 * (1 - cip2) * sin2u / {XKE!r}
rvdot = sqrt(plat) / rl + nm * k1 * ((1 - cip2) * cos2u + 1.5 * (3 * cip2 - 1)) / {XKE!r}
sins = sin(su)
coss = cos(su)
sinx = sin(xnode)
cosx = cos(xnode)
sinj = sin(xinc)
cosj = cos(xinc)
ux = -sinx * cosj * sins + cosx * coss
uy = cosx * cosj * sins + sinx * coss
uz = sinj * sins
wx = -sinx * cosj * coss - cosx * sins
wy = cosx * cosj * coss - sinx * sins
wz = sinj * coss
code = CASE WHEN t IS NULL OR nm0 IS NULL THEN 1 WHEN nm0 <= 0 THEN 2 WHEN em0 >= 1 OR em0 < -0.001 THEN 1 WHEN ph IS NOT NULL AND (ep < 0 OR ep > 1) THEN 3 WHEN plat < 0 THEN 4 WHEN mrt < 1 THEN 6 END
"""
SPEED = RADIUS * XKE / 60.0
FIELDS = {axis: f"mrt * u{axis} * {RADIUS}" for axis in "xyz"} | {
    f"v{axis}": f"(mvt * u{axis} + rvdot * w{axis}) * {SPEED!r}" for axis in "xyz"
}

NAME = re.compile(r"(?<![\w.])[A-Za-z_]\w*(?![\w(])(?!\s*\()")
NUMBER = re.compile(r"(?<![\w.])\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])")


def steps_of(block: str) -> Steps:
    pairs = [line.split(" = ", 1) for line in block.splitlines() if line]
    return [(name.strip(), expression.strip()) for name, expression in pairs]


def as_doubles(expression: str) -> str:
    """Numbers with an exponent, which SQL reads as doubles."""

    def one(match: re.Match) -> str:
        text = repr(float(match.group()))
        return text if "e" in text else text + "e0"

    return NUMBER.sub(one, expression)


def folded(steps: Steps, wanted: list[str]) -> Steps:
    """Fewer and longer steps: one that is used once, or that is short, is written out where it
    is used. Spark evaluates what is then repeated in one projection only once.

    ``wanted`` are expressions that read the steps afterwards.
    """
    uses = Counter(x for _, expression in steps for x in NAME.findall(expression))
    last = {x for expression in wanted for x in NAME.findall(expression)}
    inlined: dict[str, str] = {}
    out = []
    for name, expression in steps:
        expression = NAME.sub(lambda m: inlined.get(m.group(), m.group()), expression)
        longest = MOST_ONCE if uses[name] <= 1 else MOST_OFTEN // uses[name]
        if name not in last and len(expression) <= longest:
            inlined[name] = f"({expression})"
        else:
            out.append((name, expression))
    return out


def levels(steps: Steps) -> list[Steps]:
    """Steps grouped so that each needs only steps of groups before."""
    depth: dict[str, int] = {}
    for name, expression in steps:
        depth[name] = 1 + max((depth[x] for x in NAME.findall(expression) if x in depth), default=-1)
    out: list[Steps] = [[] for _ in range(max(depth.values()) + 1)]
    for name, expression in steps:
        out[depth[name]].append((name, expression))
    return out


def written(expression: str, names: set[str], mark: str, near: str, deep: str) -> str:
    """An expression with ``mark`` before the names of steps, and the places of constants."""
    marked = NAME.sub(lambda m: mark + m.group() if m.group() in names else m.group(), as_doubles(expression))
    return re.sub(r"\b([nd])\.(\w+)", lambda m: (near if m.group(1) == "n" else deep) + m.group(2), marked)


def error_text(code: str) -> str:
    cases = " ".join(f"WHEN {n} THEN 'SGP4 propagation failed ({n}): {text.replace(chr(39), chr(39) * 2)}'" for n, text in ERRORS.items())
    return f"CASE {code} {cases} END"


class Sgp4:
    """The model as column expressions; see the module's text."""

    columns = ("k_epoch_us", "k_near", "k_deep")
    minimum_radius_km = RADIUS

    def prepare(self, elements: DataFrame) -> DataFrame:
        """Elements with the model's constants. A null, negative or too large eccentricity,
        or a mean motion that is not positive, gives error 1 at every time."""
        mark = "_i_"
        fine = "eccentricity >= 0 AND eccentricity < 1 AND mean_motion > 0"
        kept = elements.columns
        rows = elements.selectExpr(
            "*",
            "unix_micros(epoch) AS k_epoch_us",
            f"CASE WHEN {fine} THEN eccentricity END AS {mark}e",
            f"CASE WHEN {fine} THEN mean_motion * {TWO_PI / 1440.0!r}D END AS {mark}n_mean",
            f"radians(inclination) AS {mark}inc",
            f"radians(ra_of_asc_node) AS {mark}nodeo",
            f"radians(arg_of_pericenter) AS {mark}argpo",
            f"radians(mean_anomaly) AS {mark}mo",
            f"coalesce(bstar, 0D) AS {mark}bstar",
            f"unix_micros(epoch) / 8.64e10D + 7306D AS {mark}days_1950",
        )
        steps = steps_of(NEAR_CONSTANTS) + steps_of(DEEP_CONSTANTS)
        given = {"e", "n_mean", "inc", "nodeo", "argpo", "mo", "bstar", "days_1950"}
        names = given | {name for name, _ in steps}
        wanted = [*NEAR, *DEEP, "deep"]
        for level in levels(folded(steps, wanted)):
            rows = rows.selectExpr("*", *[f"{written(x, names, mark, '', '')} AS {mark}{name}" for name, x in level])
        near = F.struct(*[F.col(mark + c).alias(c) for c in NEAR]).alias("k_near")
        deep = F.when(F.col(mark + "deep") == 1, F.struct(*[F.col(mark + c).alias(c) for c in DEEP])).alias("k_deep")
        return rows.select(*kept, "k_epoch_us", near, deep)

    def state_at(self, df: DataFrame, at_us: str, prefix: str = "", out: str = "") -> DataFrame:
        mark = "_t_"
        near, deep = f"{prefix}k_near.", f"{prefix}k_deep."
        kept = df.columns
        last = folded(steps_of(RESONANCE + LONG_PERIOD + KEPLER + SHORT_PERIOD), [*FIELDS.values(), "code"])
        first = folded(steps_of(SECULAR), [x for _, x in last] + ["width"])
        names = {"t", "xli", "xni", "whole_steps"} | {name for name, _ in first + last}
        write = lambda x: written(x, names, mark, near, deep)
        rows = df.selectExpr("*", f"({at_us} - {prefix}k_epoch_us) / 6e7D AS {mark}t")
        for level in levels(first):
            rows = rows.selectExpr("*", *[f"{write(x)} AS {mark}{name}" for name, x in level])

        # Only orbits in resonance take steps; a null array is not walked at all.
        walk_longitude, walk_motion = map(write, next_longitude("acc.l", "acc.m", "((i - 1) * width)"))
        rows = rows.selectExpr(
            "*", f"CASE WHEN {deep}irez > 0 THEN CAST(floor(abs({mark}t) / {RESONANCE_STEP}D) AS INT) END AS {mark}n"
        ).selectExpr(
            "*",
            f"aggregate(sequence(0, {mark}n), struct({deep}xlamo AS l, {near}no AS m), "
            f"(acc, i) -> IF(i = 0, acc, struct({walk_longitude} AS l, {walk_motion} AS m))) AS {mark}walked",
        ).selectExpr("*", f"{mark}walked.l AS {mark}xli", f"{mark}walked.m AS {mark}xni", f"CAST({mark}n AS DOUBLE) AS {mark}whole_steps")
        for level in levels(last):
            rows = rows.selectExpr("*", *[f"{write(x)} AS {mark}{name}" for name, x in level])
        fields = {name: write(x) for name, x in FIELDS.items()} | {"error": error_text(mark + "code")}
        # Worked out before the generator: outside of whole-stage code it is interpreted.
        rows = rows.selectExpr(*kept, *[f"{x} AS {mark}out_{name}" for name, x in fields.items()])
        # A one-row generator keeps filters on a state from being rewritten over all steps.
        named = ", ".join(f"{mark}out_{name} AS {out}{name}" for name in fields)
        return rows.selectExpr(*kept, f"inline(array(struct({named})))")
