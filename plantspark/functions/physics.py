"""Psychrometrics, heat balance, pump laws and plant indicators as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantspark.functions.timefx import as_col

# ---------------------------------------------------------------- fixed values
# Stull's wet-bulb fit (2011), unit factors and plant constants.
STULL = (0.151977, 8.313659, 1.676331, 0.00391838, 0.023101, 4.686035)
GPM_TO_LPM = 3.78541
RT_PER_GPM_F = 24.0
KW_PER_RT = 3.517
#: Specific heat of water in kJ/(kg K), constant term first.
CP_WATER = (4.2174, -0.0037, 0.00009)
WATER_KG_PER_L = 1.0


def wet_bulb(temp: Column | str, rh: Column | str) -> Column:
    """Wet-bulb temperature in C from dry bulb in C and relative humidity in percent."""
    t, h = as_col(temp), as_col(rh)
    a, b, c, d, e, f = (F.lit(x) for x in STULL)
    return (
        t * F.atan(a * F.sqrt(h + b))
        + F.atan(t + h)
        - F.atan(h - c)
        + d * F.pow(h, F.lit(1.5)) * F.atan(e * h)
        - f
    )


def wet_bulb_guarded(
    temp: Column | str,
    rh: Column | str,
    temp_range: tuple[float, float] = (-40.0, 60.0),
    rh_range: tuple[float, float] = (0.0, 100.0),
) -> Column:
    """As :func:`wet_bulb`, null outside the valid range."""
    t, h = as_col(temp), as_col(rh)
    return F.when(t.between(*temp_range) & h.between(*rh_range), wet_bulb(t, h))


def enthalpy(temp: Column | str, humidity_ratio: Column | str) -> Column:
    """Moist-air enthalpy in kJ/kg from C and kg/kg."""
    t, w = as_col(temp), as_col(humidity_ratio)
    return F.lit(1.006) * t + w * (F.lit(2501.0) + F.lit(1.86) * t)


def gpm_to_lpm(flow: Column | str) -> Column:
    return as_col(flow) * F.lit(GPM_TO_LPM)


def fahrenheit_to_celsius(temp: Column | str) -> Column:
    return (as_col(temp) - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def to_si(value: Column | str, unit: Column | str) -> Column:
    """Imperial readings in SI, others unchanged."""
    v, u = as_col(value), as_col(unit)
    return (
        F.when(u == F.lit("GPM"), gpm_to_lpm(v))
        .when(u == F.lit("F"), fahrenheit_to_celsius(v))
        .otherwise(v)
    )


def si_unit(unit: Column | str) -> Column:
    u = as_col(unit)
    return F.when(u == F.lit("GPM"), F.lit("LPM")).when(u == F.lit("F"), F.lit("C")).otherwise(u)


def cooling_tons(flow: Column | str, t_in: Column | str, t_out: Column | str) -> Column:
    return as_col(flow) * (as_col(t_in) - as_col(t_out)) / F.lit(RT_PER_GPM_F)


def relative_error_exceeds(calc: Column, measured: Column, tolerance: float) -> Column:
    """``|calc - measured| / measured > tolerance``; a measured zero always exceeds."""
    return (
        F.when(calc.isNull() | measured.isNull(), F.lit(None).cast("boolean"))
        .when(measured == 0, F.lit(True))
        .otherwise(F.try_divide(F.abs(calc - measured), measured) > F.lit(tolerance))
    )


def heat_balance_invalid(
    flow: Column | str, t_in: Column | str, t_out: Column | str, load_rt: Column | str, tolerance: float = 0.15
) -> Column:
    return relative_error_exceeds(cooling_tons(flow, t_in, t_out), as_col(load_rt), tolerance)


def water_cp(temp: Column, coeffs: Sequence[float] = CP_WATER) -> Column:
    """Specific heat as a polynomial in temperature."""
    out = F.lit(float(coeffs[-1]))
    for k in reversed(coeffs[:-1]):
        out = out * temp + F.lit(float(k))
    return out


def cooling_kw(
    flow_lpm: Column | str, t_in: Column | str, t_out: Column | str, coeffs: Sequence[float] = CP_WATER
) -> Column:
    """Heat flow in kW from litres per minute and Celsius with temperature-dependent Cp."""
    a, b = as_col(t_in), as_col(t_out)
    mean = (a + b) / F.lit(2.0)
    return as_col(flow_lpm) * (a - b) * water_cp(mean, coeffs) * F.lit(WATER_KG_PER_L) / F.lit(60.0)


def heat_balance_invalid_si(
    flow_lpm: Column | str,
    t_in: Column | str,
    t_out: Column | str,
    meter_kw: Column | str,
    tolerance: float = 0.15,
    coeffs: Sequence[float] = CP_WATER,
) -> Column:
    return relative_error_exceeds(cooling_kw(flow_lpm, t_in, t_out, coeffs), as_col(meter_kw), tolerance)


def affinity_ratio(hz: Column | str, kw: Column | str) -> Column:
    """Power over speed cubed; null at standstill, so idle rows do not enter the median."""
    f = as_col(hz)
    return F.when(f > 0, F.try_divide(as_col(kw), f * f * f))


def plant_indicators(
    load_rt: Column | str,
    power_kw: Column | str,
    return_temp: Column | str,
    supply_temp: Column | str,
    tower_return: Column | str,
    tower_supply: Column | str,
    wet_bulb_temp: Column | str,
) -> dict[str, Column]:
    """COP, kW/RT, chilled-water delta T, tower approach and tower range."""
    load, kw = as_col(load_rt), as_col(power_kw)
    return {
        "cop": F.try_divide(load * F.lit(KW_PER_RT), kw),
        "kw_per_rt": F.try_divide(kw, load),
        "delta_t": as_col(return_temp) - as_col(supply_temp),
        "tower_approach": as_col(tower_supply) - as_col(wet_bulb_temp),
        "tower_range": as_col(tower_return) - as_col(tower_supply),
    }
