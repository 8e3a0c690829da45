"""Warping of the frequency axis for vocal tract length: each kind gives the way to the warped axis and back."""

from __future__ import annotations

from collections.abc import Callable

Map = Callable[[float], float]


def warps(kind: str, parameters: tuple[float, ...], rate: float) -> tuple[Map, Map]:
    """(to the warped axis, back). Without parameters, or with a factor of zero, nothing is warped."""
    if not parameters or parameters[0] == 0:
        return (lambda f: f), (lambda f: f)
    if kind == "inverse_linear":
        (a,) = parameters
        return (lambda f: f / a), (lambda f: f * a)
    if kind == "affine":
        a, b = (*parameters, 0.0)[:2]
        return (lambda f: a * f + b), (lambda f: (f - b) / a)
    if kind == "piecewise_linear":
        a, knee = (*parameters, 0.0)[:2]
        nyquist = rate / 2
        knee = knee or 0.85 * rate
        if knee >= nyquist:
            return (lambda f: f * a), (lambda f: f / a)
        slope = (nyquist - a * knee) / (nyquist - knee)
        rest = nyquist * (1 - slope)
        return (lambda f: a * f if f < knee else slope * f + rest), (lambda f: f / a if f < a * knee else (f - rest) / slope)
    raise ValueError(f"no such warp: {kind}")
