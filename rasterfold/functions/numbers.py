"""Small pieces of SQL that Spark and other engines read alike."""

from __future__ import annotations


def num(x: float) -> str:
    """A literal of type double."""
    text = repr(float(x))
    return f"({text})" if "e" in text else f"({text}e0)"


def clamp(e: str, low: str = "0", high: str = "255") -> str:
    return f"least({high}, greatest({low}, {e}))"


def byte(e: str) -> str:
    """A value of 0 to 255, halves rounded up."""
    return f"CAST({clamp(f'floor(({e}) + 0.5e0)')} AS INT)"


def unit(e: str) -> str:
    """A byte as a share of one."""
    return f"(CAST({e} AS DOUBLE) / 255)"


def from_unit(e: str) -> str:
    return byte(f"255e0 * {clamp(e, '0e0', '1e0')}")


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    """BT.709 luma as a byte."""
    return f"CAST(floor(0.2126e0 * {r} + 0.7152e0 * {g} + 0.0722e0 * {b} + 0.5e0) AS INT)"
