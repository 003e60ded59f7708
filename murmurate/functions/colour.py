"""Colours as #rrggbb text: OKLab coordinates and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published matrices of OKLab and the luminance weights of sRGB.
_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
_LUMINANCE = (0.2126, 0.7152, 0.0722)


def linear_rgb(colour: Column) -> list[Column]:
    """The three channels as linear light; null if the text is no such colour."""
    ok = colour.rlike("^#[0-9A-Fa-f]{6}$")
    out = []
    for k in range(3):
        c = F.when(ok, F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("double") / 255)
        out.append(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    return out


def _dot(weights: tuple[float, ...], values: list[Column]) -> Column:
    return sum((w * v for w, v in zip(weights[1:], values[1:], strict=True)), weights[0] * values[0])


def oklab(colour: Column) -> dict[str, Column]:
    """``lightness``, ``a`` and ``b``."""
    rgb = linear_rgb(colour)
    roots = [F.cbrt(_dot(w, rgb)) for w in _LMS]
    return {name: _dot(w, roots) for name, w in zip(("lightness", "a", "b"), _LAB, strict=True)}


def contrast(one: Column, other: Column) -> Column:
    """The ratio of relative luminances, lighter over darker: 1 to 21; null if either is no colour."""
    x, y = (_dot(_LUMINANCE, linear_rgb(c)) + 0.05 for c in (one, other))
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y) / F.least(x, y))
