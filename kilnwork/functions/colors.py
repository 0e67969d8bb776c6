"""Colours: parsing over Arrow batches, OKLab and contrast as column arithmetic."""

from __future__ import annotations

import colorsys
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RGBA = T.StructType([T.StructField(n, T.DoubleType()) for n in "rgba"])
CALL = re.compile(r"^(rgba?|hsla?)\(\s*([^)]*)\)$")


def _part(text: str, whole: float) -> float:
    return float(text[:-1]) / 100 * whole if text.endswith("%") else float(text)


def parsed(value: str | None) -> tuple[float, float, float, float] | None:
    """(r, g, b, a), the first three in 0 to 255; None for what isn't a colour or can't be seen."""
    text = (value or "").strip().lower()
    m = re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", text)
    try:
        if m:
            digits = m[1] if len(m[1]) > 4 else "".join(2 * c for c in m[1])
            r, g, b, *a = (int(digits[k : k + 2], 16) for k in range(0, len(digits), 2))
            out = (float(r), float(g), float(b), a[0] / 255 if a else 1.0)
        else:
            m = CALL.match(text)
            parts = re.split(r"[\s,/]+", m[2].strip()) if m else []
            if len(parts) not in (3, 4):
                return None
            alpha = _part(parts[3], 1.0) if len(parts) == 4 else 1.0
            if m[1].startswith("rgb"):
                out = (*(min(255.0, max(0.0, _part(p, 255.0))) for p in parts[:3]), alpha)
            else:
                hue = float(parts[0].removesuffix("deg")) % 360 / 360
                s, lightness = (_part(p if p.endswith("%") else p + "%", 1.0) for p in parts[1:3])
                out = (*(255 * c for c in colorsys.hls_to_rgb(hue, lightness, s)), alpha)
    except ValueError:
        return None
    return out if out[3] > 0 else None


@F.pandas_udf(RGBA)
def rgba(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(v) or (None,) * 4 for v in values], columns=list("rgba"), dtype=float)


def _linear(c: Column) -> Column:
    c = c / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


# The matrices of OKLab.
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    rgb = [_linear(c) for c in (r, g, b)]
    cones = [F.cbrt(sum((rgb[k] * m[k] for k in range(1, 3)), rgb[0] * m[0])) for m in TO_CONES]
    return [sum((cones[k] * m[k] for k in range(1, 3)), cones[0] * m[0]) for m in TO_LAB]


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum((F.pow(x - y, F.lit(2)) for x, y in zip(a[1:], b[1:])), F.pow(a[0] - b[0], F.lit(2))))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * _linear(r) + 0.7152 * _linear(g) + 0.0722 * _linear(b)


def contrast(a: Column, b: Column) -> Column:
    """Of two luminances: 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def hue_gap(a: Column, b: Column) -> Column:
    apart = F.abs(a - b) % 360
    return F.least(apart, 360 - apart)


def _inverse(rows: tuple[tuple[float, ...], ...]) -> list[list[float]]:
    return np.linalg.inv(np.array(rows)).tolist()


def from_oklab(lightness: Column, a: Column, b: Column) -> list[Column]:
    """(r, g, b) in 0 to 255, clamped."""
    lab = (lightness, a, b)
    cones = [F.pow(sum((lab[k] * m[k] for k in range(1, 3)), lab[0] * m[0]), F.lit(3)) for m in _inverse(TO_LAB)]
    out = []
    for m in _inverse(TO_CONES):
        v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((cones[k] * m[k] for k in range(1, 3)), cones[0] * m[0])))
        out.append(255 * F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055))
    return out


def polar(lab: list[Column]) -> list[Column]:
    """(lightness, chroma, hue in degrees) of an OKLab colour."""
    return [lab[0], F.hypot(lab[1], lab[2]), F.pmod(F.degrees(F.atan2(lab[2], lab[1])), F.lit(360.0))]
