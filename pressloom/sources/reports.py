"""Small results as files and text: CSV, JSON, script, SVG, plain tables. Driver side by nature."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from pressloom.operators import geometry


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for report-sized results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str, ensure_ascii=False, separators=(",", ":"))


def to_script(df: DataFrame, name: str = "window.DATA") -> str:
    return f"{name} = {to_json(df)};\n"


def text_table(df: DataFrame) -> str:
    rows = [[("" if v is None else str(v)) for v in r] for r in df.collect()]
    width = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(df.columns)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(df.columns, width, strict=True))]
    return "\n".join(lines + ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)) for r in rows])


def sparkline(values: list[float]) -> str:
    top = max(values, default=0) or 1
    return "".join("▁▂▃▄▅▆▇█"[min(7, int(v / top * 7.999))] for v in values)


def shade(stance: float | None) -> str:
    """Red below zero, green above, grey without a score."""
    if stance is None:
        return "#999999"
    k = max(-1.0, min(1.0, stance / 2))
    r, g = (200, int(200 * (1 + k))) if k < 0 else (int(200 * (1 - k)), 200)
    return f"#{r:02x}{g:02x}50"


def svg(layout: geometry.Layout, names: dict, stances: dict, size: int = 800) -> str:
    half = size / 2
    at = lambda p: f"{half + p[0] * half:.1f},{half + p[1] * half:.1f}"
    shapes = [f'<polygon points="{" ".join(map(at, pts))}" fill="{shade(stances.get(i))}"/>' for i, pts in geometry.outlines(layout).items()]
    labels = [f'<text x="{half + x * half:.1f}" y="{half + y * half:.1f}" text-anchor="middle">{html.escape(str(names.get(i, "")))}</text>' for i, (x, y, _) in geometry.label_anchors(layout).items()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">{"".join(shapes + labels)}</svg>'
