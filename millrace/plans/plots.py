"""Chart specifications from tables: small JSON documents, and a page that shows one.

The data of a chart are aggregated or limited before they leave the cluster:
``MAX_POINTS`` at most.
"""

from __future__ import annotations

import html
import json
import math
import struct
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_POINTS = 50_000


def points(df: DataFrame, columns: Sequence[str], order_by: str | None = None) -> list[list]:
    d = df.select(*columns)
    d = d.orderBy(order_by) if order_by else d
    got = d.limit(MAX_POINTS + 1).collect()
    if len(got) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points; aggregate first")
    return [list(r) for r in got]


def chart(kind: str, title: str = "", **body) -> dict:
    return {"kind": kind, "title": title, **body}


def line(df: DataFrame, x: str, ys: Sequence[str], title: str = "", step: bool = False) -> dict:
    rows = points(df, [x, *ys], x)
    return chart("step" if step else "line", title, x=[r[0] for r in rows], series=[{"name": y, "data": [r[i + 1] for r in rows]} for i, y in enumerate(ys)])


def bar(df: DataFrame, category: str, values: Sequence[str], title: str = "") -> dict:
    rows = points(df, [category, *values])
    return chart("bar", title, x=[r[0] for r in rows], series=[{"name": v, "data": [r[i + 1] for r in rows]} for i, v in enumerate(values)])


def parts(df: DataFrame, name: str, value: str, title: str = "", kind: str = "pie") -> dict:
    """Pie, funnel or word cloud."""
    return chart(kind, title, items=[{"name": r[0], "value": r[1]} for r in points(df, [name, value])])


def word_counts(df: DataFrame, text: str, title: str = "", most: int = 200) -> dict:
    counts = df.select(F.explode(F.split(F.lower(text), r"\W+")).alias("w")).filter("w <> ''").groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(most)
    return parts(counts, "w", "count", title, "wordcloud")


def scatter(df: DataFrame, x: str, y: str, group: str | None = None, title: str = "") -> dict:
    rows = points(df, [x, y, *([group] if group else [])])
    names = list(dict.fromkeys(r[2] for r in rows)) if group else [y]
    return chart("scatter", title, series=[{"name": n, "data": [r[:2] for r in rows if not group or r[2] == n]} for n in names])


def heatmap(df: DataFrame, x: str, y: str, value: str, title: str = "") -> dict:
    rows = points(df, [x, y, value])
    xs, ys = (list(dict.fromkeys(r[i] for r in rows)) for i in (0, 1))
    return chart("heatmap", title, x=xs, y=ys, data=[[xs.index(r[0]), ys.index(r[1]), r[2]] for r in rows])


def box(df: DataFrame, value: str, group: str, title: str = "") -> dict:
    """Five numbers of each group, computed where the rows are."""
    q = df.groupBy(group).agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")).orderBy(group)
    return chart("box", title, items=[{"name": r[0], "data": list(r[1])} for r in q.collect()])


def histogram(df: DataFrame, value: str, bins: int = 20, title: str = "") -> dict:
    """Counts of equal bins: one aggregate for the ends, one for the counts."""
    x = F.col(value).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return chart("histogram", title, edges=[], counts=[])
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counts = {r[0]: r[1] for r in df.filter(x.isNotNull()).groupBy(at).count().collect()}
    return chart("histogram", title, edges=[low + i * width for i in range(bins + 1)], counts=[counts.get(i, 0) for i in range(bins)])


def kline(df: DataFrame, date: str, prices: Sequence[str], title: str = "") -> dict:
    """Open, close, low and high by date."""
    rows = points(df, [date, *prices], date)
    return chart("kline", title, x=[str(r[0]) for r in rows], data=[r[1:5] for r in rows])


def sankey(df: DataFrame, source: str, target: str, value: str, title: str = "") -> dict:
    rows = points(df.groupBy(source, target).agg(F.sum(value)), [source, target, f"sum({value})"])
    return chart("sankey", title, nodes=sorted({str(v) for r in rows for v in r[:2]}), links=[{"source": r[0], "target": r[1], "value": r[2]} for r in rows])


def theme_river(df: DataFrame, date: str, value: str, name: str, title: str = "") -> dict:
    return chart("themeriver", title, data=[[str(r[0]), r[1], r[2]] for r in points(df, [date, value, name], date)])


def gauge(value: float, title: str = "", low: float = 0.0, high: float = 100.0) -> dict:
    return chart("gauge", title, value=value, low=low, high=high)


def radar(series: dict[str, Sequence[float]], axes: Sequence[str], title: str = "") -> dict:
    return chart("radar", title, axes=list(axes), series=[{"name": k, "data": list(v)} for k, v in series.items()])


def function_plot(f: Callable[[float], float], low: float, high: float, n: int = 200, title: str = "") -> dict:
    xs = [low + (high - low) * i / (n - 1) for i in range(n)]
    return chart("line", title, x=xs, series=[{"name": "f", "data": [y if math.isfinite(y := f(x)) else None for x in xs]}])


def drawn(spec: dict) -> tuple[str, list[list[tuple[float, float]]]]:
    """(line, step, bar or scatter, points of each series) of a chart that can be drawn."""
    if spec["kind"] == "histogram":
        spec = {**spec, "kind": "bar", "x": spec["edges"][:-1], "series": [{"name": "n", "data": spec["counts"]}]}
    xy = [[(p[0], p[1]) for p in s["data"]] if spec["kind"] == "scatter" else [(i if not isinstance(x, (int, float)) else x, y) for i, (x, y) in enumerate(zip(spec["x"], s["data"]))] for s in spec.get("series", [])]
    return spec["kind"], [[(float(a), float(b)) for a, b in s if a is not None and b is not None] for s in xy]


def axes(xy: list[list[tuple[float, float]]], width: int, height: int, pad: int) -> tuple[Callable, Callable]:
    """Places on the drawing of an x and of a y; zero is in sight."""
    every = [p for s in xy for p in s] or [(0.0, 0.0)]
    x0, x1, y0, y1 = min(p[0] for p in every), max(p[0] for p in every), min(0.0, *(p[1] for p in every)), max(0.0, *(p[1] for p in every))
    return lambda x: pad + (x - x0) / ((x1 - x0) or 1) * (width - 2 * pad), lambda y: height - pad - (y - y0) / ((y1 - y0) or 1) * (height - 2 * pad)


def to_svg(spec: dict, width: int = 640, height: int = 400) -> str:
    """A plain drawing of a line, step, bar, scatter or histogram chart."""
    pad, marks = 40, []
    kind, xy = drawn(spec)
    px, py = axes(xy, width, height, pad)
    for k, s in enumerate(xy):
        colour = f"hsl({k * 67 % 360},60%,45%)"
        if kind in ("line", "step"):
            path = "".join(f"{'M' if i == 0 else 'L'}{px(x):.1f},{py(y):.1f} " if kind == "line" or i == 0 else f"H{px(x):.1f} V{py(y):.1f} " for i, (x, y) in enumerate(s))
            marks.append(f'<path d="{path}" fill="none" stroke="{colour}"/>')
        elif kind == "bar":
            w = (width - 2 * pad) / max(len(s), 1) / max(len(xy), 1) * 0.8
            marks += [f'<rect x="{px(x) + k * w:.1f}" y="{min(py(y), py(0)):.1f}" width="{w:.1f}" height="{abs(py(y) - py(0)):.1f}" fill="{colour}"/>' for x, y in s]
        else:
            marks += [f'<circle cx="{px(x):.1f}" cy="{py(y):.1f}" r="2.5" fill="{colour}"/>' for x, y in s]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{width / 2}" y="20" text-anchor="middle">{html.escape(spec.get("title", ""))}</text>{"".join(marks)}</svg>'


#: Colours of the series of a PNG, in turn.
COLOURS = ((31, 119, 180), (214, 98, 39), (44, 140, 80), (150, 90, 170), (120, 120, 120))


def to_png(spec: dict, width: int = 640, height: int = 400) -> bytes:
    """The same drawing as an image, without its words: a canvas of numbers, packed as PNG."""
    import numpy as np

    pad, canvas = 40, np.full((height, width, 3), 255, np.uint8)
    kind, xy = drawn(spec)
    px, py = axes(xy, width, height, pad)

    def box(x0, y0, x1, y1, colour):
        canvas[max(int(min(y0, y1)), 0) : int(max(y0, y1)) + 1, max(int(min(x0, x1)), 0) : int(max(x0, x1)) + 1] = colour

    def stroke(a, b, colour):
        n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]))) + 1
        xs, ys = np.linspace(a[0], b[0], n + 1).round().astype(int), np.linspace(a[1], b[1], n + 1).round().astype(int)
        inside = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        canvas[ys[inside], xs[inside]] = colour

    box(pad, pad, pad, height - pad, (0, 0, 0))
    box(pad, py(0), width - pad, py(0), (0, 0, 0))
    for k, s in enumerate(xy):
        colour, at = COLOURS[k % len(COLOURS)], [(px(x), py(y)) for x, y in s]
        if kind == "bar":
            w = (width - 2 * pad) / max(len(s), 1) / max(len(xy), 1) * 0.8
            for x, y in at:
                box(x + k * w, y, x + (k + 1) * w, py(0), colour)
        elif kind == "scatter":
            for x, y in at:
                box(x - 2, y - 2, x + 2, y + 2, colour)
        else:
            for a, b in zip(at, at[1:]):
                if kind == "line":
                    stroke(a, b, colour)
                else:
                    stroke(a, (b[0], a[1]), colour)
                    stroke((b[0], a[1]), b, colour)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), canvas.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def save_png(spec: dict, path: str) -> None:
    if spec["kind"] not in ("line", "step", "bar", "scatter", "histogram"):
        raise ValueError(f"a {spec['kind']} chart can't be drawn; save its page")
    with open(path, "wb") as f:
        f.write(to_png(spec))


def save_html(spec: dict, path: str) -> None:
    body = to_svg(spec) if spec["kind"] in ("line", "step", "bar", "scatter", "histogram") else ""
    data = json.dumps(spec, default=str).replace("</", "<\\/")
    with open(path, "w") as f:
        f.write(f'<!doctype html><meta charset="utf-8"><title>{html.escape(spec.get("title", ""))}</title>{body}<script type="application/json" id="chart">{data}</script>')
