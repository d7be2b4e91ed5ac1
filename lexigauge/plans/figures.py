"""Figures of plot data as SVG: bars with errors, grouped bars, small multiples and curves. No plotting library is needed."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape
from pathlib import Path
from typing import Any

# Colours of tokenizers in order, and sizes in points.
COLOURS = ["#3b6fb6", "#d1793b", "#4a9c6d", "#b64a5e", "#7d62a8", "#8c7048", "#c07fb0", "#6b6b6b"]
WIDTH, HEIGHT, LEFT, TOP, BOTTOM = 480, 300, 64, 36, 56


def _text(x: float, y: float, s: str, anchor: str = "middle", size: int = 11, turn: float = 0) -> str:
    spin = f' transform="rotate({turn} {x:.1f} {y:.1f})"' if turn else ""
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" font-family="sans-serif" text-anchor="{anchor}"{spin}>{escape(s)}</text>'


def _page(body: list[str], width: float = WIDTH, height: float = HEIGHT) -> str:
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" viewBox="0 0 {width:.0f} {height:.0f}">', '<rect width="100%" height="100%" fill="white"/>', *body, "</svg>"])


def _scale(most: float):
    """A function from values to heights on the page, with 0 at the foot."""
    top = most * 1.1 or 1.0
    return lambda v: HEIGHT - BOTTOM - v / top * (HEIGHT - TOP - BOTTOM)


def _frame(title: str, most: float, y, width: float = WIDTH) -> list[str]:
    out = [_text(width / 2, 20, title, size=13)]
    for i in range(5):
        v = most * 1.1 * i / 4
        out += [f'<line x1="{LEFT}" x2="{width - 12}" y1="{y(v):.1f}" y2="{y(v):.1f}" stroke="#ddd"/>', _text(LEFT - 6, y(v) + 4, f"{v:.3g}", "end", 10)]
    return out


def grouped_bars(title: str, groups: dict[str, dict[str, float]], tokenizers: Sequence[str], names: dict[str, str] | None = None, errors: dict[str, dict[str, float]] | None = None, mean: float | None = None) -> str:
    """A group of bars for each key, a bar for each tokenizer, with a legend; errors as whiskers, mean as a dashed line."""
    shown = names or {}
    most = max([v + (errors or {}).get(g, {}).get(t, 0) for g, x in groups.items() for t, v in x.items()] + [mean or 0, 0])
    width = max(WIDTH, LEFT + 24 + len(groups) * (14 * len(tokenizers) + 18))
    y = _scale(most)
    out = _frame(title, most, y, width)
    room = (width - LEFT - 24) / max(1, len(groups))
    bar = room * 0.8 / max(1, len(tokenizers))
    for i, (g, x) in enumerate(groups.items()):
        at = LEFT + i * room + room * 0.1
        for j, t in enumerate(tokenizers):
            if t not in x:
                continue
            cx = at + (j + 0.5) * bar
            out.append(f'<rect x="{cx - bar * 0.45:.1f}" y="{y(x[t]):.1f}" width="{bar * 0.9:.1f}" height="{y(0) - y(x[t]):.1f}" fill="{COLOURS[j % len(COLOURS)]}"/>')
            if e := (errors or {}).get(g, {}).get(t):
                out.append(f'<line x1="{cx:.1f}" x2="{cx:.1f}" y1="{y(x[t] + e):.1f}" y2="{y(max(0.0, x[t] - e)):.1f}" stroke="black"/>')
        if g:
            out.append(_text(at + room * 0.4, HEIGHT - BOTTOM + 16, g))
    if mean is not None:
        out.append(f'<line x1="{LEFT}" x2="{width - 12}" y1="{y(mean):.1f}" y2="{y(mean):.1f}" stroke="black" stroke-dasharray="5 3"/>')
    for j, t in enumerate(tokenizers):
        x0 = LEFT + j * (width - LEFT) / max(1, len(tokenizers))
        out += [f'<rect x="{x0:.1f}" y="{HEIGHT - 22}" width="10" height="10" fill="{COLOURS[j % len(COLOURS)]}"/>', _text(x0 + 14, HEIGHT - 13, shown.get(t, t), "start")]
    return _page(out, width)


def curves(title: str, lines: dict[str, dict[str, list[float]]], names: dict[str, str] | None = None) -> str:
    """Lorenz curves in the unit square beside the line of equality."""
    side = HEIGHT - TOP - BOTTOM
    px, py = (lambda v: LEFT + v * side * 1.5), (lambda v: HEIGHT - BOTTOM - v * side)
    out = [_text(WIDTH / 2, 20, title, size=13), f'<line x1="{px(0):.1f}" y1="{py(0):.1f}" x2="{px(1):.1f}" y2="{py(1):.1f}" stroke="#888" stroke-dasharray="5 3"/>']
    out.append(f'<rect x="{px(0):.1f}" y="{py(1):.1f}" width="{px(1) - px(0):.1f}" height="{side}" fill="none" stroke="#ddd"/>')
    for j, (t, c) in enumerate(lines.items()):
        points = " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in zip(c["x"], c["y"], strict=True))
        out += [f'<polyline points="{points}" fill="none" stroke="{COLOURS[j % len(COLOURS)]}" stroke-width="2"/>', _text(LEFT + 8, TOP + 16 + 14 * j, (names or {}).get(t, t), "start")]
        out.append(f'<circle cx="{LEFT + 2}" cy="{TOP + 12 + 14 * j}" r="3" fill="{COLOURS[j % len(COLOURS)]}"/>')
    return _page(out)


def facets(title: str, groups: dict[str, dict[str, float]], tokenizers: Sequence[str], names: dict[str, str] | None = None) -> str:
    """A small panel of bars for each key, all on one scale."""
    panels = [grouped_bars(g, {"": x}, tokenizers, names) for g, x in groups.items()]
    across = min(3, max(1, len(panels)))
    body = [_text(across * WIDTH / 2, 20, title, size=14)]
    for i, p in enumerate(panels):
        inside = p.partition("\n")[2].rpartition("\n")[0]
        body.append(f'<g transform="translate({i % across * WIDTH} {30 + i // across * HEIGHT})">{inside}</g>')
    return _page(body, across * WIDTH, 30 + -(-len(panels) // across) * HEIGHT)


def drawn(data: dict[str, Any], tokenizers: Sequence[str], names: dict[str, str] | None = None) -> dict[str, str]:
    """All figures of plot data by name: a metric's bars, by language together and as small panels, by group, and Lorenz curves."""
    out = {}
    for c, d in data["bars"].items():
        values, errors = {b["tokenizer"]: b["value"] for b in d["bars"]}, {b["tokenizer"]: b["error"] or 0.0 for b in d["bars"]}
        out[c] = grouped_bars(d["title"].replace("$", "").replace("\\alpha", "α"), {"": values}, tokenizers, names, {"": errors}, d["mean"])
    for c, by in data["by_language"].items():
        out[f"{c}_by_language"] = grouped_bars(f"{c} by language", by, tokenizers, names)
        out[f"{c}_faceted"] = facets(f"{c} by language", by, tokenizers, names)
    for kind, groups in data["grouped"].items():
        for c in sorted({c for x in groups.values() for c in x}):
            by = {g: {b["tokenizer"]: b["value"] for b in x[c]["bars"]} for g, x in groups.items() if c in x}
            out[f"{kind}_{c}"] = grouped_bars(f"{c} by {kind}", by, tokenizers, names)
    if data["lorenz"]:
        out["lorenz_curves"] = curves("Lorenz curves of costs by language", data["lorenz"], names)
    return out


def draw(data: dict[str, Any], tokenizers: Sequence[str], folder: str, names: dict[str, str] | None = None) -> list[str]:
    """Figures as SVG files; names are the labels shown for tokenizers."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    files = []
    for name, svg in drawn(data, tokenizers, names).items():
        p = Path(folder, f"{name}.svg")
        p.write_text(svg, encoding="utf-8")
        files.append(str(p))
    return files
