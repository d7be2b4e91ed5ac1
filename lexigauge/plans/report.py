"""Results as nested dictionaries, JSON, LaTeX tables and plot data. All frames here have a row for each tokenizer and language at most."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from pathlib import Path
from typing import Any

# Columns of the tables (title, where the value and its error are, format, whether less is better, factor).
COLUMNS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...] | None, str, bool, float]] = {
    "fertility": ("Fertility", ("fertility", "per_tokenizer", "*", "global", "mean"), ("fertility", "per_tokenizer", "*", "global", "std_err"), "{:.3f}", True, 1),
    "vocabulary_utilization": ("Vocab Utilization", ("vocabulary_utilization", "per_tokenizer", "*", "global_utilization"), None, "{:.1f}\\%", False, 100),
    "type_token_ratio": ("Type-Token Ratio", ("type_token_ratio", "per_tokenizer", "*", "global_ttr"), None, "{:.4f}", False, 1),
    "renyi_1.0": ("Rényi Entropy ($\\alpha$=1)", ("renyi_efficiency", "per_tokenizer", "*", "renyi_1.0", "overall"), None, "{:.2f}", False, 1),
    "renyi_2.5": ("Rényi Entropy ($\\alpha$=2.5)", ("renyi_efficiency", "per_tokenizer", "*", "renyi_2.5", "overall"), None, "{:.2f}", False, 1),
    "tokenizer_fairness_gini": ("Gini Coefficient", ("tokenizer_fairness_gini", "per_tokenizer", "*", "gini_coefficient"), None, "{:.3f}", True, 1),
    "morphological_alignment": ("Morphological F1", ("morphological_alignment", "summary", "*", "avg_boundary_f1"), ("morphological_alignment", "summary", "*", "boundary_f1_std_err"), "{:.3f}", False, 1),
    "morphscore_recall": ("MorphScore Recall", ("morphscore", "per_tokenizer", "*", "summary", "avg_morphscore_recall"), ("morphscore", "per_tokenizer", "*", "summary", "avg_morphscore_recall_std_err"), "{:.3f}", False, 1),
    "morphscore_precision": ("MorphScore Precision", ("morphscore", "per_tokenizer", "*", "summary", "avg_morphscore_precision"), ("morphscore", "per_tokenizer", "*", "summary", "avg_morphscore_precision_std_err"), "{:.3f}", False, 1),
    "avg_token_rank": ("Avg Token Rank", ("unigram_distribution_metrics", "per_tokenizer", "*", "global_avg_token_rank"), None, "{:.1f}", True, 1),
    "token_length": ("Token Length", ("token_length", "per_tokenizer", "*", "character_length", "mean"), ("token_length", "per_tokenizer", "*", "character_length", "std_err"), "{:.2f}", False, 1),
    "avg_tokens_per_line": ("Tokens per Line", ("avg_tokens_per_line", "per_tokenizer", "*", "global_avg"), ("avg_tokens_per_line", "per_tokenizer", "*", "global_std_err"), "{:.1f}", False, 1),
    "compression_rate": ("Compression Ratio", ("compression_ratio", "per_tokenizer", "*", "global", "mean"), ("compression_ratio", "per_tokenizer", "*", "global", "std_err"), "{:.4f}", False, 1),
}
TABLES: dict[str, tuple[str, list[str]]] = {
    "basic_metrics": ("Basic Tokenization Metrics", ["fertility", "vocabulary_utilization", "type_token_ratio", "token_length", "avg_tokens_per_line"]),
    "information_metrics": ("Information-Theoretic Metrics", ["compression_rate", "renyi_1.0", "renyi_2.5", "avg_token_rank"]),
    "morphological_metrics": ("Morphological Metrics", ["morphological_alignment", "morphscore_recall", "morphscore_precision"]),
    "comprehensive_metrics": ("Comprehensive Tokenizer Evaluation", list(COLUMNS)),
}


def at(results: dict, path: Sequence[str] | None, tokenizer: str) -> float | None:
    x: Any = results
    for k in path or ("?",):
        x = x.get(tokenizer if k == "*" else k) if isinstance(x, dict) else None
    return x if isinstance(x, (int, float)) and not (isinstance(x, float) and math.isnan(x)) else None


def wrapped(title: str, width: int = 15) -> str:
    """Lines of a heading, each word with its space up to width."""
    if len(title) <= width:
        return title
    lines: list[list[str]] = [[]]
    for w in title.split():
        if lines[-1] and sum(len(x) + 1 for x in lines[-1]) + len(w) + 1 > width:
            lines.append([])
        lines[-1].append(w)
    shown = [" ".join(x) for x in lines if x]
    return "\\makecell{" + " \\\\ ".join(shown) + "}" if len(shown) > 1 else shown[0]


def table(results: dict, tokenizers: Sequence[str], columns: Sequence[str], *, bold_best: bool = True, errors: bool = True, error_size: str = "\\scriptsize") -> str:
    """A tabular of columns by tokenizers; the best of each column (the first on ties) is bold."""
    unknown = [c for c in columns if c not in COLUMNS]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; there are {list(COLUMNS)}")
    body = {t: [] for t in tokenizers}
    for c in columns:
        _, path, err, form, less, factor = COLUMNS[c]
        values = {t: at(results, path, t) for t in tokenizers}
        real = [t for t in tokenizers if values[t] is not None]
        best = (min if less else max)(real, key=lambda t: values[t]) if real else None
        for t in tokenizers:
            cell = "---"
            if (v := values[t]) is not None:
                cell = form.format(v * factor)
                if errors and (e := at(results, err, t)) is not None:
                    cell += f" {{{error_size} $\\pm$ {form.format(e)}}}"
                cell = f"\\textbf{{{cell}}}" if bold_best and t == best else cell
            body[t].append(cell)
    lines = ["% Requires \\usepackage{makecell} in preamble", f"\\begin{{tabular}}{{l{'c' * len(columns)}}}", "\\toprule", " & ".join(["Tokenizer", *(wrapped(COLUMNS[c][0]) for c in columns)]) + " \\\\", "\\midrule"]
    lines += [" & ".join([t.replace("_", "\\_"), *body[t]]) + " \\\\" for t in tokenizers]
    return "\n".join([*lines, "\\bottomrule", "\\end{tabular}"])


def floated(tabular: str, caption: str, label: str) -> str:
    return "\n".join(["\\begin{table}[htbp]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{tab:{label}}}", tabular, "\\end{table}"])


def write_tables(results: dict, tokenizers: Sequence[str], folder: str, custom: dict[str, dict] | None = None, **style: Any) -> list[str]:
    """A file for each table: the fixed ones with the columns that have values, and those of custom {name: {metrics, caption, label}}."""
    todo = {n: (caption, n, [c for c in cols if any(at(results, COLUMNS[c][1], t) is not None for t in tokenizers)]) for n, (caption, cols) in TABLES.items()}
    todo |= {n: (c.get("caption", n), c.get("label", n), c["metrics"]) for n, c in (custom or {}).items()}
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for name, (caption, label, cols) in todo.items():
        if cols:
            p = Path(folder, f"{name}_table.tex" if not name.endswith("_table") else f"{name}.tex")
            p.write_text(floated(table(results, tokenizers, cols, **style), caption, label), encoding="utf-8")
            out.append(str(p))
    return out


def slim(x: Any, most: int = 100, points: int = 50) -> Any:
    """The same without long lists: of more than most entries every (n / points)-th stays."""
    if isinstance(x, dict):
        return {k: slim(v, most, points) for k, v in x.items() if k != "values"}
    if isinstance(x, list):
        return [slim(v, most, points) for v in (x[:: max(1, len(x) // points)] if len(x) > most else x)]
    return x


def write_json(results: dict, path: str, small: bool = False) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    clean = lambda x: {str(k): clean(v) for k, v in x.items()} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, (list, tuple)) else None if isinstance(x, float) and not math.isfinite(x) else x
    Path(path).write_text(json.dumps(clean(slim(results) if small else results), indent=2, ensure_ascii=False), encoding="utf-8")


def plot_data(results: dict, tokenizers: Sequence[str]) -> dict[str, Any]:
    """What the figures show: bars with errors and a mean line for each column, bars by language, Lorenz curves, and groups."""
    bars = {}
    for c, (title, path, err, _, less, factor) in COLUMNS.items():
        rows = [{"tokenizer": t, "value": v * factor, "error": at(results, err, t)} for t in tokenizers if (v := at(results, path, t)) is not None]
        if rows:
            bars[c] = {"title": title, "lower_is_better": less, "bars": rows, "mean": sum(r["value"] for r in rows) / len(rows)}
    by_lang = {}
    for key, pick in (("fertility", lambda x: x["mean"]), ("compression_ratio", lambda x: x), ("vocabulary_utilization", lambda x: x["utilization"]), ("unigram_distribution_metrics", lambda x: x["unigram_entropy"])):
        for t in tokenizers:
            for lang, x in results.get(key, {}).get("per_tokenizer", {}).get(t, {}).get("per_language", {}).items():
                if pick(x) is not None:
                    by_lang.setdefault(key, {}).setdefault(lang, {})[t] = pick(x)
    curves = {t: {"x": x["x_values"], "y": x["y_values"]} for t in tokenizers if "x_values" in (x := results.get("lorenz_curve_data", {}).get("per_tokenizer", {}).get(t, {}))}
    groups = {kind: {g: plot_data(r, tokenizers)["bars"] for g, r in gs.items()} for kind, gs in results.get("grouped_analysis", {}).items()}
    return {"bars": bars, "by_language": by_lang, "lorenz": curves, "grouped": groups}


def summary_text(results: dict, tokenizers: Sequence[str]) -> str:
    """A plain table of all columns that have values."""
    cols = [c for c in COLUMNS if any(at(results, COLUMNS[c][1], t) is not None for t in tokenizers)]
    lines = ["tokenizer".ljust(24) + "".join(c[:22].rjust(24) for c in cols)]
    for t in tokenizers:
        cells = [(v * COLUMNS[c][5] if (v := at(results, COLUMNS[c][1], t)) is not None else None) for c in cols]
        lines.append(t.ljust(24) + "".join(("---" if v is None else f"{v:.4f}").rjust(24) for v in cells))
    return "\n".join(lines)


def morphology_text(results: dict, tokenizers: Sequence[str]) -> str:
    """Alignment and MorphScore by tokenizer and language, as text; empty without either."""
    lines: list[str] = []
    per, brief = (results.get("morphological_alignment", {}).get(k, {}) for k in ("per_tokenizer", "summary"))
    for t in tokenizers:
        if t in brief:
            x = brief[t]
            lines.append(f"{t}: boundary F1 {x['avg_boundary_f1']:.4f}, morphemes kept {x['avg_morpheme_preservation']:.4f}, {x['total_words_analyzed']} words of {x['languages_analyzed']} languages")
            lines += [f"  {lang}: F1 {v['mean']:.4f} (std {v['std']:.4f}, {v['count']} words)" for lang, v in sorted(per.get(t, {}).get("boundary_f1", {}).items())]
    for t in tokenizers:
        x = results.get("morphscore", {}).get("per_tokenizer", {}).get(t)
        if x:
            b = x["summary"]
            lines.append(f"{t}: MorphScore recall {b['avg_morphscore_recall']:.4f}, precision {b['avg_morphscore_precision']:.4f}, {b['total_samples']} words")
            lines += [f"  {lang}: recall {v['morphscore_recall']:.4f}, precision {v['morphscore_precision']:.4f} ({v['num_samples']} words)" for lang, v in sorted(x["per_language"].items())]
    return "\n".join(lines)


def analysis_summary(results: dict, tokenizers: Sequence[str]) -> dict[str, Any]:
    """What an analysis covers: tokenizers, languages, texts, metrics and groups."""
    fert = results.get("fertility", {}).get("per_tokenizer", {})
    return {
        "tokenizers": list(tokenizers),
        "languages": sorted({lang for t in tokenizers for lang in fert.get(t, {}).get("per_language", {})}),
        "texts": {t: fert[t]["global"]["count"] for t in tokenizers if "global" in fert.get(t, {})},
        "metrics": sorted(k for k in results if k != "grouped_analysis"),
        "groups": {k: sorted(v) for k, v in results.get("grouped_analysis", {}).items()},
    }
