"""Plain versions of word alignment and boundary scores, to test the expressions with."""

from itertools import accumulate

from lexigauge.operators.morphology import PUNCTUATION


def words_of(text: str) -> list[str]:
    return [w.strip(PUNCTUATION) for w in text.lower().split()]


def aligned(text: str, tokens: list[str]) -> list[tuple[str, list[str]]]:
    """Words of text with their tokens. A token that begins with a space mark begins a word; groups of
    punctuation alone join the group before; groups and words are paired in order, and what
    is left over goes to the last word."""
    groups: list[list[str]] = []
    for t in tokens:
        if not groups or t[:1] in ("Ġ", " "):
            groups.append([t])
        else:
            groups[-1].append(t)
    merged: list[list[str]] = []
    for k, g in enumerate(groups):
        shown = "".join((t[1:] if i == 0 and k else t[2:] if i and t.startswith("##") else t) for i, t in enumerate(g))
        if k and not shown.strip(PUNCTUATION):
            merged[-1] = merged[-1] + g
        else:
            merged.append(g)
    out = list(zip(words_of(text), merged, strict=False))
    used = sum(len(g) for _, g in out)
    if out and used < len(tokens):
        out[-1] = (out[-1][0], out[-1][1] + tokens[used:])
    return out


def in_order(parts: list[str], word: str, skip: bool) -> list[tuple[int, int]]:
    """Where parts stand in word, searched from left to right. A part that is not found is skipped, or takes its length of what is left."""
    out, at = [], 0
    for p in parts:
        if not skip and at >= len(word):
            break
        k = word.find(p, at)
        if k < 0 and skip:
            continue
        a, b = (k, k + len(p)) if k >= 0 else (at, min(len(word), at + len(p)))
        out.append((a, b))
        at = b
    return out


def sound(spans: list[tuple[int, int]], n: int) -> bool:
    """Not empty, inside the word, in order and apart."""
    ends = [0, *(b for _, b in spans)]
    return bool(spans) and all(e <= a < b <= n for (a, b), e in zip(spans, ends, strict=False))


def evenly(n: int, parts: int) -> list[tuple[int, int]]:
    cuts = [int(i * n / parts) for i in range(parts)] + [n]
    return list(zip(cuts, cuts[1:], strict=False))


def spans_of(parts: list[str], word: str, morphemes: bool) -> list[tuple[int, int]]:
    """Boundaries of tokens or morphemes in word: side by side if they spell it, else as found, else evenly."""
    low = word.lower()
    if "".join(parts).lower() == low:
        ends = list(accumulate(map(len, parts)))
        spans = list(zip([0, *ends], ends, strict=False))
        if sound(spans, len(word)):
            return spans
    spans = in_order([p.lower() for p in parts], low, morphemes)
    return spans if sound(spans, len(word)) else evenly(len(word), len(parts))


def score(word: str, tokens: list[str], morphemes: list[str]) -> dict[str, float] | None:
    """Alignment of clean tokens with morphemes, from the ends inside the word. None without either."""
    if not tokens or not morphemes or not word:
        return None
    inner = lambda parts, m: {b for _, b in spans_of(parts, word, m)} - {len(word)}
    gold, cut = inner(morphemes, True), inner(tokens, False)
    both = len(gold & cut)
    p, r = both / len(cut) if cut else 0.0, both / len(gold) if gold else 0.0
    return {
        "boundary_precision": p,
        "boundary_recall": r,
        "boundary_f1": 2 * p * r / (p + r) if p + r else 0.0,
        "morpheme_preservation": sum(m in tokens for m in morphemes) / len(morphemes),
        "over_segmentation": max(0, len(tokens) - len(morphemes)) / len(morphemes),
    }
