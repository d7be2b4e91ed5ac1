"""How long a text is: lines, bytes, characters or words, as one Column."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python has it: Unicode's, and U+001C to U+001F.
SPACE = r"\s\x1c-\x1f"
WORD_PUNCT = r"(?U)\w+|[^\w\s]+"
METHODS = {
    "lines": ("single", "newline_split", "custom_regex"),
    "bytes": ("utf8", "hf_bytelevel"),
    "characters": ("single",),
    "words": ("python_split", "hf_whitespace", "regex_whitespace", "custom_regex"),
}
UNITS = {"lines": "line", "bytes": "byte", "characters": "char", "words": "word"}


@dataclass(frozen=True)
class Measure:
    """A unit and how it is counted; custom_regex switches lines and words to a split by that pattern."""

    method: str = "bytes"
    variant: str | None = None
    custom_regex: str | None = None
    include_empty: bool = False

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown measure {self.method!r}")
        v = self.variant or ("custom_regex" if self.custom_regex and self.method in ("lines", "words") else METHODS[self.method][0])
        if v not in METHODS[self.method]:
            raise ValueError(f"{self.method} cannot be counted by {v!r}")
        if v == "custom_regex" and not self.custom_regex:
            raise ValueError("custom_regex needs a pattern")
        object.__setattr__(self, "variant", v)

    @property
    def unit(self) -> str:
        return UNITS[self.method]

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Measure:
        """From a configuration with method, line_counting, byte_counting, word_counting, custom_regex, include_empty_splits."""
        method = d.get("method", "bytes")
        key = {"lines": "line_counting", "bytes": "byte_counting", "words": "word_counting"}.get(method)
        regex = d.get("custom_regex")
        return cls(method, "custom_regex" if regex and method in ("lines", "words") else d.get(key) if key else None, regex, bool(d.get("include_empty_splits", False)))

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if v not in (None, False)}


PRESETS = {
    "lines": Measure("lines"),
    "newlines": Measure("lines", "newline_split"),
    "bytes": Measure("bytes"),
    "bytes_hf": Measure("bytes", "hf_bytelevel"),
    "characters": Measure("characters"),
    "words": Measure("words"),
    "words_hf": Measure("words", "hf_whitespace"),
    "words_regex": Measure("words", "regex_whitespace"),
}


def not_blank(c: Column) -> Column:
    return F.regexp_like(c, F.lit(rf"(?U)[^{SPACE}]"))


def split_count(text: Column, pattern: str, keep_empty: bool) -> Column:
    parts = F.split(text, pattern, -1)
    return F.size(parts if keep_empty else F.filter(parts, not_blank))


def n_units(text: Column, m: Measure = Measure()) -> Column:
    """Units in text as bigint; null and empty texts have none."""
    v = m.variant
    if m.method == "lines":
        n = F.lit(1) if v == "single" else F.size(F.split(text, "\n", -1)) if v == "newline_split" else split_count(text, m.custom_regex, m.include_empty)
    elif m.method == "characters":
        n = F.length(text)
    elif m.method == "bytes":
        # the byte-level pre-tokenizer drops white space and adds a mark to each piece
        n = F.octet_length(text) if v == "utf8" else F.octet_length(F.regexp_replace(text, r"(?U)\s+", "")) + F.regexp_count(text, F.lit(WORD_PUNCT))
    elif v == "python_split":
        n = F.size(F.split(text, " ", -1)) if m.include_empty else F.regexp_count(text, F.lit(rf"(?U)[^{SPACE}]+"))
    elif v == "hf_whitespace":
        n = F.regexp_count(text, F.lit(WORD_PUNCT))
    else:
        n = split_count(text, m.custom_regex if v == "custom_regex" else r"(?U)\s+", m.include_empty)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(n).cast("bigint")
