"""Serbian scripts and casing marks ahead of encoding, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Serbian Cyrillic and Latin letters in the same order, and the letters written with two.
CYRILLIC = "абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ"
LATIN = "abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ"
DIGRAPHS = {"љ": "lj", "њ": "nj", "џ": "dž", "Љ": "Lj", "Њ": "Nj", "Џ": "Dž"}
LETTER_CYRILLIC = "[а-яА-ЯёЁђЂљЉњЊћЋџЏјЈ]"
LETTER_LATIN = "[a-zA-ZčćđšžČĆĐŠŽ]"
MARKS = ("<csta>", "<cend>", "<capi>", "<uppe>")


def to_latin(c: Column) -> Column:
    for a, b in DIGRAPHS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, CYRILLIC, LATIN)


def to_cyrillic(c: Column, digraphs: bool = False) -> Column:
    """Letter by letter; with digraphs, lj, nj and dž become one letter each."""
    if digraphs:
        for a, b in DIGRAPHS.items():
            c = F.replace(c, F.lit(b), F.lit(a))
            if b[0].isupper():
                c = F.replace(c, F.lit(b.upper()), F.lit(a))
    return F.translate(c, LATIN, CYRILLIC)


def mark_cyrillic(c: Column) -> Column:
    """Cyrillic stretches between <csta> and <cend>, in Latin letters; white space at a stretch's end goes behind it."""
    c = F.regexp_replace(c, r"(?U)\s?\p{IsCyrillic}[^\p{IsLatin}]*", "<csta>$0<cend>")
    return F.regexp_replace(to_latin(c), r"(?U)(\s+)<cend>", "<cend>$1")


def mark_casing(c: Column) -> Column:
    """mark_cyrillic, then <capi> before capitalised words and <uppe> before words in capitals, which become lower case.

    The text is cut into words and what lies between, each is marked, and all are joined.
    """
    parts = F.regexp_extract_all(mark_cyrillic(c), F.lit(r"(?U)\s?\w+|[\s\S]"), F.lit(0))
    capital = lambda w: F.regexp_like(w, F.lit(r"(?U)^\s?\p{Lu}\p{Ll}+$"))
    capitals = lambda w: F.regexp_like(w, F.lit(r"(?U)^\s?\p{Lu}{2,}$"))
    mark = lambda w: F.when(capitals(w), F.concat(F.lit("<uppe>"), F.lower(w))).when(capital(w), F.concat(F.lit("<capi>"), F.lower(w))).otherwise(w)
    return F.array_join(F.transform(parts, mark), "")


def without_marks(c: Column) -> Column:
    for m in MARKS:
        c = F.replace(c, F.lit(m), F.lit(""))
    return c


def dominant_script(c: Column) -> Column:
    """cyrillic if there are more Cyrillic than Latin letters, else latin."""
    return F.when(F.regexp_count(c, F.lit(LETTER_CYRILLIC)) > F.regexp_count(c, F.lit(LETTER_LATIN)), "cyrillic").otherwise("latin")


def byte_text(c: Column) -> Column:
    """Each word's UTF-8 bytes as the printable characters of byte-level BPE, words joined by one space."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}
    words = F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+", -1), lambda w: w != "")
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.octet_length(w) - 1), lambda i: F.conv(F.substring(F.hex(w), i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    table = F.array(*[F.lit(shown[b]) for b in range(256)])
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(pairs(w), lambda b: F.element_at(table, b + 1)), "")), " ")


PREPROCESS: dict[str, Callable[[Column], Column]] = {"latin": to_latin, "cyrillic": to_cyrillic, "mark_cyrillic": mark_cyrillic, "mark_casing": mark_casing, "bytes": byte_text}


def register_preprocessor(name: str, f: Callable[[Column], Column]) -> None:
    PREPROCESS[name] = f
