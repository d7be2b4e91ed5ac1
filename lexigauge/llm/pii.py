"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators of high recall propose spans, which may overlap. Boosted trees judge each by
format and context; a threshold, calibrated on templates that fitting does not see,
selects, and of selected spans that overlap the longest stays. Spans that match a strict
pattern (base spans) stay in any case.

The trees are fitted on the driver on written examples (fixed templates below, with
features from the same column expressions) and become nested CASE expressions.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, boosted
from .common import OWN

KINDS = ("email", "ip", "card", "phone")

# The strict patterns, written so that no long run is tried from each of its characters
# and no repeated group recurses: a start inside a run fails wherever the run's start does.
LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "", "phone": r"\+[0-9]"}

# High recall: written-out addresses, addresses of version 6, other separators, numbers without a country's plus.
AT, DOT = r"(?:\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?|\x20at\x20|\x20?@\x20?)", r"(?:\.|\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20)"
WIDE = {
    "email": [
        rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+{AT}[a-z0-9-]{{1,63}}+(?:{DOT}[a-z0-9-]{{1,63}}+){{1,5}}+",
        rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?[(\[{{<]\x20?at\x20?[)\]}}>]\x20?[a-z0-9-]{{1,63}}+(?:{DOT}[a-z0-9-]{{1,63}}+){{1,5}}+",
    ],
    "ip": [
        r"(?i)(?<![0-9a-f:.])[0-9a-f]{1,4}+(?::[0-9a-f]{0,4}+){3,7}+(?![0-9a-f:])",
        r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:[\[(]\x20?(?:\.|dot)\x20?[\])]|\.)\x20?[0-9]{1,3}+){3}+(?![0-9])",
    ],
    "card": [
        r"(?<![0-9])[0-9]{3,6}+(?:[\x20./_-]{1,2}+[0-9]{3,7}+){2,4}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[^0-9A-Za-z\n]{1,3}+[0-9]{4}){3}(?![0-9])",
    ],
    "phone": [
        r"(?<![0-9+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5}+)(?:[\x20./-]{1,2}+[0-9]{2,5}+){1,4}+(?![0-9])",
        r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    ],
}
#: What a text must hold for the second generator to be worth trying.
SECOND = {"email": "(?i)[(\\[{<] ?at", "ip": r"[0-9] ?[\[(.]", "card": "[0-9]{4}[^0-9A-Za-z\\n]{1,3}[0-9]{4}", "phone": "[0-9]{3}[) .-]{0,2}[0-9]{3}[ .-]?[0-9]{4}"}
WORDS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)",
    "ip": r"(?i)(?:\bip\b|ipv6|address|host|server|login|adresse|direcci)",
    "card": r"(?i)(?:card|visa|credit|debit|master|tarjeta|carte|karte|payment)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|dial|appel|anruf|llam|handy)",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|page|date|ref|no\.|\bid\b|build|part|lot|sku|score|ratio|year)"
AROUND = 28


def once(c: Column) -> Column:
    """c, computed where it stands. The optimizer copies expressions into the filters and columns above that use them,
    which would multiply with each step, but not those that depend on a row's place; here that is always true."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def running(lengths: Column, start: Column) -> Column:
    """start and the running sums of lengths but the last."""
    zero = F.struct(start.cast("long").alias("t"), F.array().cast("array<bigint>").alias("o"))
    step = lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["o"], F.array(a["t"])).alias("o"))
    return F.aggregate(lengths, zero, step)["o"]


def before(lengths: Column, block: int = 256) -> Column:
    """Running sums over an array of any length, by blocks, so that time stays near its length."""
    n = F.ceil(F.size(lengths) / block).cast("int")
    part = lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda a, x: a + x))
    many = F.flatten(F.zip_with(running(blocks, F.lit(0)), F.sequence(F.lit(0), n - 1), lambda s, b: running(part(b), s)))
    return F.when(F.size(lengths) <= block, running(lengths, F.lit(0))).otherwise(many)


#: Columns that located() makes on its way: matches, what stands between them, lengths of both, where each pair begins.
M, CUT, STEP, BEGIN = (OWN + x for x in ("m", "cut", "step", "begin"))


def placing() -> tuple[Column, Column, Column]:
    """STEP, BEGIN and spans over the columns before them. Building expressions takes longer than planning them, so all patterns share these."""
    matches, cuts = F.col(M), F.slice(CUT, 1, F.size(M))
    step = F.zip_with(cuts, matches, lambda c, x: (F.length(c) + F.length(x)).cast("long"))
    begin = F.when(F.size(M) > 0, before(F.col(STEP))).otherwise(F.array().cast("array<bigint>"))
    beside = F.zip_with(cuts, F.slice(CUT, 2, F.size(M)), lambda c, d: F.struct(F.length(c).alias("n"), F.right(c, F.lit(AROUND)).alias("l"), F.left(d, F.lit(AROUND)).alias("r")))
    starts = F.zip_with(F.col(BEGIN), beside, lambda b, x: F.struct((b + x["n"]).alias("s"), x["l"].alias("l"), x["r"].alias("r")))
    at = F.zip_with(starts, matches, lambda b, x: F.struct(b["s"].alias("s"), (b["s"] + F.length(x)).alias("e"), x.alias("m"), b["l"].alias("l"), b["r"].alias("r")))
    return step, begin, once(at)


def located(df: DataFrame, name: str, text: str, pattern: str, needs: str = "", place: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """df with an array name of (s, e, m, l, r): start, end (code points) and text of each match, leftmost, not overlapping,
    and up to AROUND characters on its left and right, as far as the matches beside it. place: placing(), made once for many patterns."""
    step, begin, at = place or placing()
    find = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn(M, F.when(F.regexp_like(F.col(text), F.lit(needs)), find).otherwise(none) if needs else find)
    # what stands between matches is one longer than the matches
    df = df.withColumn(CUT, F.when(F.size(M) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    return df.withColumn(STEP, step).withColumn(BEGIN, begin).withColumn(name, at).drop(M, CUT, STEP, BEGIN)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    r = F.reverse(x)
    value = lambda i: F.substring(r, i + 1, F.lit(1)).cast("int") * (F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(F.sequence(F.lit(0), F.length(x) - 1), F.lit(0), lambda a, i: a + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def small_part(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), small_part),
    "card": lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}

SPANS = "array<struct<s:bigint,e:bigint,m:string>>"
FEATURES = ("length", "digits", "letters", "groups", "longest", "spaces", "dots", "dashes", "parens", "slashes", "colons", "luhn", "word", "against", "next", "ends", "at", "first")


def features(kind: str, c: Column) -> Column:
    """Format and context of candidate c, as an array in the order of FEATURES; what several of them need is found once."""
    m = c["m"]
    digit = digits(m)
    runs = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    known = F.array(F.struct(digit.alias("d"), F.length(digit).alias("n"), runs.alias("runs")))
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    return F.transform(known, lambda k: F.array(*_features(kind, c, k, yes)))[0]


def _features(kind: str, c: Column, k: Column, yes) -> list[Column]:
    m, d, runs = c["m"], k["d"], k["runs"]
    count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
    return [
        F.length(m).cast("double"),
        k["n"].cast("double"),
        count("[A-Za-z]"),
        F.size(runs).cast("double"),
        F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"),
        count(" "),
        count(r"\."),
        count("-"),
        count(r"[()\[\]{}<>]"),
        count("/"),
        count(":"),
        yes(k["n"].between(13, 19) & F.when(k["n"] > 0, luhn(d)).otherwise(False)),
        yes(F.regexp_like(c["l"], F.lit(WORDS[kind])) | F.regexp_like(c["r"], F.lit("^.{0,4}" + WORDS[kind]))),
        yes(F.regexp_like(c["l"], F.lit(AGAINST))),
        yes(F.regexp_like(c["r"], F.lit("^[A-Za-z0-9]"))),
        yes(F.regexp_like(m, F.lit(r"(?i)(?:\.|dot\W{0,2})\x20?(?:com|org|net|edu|gov|io|de|fr|es|info|co|uk|eu|ru|cn|jp)$"))),
        yes(F.regexp_like(m, F.lit(r"(?i)[(\[{<]\x20?at|@"))),
        F.coalesce(F.substring(d, 1, 1).try_cast("double"), F.lit(-1.0)),
    ]


# Templates of written examples. # is a digit, X a hex digit, w a word; what stands in << >> is personal.
POSITIVE = {
    "email": [
        "mail me at <<w.w (at) w (dot) com>>",
        "contact: <<w at w dot org>>",
        "<<w [at] w [dot] net>> is mine",
        "email <<w##@ w.com>>",
        "write to <<w_w {at} w.w {dot} de>> now",
        "reach <<w at w dot com>> please",
        "<<w(at)w.com>>",
        "courriel <<w [at] w.fr>>",
        "kontakt <<w (at) w.de>>",
        "correo <<w at w dot es>>",
        "<<w.w[at]w[dot]com>>",
        "send it to <<w## @ w . com>> w",
        "e-mail: <<w.w @ w.org>>",
        "w w <<w##(at)w-w.net>>, w",
        "mail <<w @w.de>> w",
        "write <<w.w at w dot co dot uk>>",
        "<<w-w [at] w.com>> w w",
    ],
    "ip": [
        "server <<XXXX:XXXX:XXXX:XXXX:XXXX:XXXX:XXXX:XXXX>>",
        "ip <<XXXX:XX:XXXX::XXXX:XXX>> seen",
        "from <<2001:db8:XXXX:XXXX:XXXX:XXXX:XXXX:XXXX>> w",
        "host <<fe80::XXXX:XXXX:XXXX:XXXX>>",
        "w <<2a0X:XXXX:XXXX::XXXX:X>> w",
        "address <<XXXX:XXXX::XXXX:XXXX:XXXX>>",
        "login from <<1##[.]1##[.]##[.]##>>",
        "ip <<10(.)##(.)##(.)1##>> w",
        "w <<1## . 1## . # . ##>> host",
        "blocked <<##[dot]1##[dot]##[dot]#>>",
        "w <<fd0X:XXXX:XXXX:XXXX::X:XX>> login",
        "w host <<1##[.]##[.]1##[.]##>> w",
    ],
    "card": [
        "card <<4###.####.####.####>>",
        "visa <<4###/####/####/####>> w",
        "credit card <<5###_####_####_####>>",
        "payment <<4###  ####  ####  ####>> w",
        "tarjeta <<4###.####.####.####>>",
        "my card is <<5###.####.####.####>>",
        "visa: <<4### - #### - #### - ####>>",
        "w card <<4###,####,####,####>> w",
        "credit <<5###|####|####|####>>",
        "carte <<4###/####/####/####>>",
        "card no <<4###.####.####.####>> w",
        "debit <<5###_####_####_####>> w",
    ],
    "phone": [
        "call <<(###) 555-####>>",
        "phone <<###-###-####>> w",
        "tel <<### ### ####>>",
        "tel. <<0## ### ## ##>>",
        "mobile: <<0### #######>>",
        "fax <<(0##) ########>>",
        "dial <<00## ## #######>>",
        "w <<(###) ###-####>> w",
        "cell <<###.###.####>>",
        "anruf <<0###/######>>",
        "w w <<(###) 555-####>>.",
        "call me on <<##########>> w",
        "phone: <<(###)###-####>>",
        "tel <<0049 ### #######>>",
        "handy <<01## ########>>",
        "call <<001 ### ### ####>> w",
        "llamar <<9## ### ###>>",
        "mobile <<###-#######>>",
    ],
}
NEGATIVE = {
    "email": [
        "he is at w.w now",
        "w at w dot",
        "look at w. w w",
        "we met at w.com yesterday and w",
        "stayed at w.w",
        "arrive at 10.30 w",
        "price @ 3.50 w",
        "w at the.w",
        "laughed at w.w. w",
        "best at w.net results",
        "sold at w.de store",
        "at home.w w",
        "# @ #.## each",
        "w w @ w . w w",
        "aim at w.w w",
        "is at w.org w",
        "they sat at w. w at w.w",
    ],
    "ip": [
        "time ##:##:##:## w",
        "ratio #:#:#:# w",
        "at ##:##:##:##",
        "ref ##:##:##:##:## w",
        "w #:#:#:#:# score",
        "id ab:cd:ef:##",
        "version # . # . # . #",
        "w #:##:##:## w",
        "page # . # . ## . #",
        "section # . # . # . # w",
        "build # . # . ### . ##",
        "date ##:##:##:##",
    ],
    "card": [
        "order ####-####-#### w",
        "isbn 978-####-####-####",
        "w ####.####.#### w",
        "part ###/####/###### w",
        "lot ####-###-####",
        "serial ####-####-####-####",
        "w ####.####.####.#### w",
        "build ####.####.####",
        "ref ####/####/####/####",
        "years 19##, 19##, 20##, 20##",
        "id ####|####|####|####",
        "w 1### - 1### - 1### - 1### w",
        "order #### #### ####",
        "serial ####/####/####/####",
    ],
    "phone": [
        "date ####-##-## w",
        "on ##/##/#### w",
        "w ##-## w",
        "version #.##.###",
        "page ###-### w",
        "from ####-#### w",
        "order ###-###-####",
        "w ## ### w",
        "score ##-## w",
        "isbn ###-##-####-###",
        "w ####/## w",
        "years ####-####",
        "### ### w",
        "ref ######## ####",
        "invoice ### ### ####",
        "w ##.## w",
        "w ## ## ## w",
        "serial ###.###.####",
        "id ########## w",
        "part 00#########",
        "lot ##########",
        "w #### #### w",
    ],
}
EXAMPLES = 24
MARK = re.compile(r"(?<![A-Za-z])w(?![A-Za-z])")


def examples() -> list[dict]:
    """Written examples: kind, text, the personal span (from -1 if none), and whether the template is kept from fitting: every third."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abdefgilmnoprstuv") for _ in range(rng.randint(2, 8)))
    out = []
    for by_kind in (POSITIVE, NEGATIVE):
        for kind, templates in by_kind.items():
            for i, t in enumerate(templates):
                for _ in range(EXAMPLES):
                    t2 = "".join(rng.choice("123456789") if c == "#" else rng.choice("0123456789abcdef") if c == "X" else c for c in t)
                    s = f"{word()} {word()} {MARK.sub(lambda _: word(), t2)} {word()}"
                    a, b = s.find("<<"), s.find(">>") - 2
                    out.append({"kind": kind, "text": s.replace("<<", "").replace(">>", ""), "a": a, "b": b if a >= 0 else -1, "held": i % 3 == 2})
    rng.shuffle(out)
    return out


MODELS: dict[str, Boosted] = {}


def models(spark: SparkSession) -> dict[str, Boosted]:
    """A model for each kind, fitted once a process."""
    if not MODELS:
        for kind in KINDS:
            MODELS[kind] = boosted(*judged_examples(spark, kind))
    return MODELS


def judged_examples(spark: SparkSession, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the candidates of the written examples, whether each is most of the personal span, and whether its template is held out."""
    src = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples())), "array<struct<kind string, text string, a bigint, b bigint, held boolean>>")).alias("x")).select("x.*")
    d = None
    for pattern in WIDE[kind]:
        one = located(src.where(F.col("kind") == kind), "c", "text", pattern).withColumn("c", F.explode("c"))
        d = one if d is None else d.unionByName(one)
    # a candidate is right if it is more than half of the personal span and hardly more than it
    common = F.least(F.col("c.e"), F.col("b")) - F.greatest(F.col("c.s"), F.col("a"))
    meets = (F.col("a") >= 0) & (common * 2 > F.col("b") - F.col("a")) & (common * 5 >= (F.col("c.e") - F.col("c.s")) * 4)
    got = d.select(features(kind, F.col("c")).alias("x"), meets.cast("double").alias("y"), "held").collect()
    return np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), np.array([r["held"] for r in got], bool)


# Spark reads a lambda's parameters, so what these depend on is bound outside it.
def _valid(kind: str):
    return lambda c: VALID[kind](c["m"])


def _bare(c: Column) -> Column:
    return F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"))


def judged(df: DataFrame, name: str, spans: Column, model: Boosted, kind: str) -> DataFrame:
    """df with name: the candidates among spans whose score reaches the threshold, without context, sorted, each once.

    Features are found once a candidate, not once a node of the trees, and the trees come as one SQL text.
    """
    known = F.transform(spans, lambda c: F.struct(_bare(c).alias("c"), features(kind, c).alias("x")))
    at = OWN + "known"
    good = F.expr(f"array_sort(array_distinct(transform(filter({at}, z -> {model.sql('z.x')} >= {model.threshold!r}D), z -> z.c)))") if np.isfinite(model.threshold) else F.array().cast(SPANS)
    return df.withColumn(at, known).withColumn(name, once(F.when(F.size(at) > 0, good).otherwise(F.array().cast(SPANS)))).drop(at)


#: Spans that are looked at together: a block whose range a span doesn't meet is passed over.
BLOCK = 64


def ranges(spans: str) -> Column:
    """(b, lo, hi) of the blocks of an array of spans that is sorted by start."""
    part = lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))
    n = F.ceil(F.size(spans) / BLOCK).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(b.alias("b"), F.array_min(F.transform(part(b), lambda d: d["s"])).alias("lo"), F.array_max(F.transform(part(b), lambda d: d["e"])).alias("hi")))
    return F.when(F.size(spans) > 0, made).otherwise(F.array().cast("array<struct<b:int,lo:bigint,hi:bigint>>"))


def _met(spans: str, blocks: str, test):
    """c to whether test(c, d) holds for a span d that overlaps c; blocks are the ranges of spans."""
    near = lambda c, k: (k["lo"] < c["e"]) & (k["hi"] > c["s"])
    part = lambda k: F.slice(spans, k["b"] * BLOCK + 1, F.lit(BLOCK))
    return lambda c: F.exists(blocks, lambda k: near(c, k) & F.exists(part(k), lambda d: test(c, d)))


def _free(met):
    return lambda c: ~met(c)


def _shown(kind: str):
    return lambda c: F.concat_ws(":", F.lit(kind), c["s"], c["e"])


def _named(kind: str):
    return lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(kind).alias("k"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (a["e"] > b["s"])


def _beaten(a: Column, b: Column) -> Column:
    """Whether a overlaps b and b is longer, or as long and earlier."""
    x, y = a["e"] - a["s"], b["e"] - b["s"]
    return _overlap(a, b) & ((y > x) | ((y == x) & (b["s"] < a["s"])))


def detected(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with an OWN-prefixed array for each kind of base spans and one of added spans: email, ip, card, phone and email_more, ...

    Spans are (s, e, m) in code points. Null and empty texts have none; very long texts are
    searched whole; repeated rows are alike; an empty table gives no rows; extra columns
    stay. Added spans overlap neither each other nor base spans; base spans of different
    kinds may overlap each other.
    """
    fitted = models(docs.sparkSession)
    text = OWN + "t"
    df = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    place = placing()
    for kind in KINDS:
        df = located(df, OWN + kind, text, BASE[kind], NEEDS[kind], place)
        df = df.withColumn(OWN + kind, F.transform(F.filter(OWN + kind, _valid(kind)), _bare))
    taken, blocks, more, second = (OWN + x for x in ("taken", "blocks", "more", "second"))
    df = df.withColumn(taken, once(F.array_sort(F.concat(*(F.col(OWN + k) for k in KINDS)))))
    free = F.filter(F.concat(more, second), _free(_met(taken, blocks, _overlap)))
    best = once(F.when(F.size(more) > 1, F.filter(more, _free(_met(more, blocks, _beaten)))).otherwise(F.col(more)))
    all_taken = once(F.when(F.size(more) > 0, F.array_sort(F.concat(taken, more))).otherwise(F.col(taken)))
    of_taken, of_more = once(ranges(taken)), once(ranges(more))
    for kind in KINDS:
        df = located(df, more, text, WIDE[kind][0], "", place)
        df = located(df, second, text, WIDE[kind][1], SECOND[kind], place)
        # what both propose is one span; of spans that overlap the longest stays
        df = judged(df.withColumn(blocks, of_taken), more, free, fitted[kind], kind)
        df = df.withColumn(blocks, of_more).withColumn(more, best).withColumn(taken, all_taken).withColumnRenamed(more, f"{OWN}{kind}_more")
    return df.drop(taken, blocks, second)


def listed(kinds: tuple[str, ...], more: bool) -> Column:
    """kind:start:end of all spans by kind, then start."""
    each = []
    for k in kinds:
        spans = F.concat(OWN + k, f"{OWN}{k}_more") if more else F.col(OWN + k)
        each.append(F.transform(F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))), _shown(k)))
    return F.array_join(F.concat(*each), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    x = detected(docs.select("doc_id", "text"))
    n = [F.size(OWN + k).cast("long").alias(f"n_{k}") for k in KINDS]
    return x.select("doc_id", *n, F.sha2(listed(KINDS, False), 256).alias("base_sha256"), listed(KINDS, True).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one of the first's kind."""
    x = detected(docs, text_col)
    spans = F.array_sort(F.concat(*(F.transform(F.concat(OWN + k, f"{OWN}{k}_more"), _named(k)) for k in KINDS)))
    t = F.col(OWN + "t")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("o"))
    step = lambda a, c: F.when(
        c["s"] >= a["at"],
        F.struct(c["e"].alias("at"), F.concat(a["o"], F.array(F.substring(t, a["at"].cast("int") + 1, (c["s"] - a["at"]).cast("int")), F.concat(F.lit("["), c["k"], F.lit("]")))).alias("o")),
    ).otherwise(F.struct(F.greatest(a["at"], c["e"]).alias("at"), a["o"].alias("o")))
    done = lambda a: F.concat(F.array_join(a["o"], ""), F.substring(t, a["at"].cast("int") + 1, F.length(t)))
    x = x.withColumn(OWN + "spans", spans)
    new = F.when(F.size(OWN + "spans") > 0, F.aggregate(OWN + "spans", empty, step, done)).otherwise(F.col(f"`{text_col}`"))
    return x.withColumn(OWN + "new", new).select(*[F.col(OWN + "new").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
