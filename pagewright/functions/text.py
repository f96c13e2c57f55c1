"""Text and colour functions over words."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.tables import materialised

#: The blocks of Arabic letters.
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
#: Language codes that are written from right to left.
RTL_LANGUAGES = ("ar", "arc", "dv", "fa", "ha", "he", "khw", "ks", "ku", "ps", "ur", "yi")
#: Bidirectional classes by dominance; all others are 5.
BIDI_CODES = {"ON": 5, "ET": 4, "AN": 3, "EN": 2, "R": 1, "AL": 1, "L": 0}
#: Fixed value: the pattern of a date range.
DATE_RANGE = r"^\s*\d{1,2}\s*[/\.]\s*\d{1,2}\s*[/\.]\s*\d{4}\s*-\s*\d{1,2}\s*[/\.]\s*\d{1,2}\s*[/\.]\s*\d{4}\s*$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def has_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def flipped_number_blocks(text: Column) -> Column:
    """Blocks of digits in reverse order; what stands between them stays in place."""
    digits, others = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), F.split(text, r"\d+")
    woven = F.zip_with(others, F.reverse(digits), lambda o, d: F.concat(F.coalesce(o, F.lit("")), F.coalesce(d, F.lit(""))))
    return F.array_join(woven, "")


def bidi_fixed(text: Column, language: Column) -> Column:
    """Undoes the reversed number blocks of readings in Arabic that hold no Arabic letter."""
    wrong = (F.length(text) > 1) & (F.coalesce(language, F.lit("")) == "ar") & ~has_arabic(text)
    return F.when(wrong, flipped_number_blocks(text)).otherwise(text)


def is_word(text: Column) -> Column:
    return text.rlike(r"^\p{L}{2,}$")


#: Parts of Unicode in which nearly all texts lie, so that their character classes are short: Latin, Greek to Arabic,
#: punctuation, currencies, Kana, Han, Hangul.
COMMON = ((0x0, 0x24F), (0x370, 0x6FF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _class(ranges: list[tuple[int, int]], negated: bool = False) -> str:
    return ("[^" if negated else "[") + "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for a, z in ranges) + "]"


@cache
def bidi_ranges(within: tuple[tuple[int, int], ...] = ((0, 0x10FFFF),)) -> dict[int, str]:
    """For each code but the last, the characters that have it, as a character class; from the Unicode database."""
    out: dict[int, list[tuple[int, int]]] = {}
    for low, high in within:
        codes = np.array([BIDI_CODES.get(unicodedata.bidirectional(chr(c)), 5) for c in range(low, high + 1)])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if codes[a] < 5:
                out.setdefault(int(codes[a]), []).append((low + a, low + z - 1))
    return {code: _class(ranges) for code, ranges in sorted(out.items())}


def box_type(text: Column) -> Column:
    """The dominant bidirectional class of a text, by the Unicode database; that of an empty text is 0.

    Only a text with a character outside the common parts needs the long character classes.
    """
    first = lambda classes: F.coalesce(*[F.when(text.rlike(c), code) for code, c in classes.items()], F.lit(5))
    ascii_ = first({0: "[A-Za-z]", 2: "[0-9]", 4: "[#$%]"})
    return F.when(text == "", 0).when(text.rlike(r"^[\x00-\x7F]*$"), ascii_).when(text.rlike(_class(list(COMMON), True)), first(bidi_ranges())).otherwise(first(bidi_ranges(COMMON)))


def barcode_text(kind: Column, data: Column) -> Column:
    return F.concat(kind, F.lit("[["), data, F.lit("]]"))


def barcode_parts(text: Column) -> tuple[Column, Column]:
    pattern = r"(\w+)\[\[([^\]]+)\]\]"
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def override_map(text: Column) -> Column:
    """ "a=b,c=d" as a map; an entry without exactly one = is an error."""
    entries = F.split(text, ",")
    bad = F.exists(entries, lambda e: F.size(F.split(e, "=")) != 2)
    empty, wrong = F.create_map().cast("map<string,string>"), F.raise_error(F.lit("an override is name=name")).cast("map<string,string>")
    return F.when(text == "", empty).when(bad, wrong).otherwise(F.str_to_map(text, F.lit(","), F.lit("=")))


def with_brightness(colour: Column, goal: float = 0.5) -> Column:
    """A #rrggbb colour scaled to a mean brightness; other texts stay as they are."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    r, g, b = part(2), part(4), part(6)
    factor = F.lit(goal) / ((r + g + b) / 3 / 255 + F.lit(0.0001))
    hexed = [F.lower(F.lpad(F.hex(F.least(F.lit(255), F.floor(c * factor)).cast("int")), 2, "0")) for c in (r, g, b)]
    return F.when(colour.rlike("^#[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), *hexed)).otherwise(colour)


#: Palettes of 2, 3, 4, 8, 16, 32 and 64 colours that are told apart well and avoid red. The smallest that
#: holds all labels is taken; the largest repeats.
PALETTES = (
    (
        "#2781ff", "#ffb217",
    ),
    (
        "#8300c1", "#01fb99", "#ffb638",
    ),
    (
        "#319cff", "#ff9e25", "#380d68", "#c1ff79",
    ),
    (
        "#ff67e4", "#3ad615", "#0008ad", "#ffaf20", "#bd7aff", "#005921", "#a5009a", "#002560",
    ),
    (
        "#8ebf00", "#8539e8", "#fff55a", "#61009e", "#c3ff94", "#ff38dd", "#006d31", "#ff8edd", "#8b7c00", "#80a4ff", "#ffa337", "#20254d",
        "#2ceeff", "#bc692d", "#007084", "#cadcb2",
    ),
    (
        "#02c171", "#8c09cb", "#3dec3f", "#d513d7", "#dfff03", "#0032b1", "#b5c900", "#440084", "#96ff93", "#420562", "#8dffc0", "#a50076",
        "#017426", "#ff7ff7", "#436300", "#9583ff", "#ffbe55", "#31a6ff", "#756f00", "#a1abff", "#283500", "#cc4a9b", "#005947", "#e7c1ff",
        "#002e57", "#ffceae", "#0072bd", "#be7d52", "#00ace3", "#e1a4c5", "#01a4ad", "#72aac6",
    ),
    (
        "#291c5f", "#8eff39", "#3133d9", "#c9e600", "#9f30e3", "#6eff67", "#8500a1", "#01ab1b", "#240683", "#ffea1c", "#5a6dff", "#84c300",
        "#0054d4", "#ffc828", "#400071", "#01de70", "#bd00a0", "#1b8c00", "#ff8afb", "#b9ff85", "#0256c2", "#f09800", "#7586ff", "#8e9f00",
        "#3399ff", "#a68c00", "#c097ff", "#006200", "#ff78d4", "#01cfa1", "#9b006f", "#a0ffb4", "#59004e", "#7fffc8", "#08255b", "#ffe583",
        "#003d65", "#ff9851", "#007dc2", "#b36700", "#5afaff", "#a5500a", "#02f1d9", "#ff99e2", "#567700", "#e4a6ff", "#01aa75", "#fba6d5",
        "#017e49", "#eec9ff", "#003615", "#b1c9ff", "#8d5a00", "#02a7bf", "#525700", "#bf77a0", "#c2fece", "#6e4d6c", "#ecf7ac", "#5c769b",
        "#3d3300", "#adc097", "#684024", "#c78c66",
    ),
)


def label_colours(labels: DataFrame, column: str = "label") -> DataFrame:
    """Rows (label, colour) of the distinct labels in order; the colours of the largest palette repeat.

    The place of a label is how many are in the ranges before its own and in its own before it, so no task holds all.
    """
    distinct = labels.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(distinct.repartitionByRange(parts, "label").sortWithinPartitions("label").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("count"))  # one row for each partition
    sums = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("label")) - 1 + F.col("before")
    numbered = ranged.join(F.broadcast(sums), "part").select("label", "n", at.alias("at"))
    sizes = [len(p) for p in PALETTES]
    size = F.coalesce(*[F.when(F.col("n") <= s, s) for s in sizes], F.lit(sizes[-1]))
    colours = F.create_map(*[x for p in PALETTES for x in (F.lit(len(p)), F.array(*map(F.lit, p)))])
    return numbered.select("label", F.element_at(F.element_at(colours, size), (F.col("at") % size + 1).cast("int")).alias("colour"))
