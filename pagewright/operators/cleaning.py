"""Filters and splits of word boxes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators.keys import on_page

#: Ratios at which a box with a date range is cut: behind the first date, and behind the hyphen in what is left.
FIRST_DATE, HYPHEN = 0.49, 0.07
TALL = 1.05
LONGEST_RUN = 10
RANGE_RUN = r"^\d{1,2}/\d{1,2}/\d{4}-\d{1,2}/\d{1,2}/\d{4}$"
_DATED = re.compile(RANGE_RUN, re.ASCII)


def split_date_ranges(boxes: DataFrame, box: str = "box", seq: str = "seq", within: Column | None = None) -> DataFrame:
    """A box with a date range becomes three: date, hyphen, date. All other columns repeat; part numbers the pieces.

    Rows that are not within stay whole.
    """
    b = F.col(box)

    def three(b: Column) -> Column:
        dates = F.split(b["text"], "-")
        behind = lambda first, rest: F.array(G.retext(first, T.stripped(F.get(dates, F.lit(0)))), G.retext(rest[0], F.lit("-")), G.retext(rest[1], T.stripped(F.get(dates, F.lit(1)))))
        return G.let(F.array(*G.split(b, FIRST_DATE)), lambda x: G.let(F.array(*G.split(x[1], HYPHEN)), lambda rest: behind(x[0], rest)))

    whole = F.coalesce(b["text"].rlike(T.DATE_RANGE), F.lit(False))
    if within is not None:
        whole = within & whole
    others = [c for c in boxes.columns if c != box]
    # one pass, so that what makes the boxes runs once
    return boxes.select(*others, F.posexplode(F.when(whole, G.let(b, three)).otherwise(F.array(b))).alias("part", box))


def median_height(boxes: DataFrame, page: list[str], box: str = "box") -> DataFrame:
    """Rows (page, median_height): exact, the mean of the middle two for an even number."""
    return boxes.groupBy(*page).agg(F.median(G.box_height(F.col(box))).alias("median_height"))


def without_columns_of_digits(boxes: DataFrame, page: list[str], width_by_height: Column, box: str = "box") -> DataFrame:
    """Drops boxes that are taller than the page's median, stand upright and hold no single character.

    A text without characters is dropped, a missing text stays.
    """
    b = F.col(box)
    joined = on_page(boxes, median_height(boxes, page, box), page)
    odd = (G.box_height(b) > F.col("median_height") * TALL) & G.stands_upright(b, width_by_height) & (F.length(T.stripped(b["text"])) != 1)
    return joined.where(~F.coalesce(odd, F.lit(False))).drop("median_height")


def date_run_candidates(boxes: DataFrame, page: list[str], box: str = "box", seq: str = "seq", longest: int = LONGEST_RUN) -> DataFrame:
    """Rows (page, seq, n): a run of n boxes from seq whose joined text, without blanks, is a date range."""
    following = Window.partitionBy(*page).orderBy(seq).rowsBetween(0, longest - 1)
    texts = F.collect_list(F.regexp_replace(F.coalesce(F.col(box)["text"], F.lit("")), " ", "")).over(following)
    runs = boxes.select(*page, seq, texts.alias("texts")).select(*page, seq, "texts", F.explode(F.when(F.size("texts") >= 2, F.sequence(F.lit(2), F.size("texts")))).alias("n"))
    return runs.where(F.array_join(F.slice("texts", 1, F.col("n")), "").rlike(RANGE_RUN)).select(*page, seq, "n")


def without_date_runs(boxes: DataFrame, page: list[str], box: str = "box", seq: str = "seq", longest: int = LONGEST_RUN) -> DataFrame:
    """Removes runs of boxes that together read as a date range: the longest first, then the leftmost, until none is left.

    The texts of a page that could hold a run come together as one array, and the sequential step sees many such pages at
    once; what it gives are places.
    """
    text = F.regexp_replace(F.coalesce(F.col(box)["text"], F.lit("")), " ", "")
    pages = boxes.select(*page, F.struct(F.col(seq).alias("s"), text.alias("t")).alias("w")).groupBy(*page).agg(F.array_sort(F.collect_list("w")).alias("w"))
    texts = F.transform("w", lambda w: w["t"])
    dated = pages.where(F.array_join(texts, "").rlike(RANGE_RUN.strip("^$")))

    @F.pandas_udf("array<int>")
    def doomed(pages: pd.Series) -> pd.Series:
        return pd.Series([date_run_places(list(t), longest) for t in pages], dtype=object)

    gone = dated.select(*page, "w", F.explode(doomed(texts)).alias("k")).select(*page, F.get("w", "k")["s"].alias(seq))
    return on_page(boxes, gone, [*page, seq], "left_anti")


def date_run_places(texts: list[str], longest: int = LONGEST_RUN) -> list[int]:
    """Places of texts without blanks that go as runs: the longest first, then the leftmost, until none is left."""
    left, gone = list(enumerate(texts)), []

    def one_run() -> bool:
        for n in range(min(longest, len(left)), 1, -1):
            for at in range(len(left) - n + 1):
                if _DATED.match("".join(t for _, t in left[at : at + n])):
                    gone.extend(k for k, _ in left[at : at + n])
                    del left[at : at + n]
                    return True
        return False

    while one_run():
        pass
    return gone


def confident(boxes: DataFrame, threshold: float, confidence: str = "confidence") -> DataFrame:
    return boxes.where(F.col(confidence) > threshold)
