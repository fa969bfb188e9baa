"""Release dates and tables in HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DATE = re.compile(r"\d{1,2} [A-Z][a-z]+ \d{4}")
# Fixed value: how many texts before a title its date may stand.
LOOK_BACK = 24


class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.texts: list[str] = []

    def handle_data(self, data: str) -> None:
        if text := " ".join(data.split()):
            self.texts.append(text)


class _Cells(HTMLParser):
    """Cells of tables; footnotes are dropped."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int, str]] = []
        self.table, self.row, self.cell, self.open, self.note = -1, -1, -1, False, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.cell = self.row + 1, -1
        elif tag in ("td", "th"):
            self.cell, self.open = self.cell + 1, True
            self.rows.append((self.table, self.row, self.cell, ""))
        self.note = self.note or tag == "sup"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.open = False
        elif tag == "sup":
            self.note = False

    def handle_data(self, data: str) -> None:
        if self.open and not self.note:
            self.rows[-1] = (*self.rows[-1][:3], " ".join((self.rows[-1][3] + " " + data).split()))


def release_dates(pages: DataFrame, title: str, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, period, release_day, n_days): for each `title: Month YYYY` the date found before it.

    n_days above 1 shows a period with conflicting dates.
    """
    wanted = re.compile(re.escape(title) + r": ([A-Z][a-z]+ \d{4})")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch[key], batch[html], strict=True):
                parser = _Texts()
                parser.feed(text or "")
                latest, seen = None, 0
                for i, token in enumerate(parser.texts):
                    if _DATE.fullmatch(token):
                        latest, seen = token, i
                    elif (found := wanted.fullmatch(token)) and latest and i - seen <= LOOK_BACK:
                        out.append((page, found[1], latest))
            yield pd.DataFrame(out, columns=[key, "period_text", "day_text"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, html).mapInPandas(read, f"{key} {kind}, period_text string, day_text string")
    typed = found.select(
        key, F.to_date("period_text", "MMMM yyyy").alias("period"), F.to_date("day_text", "d MMMM yyyy").alias("day")
    )
    return typed.groupBy(key, "period").agg(F.min("day").alias("release_day"), F.count_distinct("day").alias("n_days"))


def table_cells(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cell_no, text) of every table cell."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch[key], batch[html], strict=True):
                parser = _Cells()
                parser.feed(text or "")
                out.extend((page, *cell) for cell in parser.rows)
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "cell_no", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(
        read, f"{key} {kind}, table_no int, row_no int, cell_no int, text string"
    )


def effective_rates(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, effective, rate) of three-column tables year / day and month / rate; the year is carried down."""
    from pyspark.sql import Window

    cells = table_cells(pages, key=key, html=html)
    wide = cells.groupBy(key, "table_no", "row_no").pivot("cell_no", [0, 1, 2]).agg(F.first("text"))
    down = Window.partitionBy(key, "table_no").orderBy("row_no")
    year = F.last(F.when(F.col("0").rlike(r"^\d{4}$"), F.col("0")), ignorenulls=True).over(down)
    day = F.regexp_replace("1", r"\.", "")
    effective = F.coalesce(
        F.try_to_timestamp(F.concat_ws(" ", day, year), F.lit("d MMM yyyy")),
        F.try_to_timestamp(F.concat_ws(" ", day, year), F.lit("d MMMM yyyy"))
    )
    rate = F.translate("2", "−–", "--").try_cast("decimal(9,4)")
    typed = wide.select(key, effective.cast("date").alias("effective"), rate.alias("rate"))
    return typed.where(F.col("effective").isNotNull() & F.col("rate").isNotNull())


def archive_entries(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, entry_no, release_day, href, title, problem) of dated archive entries `<dt isoDate=…>date</dt> … title link`.

    An entry reaches to the next `<dt`. `problem` is null, or `date` where the
    attribute is missing, no date, or another one than the text shows, or
    `title` where no title link follows. Pages without entries give no rows.
    """
    entry = F.col("entry")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    parts = pages.select(key, F.posexplode(F.split(html, "(?i)<dt(?=[\\s>])")).alias("entry_no", "entry")).where("entry_no > 0")
    iso = F.regexp_extract(entry, r"(?is)^[^>]*\bisodate\s*=\s*[\"']([0-9]{4}-[0-9]{2}-[0-9]{2})[\"']", 1)
    shown = plain(F.regexp_extract(entry, "(?is)^[^>]*>(.*?)</dt>", 1))
    link = r"(?is)<div\b[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?title(?:\s[^\"']*)?[\"'][^>]*>\s*<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    typed = parts.select(
        key, "entry_no", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date").alias("release_day"),
        F.try_to_timestamp(shown, F.lit("d MMMM yyyy")).cast("date").alias("_shown"),
        F.nullif(F.regexp_extract(entry, link, 1), F.lit("")).alias("href"), F.nullif(plain(F.regexp_extract(entry, link, 2)), F.lit("")).alias("title"),
    )
    same = F.col("release_day").isNotNull() & F.col("release_day").eqNullSafe(F.col("_shown"))
    problem = F.when(~same, "date").when(F.col("href").isNull() | F.col("title").isNull(), "title")
    return typed.withColumn("problem", problem).drop("_shown")


def identifier_period(code: Column, release_day: Column) -> Column:
    """First day of the month that a code YYMM names, if it ended before the release, in its year or the year before."""
    year, month = F.substring(code, 1, 2).try_cast("int"), F.substring(code, 3, 2).try_cast("int")
    full = F.when(F.year(release_day) % 100 == year, F.year(release_day)).when((F.year(release_day) - 1) % 100 == year, F.year(release_day) - 1)
    first = F.when(code.rlike("^[0-9]{2}(0[1-9]|1[0-2])$"), F.make_date(full, month, F.lit(1)))
    return F.when(F.last_day(first) < release_day, first)
