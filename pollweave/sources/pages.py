"""Rows from stored web pages.

Pages are a frame with one row each; cells come out through built-in regular
expression functions, so the work is split by page and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import collapse_other, decimal_comma, parse_day, recode, survey_mode
from ..functions.text import POLL_MARKS

HEAD_CELL = r"(?is)<th\b[^>]*>(.*?)</th>"
BODY = r"(?is)<tbody\b[^>]*>(.*?)</tbody>"
BODY_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
BODY_CELL = r"(?is)<td\b[^>]*>(.*?)</td>"
LINK_ITEM = r'<li><a href="([^"]*)">([^<]*)</a></li>'


def cell_text(cell: Column) -> Column:
    """Cell content without tags, hard spaces and outer blanks."""
    plain = F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]*>", ""), "&nbsp;| ", " ")
    return F.trim(F.regexp_replace(plain, "&amp;", "&"))


def table_rows(
    pages: DataFrame,
    key: str,
    headers: Sequence[str],
    html: str = "html",
    first_column: str = "datum",
    shifted: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Body rows of the table on each page, one text column per wanted header.

    A header is looked up by its text, so pages may order or lack columns
    (NULL then); the columns are named in lower case without dots. The leading
    column is taken by position. ``shifted`` names, per
    page key, the headers whose cells stand one place further right.
    """
    heads = F.transform(F.regexp_extract_all(F.col(html), F.lit(HEAD_CELL), 1), cell_text)
    rows = F.flatten(
        F.transform(
            F.regexp_extract_all(F.col(html), F.lit(BODY), 1),
            lambda body: F.regexp_extract_all(body, F.lit(BODY_ROW), 1),
        )
    )
    cells = F.transform(rows, lambda row: F.transform(F.regexp_extract_all(row, F.lit(BODY_CELL), 1), cell_text))
    # Heads are found once a page, below the rows, and cells once a row, in what is exploded: whatever is selected
    # beside or after it would be evaluated anew for every row and for every use, later filters included.
    read = pages.select(key, F.col(html), heads.alias("_heads"))
    listed = read.select(key, "_heads", F.posexplode(cells).alias("row", "_cells")).filter(F.size("_cells") > 0)

    def cell(header: str) -> Column:
        place = F.array_position("_heads", F.lit(header)).cast("int")
        moved = [k for k, names in (shifted or {}).items() if header in names]
        index = place - 1 + (F.when(F.col(key).isin(*moved), 1).otherwise(0) if moved else 0)
        return F.when(place > 0, F.get("_cells", index))

    return listed.select(
        key,
        "row",
        F.get("_cells", 0).alias(first_column),
        *[cell(h).alias(h.lower().replace(".", "")) for h in headers],
    )


def link_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Linked list items of each page: (key, position, target, label)."""
    items = F.regexp_extract_all(F.col(html), F.lit(LINK_ITEM), 0)
    return pages.select(key, F.posexplode(items).alias("position", "_item")).select(
        key,
        "position",
        F.regexp_extract("_item", LINK_ITEM, 1).alias("target"),
        F.regexp_extract("_item", LINK_ITEM, 2).alias("label"),
    )


# Column heads of the published poll tables, and party labels.
POLL_HEADERS = (
    "CDU/CSU", "SPD", "GRÜNE", "FDP", "LINKE", "AfD", "Sonstige",
    "Nichtwähler/Unentschl.", "FW", "Befragte", "Zeitraum",
)
POLL_PARTIES = {
    "cdu/csu": "CDU/CSU", "spd": "SPD", "grüne": "Grüne", "fdp": "FDP", "linke": "Linke",
    "afd": "AfD", "sonstige": "sonstige", "nichtwähler/unentschl": "nw_un", "fw": "fw",
}
ELECTION_ROW = "Bundestagswahl"
SHIFTED_CELLS = {"politbarometer": ("Befragte", "Zeitraum")}


@dataclass(frozen=True)
class PollColumns:
    """Column names of the raw poll rows."""

    source: str = "institut"
    day: str = "datum"
    size: str = "befragte"
    period: str = "zeitraum"
    parties: Mapping[str, str] = field(default_factory=lambda: dict(POLL_PARTIES))
    election_row: str = ELECTION_ROW


def clean_poll_rows(raw: DataFrame, columns: PollColumns = PollColumns()) -> DataFrame:
    """Text rows to the long poll table: source, day, size, period, mode, party, share (0..1).

    Election-result rows and rows without a sample size are dropped.
    """
    c = columns
    size_text = F.col(c.size)

    def stripped(name: str) -> Column:
        return F.trim(F.regexp_replace(F.col(name), POLL_MARKS, ""))

    size = F.regexp_replace(stripped(c.size), "[.]", "").try_cast("double")
    parties = [p for p in c.parties if p in raw.columns]
    wide = raw.filter(~F.coalesce(size_text.contains(c.election_row), F.lit(False))).select(
        c.source,
        parse_day(F.trim(F.col(c.day))).alias(c.day),
        size.alias(c.size),
        F.col(c.period),
        survey_mode(size_text).alias("typ"),
        *[decimal_comma(stripped(p)).alias(p) for p in parties],
    )
    ids = [c.source, c.day, c.size, c.period, "typ"]
    return (
        wide.filter(F.col(c.size).isNotNull())
        .unpivot(ids, parties, "partei", "anteil")
        .select(*ids, recode(F.col("partei"), c.parties).alias("partei"), (F.col("anteil") / 100).alias("anteil"))
    )


def main_parties(polls: DataFrame, keep: Sequence[str], party: str = "partei", share: str = "anteil") -> DataFrame:
    """Polls of the listed parties with a known share."""
    return polls.filter(F.col(party).isin(*keep) & F.col(share).isNotNull())


def lump_parties(polls: DataFrame, keep: Sequence[str], party: str = "partei") -> DataFrame:
    """Rename every party that is not listed to Other."""
    return polls.withColumn(party, collapse_other(F.col(party), keep))
