"""Tables of stored web pages as grids: nested tables, spans, and end tags left out.

A page is read in one pass inside its task: the open tables are a stack, each with its current row
and cell, and spanned cells are placed from the columns that the rows above still hold. The tags of a page never become
rows of a frame, which would have to be sorted several times.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import share_code

TOKEN = re.compile(r"""(?is)[^<]+|<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?[a-z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>|<""", re.ASCII)
TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)")
ACROSS, DOWN = (re.compile(rf"""(?is)\s{name}\s*=\s*["']?\s*(\d{{1,9}})""", re.ASCII) for name in ("colspan", "rowspan"))
# The largest spans that the HTML standard allows.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534
_OPENING = frozenset({"td", "th"})
_ROW_END = frozenset({"thead", "/thead", "tbody", "/tbody", "tfoot", "/tfoot", "/tr"})
_BLANK = " \t\n\x0b\f\r"
# Result rows that a task holds before it passes them on.
BATCH_ROWS = 10_000


@dataclass(slots=True)
class _Cell:
    row: int
    head: bool
    across: int
    down: int
    parts: list[str] = field(default_factory=list)
    text: str = ""
    start: int = 0


@dataclass(slots=True)
class _Table:
    """Cells in page order, the number of the last row, whether it is open, and the cell that takes text."""

    cells: list[_Cell] = field(default_factory=list)
    row: int = -1
    in_row: bool = False
    cell: _Cell | None = None


def _span(tag: str, pattern: re.Pattern[str], most: int, whole: int) -> int:
    """A span attribute: 1 if missing, empty or no number, ``whole`` if 0."""
    found = pattern.search(tag)
    return min(int(found[1]) or whole, most) if found else 1


def _plain(text: str) -> str:
    """Text with plain blanks, and none around it."""
    if "&" in text:
        text = text.replace("&nbsp;", " ").replace("&lt;", "<").replace("&amp;", "&")
    return text.replace("\u00a0", " ").strip(_BLANK)


def _read_tag(token: str) -> tuple[str, int, int]:
    """Lower-case name, columns and rows of a tag."""
    named = TAG.match(token)
    tag = named[1].lower() if named else ""
    if tag not in _OPENING:
        return tag, 1, 1
    return tag, _span(token, ACROSS, MOST_COLUMNS, 1), _span(token, DOWN, MOST_ROWS, MOST_ROWS)


_known_tag = lru_cache(1_000)(_read_tag)


def _tables(html: str) -> list[list[_Cell]]:
    """The cells of every table that has some, in the order in which the tables start."""
    tables: list[_Table] = []
    stack: list[_Table] = []
    for found in TOKEN.finditer(html):
        token = found[0]
        if token[0] != "<" or token == "<":
            if stack and (cell := stack[-1].cell) is not None:
                cell.parts.append(token)
            continue
        # Long tags are rarely met again.
        tag, across, down = _known_tag(token) if len(token) <= 64 else _read_tag(token)
        if tag == "table":
            tables.append(_Table())
            stack.append(tables[-1])
        elif not stack:
            continue
        elif tag == "/table":
            stack.pop()
        elif tag in _OPENING:
            table = stack[-1]
            if not table.in_row:
                # A cell outside a row opens one.
                table.row, table.in_row = table.row + 1, True
            table.cell = _Cell(table.row, tag == "th", across, down)
            table.cells.append(table.cell)
        elif tag == "tr":
            stack[-1].row, stack[-1].in_row, stack[-1].cell = stack[-1].row + 1, True, None
        elif tag in _ROW_END:
            stack[-1].in_row, stack[-1].cell = False, None
        elif tag in ("/td", "/th"):
            stack[-1].cell = None
    return [table.cells for table in tables if table.cells]


def _place(cells: list[_Cell]) -> None:
    """Each cell's text, and its first column: the next one of its row that no cell from above reaches into."""
    busy: list[int] = []
    row, col = -1, 0
    for cell in cells:
        if cell.row != row:
            row, col = cell.row, 0
        while col < len(busy) and busy[col] > row:
            col += 1
        cell.start, cell.text, cell.parts = col, _plain("".join(cell.parts)), []
        end, until = col + cell.across, row + cell.down
        if end > len(busy):
            busy.extend([0] * (end - len(busy)))
        for x in range(col, end):
            if busy[x] < until:
                busy[x] = until
        col = end


def _rows(cells: list[_Cell]) -> Iterator[tuple[int, list[_Cell]]]:
    """Every row that has cells, with its own ones and those that reach into it; spans end with the table."""
    at, reaching = 0, []
    for row in range(cells[-1].row + 1):
        reaching = [cell for cell in reaching if cell.row + cell.down > row]
        while at < len(cells) and cells[at].row == row:
            reaching.append(cells[at])
            at += 1
        if reaching:
            yield row, reaching


def _places(html: str) -> Iterator[tuple]:
    for number, cells in enumerate(_tables(html)):
        _place(cells)
        for row, reaching in _rows(cells):
            for cell in reaching:
                for col in range(cell.start, cell.start + cell.across):
                    yield number, row, col, cell.head, cell.row == row and cell.start == col, cell.text


def _body_rows(html: str, headers: Sequence[str], lead: bool) -> Iterator[tuple]:
    for number, cells in enumerate(_tables(html)):
        if not any(cell.head for cell in cells):
            continue
        _place(cells)
        found: dict[str, set[int]] = {header: set() for header in headers}
        for cell in cells:
            if cell.head and cell.text in found:
                found[cell.text].update(range(cell.start, cell.start + cell.across))
        under = [sorted(found[header]) for header in headers]
        if not any(under):
            continue
        for row, reaching in _rows(cells):
            for cell in reaching:
                if not cell.head and cell.row == row:
                    break
            else:
                continue
            places: dict[int, str] = {}
            for cell in reaching:
                for col in range(cell.start, cell.start + cell.across):
                    if col not in places:
                        places[col] = cell.text
            texts = []
            for cols in under:
                for col in cols:
                    if col in places:
                        texts.append(places[col])
                        break
                else:
                    texts.append(None)
            if texts.count(None) < len(texts):
                yield number, row, *([places[min(places)]] if lead else []), *texts


def table_grids(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per place of every table's grid: ``key``, table_no, row, col, head, first, text.

    Tables with cells are numbered by page, from 0 in the order of their start; a nested table is a table of its own, and its
    text is not that of the cell around it. A spanned cell stands at each of its places, ``first`` only at the upper
    left one; a row span ends with the table (0 means up to there). ``head`` tells ``th`` cells. End tags of cells and rows may be left
    out; comments, scripts and styles are skipped. Pages are told apart by ``key``; a null page, or one without a table, gives no rows, nor does a table without
    cells. Rows that repeat a key have to be made distinct before.
    """
    # Reading makes many rows of one page, so the pages are dealt out first.
    fields = "table_no INT, row INT, col INT, head BOOLEAN, first BOOLEAN, text STRING"
    return _read(pages.select(key, html).repartition(key), key, html, _places, fields)


def grid_rows(pages: DataFrame, key: str, headers: Sequence[str], html: str = "html", first_column: str | None = None) -> DataFrame:
    """Body rows of the tables that have one of the wanted headers: ``key``, table_no, row, and a text column per header.

    A body row has a ``td`` cell of its own. A header stands for the leftmost column that has it in a ``th`` cell, in
    whichever row; a missing one is NULL. Columns are named in lower case without dots; ``first_column`` names the leading column, taken by position.
    """
    names = [*([first_column] if first_column else []), *(h.lower().replace(".", "") for h in headers)]
    kinds = T.StructType([T.StructField(n, T.IntegerType()) for n in ("table_no", "row")] + [T.StructField(n, T.StringType()) for n in names])
    wanted, lead = tuple(headers), first_column is not None
    return _read(pages.select(key, html), key, html, lambda page: _body_rows(page, wanted, lead), kinds)


def _read(pages: DataFrame, key: str, html: str, rows_of: Callable[[str], Iterator[tuple]], fields: str | T.StructType) -> DataFrame:
    """The rows of each page beside its ``key``, in batches of bounded length."""
    share_code(pages.sparkSession)
    kinds = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    names, schema = kinds.names, T.StructType([pages.schema[key], *kinds])
    types = [to_arrow_type(f.dataType) for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, stored = batch.column(0), batch.column(1).cast(pa.binary())
            at: list[int] = []
            held: list[tuple] = []

            def passed() -> pa.RecordBatch:
                columns = [pa.array(values, kind) for values, kind in zip(zip(*held, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], names=[key, *names])

            for n, page in enumerate(stored):
                if not page.is_valid:
                    continue
                for row in rows_of(page.as_py().decode("utf-8", "replace")):
                    at.append(n)
                    held.append(row)
                    if len(held) >= BATCH_ROWS:
                        yield passed()
                        at, held = [], []
            if held:
                yield passed()

    return pages.mapInArrow(run, schema)
