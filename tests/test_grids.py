"""Grids of web tables against a parser with a stack."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pollweave.sources.grids import grid_rows, table_grids


class Tables(HTMLParser):
    """Tables in page order: rows of (head, across, down, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.all, self.open = [], []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "table":
            self.all.append({"rows": [], "row": False, "cell": None})
            self.open.append(self.all[-1])
        elif self.open:
            top = self.open[-1]
            if tag in ("tr", "thead", "tbody", "tfoot"):
                top["cell"], top["row"] = None, tag == "tr"
                if tag == "tr":
                    top["rows"].append([])
            elif tag in ("td", "th"):
                if not top["row"]:
                    top["rows"].append([])
                    top["row"] = True
                top["cell"] = [tag == "th", int(own.get("colspan") or 1) or 1, int(own.get("rowspan") or 1) or 65_534, ""]
                top["rows"][-1].append(top["cell"])

    def handle_endtag(self, tag):
        if self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            self.open[-1]["cell"] = None
            if tag not in ("td", "th"):
                self.open[-1]["row"] = False

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][3] += data


def grid(html):
    parser, out = Tables(), set()
    parser.feed(html)
    for n, table in enumerate(one for one in parser.all if any(one["rows"])):
        taken, last = set(), max(r for r, row in enumerate(table["rows"]) if row)
        for r, row in enumerate(table["rows"]):
            col = 0
            for head, across, down, text in row:
                while (r, col) in taken:
                    col += 1
                for y in range(r, min(r + down, last + 1)):
                    for x in range(col, col + across):
                        taken.add((y, x))
                        out.add((n, y, x, head, (y, x) == (r, col), text.strip()))
                col += across
    return out


def random_table(pick, depth=0):
    parts = [pick.choice(["<table>", "<TABLE class='x>y'>"])]
    for _ in range(pick.randint(0, 5)):
        parts.append(pick.choice(["<tr>", "<tr>", "<tbody><tr>", "</tr><tr >", "</tbody>"]))
        for _ in range(pick.randint(0, 4)):
            tag = pick.choice(["td", "th"])
            span = pick.choice(["", "", "", f" colspan={pick.randint(0, 3)}", f' rowspan="{pick.randint(0, 3)}"', " rowspan=''"])
            parts.append(f"<{tag}{span}>{pick.choice(['', 'a', 'b c', '<b>d</b>'])}")
            if depth < 2 and pick.random() < 0.15:
                parts.append(random_table(pick, depth + 1) + "after")
            parts.append(pick.choice(["", f"</{tag}>", f"</{tag}> between "]))
    return "".join(parts) + "</table>"


def test_grids_against_a_parser(spark):
    pick = random.Random(5)
    pages = ["text " + "".join(random_table(pick) + pick.choice(["", "<p>x", "<!-- <table><td>no -->"]) for _ in range(3)) for _ in range(120)]
    pages += ["", "no table", "<table>", "<table><td>open", "</table><table><tr><td>x</table></table><td>y", "<script>'<table><td>'</script><table><td>1</table>"]
    frame = spark.createDataFrame([*enumerate(pages), (-1, None), (None, pages[0])], "id int, html string").selectExpr("*", "'x' AS page", "1 AS row", "2 AS at").repartition(4)
    found = {}
    for r in table_grids(frame, "id").collect():
        found.setdefault(r.id, set()).add(tuple(r)[1:])
    wanted = {n: grid(html) for n, html in enumerate(pages)}
    assert found == {n: g for n, g in wanted.items() if g} | {None: wanted[0]}
    assert table_grids(frame.limit(0), "id").count() == 0


def test_headers_are_found_under_spans_and_when_missing(spark):
    html = "<table><tr><th>Datum<th colspan=2>SPD<th>FDP</tr><tr><td>1.1.<td>30<td>x<td>5<tr><td>2.1.<td colspan=2>31<td>6</table><table><td>other</table>"
    rows = grid_rows(spark.createDataFrame([("a", html)], "site string, html string"), "site", ("FDP", "SPD", "AfD"), first_column="datum").orderBy("row").collect()
    assert [tuple(r) for r in rows] == [("a", 0, 1, "1.1.", "5", "30", None), ("a", 0, 2, "2.1.", "6", "31", None)]


def test_one_exchange_for_all_that_a_page_needs(spark):
    """Nesting, rows and cells are told within pages: the tags are shuffled once."""
    pages = spark.range(10).select((F.col("id") + 1).alias("id"), F.lit("<table><td>1</table>").alias("html"))
    plan = table_grids(pages, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_pages_grouped_by_key_are_read_without_sorting(spark):
    """Tags are no rows: nothing is sorted, spilled or shuffled once a page is in one row."""
    lines = spark.range(2_000).selectExpr("id % 20 AS id", "concat('<tr><td>', id) AS part")
    pages = lines.groupBy("id").agg(F.concat(F.lit("<table><th>A"), F.array_join(F.array_sort(F.collect_list("part")), "")).alias("html"))
    rows = grid_rows(pages, "id", ("A",))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and not any(word in plan for word in ("Sort ", "Window", "Generate"))
    found = rows.collect()
    assert len(found) == 2_000 and {(r.id, r.table_no, int(r.a) % 20) for r in found} == {(n, 0, n) for n in range(20)}
