"""Table structure: alignment of components, cell tagging, grids, and their rendering.

Statistics and joins are DataFrame operations. A single table's grid, whose cells
move one after another, is built in Python: tables are sorted together and come as a stream of Arrow
batches, since a call of Python for each table costs far more than a small table's grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import fmean

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import block_type, is_caption
from folioframe.operators.layout import best_overlap, nearest_column
from folioframe.operators.reading_order import present, repair, tolerance_order


def align_edges(components: DataFrame) -> DataFrame:
    """(table_id, label, x0, x1, top, bottom) with rows and headers drawn out to common left and right
    edges, and columns to a common top and bottom: the mean (columns: median) of more than four, else the extreme."""
    rows = F.col("label").contains("row") | F.col("label").contains("header")
    rows = rows & ~F.col("label").startswith("row") & ~F.col("label").startswith("header")  # not at the name's beginning
    cols = F.col("label") == "table column"
    w = Window.partitionBy("table_id")
    of = lambda agg, which, c: agg(F.when(which, F.col(c))).over(w)
    many = lambda which: F.count(F.when(which, 1)).over(w) > 4
    left = F.when(many(rows), of(F.avg, rows, "x0")).otherwise(of(F.min, rows, "x0"))
    right = F.when(many(rows), of(F.avg, rows, "x1")).otherwise(of(F.max, rows, "x1"))
    top = F.when(many(cols), of(F.median, cols, "top")).otherwise(of(F.min, cols, "top"))
    bottom = F.when(many(cols), of(F.median, cols, "bottom")).otherwise(of(F.max, cols, "bottom"))
    return components.select(
        *[c for c in components.columns if c not in ("x0", "x1", "top", "bottom")],
        F.when(rows, F.least("x0", left)).otherwise(F.col("x0")).alias("x0"),
        F.when(rows, F.greatest("x1", right)).otherwise(F.col("x1")).alias("x1"),
        F.when(cols, F.least("top", top)).otherwise(F.col("top")).alias("top"),
        F.when(cols, F.greatest("bottom", bottom)).otherwise(F.col("bottom")).alias("bottom"),
    )


def tag_cells(cells: DataFrame, components: DataFrame) -> DataFrame:
    """Cells (table_id, b_idx, b_x0..) with the numbers and extents of their row R, header H, column C
    and span SP from components (table_id, label, r_idx, r_x0..). A span's extents replace the header's."""
    pick = lambda pattern: components.where(F.col("label").rlike(pattern)).select("table_id", "r_idx", "r_x0", "r_y0", "r_x1", "r_y1")
    hit = lambda pattern, p: best_overlap(cells, pick(pattern), 0.3, (), "table_id").select(
        "table_id", "b_idx", F.col("r_idx").alias(p), F.col("r_x0").alias(f"{p}_left"), F.col("r_x1").alias(f"{p}_right"), F.col("r_y0").alias(f"{p}_top"), F.col("r_y1").alias(f"{p}_bott")
    )
    key = ["table_id", "b_idx"]
    column = pick("^table column$")
    near = nearest_column(cells, column, "table_id").join(column, ["table_id", "r_idx"])
    near = near.select(*key, F.col("r_idx").alias("C"), F.col("r_x0").alias("C_left"), F.col("r_x1").alias("C_right"))
    out = cells.join(hit("row$", "R").drop("R_left", "R_right"), key, "left").join(hit("header$", "H"), key, "left").join(near, key, "left").join(hit("spanning", "SP"), key, "left")
    for side in ("left", "right", "top", "bott"):
        out = out.withColumn(f"H_{side}", F.coalesce(f"SP_{side}", f"H_{side}")).drop(f"SP_{side}")
    return out


#: Cells that one task takes when tables are dealt over tasks.
TASK_CELLS = 400_000


def _dealt(cells: DataFrame) -> DataFrame:
    """Whole tables to tasks, as many more as there are more cells: what follows is grouped within a task, however large the files' parts."""
    return cells.repartition(1 + cells.count() // TASK_CELLS, "table_id")


def dominant_type(cells: DataFrame) -> DataFrame:
    """(table_id, btype): the commonest type of a table's cells (table_id, cell_no, text); of equal ones, the first seen. Null is a type."""
    typed = _dealt(cells).withColumn("btype", block_type(F.col("text")))
    counts = typed.groupBy("table_id", "btype").agg(F.count("*").alias("n"), F.min("cell_no").alias("seen"))
    best = counts.groupBy("table_id").agg(F.max_by(F.struct("btype"), F.struct("n", -F.col("seen"))).alias("m"))
    return best.select("table_id", F.col("m.btype").alias("btype"))


def header_rows(cells: DataFrame, dominant: DataFrame) -> DataFrame:
    """(table_id, rn) of the rows where over half of the filled places vote for a header.

    A place votes by its first cell: in a table of numbers if that is no number, else if any of its cells
    has a header number that is not 0. Cells: (table_id, rn, cn, cell_no, text, H)."""
    typed = _dealt(cells).withColumn("btype", block_type(F.col("text")))
    place = typed.groupBy("table_id", "rn", "cn").agg(F.min_by(F.struct("btype"), "cell_no").alias("first"), F.max(F.coalesce(F.col("H") != 0, F.lit(False))).alias("headed"))
    kind, number = F.col("first.btype"), F.coalesce(F.col("btype") == "Nu", F.lit(False))
    vote = F.when(number, ~F.coalesce(kind == "Nu", F.lit(False))).otherwise(F.col("headed"))
    votes = place.join(dominant, "table_id").groupBy("table_id", "rn").agg(F.avg(vote.cast("int")).alias("share"))
    return votes.where("share > 0.5").select("table_id", "rn")


def row_segments(cells: DataFrame) -> DataFrame:
    """rn of cells (table_id, R, ...) that all have a row number: from 0, a new one where R changes in (R, x0) order."""
    w = Window.partitionBy("table_id").orderBy("R", "x0", "cell_no")
    new = F.coalesce((F.col("R") != F.lag("R").over(w)).cast("int"), F.lit(0))
    return cells.withColumn("__new", new).withColumn("rn", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def markdown(cells: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """(table_id, markdown) of placed cells (table_id, rn, cn, cell_no, text); the first row is the header. Places
    without cells are empty; a row number without cells gives no line. captions: (table_id, caption)."""
    place = cells.groupBy("table_id", "rn", "cn").agg(F.array_sort(F.collect_list(F.struct("cell_no", "text"))).alias("t"))
    place = place.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), " "))
    width = cells.groupBy("table_id").agg((F.max("cn") + 1).alias("width"))
    row = place.groupBy("table_id", "rn").agg(F.map_from_entries(F.collect_list(F.struct("cn", "text"))).alias("m")).join(width, "table_id")
    texts = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.element_at("m", c.cast(dict(cells.dtypes)["cn"])), F.lit("")))
    line = F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |\n"))
    rows = row.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("l"), F.first("width").alias("width"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width").cast("int")), " | "), F.lit(" |\n"))
    text = F.transform("l", lambda x: x["line"])
    body = F.concat(F.get(text, F.lit(0)), rule, F.array_join(F.slice(text, F.lit(2), F.size(text)), ""))
    if captions is None:
        return rows.select("table_id", body.alias("markdown"))
    cap = F.when(F.coalesce(F.col("caption"), F.lit("")) != "", F.concat(F.lit("**"), F.col("caption"), F.lit("**\n\n"))).otherwise("")
    return rows.join(captions, "table_id", "left").select("table_id", F.concat(cap, body).alias("markdown"))


@dataclass
class Grid:
    """One table: its cells, and the lists of cells (by number) at each place."""

    cells: list[dict]
    at: list[list[list[int]]] = field(default_factory=list)

    def text(self, place: list[int], sep: str = "") -> str:
        return sep.join(self.cells[i]["text"] or "" for i in place)

    def turned(self) -> Grid:
        return Grid(self.cells, [list(col) for col in zip(*self.at, strict=True)])


def missing(v) -> bool:
    return not present(v)


def _segments(cells: list[dict], order: list[int], label: str, low: str, high: str, slack: float, step: bool) -> list[list[int]]:
    """Runs of cells in order. A run ends where the label changes (step: where it grows by just one on the same page), or
    where the next cell begins beyond the run's edge, a running mean, and its label differs or is missing."""
    runs: list[list[int]] = []
    edge = 0.0
    for i in order:
        c = cells[i]
        if runs:
            before = cells[runs[-1][-1]]
            a, b = before[label], c[label]
            if step:
                turn = (1 if missing(b) else b) - (1 if missing(a) else a) == 1 and before["page_number"] == c["page_number"]
            else:
                turn = not (missing(a) and missing(b)) and a != b
            turn = turn or (c[low] >= edge - slack and (missing(a) or missing(b) or a != b))
            if not turn:
                edge = (edge + c[high]) / 2
                runs[-1].append(i)
                continue
        runs.append([i])
        edge = c[high]
    return runs


def _absorb_lonely(grid: Grid, low: str, high: str) -> Grid:
    """Columns that hold one filled place move into the neighbour that is nearer, unless
    both neighbours of that place are text or the table's end."""
    rows = grid.at
    j = 0
    while rows and j < len(rows[0]):
        filled = [i for i, row in enumerate(rows) if row[j]]
        if len(filled) != 1:
            j += 1
            continue
        row = rows[filled[0]]
        own = grid.cells[row[j][0]]
        gaps = {}
        for k in (j - 1, j + 1):
            if 0 <= k < len(row) and not (row[k] and grid.cells[row[k][0]]["text"]):
                others = [grid.cells[i] for r in rows for i in r[k]]
                gaps[k] = min((own[low] - o[high] if k < j else o[low] - own[high] for o in others), default=float("inf"))
        if not gaps or min(gaps.values()) == float("inf"):
            j += 1
            continue
        to = j - 1 if gaps.get(j - 1, float("inf")) < gaps.get(j + 1, float("inf")) else j + 1
        row[to].extend(row[j])
        for r in rows:
            del r[j]
    return grid


def build_grid(cells: list[dict]) -> Grid:
    """Rows and columns of one table's cells; lonely columns (given four rows) and rows (given four columns) are absorbed.

    Cells are dicts with the fields of TABLE_CELL, missing labels null."""
    least = lambda a, b, label: min((c[a] - c[b] for c in cells if present(c[label]) and present(c[a]) and present(c[b])), default=0.0) / 2
    for i, c in enumerate(cells):
        c["__i"] = i
    by_row = repair(tolerance_order(cells, "top", "x0", least("R_bott", "R_top", "R")), "R", "x0")
    rows = _segments(cells, [c["__i"] for c in by_row], "R", "top", "bottom", 3.0, False)
    in_x = tolerance_order(by_row, "x0", "top", least("C_right", "C_left", "C"))
    if len({c["page_number"] for c in cells}) == 1:
        in_x = repair(in_x, "C", "top")
    cols = _segments(cells, [c["__i"] for c in in_x], "C", "x0", "x1", 0.0, True)
    row_of, col_of = ({i: n for n, run in enumerate(runs) for i in run} for runs in (rows, cols))
    grid = Grid(cells, [[[] for _ in cols] for _ in rows])
    for c in in_x:
        grid.at[row_of[c["__i"]]][col_of[c["__i"]]].append(c["__i"])
    if len(rows) >= 4:
        _absorb_lonely(grid, "x0", "x1")
    if len(grid.at[0]) >= 4:
        grid = _absorb_lonely(grid.turned(), "top", "bottom").turned()
    return grid


def spread_spans(grid: Grid) -> Grid:
    """Cells with a span cover every place whose centre line lies within their extents, made one rectangle; its
    places share one content, in reading order, equal texts once."""
    if not any(present(c["SP"]) for c in grid.cells):
        return grid
    rows, cols = range(len(grid.at)), range(len(grid.at[0]))
    mean = lambda places, a, b: fmean([c[a] if a in c and present(c[a]) else c[b] for p in places for c in (grid.cells[i] for i in p)] or [0.0])
    line = [[grid.at[r][c] for r in rows] for c in cols]
    mid_x = [(mean(p, "C_left", "x0") + mean(p, "C_right", "x1")) / 2 for p in line]
    mid_y = [(mean(p, "R_top", "top") + mean(p, "bottom", "bottom")) / 2 for p in grid.at]
    for r in rows:
        for c in cols:
            spans = [grid.cells[i] for i in grid.at[r][c] if present(grid.cells[i]["SP"])]
            if not spans:
                continue
            over_c = {c} | {j for s in spans for j in cols if s["H_left"] <= mid_x[j] <= s["H_right"]}
            over_r = {r} | {i for s in spans for i in rows if s["H_top"] <= mid_y[i] <= s["H_bott"]}
            if len(over_c) < 2 and len(over_r) < 2:
                continue
            content: list[int] = []
            box = [(i, j) for i in range(min(over_r), max(over_r) + 1) for j in range(min(over_c), max(over_c) + 1)]
            for i, j in box:
                if grid.at[i][j] is not content and grid.at[i][j] and grid.text(grid.at[i][j]) != grid.text(content):
                    content.extend(k for k in grid.at[i][j] if k not in content)
            for i, j in box:
                grid.at[i][j] = content
    return grid


def _headers(grid: Grid, kinds: list[str | None], main: str | None) -> list[int]:
    def vote(place: list[int]) -> bool:
        if main == "Nu":
            return kinds[place[0]] != "Nu"
        return any(present(grid.cells[i]["H"]) and grid.cells[i]["H"] != 0 for i in place)

    out = []
    for n, row in enumerate(grid.at):
        filled = [p for p in row if p]
        if filled and sum(map(vote, filled)) / len(filled) > 0.5:
            out.append(n)
    return out


def render_markdown(grid: Grid, caption: str) -> str:
    table = [[grid.text(p, " ") for p in row] for row in grid.at]
    lines = [table[0], ["---"] * len(table[0]), *table[1:]]
    return (f"**{caption}**\n\n" if caption else "") + "".join(f"| {' | '.join(x)} |\n" for x in lines)


def render_sentences(grid: Grid, caption: str, headers: list[int], english: bool) -> list[str]:
    """One line per row, "header：value; ...": values take the nearest header row above. Header
    rows inherit what they lack from the one before, and neighbouring ones are
    joined, the longer first. Without headers, rows of up to two columns are packed into lines below 64 characters."""
    of, width = (" for " if english else "的"), len(grid.at[0])
    names: dict[int, list[str]] = {}
    for r in headers:
        own = [" ".join((grid.cells[i]["text"] or "").strip() for i in p) for p in grid.at[r]]
        if any(own):
            last = names[max(names)] if names else [""] * width
            names[r] = [a or b for a, b in zip(own, last, strict=True)]
    for r in sorted(names):
        if r - 1 in names:
            for k, (a, b) in enumerate(zip(names[r], names[r - 1], strict=True)):
                if b and b not in a:
                    names[r][k] = (a + (of if a else "") + b) if len(a) > len(b) else b + of + a
    out: list[str] = []
    for r, row in enumerate(grid.at):
        if r in names:
            continue
        above = max((h for h in names if h < r), default=None)
        values = ["".join((grid.cells[i]["text"] or "").strip() for i in p) for p in row]
        if above is None and width <= 2:
            text = "：".join(v for v in values if v)
            if text and out and len(out[-1]) + len(text) < 64:
                out[-1] += "\n" + text
            elif text:
                out.append(text)
            continue
        heads = names[above] if above is not None else [""] * width
        text = "; ".join((f"{h}：" if h else "") + v for h, v in zip(heads, values, strict=True) if v)
        if text:
            out.append(text)
    if caption:
        origin = " in " if english else "来自"
        out = [f"{t}\t——{origin}“{caption}”" for t in out]
    return out


def table_body(rows: list[dict], style: str = "markdown", english: bool = False) -> str | None:
    """One table's cells, with btype and caption, as text; None where there are captions only."""
    rows = sorted(rows, key=lambda r: r["cell_no"])
    caption = "".join(r["text"] or "" for r in rows if r["caption"])
    rows = [r for r in rows if not r["caption"]]
    if not rows:
        return None
    kinds = [r["btype"] for r in rows]
    main = max(dict.fromkeys(kinds), key=kinds.count)
    grid = build_grid(rows)
    headers = _headers(grid, kinds, main)
    grid = spread_spans(grid)
    return render_markdown(grid, caption) if style == "markdown" else "\n".join(render_sentences(grid, caption, headers, english))


def typed_cells(cells: DataFrame) -> DataFrame:
    """cells with what table_body asks for besides."""
    return cells.withColumn("btype", block_type(F.col("text"))).withColumn("caption", is_caption(F.col("text"), F.col("layout_type")))


BODIES = pa.schema([("table_id", pa.string()), ("body", pa.string())])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of one key after another, of batches in which they come together."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def construct_tables(cells: DataFrame, style: str = "markdown", english: bool = False) -> DataFrame:
    """(table_id, body) of cells with the columns of TABLE_CELL: markdown, or with style "sentences" one line per row.

    Captions are taken out first and joined. Tables without other cells give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies = [], []
        for rows in _groups(batches, "table_id"):
            body = table_body(rows, style, english)
            if body is not None:
                ids.append(str(rows[0]["table_id"]))
                bodies.append(body)
            if len(ids) == 1000:
                yield pa.RecordBatch.from_pydict({"table_id": ids, "body": bodies}, BODIES)
                ids, bodies = [], []
        yield pa.RecordBatch.from_pydict({"table_id": ids, "body": bodies}, BODIES)

    whole = typed_cells(cells).repartition("table_id").sortWithinPartitions("table_id")
    return whole.mapInArrow(run, "table_id string, body string")
