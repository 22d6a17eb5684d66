"""Positioned text items (doc_id, page, seq, x, y, str) → rows, columns, tables and metrics.

The unit of work is a page: one shuffle on (doc_id, page) gathers the items of a page, which
a page's size bounds; the rest are array functions inside that row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import let, normalize_heading, parse_indian_num, parse_indian_number, trailing_page_number
from ..functions.numbers import leading_float
from ..rules import pages as PR
from ..rows import once
from ..rules import tables as R

PAGE = ["doc_id", "page"]
CELL = "array<struct<x:double,text:string>>"


def _round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def row_cells(items: DataFrame, tolerance: float = 4, round_x: bool = False) -> DataFrame:
    """One row per printed line: doc_id, page, row_y, cells ordered by x, text."""
    x = _round_half_up(F.col("x")).cast("double") if round_x else F.col("x").cast("double")
    bucket = (_round_half_up(F.col("y") / F.lit(tolerance)) * tolerance).cast("double")
    named = items.select(*PAGE, "seq", x.alias("x"), bucket.alias("row_y"), F.trim("str").alias("text")).filter("text <> ''")
    gathered = named.groupBy(*PAGE, "row_y").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))).alias("c"))
    cells = F.transform("c", lambda s: F.struct(s["x"].alias("x"), s["text"].alias("text")))
    return gathered.select(
        *PAGE, "row_y", cells.alias("cells"), F.array_join(F.transform("c", lambda s: s["text"]), " ").alias("text")
    )


def page_rows(items: DataFrame, tolerance: float = 4, round_x: bool = False) -> DataFrame:
    """One row per page with its lines in reading order: rows array<struct<o, cells, text>>.

    One aggregation gathers a page; its sorted pieces are cut where the line changes.
    """
    x = _round_half_up(F.col("x")).cast("double") if round_x else F.col("x").cast("double")
    bucket = (_round_half_up(F.col("y") / F.lit(tolerance)) * tolerance).cast("double")
    named = items.select(*PAGE, (-bucket).alias("o"), x.alias("x"), "seq", F.trim("str").alias("text")).filter("text <> ''")
    # No piece is null, so sort_array gives the order of array_sort, whose comparison is interpreted for every pair.
    pieces = named.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("o", "x", "seq", "text"))).alias("_p"))
    starts = F.filter(
        F.transform("_p", lambda s, k: F.when((k == 0) | ~F.get("_p", k - 1)["o"].eqNullSafe(s["o"]), k + 1)), lambda k: k.isNotNull()
    )
    cut = once(once(pieces, {"_p": F.col("_p")}), {"_starts": starts})

    def line(start: Column, j: Column) -> Column:
        held = F.slice("_p", start, F.coalesce(F.get("_starts", j + 1), F.size("_p") + 1) - start)
        return let(held, lambda c: F.struct(
            F.get(c, F.lit(0))["o"].alias("o"),
            F.transform(c, lambda s: F.struct(s["x"].alias("x"), s["text"].alias("text"))).alias("cells"),
            F.array_join(F.transform(c, lambda s: s["text"]), " ").alias("text"),
        ))

    return once(cut, {"rows": F.transform("_starts", line)}).select(*PAGE, "rows")


# --- periods and metrics ----------------------------------------------------------------


def _joined_cells(cells: Column) -> Column:
    """Neighbouring pieces of one cell put together: less than 10 px after the last text.

    Only lines in which a piece follows the one before it so closely are folded.
    """
    empty = F.array().cast(CELL)

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(c["x"] - (last["x"] + F.length(last["text"]) * 4) < 10, F.lit(False))
        longer = F.array(F.struct(last["x"].alias("x"), F.concat(last["text"], F.lit(" "), c["text"]).alias("text")))
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.concat(acc, F.array(c))).cast(CELL)

    beside = F.exists(
        F.transform(cells, lambda c, i: (i > 0) & (c["x"] - (F.get(cells, i - 1)["x"] + F.length(F.get(cells, i - 1)["text"]) * 4) < 10)), lambda b: b
    )
    return F.when(beside, F.aggregate(cells, empty, step)).otherwise(cells.cast(CELL))


CLUSTERS = "array<struct<x:double,texts:array<string>>>"


def _period_clusters(cells: Column) -> Column:
    """Month and year cells of a page grouped by x: a cell joins the first group within 30 px."""
    def step(acc: Column, c: Column) -> Column:
        hit = F.array_position(F.transform(acc, lambda g: F.abs(g["x"] - c["x"]) < 30), F.lit(True))
        grown = F.transform(
            acc,
            lambda g, i: F.struct(
                g["x"].alias("x"),
                F.when((i + 1 == hit) & ~F.array_contains(g["texts"], c["text"]), F.array_append(g["texts"], c["text"]))
                .otherwise(g["texts"]).alias("texts"),
            ),
        )
        fresh = F.array(F.struct(c["x"].alias("x"), F.array(c["text"]).alias("texts")))
        return F.when(hit > 0, grown).otherwise(F.concat(acc, fresh)).cast(CLUSTERS)

    return F.aggregate(cells, F.array().cast(CLUSTERS), step)


def with_periods(pages: DataFrame) -> DataFrame:
    """page_rows + periods: array<struct<x, label>> of columns whose header has a month and a year."""
    joined = once(
        pages, {"rows": F.transform("rows", lambda r: F.struct(r["o"].alias("o"), _joined_cells(r["cells"]).alias("cells")))}
    )
    marks = F.filter(
        F.flatten(F.transform("rows", lambda r: r["cells"])), lambda c: c["text"].rlike(R.MONTH) | c["text"].rlike(R.YEAR)
    )
    clustered = once(joined.withColumn("_marks", marks), {"_groups": _period_clusters(F.col("_marks"))})
    both = F.filter(
        "_groups",
        lambda g: F.exists(g["texts"], lambda t: t.rlike(R.MONTH)) & F.exists(g["texts"], lambda t: t.rlike(R.YEAR)),
    )

    def label(g: Column) -> Column:
        months = F.filter(g["texts"], lambda t: t.rlike(R.MONTH))
        rest = F.filter(g["texts"], lambda t: ~t.rlike(R.MONTH))
        return F.array_join(F.concat(months, rest), " ")

    periods = F.array_sort(F.transform(both, lambda g: F.struct(g["x"].alias("x"), label(g).alias("label"))))
    return once(clustered, {"periods": periods}).drop("_marks", "_groups").filter(F.size("periods") >= 2)


def plain_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9\s]", " "), r"\s+", " "))


def match_metric(plain: Column, metrics: list[tuple[str, list[str]]]) -> Column:
    """First metric with an alias whose words all occur in the plain label."""
    out = F.lit(None).cast("string")
    for key, aliases in reversed(metrics):
        tests = [reduce(lambda a, b: a & b, [F.contains(plain, F.lit(w)) for w in alias.split()]) for alias in aliases]
        out = F.when(reduce(lambda a, b: a | b, tests), key).otherwise(out)
    return out


def _bare(c: Column) -> Column:
    return F.translate(c, ",()", "")


def _is_value(text: Column) -> Column:
    def judged(bare: Column) -> Column:
        number = bare.rlike(r"^[-\d,()]+(\.\d+)?$") | bare.rlike(r"^-?\d*\.?\d+$")
        return number & ~bare.rlike(r"^\d{1,3}$")

    return let(_bare(text), judged)


TAKEN = "struct<used:array<int>,vals:array<double>>"


def nearest_values(cells: Column, periods: Column, reach: float = 120) -> Column:
    """For each period the closest number cell not used yet, less than ``reach`` px away."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<double>").alias("vals"))

    def nearest(data: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            free = F.filter(
                F.transform(data, lambda c, i: F.struct(F.abs(c["x"] - p["x"]).alias("d"), i.alias("i"), c["v"].alias("v"))),
                lambda s: (s["d"] < reach) & ~F.array_contains(acc["used"], s["i"]),
            )

            def take(best: Column) -> Column:
                return F.struct(
                    F.when(best.isNotNull(), F.array_append(acc["used"], best["i"])).otherwise(acc["used"]).alias("used"),
                    F.array_append(acc["vals"], best["v"]).alias("vals"),
                )

            return let(F.array_min(free), take).cast(TAKEN)

        return F.aggregate(periods, start.cast(TAKEN), step)["vals"]

    numbers = F.filter(cells, lambda c: _is_value(c["text"]))
    return let(F.transform(numbers, lambda c: F.struct(c["x"].alias("x"), parse_indian_num(c["text"]).alias("v"))), nearest)


def item_metrics(items: DataFrame, metrics: list[tuple[str, list[str]]]) -> DataFrame:
    """doc_id, page, key, period_idx, period, value: first row with a value per page and key."""
    pages = with_periods(page_rows(items, 3, round_x=True))

    def keyed(r: Column) -> Column:
        label = F.get(
            F.filter(r["cells"], lambda c: (F.length(c["text"]) > 3) & ~_bare(c["text"]).rlike(r"^[-\d,()]+(\.\d+)?$")), F.lit(0)
        )["text"]
        return let(plain_label(label), lambda plain: F.struct(match_metric(plain, metrics).alias("key"), r["cells"].alias("cells")))

    rows = once(pages, {"_rows": F.filter(F.transform("rows", keyed), lambda r: r["key"].isNotNull())}).drop("rows")
    read = F.transform("_rows", lambda r: F.struct(r["key"].alias("key"), nearest_values(r["cells"], F.col("periods")).alias("values")))
    valued = once(rows, {"_read": F.filter(read, lambda r: F.exists(r["values"], lambda v: v.isNotNull()))}).drop("_rows")
    keys = F.transform("_read", lambda r: r["key"])
    first = F.filter("_read", lambda r, i: F.array_position(keys, r["key"]) == i + 1)
    return valued.select(*PAGE, "periods", F.explode(first).alias("m")).select(
        *PAGE, F.col("m.key").alias("key"), "periods", F.posexplode("m.values").alias("period_idx", "value")
    ).select(*PAGE, "key", "period_idx", F.get("periods", F.col("period_idx"))["label"].alias("period"), "value")


def item_statements(items: DataFrame) -> DataFrame:
    return item_metrics(items, R.ITEM_STATEMENT_METRICS)


def item_ratios(items: DataFrame) -> DataFrame:
    return item_metrics(items, R.ITEM_RATIO_METRICS)


def first_page_wins(metrics: DataFrame) -> DataFrame:
    """Per document the values of each metric from its first page; period labels from the
    document's first page with any metric. The metrics are read once, shuffled by document."""
    own, opening = Window.partitionBy("doc_id", "key"), Window.partitionBy("doc_id", "period_idx")
    paged = metrics.withColumn("_first", F.min("page").over(Window.partitionBy("doc_id"))).withColumn("_own", F.min("page").over(own))
    label = F.max(F.when(F.col("page") == F.col("_first"), F.col("period"))).over(opening)
    named = paged.withColumn("period", label).filter(F.col("page") == F.col("_own"))
    return named.select("doc_id", "key", "page", "period_idx", "period", "value")


def derive_ebitda(metrics: DataFrame) -> DataFrame:
    """Adds ebitda = profit before tax + finance costs + depreciation per period, where ebitda
    is missing and profit before tax is known for every period."""
    v = F.col("value")
    parts = metrics.groupBy("doc_id", "period_idx").agg(
        F.max("period").alias("period"),
        F.max(F.when(F.col("key") == "profitBeforeTax", v)).alias("pbt"),
        F.max(F.when(F.col("key") == "financeCosts", v)).alias("fc"),
        F.max(F.when(F.col("key") == "depreciation", v)).alias("da"),
        F.max((F.col("key") == "profitBeforeTax")).alias("has_pbt"),
    )
    state = metrics.groupBy("doc_id").agg(
        F.max(F.col("key") == "ebitda").alias("known"),
        F.max((F.col("key") == "profitBeforeTax") & v.isNull()).alias("hole"),
    )
    fresh = (
        parts.filter("has_pbt").join(state, "doc_id").filter(~F.col("known") & ~F.col("hole"))
        .withColumn("key", F.lit("ebitda"))
        .withColumn("value", F.col("pbt") + F.coalesce("fc", F.lit(0.0)) + F.coalesce("da", F.lit(0.0)))
    )
    return metrics.unionByName(fresh.select(*[c for c in metrics.columns if c in fresh.columns]), allowMissingColumns=True)


# --- fields of one page -----------------------------------------------------------------

NUMBERS = "array<struct<col:int,value:double>>"
FILLED = f"struct<full:array<string>,put:array<struct<field:string,vals:{NUMBERS}>>>"


def page_fields(items: DataFrame) -> DataFrame:
    """doc_id, page, field, col, label, value.

    A row fills the first matching field that is still empty and only one. With two or more
    year columns and two or more numbers each number goes to its nearest column (lowest index
    on ties, the last number stays); otherwise the first number is taken with a null column.
    Each row's numbers and fields are read once; filling the fields only looks at them.
    """
    is_year = lambda c: c["text"].rlike(R.ITEM_YEAR)
    none = F.array().cast(CELL)

    def header(acc: Column, r: Column) -> Column:
        # Lines below the header are not searched.
        return F.when(F.size(acc) >= 2, acc).otherwise(let(F.filter(r["cells"], is_year), lambda y: F.when(F.size(y) >= 2, y).otherwise(none)))

    headed = once(page_rows(items, 4), {"years": F.sort_array(F.aggregate("rows", none, header))})

    def nearest(x: Column) -> Column:
        return F.array_min(F.transform(F.col("years"), lambda y, i: F.struct(F.abs(x - y["x"]).alias("d"), i.alias("i"))))["i"]

    def numbered(r: Column) -> Column:
        nums = F.filter(r["cells"], lambda c: F.trim(F.replace(c["text"], F.lit(","), F.lit(""))).rlike(r"^-?\d+\.?\d*$"))
        return let(nums, lambda n: F.when(F.size(n) > 0, F.struct(r["text"].alias("text"), n.alias("nums"))))

    lines = once(headed, {"_lines": F.array_compact(F.transform("rows", numbered))}).drop("rows")

    def valued(col: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda n: F.struct(col(n["x"]).alias("col"), parse_indian_number(n["text"]).alias("value"))

    def step(acc: Column, r: Column) -> Column:
        field = F.lit(None).cast("string")
        for pattern, name in reversed(R.ITEM_FIELDS):
            field = F.when(~F.array_contains(acc["full"], name) & r["text"].rlike(pattern), name).otherwise(field)
        single = F.transform(F.slice(r["nums"], 1, 1), valued(lambda x: F.lit(None).cast("int")))
        values = F.when((F.size("years") >= 2) & (F.size(r["nums"]) >= 2), F.transform(r["nums"], valued(nearest))).otherwise(single).cast(NUMBERS)

        def fill(f: Column, v: Column) -> Column:
            first = F.get(v, F.lit(0))
            # A lone zero is kept until a later row has the field.
            lone_zero = F.coalesce((F.size(v) == 1) & first["col"].isNull() & (first["value"] == 0), F.lit(False))
            full = F.when(lone_zero, acc["full"]).otherwise(F.array_append(acc["full"], f))
            return F.struct(full.alias("full"), F.array_append(acc["put"], F.struct(f.alias("field"), v.alias("vals"))).alias("put")).cast(FILLED)

        return let(field, lambda f: F.when(f.isNull(), acc).otherwise(let(values, lambda v: fill(f, v)))).cast(FILLED)

    empty = F.struct(F.array().cast("array<string>").alias("full"), F.array().cast(f"array<struct<field:string,vals:{NUMBERS}>>").alias("put")).cast(FILLED)
    put = once(lines, {"_put": F.aggregate("_lines", empty, step)["put"]}).drop("_lines")
    names = F.reverse(F.transform("_put", lambda p: p["field"]))
    stays = let(names, lambda n: F.filter("_put", lambda p, i: F.array_position(n, p["field"]) == F.size(n) - i))
    filled = put.select(*PAGE, "years", F.explode(stays).alias("p"))
    last = F.filter("p.vals", lambda v, i: ~F.exists(F.slice("p.vals", i + 2, F.size("p.vals")), lambda w: w["col"].eqNullSafe(v["col"])))
    long = filled.select(*PAGE, "years", F.col("p.field").alias("field"), F.explode(last).alias("v"))
    return long.select(*PAGE, "field", F.col("v.col").alias("col"), F.get("years", F.col("v.col"))["text"].alias("label"), F.col("v.value").alias("value"))


def best_page(fields: DataFrame, first: int = 1, last: int | None = None, enough: int | None = None) -> DataFrame:
    """Per document the page with most fields (first on ties); with ``enough``, rather the first with so many.

    Year columns count as one more field.
    """
    pages = fields.filter(F.col("page") >= first) if last is None else fields.filter(F.col("page").between(first, last))
    per_page = pages.groupBy(*PAGE).agg(
        (F.count_distinct("field") + F.max(F.when(F.col("label").isNotNull(), 1).otherwise(0))).alias("score")
    )
    return per_page.groupBy("doc_id").agg(
        F.coalesce(
            *([] if enough is None else [F.min(F.when(F.col("score") >= enough, F.col("page")))]),
            F.max_by("page", F.struct("score", -F.col("page"))),
        ).alias("page")
    )


def promoter_holding(items: DataFrame, last_page: int | None = None) -> DataFrame:
    """doc_id, pre_issue, post_issue from the first total row of promoters with two percentages."""
    rows = row_cells(items if last_page is None else items.filter(F.col("page") <= last_page), 4).filter(F.col("text").rlike(R.HOLDING_ROW))
    shares = F.filter("cells", lambda c: c["text"].rlike(r"\d+\.\d+%?"))
    values = F.transform(shares, lambda c: leading_float(F.regexp_replace(c["text"], "%", "")))
    fit = rows.withColumn("v", values).filter(F.size("v") >= 2)
    return fit.groupBy("doc_id").agg(F.min_by("v", F.struct("page", -F.col("row_y"))).alias("v")).select(
        "doc_id", F.get("v", F.lit(0)).alias("pre_issue"), F.element_at("v", F.lit(-1)).alias("post_issue")
    )


# --- tables by column positions ---------------------------------------------------------


def _column_runs(xs: Column, gap: int) -> Column:
    """Sorted positions → runs array<struct<lo, hi, n>> that a gap separates: cut where a position is not near the one before."""
    starts = F.filter(F.transform(xs, lambda x, k: F.when((k == 0) | ~F.coalesce(x - F.get(xs, k - 1) < gap, F.lit(False)), k)), lambda k: k.isNotNull())

    def run(s: Column) -> Column:
        def held(start: Column, j: Column) -> Column:
            after = F.coalesce(F.get(s, j + 1), F.size(xs))
            return F.struct(F.get(xs, start).alias("lo"), F.get(xs, after - 1).alias("hi"), (after - start).cast("long").alias("n"))

        return F.transform(s, held)

    return let(starts, run)


def _centers(xs: Column, gap: int, least: int) -> Column:
    """array<struct<center, items>> of the runs with so many positions, from left to right."""
    # Unknown positions go last, as by array_sort, whose comparison is interpreted for every pair.
    ordered = let(xs, lambda x: F.concat(F.sort_array(F.filter(x, lambda v: v.isNotNull())), F.filter(x, lambda v: v.isNull())))
    kept = let(ordered, lambda x: F.filter(_column_runs(x, gap), lambda r: r["n"] >= least))
    return F.transform(kept, lambda r: F.struct(_round_half_up((r["lo"] + r["hi"]) / 2).alias("center"), r["n"].alias("items")))


def _middles(centers: Column) -> Column:
    """Where each of the sorted centers but the last gives way to the next."""
    later = F.slice(centers, 2, F.greatest(F.size(centers) - 1, F.lit(0)))
    return F.transform(later, lambda c, i: (c["center"] + F.get(centers, i)["center"]) / 2)


def _column_of(x: Column, centers: Column) -> Column:
    """Index of the closest of the sorted centers, the lowest on ties: the number of middles that x lies beyond."""
    return F.size(F.filter(_middles(centers), lambda m: x > m))


def page_columns(items: DataFrame, gap: int = 20, least: int = 2) -> DataFrame:
    """One row per page: its items (x, seq, str) and the columns (center, items) that their positions form.

    Columns are runs of x positions closer than ``gap``, of ``least`` items at least. One shuffle gathers a page.
    """
    held = items.filter(F.trim("str") != "").groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "seq", "str")).alias("items"))
    xs = F.transform("items", lambda i: _round_half_up(i["x"]))
    return once(held, {"columns": _centers(xs, gap, least)})


def column_centers(items: DataFrame, gap: int = 20, least: int = 2) -> DataFrame:
    """doc_id, page, col, center, items: the columns of page_columns."""
    return page_columns(items, gap, least).select(*PAGE, F.posexplode("columns").alias("col", "c")).select(*PAGE, "col", "c.center", "c.items")


def nearest_column(cells: DataFrame, centers: DataFrame) -> DataFrame:
    """cells (doc_id, page, x, …) + col: the closest column, the lowest index on ties.

    The columns of a page travel as one array, so cells are not multiplied by columns.
    """
    listed = centers.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("center", "col"))).alias("_c"))
    return cells.join(listed, PAGE).withColumn("col", F.get("_c", _column_of(F.col("x"), F.col("_c")))["col"]).drop("_c")


def placed_items(pages: DataFrame) -> DataFrame:
    """Rows of page_columns → each item with col, its closest column, and how far that is; pages without a column give nothing."""
    def placed(i: Column) -> Column:
        far = let(_column_of(i["x"], F.col("columns")), lambda c: F.struct(c.alias("col"), F.abs(i["x"] - F.get("columns", c)["center"]).alias("far")))
        return F.struct(i["x"].alias("x"), i["seq"].alias("seq"), i["str"].alias("str"), far.alias("c"))

    kept = pages.filter(F.size("columns") > 0).select(*PAGE, F.explode(F.transform("items", placed)).alias("i"))
    return kept.select(*PAGE, "i.x", "i.seq", "i.str", "i.c.col", "i.c.far")


def detect_tables(items: DataFrame) -> DataFrame:
    """doc_id, page, num_cols, row_idx, is_header, cells: pages that hold a table.

    A table needs five rows, three columns, three rows filling two columns, and a column with
    three numbers. Items are read and shuffled once: lines and columns of a page are found in its row.
    """
    xs = F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["x"].cast("long"))))
    lines = page_rows(items, 4, round_x=True).filter(F.size("rows") >= 5)
    pages = once(lines, {"cols": _centers(xs, 20, 2)}).filter(F.size("cols") >= 3)

    # A cell belongs to a column if it lies beyond as many middles.
    pages = once(pages, {"_middles": _middles(F.col("cols"))})

    def assign(cells: Column) -> Column:
        placed = F.transform(cells, lambda c: F.struct(F.size(F.filter("_middles", lambda m: c["x"] > m)).alias("col"), c["text"].alias("text")))
        return let(placed, lambda held: F.transform(
            F.col("cols"), lambda _, k: F.array_join(F.transform(F.filter(held, lambda p: p["col"] == k), lambda p: p["text"]), " ")
        ))

    placed = once(pages, {"grid": F.transform("rows", lambda r: assign(r["cells"]))}).drop("rows", "_middles")
    data = F.filter("grid", lambda g: F.size(F.filter(g, lambda c: F.trim(c) != "")) >= 2)
    kept = once(placed, {"data": data}).filter(F.size("data") >= 3)
    numbers = F.exists(
        F.transform("cols", lambda _, k: F.size(F.filter("data", lambda g: F.trim(F.get(g, k)).rlike(r"^-?[\d,]+\.?\d*%?$")))),
        lambda n: n >= 3,
    )
    return kept.filter(numbers).select(*PAGE, F.size("cols").alias("num_cols"), F.posexplode("data").alias("row_idx", "cells")).select(
        *PAGE, "num_cols", "row_idx", (F.col("row_idx") == 0).alias("is_header"), "cells"
    )


# --- contents ---------------------------------------------------------------------------


def _targets(heading: Column, targets: dict[str, list[str]]) -> Column:
    tests = []
    for key, aliases in targets.items():
        hit = reduce(lambda a, b: a | b, [F.contains(heading, F.lit(x)) for x in aliases])
        tests.append(F.when(hit, F.lit(key)))
    return F.array_compact(F.array(*tests))


def locate_by_contents(
    items: DataFrame, targets: dict[str, list[str]] | None = None, last_span: int | None = None, most_span: int | None = None,
) -> DataFrame:
    """doc_id, section, printed_start, printed_end, pdf_start, pdf_end, origin.

    Contents pages have more than three longer lines, over 30 % of lines against those ending
    in a number. A section starts at its least printed number and ends before the next start, the
    last one at an unknown page (null). Sections not in the contents start at the first page with the
    heading, and their end is unknown. ``last_span`` pages are taken where the end is unknown, and no
    section has over ``most_span``, if given.
    """
    targets = targets or PR.CONTENTS_TARGETS
    read = F.transform(
        "rows",
        lambda r: F.struct(
            F.length(r["text"]).alias("len"), trailing_page_number(r["text"]).alias("number"), normalize_heading(r["text"]).alias("heading")
        ),
    )
    pages = once(page_rows(items, 0.5), {"lines": read}).drop("rows")
    longer = F.size(F.filter("lines", lambda x: x["len"] > 8))
    numbered = F.size(F.filter("lines", lambda x: x["number"].isNotNull()))
    named = F.transform("lines", lambda x: F.struct(x["number"].alias("number"), _targets(x["heading"], targets).alias("sections")))
    flagged = pages.select(
        *PAGE, ((longer > 3) & (numbered / longer > 0.3)).alias("contents"),
        F.explode(F.filter(named, lambda x: F.size(x["sections"]) > 0)).alias("x"),
    )
    hits = flagged.select(*PAGE, "contents", "x.number", F.explode("x.sections").alias("section"))
    # One shuffle by document serves both aggregations.
    per_section = hits.repartition("doc_id").groupBy("doc_id", "section").agg(
        F.min(F.when(F.col("contents"), F.col("number"))).alias("start"), F.min("page").alias("first_page")
    )
    held = per_section.groupBy("doc_id").agg(F.collect_list(F.struct("section", "start", "first_page")).alias("s"))
    starts = F.array_sort(F.filter(F.transform("s", lambda x: x["start"]), lambda n: n.isNotNull()))
    rows = once(held, {"starts": starts}).select("doc_id", "starts", F.explode("s").alias("s")).select("doc_id", "starts", "s.*")
    following = F.get("starts", F.array_position("starts", F.col("start")).cast("int"))
    unknown = F.lit(None).cast("int")
    end = F.coalesce(following - 1, unknown if last_span is None else F.col("start") + last_span)
    if most_span is not None:
        end = F.least(end, F.col("start") + most_span)
    listed, page = F.col("start").isNotNull(), F.col("first_page").cast("int")
    page_end = unknown if last_span is None else (page + last_span).cast("int")
    return rows.select(
        "doc_id", "section", F.col("start").alias("printed_start"), F.when(listed, end).alias("printed_end"),
        F.when(~listed, page).alias("pdf_start"), F.when(~listed, page_end).alias("pdf_end"), F.when(listed, "toc").otherwise("fullscan").alias("origin"),
    )

