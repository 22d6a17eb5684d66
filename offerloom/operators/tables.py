"""Markdown tables and the metrics in them.

Everything below happens inside the row of a document with array functions: a document's
tables are never shuffled, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let, looks_like_period, parse_num, trim_all
from ..functions.text import WS_CHARS
from ..rows import once
from ..rules import tables as R

ROWS = "array<array<string>>"
METRICS = "map<string,array<double>>"


def _is_table_line(line: Column) -> Column:
    """Starts with a bar and has another one."""
    t = F.ltrim(line, F.lit(WS_CHARS))
    return t.startswith("|") & (F.position(F.lit("|"), line) < F.length(line) - F.position(F.lit("|"), F.reverse(line)) + 1)


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(trim_all(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), trim_all)


def _is_rule_row(cells: Column) -> Column:
    """A row of dashes (or blanks) under the header; a letter in the first cell settles it."""
    return F.forall(cells, lambda c: (c == "") | (c.rlike("^[:-]") & F.translate(c, WS_CHARS, "").rlike("^:?-{2,}:?$")))


def with_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs + ``tables``: array of tables, each an array of rows of cells, two rows at least.

    Table lines keep their line number; consecutive lines share ``line number - position``,
    which cuts the ordered array into tables by slicing.
    """
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    lines = F.filter(numbered, lambda s: _is_table_line(s["line"]))
    keyed = F.transform(lines, lambda s, k: F.struct((s["i"] - k).alias("block"), _cells(s["line"]).alias("cells")))
    staged = once(docs, {"_keyed": keyed})
    staged = staged.withColumn(
        "_starts",
        F.filter(
            F.transform("_keyed", lambda s, k: F.when((k == 0) | (F.get("_keyed", k - 1)["block"] != s["block"]), k + 1)),
            lambda p: p.isNotNull(),
        ),
    )

    def table(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get("_starts", j + 1), F.size("_keyed") + 1)
        rows = F.transform(F.slice("_keyed", start, end - start), lambda s: s["cells"])
        return F.filter(rows, lambda r: ~_is_rule_row(r))

    found = F.filter(F.transform("_starts", table), lambda t: F.size(t) >= 2)
    return once(staged, {"tables": found}).drop("_keyed", "_starts")


def markdown_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, table_idx, row_idx, col_idx, cell."""
    tables = with_tables(docs, text).select("doc_id", F.posexplode("tables").alias("table_idx", "rows"))
    rows = tables.select("doc_id", "table_idx", F.posexplode("rows").alias("row_idx", "cells"))
    return rows.select("doc_id", "table_idx", "row_idx", F.posexplode("cells").alias("col_idx", "cell"))


def first_label(row: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(row, trim_all), lambda c: c != ""), F.lit(0)), F.lit(""))


def values_at(row: Column, cols: Column) -> Column:
    return F.transform(cols, lambda i: parse_num(F.get(row, i)))


def period_row(rows: Column) -> Column:
    """struct(n, row_idx, cols, labels) of the row with most period cells (two or more), or null."""
    def scored(row: Column, i: Column) -> Column:
        found = F.filter(F.transform(row, lambda c, k: F.when(looks_like_period(c), k)), lambda k: k.isNotNull())
        return let(
            found,
            lambda cols: F.struct(
                F.size(cols).alias("n"), (-i).alias("neg"), cols.alias("cols"), F.transform(cols, lambda k: F.get(row, k)).alias("labels")
            ),
        )

    def told(best: Column) -> Column:
        return F.when(
            best.isNotNull(),
            F.struct(best["n"].alias("n"), (-best["neg"]).alias("row_idx"), best["cols"].alias("cols"), best["labels"].alias("labels")),
        )

    return let(F.array_max(F.filter(F.transform(rows, scored), lambda s: s["n"] >= 2)), told)


def rule_score(rows: Column, rules: list[tuple[str, str]]) -> Column:
    """Number of different rules that some row label satisfies."""
    def met(labels: Column) -> Column:
        return reduce(add, [F.exists(labels, lambda x: x.rlike(p)).cast("int") for _, p in rules])

    return let(F.transform(rows, first_label), met)


def tables_of(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = ("statement", "ratio")) -> DataFrame:
    """doc_id, table_idx, rows, header (period row or null), and the wanted rule scores."""
    rules = {"statement": R.STATEMENT_METRICS, "ratio": R.RATIO_METRICS}
    listed = with_tables(docs, text).select("doc_id", F.posexplode("tables").alias("table_idx", "rows"))
    return once(listed, {
        "header": period_row(F.col("rows")), **{f"{k}_score": rule_score(F.col("rows"), rules[k]) for k in kinds}
    })


def best_table(tables: DataFrame, kind: str = "statement", least: int = 2) -> DataFrame:
    """Per document the table with the highest score, first on ties; statements need a header."""
    score = F.col(f"{kind}_score")
    fit = score >= least
    if kind == "statement":
        fit = fit & F.col("header").isNotNull()
    return tables.filter(fit).groupBy("doc_id").agg(
        F.max_by(F.struct("table_idx", "rows", "header", score.alias("score")), F.struct(score, -F.col("table_idx"))).alias("t")
    ).select("doc_id", "t.*")


def has_key(entries: Column, key: Column) -> Column:
    return F.call_function("map_contains_key", entries, key)


def _put(acc: Column, key: Column, values: Column) -> Column:
    one = F.map_from_entries(F.array(F.struct(key, values)))
    some = key.isNotNull() & F.exists(values, lambda v: v.isNotNull())
    return F.when(some, F.map_concat(acc, one)).otherwise(acc).cast(METRICS)


def labelled_rows(rows: Column) -> Column:
    """Rows with their position and label, so that a fold reads the label instead of building it."""
    return F.transform(rows, lambda r, i: F.struct(i.alias("i"), first_label(r).alias("label"), r.alias("r")))


def statement_metrics(rows: Column, header: Column) -> Column:
    """map key → values per period: each row fills the first matching key that is still empty.

    ``rows`` are labelled rows.
    """
    def step(acc: Column, s: Column) -> Column:
        key = F.lit(None).cast("string")
        for name, pattern in reversed(R.STATEMENT_METRICS):
            key = F.when(~has_key(acc, F.lit(name)) & s["label"].rlike(pattern), name).otherwise(key)
        key = F.when(s["i"] != header["row_idx"], key)
        return _put(acc, key, values_at(s["r"], header["cols"]))

    return F.aggregate(rows, F.create_map().cast(METRICS), step)


def ratio_metrics(rows: Column, header: Column) -> Column:
    """map key → values: each labelled row's first matching rule; the first row with a value stays."""
    def step(acc: Column, s: Column) -> Column:
        key = first_rule(s["label"], R.RATIO_METRICS)
        skip = (s["i"].eqNullSafe(header["row_idx"])) | (s["label"] == "")
        key = F.when(~skip & ~has_key(acc, F.coalesce(key, F.lit(""))), key)
        numbers = F.slice(F.filter(F.transform(s["r"], parse_num), lambda v: v.isNotNull()), 1, 1)
        values = F.when(header.isNotNull(), values_at(s["r"], header["cols"])).otherwise(numbers)
        return _put(acc, key, values)

    return F.aggregate(rows, F.create_map().cast(METRICS), step)


def _long(best: DataFrame, metrics: Callable[[Column, Column], Column]) -> DataFrame:
    staged = once(best, {"_rows": labelled_rows(F.col("rows"))})
    filled = once(staged, {"metrics": metrics(F.col("_rows"), F.col("header"))})
    rows = filled.select("doc_id", "table_idx", "header", F.explode("metrics").alias("key", "values"))
    return rows.select("doc_id", "table_idx", "header", "key", F.posexplode("values").alias("period_idx", "value")).select(
        "doc_id", "table_idx", "key", "period_idx", F.get("header.labels", F.col("period_idx")).alias("period"), "value"
    )


def table_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, table_idx, key, period_idx, period, value of the best statement table."""
    best = best_table(tables_of(docs, text, ("statement",)), "statement")
    return _long(best, statement_metrics)


def table_ratios(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, table_idx, key, period_idx, period, value of the best ratio table."""
    best = best_table(tables_of(docs, text, ("ratio",)), "ratio")
    return _long(best, ratio_metrics)


def first_rule(label: Column, rules: list[tuple[str, str]]) -> Column:
    """Key of the first rule a label satisfies; rules compile into one expression."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(label.rlike(pattern), name).otherwise(out)
    return out
