"""Queries: markdown tables, positioned items and the facts read from them.

Each order stands for a document: its line items become table rows or printed lines, so the
text is assembled from the tables and the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import facts, items, parties, tables
from .registry import query, spread, table

# Row labels by line number; the seventh means nothing.
STATEMENT_LABELS = ["Revenue from operations", "Total income", "EBITDA", "Profit after tax", "Net worth", "Total borrowings", "Sundry row"]
STATEMENT_KEYS = ["revenueFromOperations", "totalIncome", "ebitda", "profitAfterTax", "netWorth", "totalBorrowings"]
RATIO_LABELS = ["RoCE", "Return on net worth", "Debt to equity", "Current ratio", "PAT margin", "Gross margin", "Sundry row"]
RATIO_KEYS = ["roce", "ronw", "debtEquity", "currentRatio", "patMargin", "grossMargin"]

LINES = """
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)
"""


def _pick(labels: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), number)


def _key_sql(keys: list[str]) -> str:
    return "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{k}'" for i, k in enumerate(keys)) + " END"


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and its line items in order: array of structs. An order has a handful of lines."""
    line = F.struct(
        F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
    )
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("l"))


def _money(c: Column) -> Column:
    return F.format_string("%,.2f", c)


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def statement_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Two markdown tables per order: lines one to three, then the rest."""
    head = "| Particulars | 31 March 2025 | FY 2024 |\n|---|---:|:--:|\n"

    def body(low: int, high: int) -> Column:
        some = F.filter("l", lambda x: (x["no"] >= low) & (x["no"] <= high))
        rows = F.transform(some, lambda x: _row(_pick(STATEMENT_LABELS, x["no"]), _money(x["price"]), F.concat(F.lit("("), _money(x["qty"]), F.lit(")"))))
        return F.concat(F.lit(head), F.array_join(rows, "\n"))

    return order_lines(spark, folder).select(
        "doc_id", F.concat(F.lit("Intro | text\n"), body(1, 3), F.lit("\nbetween\n"), body(4, 7), F.lit("\nend")).alias("text")
    )


# A table needs a row besides its header.
TABLES = f"""
{LINES},
rows_of AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber <= 3 THEN 0 ELSE 1 END AS block, {_key_sql(STATEMENT_KEYS)} AS key, {_key_sql(STATEMENT_LABELS)} AS label,
                   l_extendedprice AS v0, -l_quantity AS v1, rn FROM lines),
blocks AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS table_idx, n, score FROM
             (SELECT doc_id, block, count(*) AS n, count(DISTINCT key) AS score FROM rows_of GROUP BY 1, 2))
"""


@query("markdown_cells", f"""
WITH {TABLES},
body AS (SELECT r.doc_id, b.table_idx, row_number() OVER (PARTITION BY r.doc_id, r.block ORDER BY rn) AS row_idx, label, v0, v1 FROM rows_of r JOIN blocks b USING (doc_id, block))
SELECT doc_id, CAST(table_idx AS INTEGER) AS table_idx, CAST(row_idx AS INTEGER) AS row_idx, col_idx, cell FROM (
  SELECT doc_id, table_idx, 0 AS row_idx, unnest([0, 1, 2]) AS col_idx, unnest(['Particulars', '31 March 2025', 'FY 2024']) AS cell FROM blocks
  UNION ALL SELECT doc_id, table_idx, row_idx, unnest([0, 1, 2]), unnest([label, format('{{:,.2f}}', v0), '(' || format('{{:,.2f}}', -v1) || ')']) FROM body)
""")
def markdown_cells(spark: SparkSession, folder: str) -> DataFrame:
    return tables.markdown_cells(statement_docs(spark, folder))


@query("period_header", f"WITH {TABLES} SELECT doc_id, CAST(table_idx AS INTEGER) AS table_idx, 0 AS row_idx, 2 AS periods, '31 March 2025,FY 2024' AS labels FROM blocks")
def period_header(spark: SparkSession, folder: str) -> DataFrame:
    t = tables.tables_of(statement_docs(spark, folder), kinds=())
    return t.filter(F.col("header").isNotNull()).select(
        "doc_id", "table_idx", "header.row_idx", F.col("header.n").alias("periods"), F.array_join("header.labels", ",").alias("labels")
    )


@query("best_table", f"""
WITH {TABLES} SELECT doc_id, CAST(arg_max(table_idx, {{'s': score, 'i': -table_idx}}) AS INTEGER) AS table_idx, CAST(max(score) AS INTEGER) AS score FROM blocks WHERE score >= 2 GROUP BY 1
""")
def best_table(spark: SparkSession, folder: str) -> DataFrame:
    return tables.best_table(tables.tables_of(statement_docs(spark, folder), kinds=("statement",))).select("doc_id", "table_idx", "score")


@query("table_metrics", f"""
WITH {TABLES},
best AS (SELECT doc_id, arg_max(block, {{'s': score, 'i': -table_idx}}) AS block FROM blocks WHERE score >= 2 GROUP BY 1),
one AS (SELECT r.doc_id, key, arg_min({{'a': v0, 'b': v1}}, rn) AS v FROM rows_of r JOIN best USING (doc_id, block) WHERE key IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, key, 0 AS period_idx, '31 March 2025' AS period, v.a AS value FROM one UNION ALL SELECT doc_id, key, 1, 'FY 2024', v.b FROM one
""")
def table_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table_metrics(statement_docs(spark, folder)).select("doc_id", "key", "period_idx", "period", "value")


@query("table_ratios", f"""
WITH {LINES},
r AS (SELECT l_orderkey AS doc_id, {_key_sql(RATIO_KEYS)} AS key, l_discount * 100 AS v, rn FROM lines),
fit AS (SELECT doc_id FROM r GROUP BY 1 HAVING count(DISTINCT key) >= 2)
SELECT doc_id, key, 0 AS period_idx, round(arg_min(v, rn), 2) AS value FROM r WHERE doc_id IN (SELECT doc_id FROM fit) AND key IS NOT NULL GROUP BY 1, 2
""")
def table_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratio tables without a period header: the first number of each row."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    per = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    rows = F.transform("l", lambda x: _row(_pick(RATIO_LABELS, x["l_linenumber"]), F.format_string("%.2f%%", x["l_discount"] * 100), F.lit("n.a.")))
    return tables.table_ratios(per.select("doc_id", F.array_join(rows, "\n").alias("text"))).select("doc_id", "key", "period_idx", "value")


# --- positioned items ---------------------------------------------------------------------


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    """One text item per line item at a place that its numbers decide."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        (F.col("l_partkey") % 97 * 3).cast("double").alias("x"), (F.col("l_quantity") * 2).alias("y"), F.col("l_partkey").cast("string").alias("str"),
    )


ITEMS = """
items AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page, l_partkey * 1000 + l_suppkey AS seq, CAST(l_partkey % 97 * 3 AS DOUBLE) AS x, l_quantity * 2 AS y, CAST(l_partkey AS VARCHAR) AS str FROM lineitem)
"""


@query("item_rows", f"""
WITH {ITEMS} SELECT doc_id, page, floor(y / 4 + 0.5) * 4 AS row_y, string_agg(str, ' ' ORDER BY x, seq) AS text FROM items GROUP BY doc_id, page, floor(y / 4 + 0.5) * 4
""")
def item_rows(spark: SparkSession, folder: str) -> DataFrame:
    return items.row_cells(line_items(spark, folder), 4).select("doc_id", "page", "row_y", "text")


CENTERS = f"""
{ITEMS},
pos AS (SELECT doc_id, page, floor(x + 0.5) AS x FROM items),
jumps AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) >= 20 THEN 1 ELSE 0 END AS j FROM pos),
groups AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM jumps),
centers AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY min(x)) - 1 AS INTEGER) AS col, CAST(floor((min(x) + max(x)) / 2 + 0.5) AS BIGINT) AS center,
   CAST(count(*) AS BIGINT) AS items FROM groups GROUP BY doc_id, page, g HAVING count(*) >= 2)
"""


@query("column_centers", f"WITH {CENTERS} SELECT * FROM centers")
def column_centers(spark: SparkSession, folder: str) -> DataFrame:
    return items.column_centers(line_items(spark, folder))


@query("nearest_column", f"""
WITH {CENTERS} SELECT i.doc_id, i.page, i.seq, arg_min(c.col, {{'d': abs(i.x - c.center), 'c': c.col}}) AS col FROM (SELECT DISTINCT doc_id, page, seq, x FROM items) i JOIN centers c USING (doc_id, page) GROUP BY 1, 2, 3
""")
def nearest_column(spark: SparkSession, folder: str) -> DataFrame:
    """Of places with one number on a page, that closest to a column decides."""
    placed = items.placed_items(items.page_columns(line_items(spark, folder)))
    return placed.groupBy("doc_id", "page", "seq").agg(F.min(F.struct("far", "col")).alias("c")).select("doc_id", "page", "seq", "c.col")


@query("detect_tables", """
WITH li AS (SELECT l_orderkey // 4 AS doc_id, l_linenumber AS r, l_partkey * 1000 + l_suppkey AS seq, l_partkey, l_quantity, l_tax FROM lineitem),
g AS (SELECT doc_id, r, string_agg('part' || l_partkey, ' ' ORDER BY seq, l_partkey) AS c0, string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ' ' ORDER BY seq, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS c1,
        string_agg(CAST(l_tax AS VARCHAR), ' ' ORDER BY seq, CAST(l_tax AS VARCHAR)) AS c2 FROM li GROUP BY 1, 2),
ok AS (SELECT doc_id FROM g GROUP BY 1 HAVING count(*) >= 5 AND greatest(count(*) FILTER (WHERE regexp_matches(c1, '^-?[\\d,]+\\.?\\d*%?$')), count(*) FILTER (WHERE regexp_matches(c2, '^-?[\\d,]+\\.?\\d*%?$'))) >= 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INTEGER) AS row_idx, c0 || ';' || c1 || ';' || c2 AS cells FROM g WHERE doc_id IN (SELECT doc_id FROM ok)
""")
def detect_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Three columns of items per line number; four orders share a page."""
    places = [(10.0, F.concat(F.lit("part"), F.col("l_partkey").cast("string"))), (110.0, F.col("l_quantity").cast("int").cast("string")), (210.0, F.col("l_tax").cast("string"))]
    cells = [F.struct(F.lit(x).alias("x"), t.alias("str")) for x, t in places]
    it = table(spark, folder, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("doc_id"), F.lit(1).alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        (500 - 20 * F.col("l_linenumber")).cast("double").alias("y"), F.explode(F.array(*cells)).alias("c"),
    ).select("doc_id", "page", "seq", "y", "c.x", "c.str")
    return items.detect_tables(it).select("doc_id", "row_idx", F.array_join("cells", ";").alias("cells"))


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """A printed sheet per order: a header line and one line per line item."""
    def cell(x: float, y: Column, text: Column) -> Column:
        return F.struct(F.lit(x).alias("x"), y.cast("double").alias("y"), text.alias("str"))

    top = F.array(cell(50.0, F.lit(700), F.lit("Particulars")), cell(300.0, F.lit(700), F.lit("March 2025")), cell(400.0, F.lit(700), F.lit("March 2024")))
    body = F.flatten(F.transform("l", lambda x, i: F.array(
        cell(50.0, 680 - 20 * i, _pick(STATEMENT_LABELS, x["no"])), cell(301.0, 680 - 20 * i, _money(x["price"])),
        cell(399.0, 680 - 20 * i, F.concat(F.lit("("), _money(x["qty"]), F.lit(")"))),
    )))
    all_cells = order_lines(spark, folder).select("doc_id", F.posexplode(F.concat(top, body)).alias("seq", "c"))
    return all_cells.select("doc_id", F.lit(1).alias("page"), "seq", "c.*")


@query("item_statements", f"""
WITH {LINES}, r AS (SELECT l_orderkey AS doc_id, {_key_sql(STATEMENT_KEYS)} AS key, l_extendedprice AS v0, -l_quantity AS v1, rn FROM lines),
one AS (SELECT doc_id, key, arg_min({{'a': v0, 'b': v1}}, rn) AS v FROM r WHERE key IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, key, 0 AS period_idx, 'March 2025' AS period, v.a AS value FROM one UNION ALL SELECT doc_id, key, 1, 'March 2024', v.b FROM one
""")
def item_statements(spark: SparkSession, folder: str) -> DataFrame:
    return items.first_page_wins(items.item_statements(sheets(spark, folder))).select("doc_id", "key", "period_idx", "period", "value")


@query("page_fields", f"""
WITH {LINES}, r AS (SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'revenueFromOperations' WHEN 2 THEN 'totalIncome' WHEN 3 THEN 'ebitda' WHEN 4 THEN 'netProfit' WHEN 5 THEN 'netWorth' WHEN 6 THEN 'totalBorrowings' END AS field,
  l_extendedprice AS v, rn FROM lines)
SELECT doc_id, field, CAST(NULL AS INTEGER) AS col, arg_min(v, rn) AS value FROM r WHERE field IS NOT NULL GROUP BY 1, 2
""")
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Bracketed numbers are no numbers here, so every row has a single value."""
    return items.page_fields(sheets(spark, folder)).select("doc_id", "field", "col", "value")


@query("derived_ebitda", """
WITH m AS (SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'profitBeforeTax' WHEN 2 THEN 'financeCosts' WHEN 3 THEN 'depreciation' WHEN 4 THEN 'ebitda' ELSE 'other' END AS key,
   CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS period_idx, max(CASE WHEN l_linenumber <> 1 OR l_discount > 0 THEN l_extendedprice END) AS value FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT doc_id, period_idx, max(value) FILTER (WHERE key = 'profitBeforeTax') AS pbt, max(value) FILTER (WHERE key = 'financeCosts') AS fc, max(value) FILTER (WHERE key = 'depreciation') AS da,
   bool_or(key = 'profitBeforeTax') AS has FROM m GROUP BY 1, 2),
d AS (SELECT doc_id FROM m GROUP BY 1 HAVING NOT bool_or(key = 'ebitda') AND NOT bool_or(key = 'profitBeforeTax' AND value IS NULL))
SELECT doc_id, period_idx, round(pbt + coalesce(fc, 0) + coalesce(da, 0), 2) AS value FROM p WHERE has AND doc_id IN (SELECT doc_id FROM d)
""")
def derived_ebitda(spark: SparkSession, folder: str) -> DataFrame:
    no, flag = F.col("l_linenumber"), F.col("l_returnflag")
    key = F.when(no == 1, "profitBeforeTax").when(no == 2, "financeCosts").when(no == 3, "depreciation").when(no == 4, "ebitda").otherwise("other")
    m = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("doc_id"), key.alias("key"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("period_idx")
    ).agg(F.max(F.when((no != 1) | (F.col("l_discount") > 0), F.col("l_extendedprice"))).alias("value"))
    out = items.derive_ebitda(m.withColumn("period", F.lit("p")).withColumn("given", F.lit(True)))
    return out.filter("key = 'ebitda' AND given IS NULL").select("doc_id", "period_idx", F.round("value", 2).alias("value"))


# --- facts --------------------------------------------------------------------------------


def _quantities(spark: SparkSession, folder: str) -> DataFrame:
    def of(test) -> Column:
        return F.array_distinct(F.transform(F.filter("l", test), lambda x: x["qty"].cast("bigint")))

    return order_lines(spark, folder).select(
        "doc_id", of(lambda x: x["no"] >= 4).alias("fresh"), of(lambda x: x["no"] == 1).alias("mm"), of(lambda x: x["no"] == 2).alias("emp"), of(lambda x: x["no"] == 3).alias("net")
    )


CANDIDATES = f"""
{LINES},
c AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber >= 4 THEN 'f' WHEN l_linenumber = 1 THEN 'm' WHEN l_linenumber = 2 THEN 'e' ELSE 'n' END AS kind, CAST(l_quantity AS BIGINT) AS v, min(rn) AS ord FROM lines GROUP BY 1, 2, 3),
docs AS (SELECT DISTINCT doc_id FROM c),
m AS (SELECT doc_id, v, ord FROM c WHERE kind = 'm' UNION ALL SELECT doc_id, NULL, 1000 FROM docs),
e AS (SELECT doc_id, v, ord FROM c WHERE kind = 'e' UNION ALL SELECT doc_id, NULL, 1000 FROM docs)
"""


@query("reservation_match", f"""
WITH {CANDIDATES},
fits AS (SELECT f.doc_id, f.v AS fresh, m.v AS mm, e.v AS emp, n.v AS net,
    row_number() OVER (PARTITION BY f.doc_id ORDER BY -((m.v IS NOT NULL)::INT + (e.v IS NOT NULL)::INT), f.ord, m.ord, e.ord, n.ord) AS rn
  FROM c f JOIN m USING (doc_id) JOIN e USING (doc_id) JOIN c n USING (doc_id) WHERE f.kind = 'f' AND n.kind = 'n' AND f.v = coalesce(m.v, 0) + coalesce(e.v, 0) + n.v)
SELECT d.doc_id, CASE WHEN x.doc_id IS NOT NULL THEN x.fresh ELSE (SELECT arg_min(v, ord) FROM c WHERE kind = 'f' AND c.doc_id = d.doc_id) END AS fresh,
  CASE WHEN x.doc_id IS NOT NULL THEN x.mm ELSE (SELECT arg_min(v, ord) FROM c WHERE kind = 'm' AND c.doc_id = d.doc_id) END AS mm,
  CASE WHEN x.doc_id IS NOT NULL THEN x.emp ELSE (SELECT arg_min(v, ord) FROM c WHERE kind = 'e' AND c.doc_id = d.doc_id) END AS emp,
  CASE WHEN x.doc_id IS NOT NULL THEN x.net ELSE (SELECT arg_min(v, ord) FROM c WHERE kind = 'n' AND c.doc_id = d.doc_id) END AS net
FROM docs d LEFT JOIN fits x ON x.doc_id = d.doc_id AND x.rn = 1
""")
def reservation_match(spark: SparkSession, folder: str) -> DataFrame:
    r = facts.reservation_match(F.col("fresh"), F.col("mm"), F.col("emp"), F.col("net"))
    return _quantities(spark, folder).select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("pre_post_match", f"""
WITH {CANDIDATES},
fresh AS (SELECT doc_id, arg_min(v, ord) AS f FROM c WHERE kind = 'n' GROUP BY 1),
fits AS (SELECT p.doc_id, p.v AS pre, q.v AS post, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.ord) AS rn FROM c p JOIN c q USING (doc_id) JOIN fresh USING (doc_id) WHERE p.kind = 'm' AND q.kind = 'f' AND q.v = p.v + f)
SELECT d.doc_id, coalesce(x.pre, (SELECT arg_min(v, ord) FROM c WHERE kind = 'm' AND c.doc_id = d.doc_id)) AS pre, coalesce(x.post, (SELECT arg_min(v, ord) FROM c WHERE kind = 'f' AND c.doc_id = d.doc_id)) AS post
FROM docs d LEFT JOIN fits x ON x.doc_id = d.doc_id AND x.rn = 1
""")
def pre_post_match(spark: SparkSession, folder: str) -> DataFrame:
    r = facts.pre_post_match(F.col("mm"), F.col("fresh"), F.get("net", F.lit(0)))
    return _quantities(spark, folder).select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("issue_details", """
SELECT p_partkey AS doc_id, CAST(p_size * 1000 + 5000 AS BIGINT) AS fresh, CAST(p_size * 1000 AS BIGINT) AS mm, CAST(5000 AS BIGINT) AS net, CASE WHEN p_partkey % 2 = 0 THEN CAST(0 AS BIGINT) END AS ofs,
       CAST(p_size * 1000 + 5000 AS BIGINT) AS total, CAST(20000 AS BIGINT) AS pre, CAST(p_size * 1000 + 25000 AS BIGINT) AS post, 'high' AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 'Fixed Price' ELSE 'Bookbuilding' END AS issue_type,
       CASE WHEN p_partkey % 2 = 0 THEN 'BSE SME' ELSE 'NSE' END AS listing_at
FROM part
""")
def issue_details(spark: SparkSession, folder: str) -> DataFrame:
    """A share-structure table and a sentence per part."""
    n, k = F.col("p_size") * 1000, F.col("p_partkey")
    share = lambda c: F.concat(F.format_string("%,d", c.cast("bigint")), F.lit(" Equity Shares"))
    rows = [
        _row(F.lit("Fresh Issue"), share(n + 5000)), _row(F.lit("Market Maker Reservation Portion"), share(n)), _row(F.lit("Net Issue to Public"), share(F.lit(5000))),
        _row(F.lit("Equity Shares outstanding prior to the Issue"), F.format_string("%,d", F.lit(20000))), _row(F.lit("Equity Shares outstanding after the Issue"), F.format_string("%,d", (n + 25000).cast("bigint"))),
        F.lit(""), F.when(k % 2 == 0, "The entire issue constitutes fresh issue on BSE SME.").otherwise("Listed on NSE."), F.when(k % 3 == 0, "A fixed price issue.").otherwise("A book building issue."),
    ]
    d = spread(table(spark, folder, "part"), "p_partkey").select(k.alias("doc_id"), F.concat_ws("\n", *rows).alias("text"), F.lit(True).alias("is_sme"))
    return facts.issue_details(d).select(
        "doc_id", F.col("fresh_issue_shares").alias("fresh"), F.col("market_maker_shares").alias("mm"), F.col("net_offer_shares").alias("net"), F.col("ofs_shares").alias("ofs"),
        F.col("total_issue_shares").alias("total"), F.col("pre_issue_shares").alias("pre"), F.col("post_issue_shares").alias("post"), "confidence", "issue_type", "listing_at",
    )


@query("issue_structures", """
WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 5 AS kind, CAST(p_size * 1000 AS BIGINT) AS n FROM part)
SELECT doc_id,
  CASE kind WHEN 0 THEN n + 5000 WHEN 1 THEN n + 5000 WHEN 2 THEN n + 10000 WHEN 3 THEN 0 ELSE n + 5000 END AS fresh,
  CASE kind WHEN 1 THEN n WHEN 3 THEN n + 5000 WHEN 4 THEN n END AS ofs,
  CASE kind WHEN 0 THEN n WHEN 2 THEN n END AS mm,
  CASE kind WHEN 1 THEN CAST(1000 AS BIGINT) WHEN 4 THEN 1000 END AS emp,
  CASE kind WHEN 0 THEN 5000 WHEN 1 THEN 2 * n + 4000 WHEN 2 THEN 10000 WHEN 4 THEN 2 * n + 4001 END AS net,
  CASE kind WHEN 0 THEN n + 5000 WHEN 1 THEN 2 * n + 5000 WHEN 2 THEN n + 10000 WHEN 3 THEN n + 5000 ELSE 2 * n + 5000 END AS total,
  CASE kind WHEN 1 THEN 'Fresh + OFS' WHEN 4 THEN 'Fresh + OFS' WHEN 3 THEN 'Offer for Sale only' ELSE 'Fresh capital only' END AS sale_type,
  CASE WHEN kind = 4 THEN 'needs_review' ELSE 'high' END AS confidence
FROM p
""")
def issue_structures(spark: SparkSession, folder: str) -> DataFrame:
    """Share structures of five kinds: SME table, mainboard table, running text, an offer for sale alone, and parts that do not add up.

    Labels are longer than the surveyed limit in the mainboard table.
    """
    n, kind = F.col("p_size") * 1000, F.col("p_partkey") % 5
    whole = lambda c: F.format_string("%,d", c.cast("bigint"))
    share = lambda c: F.concat(whole(c), F.lit(" Equity Shares"))
    five = F.lit(5000)
    long = "Fresh Issue of shares that our company offers to all investors who are entitled to apply for them under this prospectus"

    def lines(*rows: Column) -> Column:
        return F.concat_ws("\n", *rows)

    def main(net: Column) -> Column:
        return lines(
            _row(F.lit(long), share(n + 5000)), _row(F.lit("Offer for Sale"), share(n)), _row(F.lit("Total Issue Size"), share(n * 2 + 5000)),
            _row(F.lit("Employee Reservation Portion"), share(F.lit(1000))), _row(F.lit("Net Offer"), share(net)),
        )

    sme = lines(_row(F.lit("Fresh Issue"), share(n + 5000)), _row(F.lit("Market Maker Reservation Portion"), share(n)), _row(F.lit("Net Issue to Public"), share(five)))
    prose = F.concat(
        F.lit("Total issue size of up to "), share(n + 10000), F.lit(". The fresh issue of "), share(n + 10000), F.lit(" is open. "), share(n),
        F.lit(" are reserved for subscription by the market maker. The issue less the market maker reservation portion i.e. "), share(F.lit(10000)), F.lit(" is net."),
    )
    sale = lines(_row(F.lit("Offer for Sale"), share(n + 5000)), _row(F.lit("Total Offer Size"), share(n + 5000)), F.lit(""), F.lit("Listing through an offer for sale."))
    text = F.when(kind == 0, sme).when(kind == 1, main(n * 2 + 4000)).when(kind == 2, prose).when(kind == 3, sale).otherwise(main(n * 2 + 4001))
    d = spread(table(spark, folder, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), text.alias("text"), kind.isin(0, 2).alias("is_sme"))
    fields = {"fresh_issue": "fresh", "ofs": "ofs", "market_maker": "mm", "employee_reservation": "emp", "net_offer": "net", "total_issue": "total"}
    return facts.issue_details(d).select("doc_id", *[F.col(f"{c}_shares").alias(a) for c, a in fields.items()], "sale_type", "confidence")


@query("objects_in_lists", f"""
WITH {LINES},
o AS (SELECT l_orderkey AS doc_id, rn * 2 - 2 AS ord, 'Setting up the manufacturing unit of our company for the products of part ' || l_partkey || ' in all the regions that we serve' AS name FROM lines
      UNION ALL SELECT l_orderkey, rn * 2 - 1, 'Marketing and brand building for the same products of supplier ' || l_suppkey || ' over the next three financial years' FROM lines),
first AS (SELECT doc_id, name, min(ord) AS ord FROM o GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, name, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS total,
  CASE WHEN doc_id % 2 = 0 THEN 'Crore' ELSE 'Lakhs' END AS unit, 'list' AS origin
FROM first
""")
def objects_in_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Objects that only a numbered list names, over 1,500 characters long for orders with many lines; amounts in Crore or Lakhs."""
    def item(number: Column, text: Column) -> Column:
        return F.concat(number.cast("string"), F.lit(". "), text, F.lit("; "))

    listed = F.flatten(F.transform("l", lambda x, i: F.array(
        item(i * 2 + 1, F.concat(F.lit("Setting up the manufacturing unit of our company for the products of part "), x["part"].cast("string"), F.lit(" in all the regions that we serve"))),
        item(i * 2 + 2, F.concat(F.lit("Marketing and brand building for the same products of supplier "), x["supp"].cast("string"), F.lit(" over the next three financial years"))),
    )))
    unit = F.when(F.col("doc_id") % 2 == 0, "Amount in Rs. crore. ").otherwise("All figures as printed. ")
    d = order_lines(spark, folder).select("doc_id", F.concat(unit, F.lit("The net proceeds go to the following objects: "), F.array_join(listed, "")).alias("text"))
    return facts.objects_of_issue(d).select("doc_id", "ord", "name", "amount", "total", "unit", "origin")


@query("objects_of_issue", f"""
WITH {LINES},
n AS (SELECT l_orderkey AS doc_id, max(rn) AS n, floor(sum(l_extendedprice) * 100 + 0.5) / 100 AS s FROM lines GROUP BY 1),
o AS (SELECT l_orderkey AS doc_id, rn - 1 AS ord, 'Funding working capital of unit ' || l_partkey AS name, l_extendedprice AS amount FROM lines
      UNION ALL SELECT doc_id, n, 'General corporate purposes', 100 FROM n)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, name, amount, floor(amount / 100 * 100 + 0.5) / 100 AS amount_cr, CASE WHEN doc_id % 2 = 0 THEN 5000.0::DOUBLE ELSE round(s + 100, 2) END AS total FROM o JOIN n USING (doc_id)
""")
def objects_of_issue(spark: SparkSession, folder: str) -> DataFrame:
    rows = F.transform("l", lambda x, i: _row(F.concat((i + 1).cast("string"), F.lit("."), F.lit(" Funding working capital of unit "), x["part"].cast("string"), F.lit("*")), _money(x["price"])))
    text = F.concat(
        F.lit("Amount (in Rs. lakhs)\n| Particulars | Amount |\n|---|---|\n"), F.array_join(rows, "\n"), F.lit("\n| General corporate purposes | 100.00 |\n| Net proceeds | 1 |"),
        F.when(F.col("doc_id") % 2 == 0, "\n| Total | 5,000.00 |").otherwise(""),
    )
    d = order_lines(spark, folder).select("doc_id", text.alias("text"))
    return facts.objects_of_issue(d).select("doc_id", "ord", "name", "amount", "amount_cr", F.round("total", 2).alias("total"))


@query("promoter_names", f"""
WITH {LINES},
f AS (SELECT l_orderkey AS doc_id, upper(p_name) AS name, min(rn) AS ord FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT doc_id, string_agg(name, ',' ORDER BY ord) AS promoters, 'high' AS confidence FROM f GROUP BY 1
""")
def promoter_names(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").join(table(spark, folder, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "p_name")
    per = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    names = F.array_join(F.transform("l", lambda x: F.upper(x["p_name"])), ", ")
    d = per.select("doc_id", F.concat(F.lit("PROMOTERS OF OUR COMPANY: "), names, F.lit(" DETAILS OF THE ISSUE")).alias("text"))
    return facts.promoter_names(d).select("doc_id", F.array_join("promoters", ",").alias("promoters"), "confidence")


@query("party_mentions", """
WITH d AS (SELECT o_orderkey AS doc_id, upper(p_name[1]) || p_name[2:] || ' Capital' AS n, regexp_extract(p_name || ' capital', '[a-z]{4,}') AS t, lpad(CAST(o_orderkey AS VARCHAR), 8, '1') AS ph
  FROM (SELECT l_orderkey AS o_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY 1) JOIN part ON p_partkey = k)
SELECT doc_id, 'lead_manager' AS role, n || ' Private Limited' AS name, 'mb@' || t || 'house.com' AS email, '+91 22 ' || ph AS phone, CAST(2 AS BIGINT) AS mentions FROM d
UNION ALL SELECT doc_id, 'registrar', 'Kfin Technologies Limited', CASE WHEN doc_id % 2 = 0 THEN 'ris@kfintech.com' END, CASE WHEN doc_id % 2 = 0 THEN '040 ' || ph ELSE '+91 22 ' || ph END, 1 FROM d
""")
def party_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """A lead manager (an order's first part) named twice and a registrar in a text per order."""
    n = table(spark, folder, "part").select("p_partkey", "p_name")
    first = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"))
    o = first.join(n, "p_partkey")
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100), F.lit(" Capital"))
    token = F.regexp_extract(F.concat("p_name", F.lit(" capital")), "[a-z]{4,}", 0)
    phone = F.lpad(F.col("o_orderkey").cast("string"), 8, "1")
    text = F.concat(
        F.lit("Book Running Lead Manager: "), name, F.lit(" Private Limited (the Manager) Tel: +91 22 "), phone, F.lit("; Email: MB@"), token, F.lit("house.com; \n"),
        F.lit("Lead Manager to the Issue "), name, F.lit(" Limited; 12 Hill Road; \nRegistrar to the Issue: Kfin Technologies Limited "),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Tel: 040-"), phone, F.lit("; Email: ris@kfintech.com"))).otherwise("; none"),
    )
    d = o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return parties.parties_of(d).select("doc_id", "role", "name", "email", "phone", "mentions")


@query("company_contacts", """
SELECT s_suppkey AS doc_id, s_suppkey || ' Hill Road, Mumbai' AS registered_office, 'Asha Rao' AS contact_person, 'cs@supplier' || s_suppkey || '.com' AS email, '022 ' || lpad(CAST(s_suppkey AS VARCHAR), 8, '2') AS phone,
       'https://www.supplier' || s_suppkey || '.com' AS website FROM supplier
""")
def company_contacts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("Cover page. Registered Office: "), k, F.lit(" Hill Road, Mumbai Tel: 022-"), F.lpad(k, 8, "2"), F.lit(" Contact Person: Asha Rao E-mail: cs@supplier"), k,
        F.lit(".com Website: https://www.supplier"), k, F.lit(".com; end"),
    )
    d = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"), F.concat(F.lit("Supplier "), k, F.lit(" Ltd")).alias("company_name"))
    return parties.company_contacts(d)


@query("canonical_mention", None)
def canonical_mention(spark: SparkSession, folder: str) -> DataFrame:
    """Most mentioned maker among the similar names of an order's parts."""
    li = table(spark, folder, "lineitem").join(table(spark, folder, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name")
    per = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    m = per.select("doc_id", F.transform("l", lambda x: F.concat(F.initcap(x["p_name"]), F.when(x["l_linenumber"] % 2 == 0, " Private Limited").otherwise(" Limited"))).alias("names"))
    out = facts.canonical_mentions(m, "names", "variants")
    return out.select("doc_id", F.get("variants", F.lit(0)).alias("name"), F.size("variants").alias("groups"))


@query("printed_lot_table", """
SELECT p_partkey AS doc_id, CAST(p_size + 10 AS INTEGER) AS lot_size, category, type, CAST(lots AS BIGINT) AS lots, CAST(lots * (p_size + 10) AS BIGINT) AS shares, CAST(lots * (p_size + 10) * 100 AS BIGINT) AS amount
FROM part, (VALUES ('Retail', 'Min', 1), ('Retail', 'Max', 13), ('B-HNI', 'Min', 68), ('HNI', 'Min', 68)) t(category, type, lots)
""")
def printed_lot_table(spark: SparkSession, folder: str) -> DataFrame:
    s = (F.col("p_size") + 10).cast("bigint")
    def row(label: str, lots: int) -> Column:
        return F.concat(F.lit(f"\n{label} {lots} "), F.format_string("%,d", s * lots), F.lit(" ₹"), F.format_string("%,d", s * lots * 100))

    text = F.concat(F.lit("A minimum of "), s.cast("string"), F.lit(" shares per lot."), row("Retail (Min)", 1), row("Retail (Max)", 13), row("B-HNI (Min)", 68))
    return facts.printed_lot_table(table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query("page_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN CAST(o_orderkey AS INTEGER) END AS page FROM orders")
def page_numbers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", fn.trailing_page_number(F.concat(F.lit("Our management ......"), k.cast("string"))).alias("page"))
