"""Queries: pages, sections and page scores.

Documents stand for prospectuses: their lines are pages. Where rules need wording that the
texts lack, the words of the texts take that role as parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import items, pages, quality
from ..rules import pages as R
from ..sources import files
from .registry import query, table

WS_SQL = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"

LINES = """
lines AS (SELECT doc_id, source, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS page, unnest(parts) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))
"""


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    return pages.pages_of(table(spark, folder, "documents"), separator="\n")


@query("hash_pages", f"WITH {LINES} SELECT doc_id, page, sha256(trim(regexp_replace(text, '{WS_SQL}', ' ', 'g'))) AS page_hash FROM lines")
def hash_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.hash_pages(lines_of(spark, folder)).select("doc_id", "page", "page_hash")


OVERLAP = f"""
{LINES},
hashed AS (SELECT CAST(substr(source, 4) AS INTEGER) AS entity, doc_id % 2 AS version, trim(regexp_replace(text, '{WS_SQL}', ' ', 'g')) AS h FROM lines),
known AS (SELECT DISTINCT entity, h, TRUE AS k FROM hashed WHERE version = 0),
o AS (SELECT n.entity, count(*) AS pages, count(k) AS overlap FROM (SELECT * FROM hashed WHERE version = 1) n LEFT JOIN known USING (entity, h) GROUP BY 1)
"""


def _overlap(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "source", "text")
    p = pages.pages_of(d, separator="\n").join(d.select("doc_id", F.substring("source", 4, 10).cast("int").alias("entity")), "doc_id")
    hashed = p.select("entity", (F.col("doc_id") % 2).alias("version"), fn.page_hash(F.col("text")).alias("page_hash"))
    return pages.page_overlap(hashed.filter("version = 1"), hashed.filter("version = 0"))


@query("page_overlap", f"WITH {OVERLAP} SELECT entity, pages, overlap, pages - overlap AS unique_pages FROM o")
def page_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every source's odd documents that occur in its even ones."""
    return _overlap(spark, folder)


@query("version_skip", f"""
WITH {OVERLAP} SELECT entity, round(overlap / pages, 6) AS ratio, overlap / pages >= 0.05 AS skipped, CASE WHEN overlap / pages >= 0.05 THEN 0 ELSE pages - overlap END AS new_pages FROM o
""")
def version_skip(spark: SparkSession, folder: str) -> DataFrame:
    return pages.version_skip(_overlap(spark, folder), 0.05).select("entity", F.round("ratio", 6).alias("ratio"), "skipped", "new_pages")


# Words of the invented prose that play section headings.
WORD_RULES = {"the": "(?i)^the", "les": "(?i)^les?", "que": "(?i)^que", "und": "(?i)^un", "tion": "(?i)tion", "ing": "(?i)^in"}

SECTIONS = f"""
{LINES},
hits AS (SELECT doc_id, section, min(page) FILTER (WHERE regexp_matches(text, rule)) AS start, max(page) AS last_page
  FROM lines, (VALUES {", ".join(f"('{k}', '{v}')" for k, v in WORD_RULES.items())}) AS r(section, rule) GROUP BY 1, 2),
found AS (SELECT * FROM hits WHERE start IS NOT NULL),
ranges AS (SELECT doc_id, section, start, coalesce((SELECT min(g.start) FROM found g WHERE g.doc_id = f.doc_id AND g.start > f.start) - 1, last_page) AS "end" FROM found f)
"""


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return pages.detect_sections(lines_of(spark, folder), WORD_RULES)


@query("detect_sections", f"WITH {SECTIONS} SELECT * FROM ranges")
def detect_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder)


@query("slice_sections", f"""
WITH {SECTIONS} SELECT r.doc_id, r.section, CAST(count(*) AS BIGINT) AS pages, CAST(sum(length(l.text)) AS BIGINT) AS chars
FROM ranges r JOIN lines l ON l.doc_id = r.doc_id AND l.page BETWEEN r.start AND r."end" GROUP BY 1, 2
""")
def slice_sections(spark: SparkSession, folder: str) -> DataFrame:
    cut = pages.slice_sections(lines_of(spark, folder), _sections(spark, folder))
    return cut.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"))


@query("section_manifest", f"""
WITH {SECTIONS} SELECT doc_id, string_agg(section || '=' || start || '-' || "end", ',' ORDER BY section) AS sections FROM ranges GROUP BY 1
""")
def section_manifest(spark: SparkSession, folder: str) -> DataFrame:
    m = files.section_manifest(_sections(spark, folder))
    entries = F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["pages"]))
    return m.select("doc_id", F.array_join(F.array_sort(entries), ",").alias("sections"))


# Pages of conversations with numbers, years and ratio words worked in by turn.
TURNS = """
turns AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text ||
    CASE WHEN turn % 2 = 1 THEN ' Revenue from operations 1,652.47 EBITDA 20 March 2025 March 2024' ELSE '' END ||
    CASE WHEN conv_id % 3 = 0 THEN ' Restated total income RoCE 12% RoNW 9.5 % current ratio' ELSE '' END ||
    CASE WHEN conv_id % 5 = 0 AND turn % 4 = 3 THEN ' Key performance indicator debt-equity ebitda margin 10% 11% 12%' ELSE '' END AS text FROM conversations)
"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    more = F.concat(
        F.when(t % 2 == 1, " Revenue from operations 1,652.47 EBITDA 20 March 2025 March 2024").otherwise(""),
        F.when(c % 3 == 0, " Restated total income RoCE 12% RoNW 9.5 % current ratio").otherwise(""),
        F.when((c % 5 == 0) & (t % 4 == 3), " Key performance indicator debt-equity ebitda margin 10% 11% 12%").otherwise(""),
    )
    return table(spark, folder, "conversations").select(c.alias("doc_id"), (t + 1).cast("int").alias("page"), F.concat("text", more).alias("text"))


# RE2 has ASCII word boundaries of its own and no look-around.
def _re2(pattern: str) -> str:
    from ..functions.text import BOUNDARY

    for java in (BOUNDARY, r"(?<!\w)", r"(?!\w)"):
        pattern = pattern.replace(java, r"\b")
    return pattern


def _hits_sql(patterns: list[str]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(text, '{_re2(p)}') THEN 1 ELSE 0 END" for p in patterns)


SCORES = f"""
{TURNS},
counted AS (SELECT *, len(regexp_extract_all(text, '{R.YEAR_HEADER}')) AS years, {_hits_sql(R.STATEMENT_SIGNALS)} AS hits, {_hits_sql(R.RATIO_SIGNALS)} AS ratios,
   len(regexp_extract_all(text, '{R.PERCENT}')) AS pct, CASE WHEN regexp_matches(text, '{R.RATIO_HEADING}') THEN 3 ELSE 0 END AS heading FROM turns),
scores AS (SELECT doc_id, page, length(text) + 20 + length(CAST(page AS VARCHAR)) AS size,
   CAST(CASE WHEN regexp_matches(text, '{R.HAS_NUMBER}') THEN hits + CASE WHEN years >= 3 THEN 3 WHEN years >= 2 THEN 2 ELSE 0 END ELSE 0 END AS INTEGER) AS statement_score,
   CAST(CASE WHEN ratios = 0 AND heading = 0 THEN 0 ELSE 2 * ratios + least(8, pct) + heading END AS INTEGER) AS ratio_score FROM counted)
"""


@query("score_pages", f"WITH {SCORES} SELECT doc_id, page, statement_score, ratio_score FROM scores")
def score_pages(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).select(
        "doc_id", "page", pages.statement_score(F.col("text")).alias("statement_score"), pages.ratio_score(F.col("text")).cast("int").alias("ratio_score")
    )


@query("page_window", f"""
WITH {SCORES},
best AS (SELECT doc_id, arg_max(page, {{'s': statement_score, 'p': -page}}) AS b FROM scores GROUP BY 1)
SELECT doc_id, page, statement_score AS score FROM scores JOIN best USING (doc_id) WHERE page = b OR statement_score >= 2
""")
def page_window(spark: SparkSession, folder: str) -> DataFrame:
    return pages.statement_window(turns(spark, folder))


@query("ratio_window", f"""
WITH {SCORES},
best AS (SELECT doc_id, arg_max(page, {{'s': ratio_score, 'p': -page}}) AS b, max(ratio_score) AS top FROM scores GROUP BY 1)
SELECT doc_id, page, ratio_score AS score FROM scores JOIN best USING (doc_id) WHERE top >= 4 AND (page = b OR ratio_score >= 3)
""")
def ratio_window(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ratio_window(turns(spark, folder))


@query("page_window_in_budget", f"""
WITH {SCORES},
best AS (SELECT doc_id, arg_max(page, {{'s': statement_score, 'p': -page}}) AS b FROM scores GROUP BY 1),
near AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY abs(page - b), page) AS rn FROM scores s JOIN best USING (doc_id) WHERE page = b OR statement_score >= 2),
used AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY page) AS total FROM near WHERE rn <= 5)
SELECT doc_id, page, statement_score AS score FROM used WHERE total <= 2000
""")
def page_window_in_budget(spark: SparkSession, folder: str) -> DataFrame:
    return pages.statement_window(turns(spark, folder), window=5, max_chars=2000)


@query("ratio_window_nearest", f"""
WITH {SCORES},
best AS (SELECT doc_id, arg_max(page, {{'s': ratio_score, 'p': -page}}) AS b, max(ratio_score) AS top FROM scores GROUP BY 1),
near AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY abs(page - b), page) AS rn FROM scores s JOIN best USING (doc_id)
         WHERE top >= 4 AND (page = b OR (ratio_score >= 3 AND abs(page - b) <= 4)))
SELECT doc_id, page, ratio_score AS score FROM near WHERE rn <= 6
""")
def ratio_window_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ratio_window(turns(spark, folder), window=6, reach=4)


@query("fact_pages", f"""
WITH {TURNS} SELECT doc_id, page, 'ratio' AS kind FROM turns WHERE regexp_matches(text, '(?i)\\b(?:return on|roce|ronw|roe|deb.*equity)\\b') AND contains(text, '%')
""")
def fact_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.ratio_pages(turns(spark, folder)).select("doc_id", "page", F.lit("ratio").alias("kind"))


GROUND = """
facts AS (SELECT c.conv_id AS doc_id, CAST(c.turn + 1 AS INTEGER) AS page, CAST(m.turn AS INTEGER) AS cited, m.text AS quote, c.text FROM conversations c JOIN conversations m
  ON m.conv_id = c.conv_id AND (m.turn = c.turn OR m.turn = c.turn + 1)),
n AS (SELECT *, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS p FROM facts),
w AS (SELECT *, list_filter(string_split(q, ' '), lambda t: length(t) > 1) AS words FROM n),
g AS (SELECT doc_id, page, cited, length(q) >= 4 AND length(p) > 0 AND (contains(p, q)
   OR (len(words) > 0 AND len(list_filter(words, lambda t: contains(p, t))) >= len(words) * 0.7)) AS grounded FROM w)
"""


def _grounded(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    pg = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    quotes = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("cited"), F.col("text").alias("quote"))
    facts = quotes.withColumn("page", F.explode(F.array(F.col("cited") + 1, F.col("cited")))).filter("page >= 1")
    return pages.ground_facts(facts, pg)


@query("grounding", f"WITH {GROUND} SELECT doc_id, page, cited, grounded FROM g")
def grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn (as a quote) looked up in their own and in the turn before."""
    known = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"))
    return _grounded(spark, folder).join(known, ["doc_id", "page"], "left_semi").select("doc_id", "page", "cited", "grounded")


@query("grounding_score", f"WITH {GROUND} SELECT doc_id, CAST(count(*) AS BIGINT) AS metrics, CAST(count(*) FILTER (WHERE grounded) AS BIGINT) AS grounded, round(avg(CAST(grounded AS INTEGER)), 3) AS grounding FROM g GROUP BY 1")
def grounding_score(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"))
    return quality.grounding_score(_grounded(spark, folder).join(known, ["doc_id", "page"], "left_semi"))


@query("clean_texts", r"""
SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x09\x0A\x20-\x7E\x{00A0}-\x{10FFFF}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS t
  FROM documents)
""")
def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    t = fn.clean_text(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), F.md5(t).alias("digest"))


@query("contents_sections", """
WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 90 + 10 AS INTEGER) AS s FROM orders),
starts AS (SELECT doc_id, 'RISK_FACTORS' AS section, s AS start FROM o UNION ALL SELECT doc_id, 'CAPITAL_STRUCTURE', s + 30 FROM o UNION ALL SELECT doc_id, 'OBJECTS_OF_THE_OFFER', s + 30 FROM o
  UNION ALL SELECT doc_id, 'OUR_BUSINESS', s + 200 FROM o UNION ALL SELECT doc_id, 'DIVIDEND_POLICY', s + 300 FROM o)
SELECT doc_id, section, start AS printed_start,
  CAST((CASE section WHEN 'RISK_FACTORS' THEN start + 29 WHEN 'CAPITAL_STRUCTURE' THEN start - 1 WHEN 'OBJECTS_OF_THE_OFFER' THEN start - 1 WHEN 'OUR_BUSINESS' THEN start + 99 END) AS INTEGER) AS printed_end,
  CAST(NULL AS INTEGER) AS pdf_start, 'toc' AS origin FROM starts
UNION ALL SELECT doc_id, 'OUR_MANAGEMENT', NULL, NULL, 9, 'fullscan' FROM o
""")
def contents_sections(spark: SparkSession, folder: str) -> DataFrame:
    """A contents page per order and a heading on a later page, located by their lines."""
    s = F.col("o_orderkey") % 90 + 10
    line = lambda text, n: F.concat(F.lit(text + " ..... "), (s + n).cast("string"))
    lines = [line("RISK FACTORS", 0), line("Capital Structure", 30), line("Objects of the Issue", 30), line("OUR BUSINESS", 200), line("Dividend Policy", 300)]
    entries = [F.struct(F.lit(2).alias("page"), F.lit(i).alias("seq"), F.lit(1.0).alias("x"), F.lit(10.0 * i).alias("y"), t.alias("str")) for i, t in enumerate(lines)]
    entries.append(F.struct(F.lit(9).alias("page"), F.lit(0).alias("seq"), F.lit(1.0).alias("x"), F.lit(5.0).alias("y"), F.lit("Our Management").alias("str")))
    it = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*entries)).alias("i")).select("doc_id", "i.*")
    return items.locate_by_contents(it).select("doc_id", "section", "printed_start", "printed_end", "pdf_start", "origin")
