"""Line-first cleaning with DataFrame functions only.

Each line of a text is judged by itself; lines that fail go. A document is rejected if it loses too much
of its text this way, or fails the base rules on its whole text (too few words, too many repeated ones).
All work happens within a row: nothing is shuffled, so no group and no copy can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
_WHITE_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Marks that close a line of prose.
CLOSING = r"[.!?…:;][\x22\x27”’»)\]]*[\x20\x09-\x0D]*$"
#: Marks between the entries of a navigation bar.
SEPARATORS = "|»›•·"
#: Entries of menus: a short line with nothing else is navigation.
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(home|menu|login|log in|log out|sign in|sign up|search|share|next|previous|back|contact|contact us|about|about us|sitemap|read more|more|top|back to top|subscribe|faq|help)[\x20\x09-\x0D]*$"
#: Phrases of notices, in lower case; they tell against lines of under 30 words.
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "use of cookies", "uses cookies", "accept cookies", "enable javascript", "lorem ipsum", "click here", "licensed under", "copyright ©", "©")


def _let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return _let(F.btrim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _WHITE_RE)))


def _less(text: Column, chars: str) -> Column:
    """How many characters of a text are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column, span: int = 8) -> Column:
    """Words that lie in windows of `span` words found twice or more; windows are told apart by 64-bit hashes."""
    def covered(hashes: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            twin = F.filter(pairs, lambda p, k: (
                F.coalesce((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"]), F.lit(False))
                | F.coalesce((k < last) & (F.get(pairs, k + 1)["h"] == p["h"]), F.lit(False))
            ))
            places = F.sort_array(F.transform(twin, lambda p: p["i"]))
            start = F.struct(F.lit(-span).alias("at"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                places, start,
                lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(span), p - a["at"])).alias("n")), lambda a: a["n"],
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, of_sorted))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (span - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(span))))
    return F.when(F.size(words) <= span, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation or boilerplate: a line without a word passes."""
    def judged(bare: Column) -> Column:
        count = F.size(F.split(F.btrim(line, F.lit(WHITE)), _WHITE_RE))
        junk = _less(line, SYMBOLS) * 10 > F.length(bare)
        stump = (count < 4) & ~line.rlike(CLOSING)
        bar = _less(line, SEPARATORS) >= 3
        low = F.lower(line)
        notice = F.lit(False)
        for phrase in BOILERPLATE:
            notice = notice | F.contains(low, F.lit(phrase))
        return (F.length(bare) > 0) & (junk | bar | stump | ((count < 4) & line.rlike(NAVIGATION)) | ((count < 30) & notice))

    return _let(F.translate(line, WHITE, ""), judged)


def judge(docs: DataFrame, max_lost: float = 0.5, min_words: int = 20, max_repeated: int = 30) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, clean_text, base_failed, kept.

    The input needs text and none of those columns. A null text has no words: it fails the base rules and
    its clean_text is null. Repeated rows are judged alike. lost_chars counts characters of words in lines
    that go; a document is kept if the base rules hold (at least
    `min_words` words, at most `max_repeated` % of them repeated) and at most the share `max_lost` of its characters goes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")

    def with_lines(rows: Column) -> Column:
        wordy = F.filter(rows, lambda x: F.btrim(x, F.lit(WHITE)) != "")
        good = F.filter(rows, lambda x: ~line_fails(x))
        return F.struct(
            _let(wordy, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("dup"), F.array_join(good, "\n").alias("clean"),
        )

    def with_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), F.length(F.array_join(words, "")).cast("long").alias("chars"), repeated_words(words).alias("repeated"))

    facts = F.struct(_let(lines, with_lines).alias("l"), _let(words_of(text), with_words).alias("w"), _less(text, SYMBOLS).cast("long").alias("symbols"))
    once = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(facts)).alias("_f"))
    f = F.col("_f")
    out = (
        once.withColumn("n_words", f["w"]["n"]).withColumn("word_chars", f["w"]["chars"]).withColumn("n_symbols", f["symbols"])
        .withColumn("n_dup_lines", f["l"]["dup"]).withColumn("n_repeat_words", f["w"]["repeated"])
        .withColumn("clean_text", F.when(F.col("text").isNotNull(), f["l"]["clean"]))
        .withColumn("lost_chars", f["w"]["chars"] - F.length(F.translate(f["l"]["clean"], WHITE, "")))
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated)
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * max_lost)).drop("_f")


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def judge_sql() -> str:
    """DuckDB SQL for the rows that `judge` gives on documents, without the text."""
    white = r"[\x20\x09-\x0D]+"
    symbols = r"[#*$%&|<>]"
    notices = " OR ".join(f"contains(lower(x), '{_quoted(p)}')" for p in BOILERPLATE)
    bare = f"length(regexp_replace(x, '{white}', '', 'g'))"
    count = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"
    fails = (
        f"{bare} > 0 AND ((length(x) - length(regexp_replace(x, '{symbols}', '', 'g'))) * 10 > {bare}"
        f" OR length(x) - length(regexp_replace(x, '[|»›•·]', '', 'g')) >= 3"
        f" OR ({count} < 4 AND (NOT regexp_matches(x, '{CLOSING}') OR regexp_matches(x, '{NAVIGATION}'))) OR ({count} < 30 AND ({notices})))"
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM d
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), twins AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM twins) GROUP BY rid
), facts AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{symbols}', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: {bare} > 0)) - len(list_distinct(list_filter(lines, lambda x: {bare} > 0))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(lines, lambda x: CASE WHEN {fails} THEN {bare} ELSE 0 END)), 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= word_chars AS kept
FROM facts"""
