"""Bounds, consistency and confidence of extracted facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import approx_equal, clamp01, let, rx
from ..rows import last_by, once
from ..rules import checks as R


def bounds_table(spark: SparkSession, bounds: dict | None = None) -> DataFrame:
    rows = [(k, float(lo), float(hi)) for k, (lo, hi) in (bounds or R.BOUNDS).items()]
    return spark.createDataFrame(rows, "field string, low double, high double")


def bounds_flags(facts: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """facts(…, field, value[, is_number]) outside their field's bounds, with a reason.

    The built-in rule table is a constant of 35 rows, hence broadcast; a given one is left to Catalyst.
    """
    rules = bounds if bounds is not None else F.broadcast(bounds_table(facts.sparkSession))
    value = F.col("value")
    number = F.col("is_number") if "is_number" in facts.columns else F.lit(True)

    def limit(c: Column) -> Column:
        """A bound as printed: whole numbers in full, without a point or an exponent."""
        return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))

    reason = (
        F.when(~number, "not_a_number")
        .when(value < F.col("low"), F.concat(F.lit("below_min:"), limit(F.col("low"))))
        .when(value > F.col("high"), F.concat(F.lit("above_max:"), limit(F.col("high"))))
    )
    return facts.join(rules, "field").withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("low", "high")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def consistency_rules(df: DataFrame, evident_intent: bool = False) -> dict[str, Column]:
    """Named checks over one wide row of facts; null or missing columns pass.

    Three rules can never fail with the facts that reach them (two count at least one of
    something that is absent when zero; one reads a venue nobody passes on). They are kept as
    they behave; ``evident_intent`` makes the two counts fail on zero.
    """
    def col(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    post, pre, fresh, ofs = (col(n) for n in ("postIssueShares", "preIssueShares", "freshIssueShares", "ofsShares"))
    total = col("totalIssueShares")
    zero = lambda c: F.coalesce(c, F.lit(0))
    reserved = zero(col("marketMakerShares")) + zero(col("employeeReservationShares")) + zero(col("netOfferShares"))
    venue = col("listingAt", "string")
    managers, objects = col("leadManagerCount"), col("objectCount")
    rules = {
        "post_equals_pre_plus_fresh": post == pre + fresh,
        "total_equals_fresh_plus_ofs": F.when(F.coalesce(fresh, ofs).isNotNull(), total == zero(fresh) + zero(ofs)),
        "fresh_ge_reserved_sum": reserved <= fresh + fresh * 0.01,
        "pre_issue_positive": pre >= 100,
        "price_band_order": col("priceMin") <= col("priceMax"),
        "listing_exchange_present": F.when(venue.isin("BSE SME", "NSE SME"), col("issueType", "string").eqNullSafe("SME")),
        "promoters_non_empty": col("promoterCount") > 0,
        "lead_managers_present": F.when(zero(managers) != 0, managers >= 1),
        "objects_non_empty_on_fresh_issue": F.lit(True),
    }
    if evident_intent:
        rules["lead_managers_present"] = managers >= 1
        rules["objects_non_empty_on_fresh_issue"] = F.when(fresh > 0, objects > 0)
    return {name: F.coalesce(test, F.lit(True)) for name, test in rules.items()}


def consistency_checks(wide: DataFrame, key: str = "doc_id", evident_intent: bool = False) -> DataFrame:
    """key, name, status per rule."""
    entries = [
        F.struct(F.lit(n).alias("name"), F.when(test, "pass").otherwise("fail").alias("status"))
        for n, test in consistency_rules(wide, evident_intent).items()
    ]
    return wide.select(key, F.explode(F.array(*entries)).alias("c")).select(key, "c.name", "c.status")


def validation_score(docs: DataFrame, flags: DataFrame, checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, flagged, failed, score, needs_review, accepted for every document in ``docs``."""
    flagged = flags.groupBy(key).agg(F.count(F.lit(1)).alias("flagged"))
    failed = checks.groupBy(key).agg(F.count_if(F.col("status") == "fail").alias("failed"))
    joined = docs.select(key).distinct().join(flagged, key, "left").join(failed, key, "left")
    return scored(joined.select(key, _zero("flagged").alias("flagged"), _zero("failed").alias("failed")))


def scored(counts: DataFrame) -> DataFrame:
    score = clamp01(F.lit(1.0) - F.lit(0.15) * F.col("flagged") - F.lit(0.10) * F.col("failed"))
    review = (F.col("flagged") > 0) | (F.col("failed") > 0) | (score < 0.7)
    return counts.select("*", score.alias("score"), review.alias("needs_review"), ((score >= 0.7) & ~review).alias("accepted"))


# --- statements -----------------------------------------------------------------------------


def grounding_score(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, metrics, grounded, grounding."""
    return facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("metrics"),
        F.count_if(F.col("grounded")).alias("grounded"),
        F.round(F.coalesce(F.avg(F.col("grounded").cast("double")), F.lit(0.0)), 3).alias("grounding"),
    )


SOFT_METRICS = [
    "revenueFromOperations", "totalIncome", "profitAfterTax", "ebitda", "netWorth", "ronw", "basicEPS", "dilutedEPS",
]


def _statements(metrics: DataFrame, periods: DataFrame, key: str, grounding: DataFrame | None = None) -> DataFrame:
    """One row per document: key, metrics, periods (arrays), grounding. One shuffle by key gathers the rows; a null key is a document too."""
    given = metrics.select(key, F.struct("metric", "period_idx", "value").alias("_m"))
    given = given.unionByName(periods.select(key, F.struct("period_idx", "label").alias("_p")), allowMissingColumns=True)
    g = F.lit(None).cast("double")
    if grounding is not None:
        given = given.unionByName(grounding.select(key, F.col("grounding").cast("double").alias("_g")), allowMissingColumns=True)
        g = F.max("_g")
    gathered = given.groupBy(key).agg(F.collect_list("_m").alias("metrics"), F.collect_list("_p").alias("periods"), F.coalesce(g, F.lit(0.0)).alias("grounding"))
    return gathered.filter((F.size("metrics") > 0) | (F.size("periods") > 0))


def _check(name: Column, test: Column, level: str) -> Column:
    return F.struct(name.alias("name"), F.lit(level).alias("level"), F.when(test, "pass").otherwise("fail").alias("status"))


def metric_checks(metrics: DataFrame, periods: DataFrame, grounding: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, level, status for every check of a document's statement.

    ``metrics``: key, metric, period_idx, value (null allowed); ``periods``: key, period_idx,
    label; ``grounding``: key, grounding. A document's rows are checked inside its own row.
    """
    docs = once(_statements(metrics, periods, key, grounding), {"_names": F.array_distinct(F.transform("metrics", lambda m: m["metric"]))})
    n = F.size("periods")
    odd = F.filter("_names", lambda x: F.size(F.filter("metrics", lambda m: m["metric"].eqNullSafe(x))) != n)
    docs = once(docs, {"_odd": odd})
    hard = F.array_compact(F.array(
        _check(F.lit("periods_count"), n.between(2, 4), "hard"),
        F.when(F.size("_odd") == 0, _check(F.lit("values_aligned"), F.lit(True), "hard")),
        _check(F.lit("has_metrics"), F.size("_names") >= 3, "hard"),
        _check(F.lit("grounding"), F.col("grounding") >= 0.6, "hard"),
    ))
    misaligned = F.transform("_odd", lambda x: _check(F.concat(F.lit("values_aligned:"), x), F.lit(False), "hard"))
    return docs.select(key, F.explode(F.concat(hard, misaligned, _soft_checks())).alias("c")).select(key, "c.*")


def soft_checks(metrics: DataFrame, periods: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, status: plausibility of the values of one period against each other."""
    return _statements(metrics, periods, key).select(key, F.explode(_soft_checks()).alias("c")).select(key, "c.name", "c.status")


def _soft_checks() -> Column:
    """The soft checks of all periods of a row of _statements."""
    def tested(w: Column, label: Column) -> Column:
        rev, inc, pat, ebitda, nw, ronw, basic, diluted = (w[m] for m in SOFT_METRICS)
        tests = {
            "rev<=income": rev <= inc * 1.02,
            "pat<=income": pat <= inc * 1.02,
            # Both values are needed: the or-branch alone must not decide.
            "eps_sign": F.when(pat.isNotNull() & basic.isNotNull(), (F.signum(pat) == F.signum(basic)) | (basic == 0)),
            "diluted<=basic": F.when(basic > 0, diluted <= basic + 0.01),
            "ronw_consistency": approx_equal(pat / F.nullif(nw, F.lit(0.0)) * 100, ronw, 0.20, 1.0),
            "ebitda_margin": (ebitda / F.nullif(rev, F.lit(0.0))).between(-1, 1.5),
        }

        def checked(name: str, test: Column) -> Column:
            return let(test, lambda ok: F.when(ok.isNotNull(), _check(F.concat(F.lit(f"{name}:"), label), ok, "soft")))

        return F.array_compact(F.array(*[checked(n, t) for n, t in tests.items()]))

    def of_period(p: Column) -> Column:
        label = F.coalesce(p["label"], F.concat(F.lit("period"), p["period_idx"].cast("string")))
        held = F.filter("metrics", lambda m: (m["period_idx"] == p["period_idx"]) & m["metric"].isin(SOFT_METRICS))

        def value(h: Column, name: str) -> Column:
            return F.get(F.filter(h, lambda m: m["metric"] == name), F.lit(0))["value"].alias(name)

        def wide(h: Column) -> Column:
            return F.struct(*[value(h, name) for name in SOFT_METRICS])

        # A period without a metric to test has no checks.
        return let(held, lambda h: F.when(F.size(h) > 0, let(wide(h), lambda w: tested(w, label))))

    return F.flatten(F.array_compact(F.transform("periods", of_period)))


def metric_verdicts(metrics: DataFrame, checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """metrics(key, metric, grounded) + ok: grounded and no failed check that carries its name.

    Soft checks carry a period label, so only alignment failures can name a metric.
    """
    named = checks.filter((F.col("status") == "fail") & F.contains("name", F.lit(":")))
    # Joined by document alone, as both sides are shuffled already.
    failed = named.groupBy(key).agg(F.collect_set(F.substring_index("name", ":", -1)).alias("_f"))
    return metrics.join(failed, key, "left").withColumn(
        "ok", F.coalesce(F.col("grounded"), F.lit(False)) & ~F.coalesce(F.array_contains("_f", F.col("metric")), F.lit(False))
    ).drop("_f")


def statement_confidence(checks: DataFrame, grounding: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, hard_fails, soft_fails, grounding, confidence, review_required."""
    fails = checks.groupBy(key).agg(
        F.count_if((F.col("level") == "hard") & (F.col("status") == "fail")).alias("hard_fails"),
        F.count_if((F.col("level") == "soft") & (F.col("status") == "fail")).alias("soft_fails"),
    )
    j = fails.join(grounding.select(key, "grounding"), key, "left").withColumn("grounding", F.coalesce("grounding", F.lit(0.0)))
    raw = 0.30 + 0.70 * F.col("grounding") - 0.25 * F.col("hard_fails") - F.least(F.lit(0.30), 0.05 * F.col("soft_fails"))
    j = j.withColumn("confidence", clamp01(raw))
    return j.withColumn("review_required", (F.col("confidence") < 0.8) | (F.col("hard_fails") > 0) | (F.col("grounding") < 0.6))


# --- ratios ---------------------------------------------------------------------------------


def canonical_key(key: Column, label: Column) -> Column:
    """A known key stays; else the first alias found in the label; else the key or 'other'."""
    text = F.coalesce(label, F.lit(""))
    alias = F.lit(None).cast("string")
    for pattern, name in reversed(R.RATIO_ALIASES):
        alias = F.when(text.rlike(rx(pattern)), name).otherwise(alias)
    known = F.when(key.isin(R.RATIO_KEYS), key)
    return F.coalesce(known, alias, F.nullif(key, F.lit("")), F.lit("other"))


def repair_key_by_unit(key: Column, unit: Column, label: Column) -> Column:
    """Keys confused between a raw amount and its ratio, repaired by unit and label."""
    u, low = F.lower(F.coalesce(unit, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    money = reduce(lambda a, b: a | b, [F.contains(u, F.lit(m)) for m in R.MONEY_UNITS])
    settled = key.isin(R.SETTLED_RATIOS)
    demoted = F.when(money & (key == "ebitdaMargin"), "ebitda").when(money & (key == "patMargin"), "profitAfterTax").otherwise(key)

    def has(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])

    as_ratio = F.lit(None).cast("string")
    for name, words in reversed(R.RATIO_LABEL_WORDS):
        as_ratio = F.when(has(words), name).otherwise(as_ratio)
    as_money = F.lit(None).cast("string")
    for name, words, unless in reversed(R.MONEY_LABEL_WORDS):
        test = has(words) if unless is None else has(words) & ~F.contains(low, F.lit(unless))
        as_money = F.when(test, name).otherwise(as_money)
    percent = (u == "%") | has(["margin", "ratio", "%"])
    plain = money | u.rlike(r"^\d+\.?\d*$")
    return F.when(F.coalesce(settled, F.lit(False)), demoted).otherwise(
        F.coalesce(F.when(percent, as_ratio).when(plain, as_money), key)
    )


def ratio_range_checks(ratios: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, value: percentages outside +-1000 and negative multiples."""
    v = F.col("value")
    name = F.when((F.col("unit") == "%") & ((v < -1000) | (v > 1000)), F.concat(F.lit("range:"), "metric")).when(
        F.col("unit").isin("x", "ratio") & (v < 0) & (F.col("metric") != "revenueGrowth"), F.concat(F.lit("negative:"), "metric")
    )
    return ratios.withColumn("name", name).filter(F.col("name").isNotNull()).select(key, "name", "value")


def ratio_confidence(grounding: DataFrame, fails: DataFrame, key: str = "doc_id") -> DataFrame:
    counted = fails.groupBy(key).agg(F.count(F.lit(1)).alias("fails"))
    j = grounding.select(key, "grounding").join(counted, key, "left").withColumn("fails", _zero("fails"))
    j = j.withColumn("confidence", clamp01(0.30 + 0.70 * F.col("grounding") - 0.05 * F.col("fails")))
    return j.withColumn("review_required", (F.col("confidence") < 0.8) | (F.col("grounding") < 0.6))


def reorder_periods(values: DataFrame, key: list[str]) -> DataFrame:
    """values(key…, period_idx, end_date, value): periods newest first, values with them.

    A key with any undated period is left as it is. Adds new_idx; positions stay unique.
    """
    entry = F.struct("period_idx", "end_date", "value")
    lists = values.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("p"))
    dated = F.forall("p", lambda s: s["end_date"].isNotNull())
    newest = F.array_sort(
        F.transform("p", lambda s: F.struct((-F.unix_date(s["end_date"])).alias("o"), s["period_idx"].alias("i"), s["end_date"].alias("d"), s["value"].alias("v")))
    )
    as_is = F.transform("p", lambda s: F.struct(F.lit(None).cast("int").alias("o"), s["period_idx"].alias("i"), s["end_date"].alias("d"), s["value"].alias("v")))
    placed = lists.select(*key, F.posexplode(F.when(dated, newest).otherwise(as_is)).alias("new_idx", "s"))
    return placed.select(*key, "new_idx", F.col("s.i").alias("period_idx"), F.col("s.d").alias("end_date"), F.col("s.v").alias("value"))


def best_run(facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, run, grounded, facts of the run with most grounded facts, then most facts, then first."""
    per_run = facts.groupBy(key, "run").agg(F.count_if(F.col("grounded")).alias("grounded"), F.count(F.lit(1)).alias("facts"))
    best = F.max_by(F.struct("run", "grounded", "facts"), F.struct("grounded", "facts", -F.col("run")))
    return per_run.groupBy(key).agg(best.alias("b")).select(key, "b.*")


# --- flattening and provenance --------------------------------------------------------------


def flatten_metrics(metrics: DataFrame, key: str = "doc_id", metric: str = "metric", which: str = "last") -> DataFrame:
    """key, field, value: one value per metric, of its last (or first) period, if not null."""
    pick = F.max_by if which == "last" else F.min_by
    return metrics.groupBy(key, F.col(metric).alias("field")).agg(
        pick(F.struct("value"), "period_idx")["value"].alias("value")
    ).filter(F.col("value").isNotNull())


def long_facts(wide: DataFrame, fields: dict[str, str], key: str = "doc_id") -> DataFrame:
    """Wide row → (key, field, value) for the named columns that hold a value."""
    entries = [F.struct(F.lit(n).alias("field"), F.col(c).cast("double").alias("value")) for n, c in fields.items()]
    return wide.select(key, F.explode(F.array(*entries)).alias("f")).select(key, "f.field", "f.value").filter(F.col("value").isNotNull())


def merge_provenance(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """tags(key, field, ord, pattern, section, source): a later extractor's tag replaces an earlier one."""
    cols = [c for c in tags.columns if c not in (key, "field", "ord")]
    return tags.groupBy(key, "field").agg(*[last_by(F.col(c), F.col("ord")).alias(c) for c in cols])


def fact_summary(counts: DataFrame) -> DataFrame:
    """Which fact blocks a document has, as shown after an extraction run."""
    return counts.select(
        "doc_id", (F.col("metrics") > 0).alias("has_financials"), (F.col("ratios") > 0).alias("has_ratios"),
        *[c for c in counts.columns if c != "doc_id"],
    )
