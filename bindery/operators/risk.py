"""Loss-run figures, factor features and transparent scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery import fixed
from bindery.functions.values import parse_currency
from bindery.operators.ranking import number_within


def check_thresholds(low_max: int, medium_max: int, high_min: int) -> None:
    if not low_max < medium_max < high_min:
        raise ValueError("thresholds must increase: low_max < medium_max < high_min")


def category(score: Column, low_max: int = fixed.RISK_LOW_MAX, medium_max: int = fixed.RISK_MEDIUM_MAX,
             high_min: int = fixed.RISK_HIGH_MIN) -> Column:
    """LOW, MEDIUM or HIGH; UNDETERMINED where there is no score."""
    check_thresholds(low_max, medium_max, high_min)
    return F.when(score.isNull(), "UNDETERMINED").when(score <= low_max, "LOW").when(score <= medium_max, "MEDIUM").otherwise("HIGH")


def risk_scores(submissions: DataFrame, factors: DataFrame, base: int = fixed.RISK_BASE,
                low_max: int = fixed.RISK_LOW_MAX, medium_max: int = fixed.RISK_MEDIUM_MAX,
                high_min: int = fixed.RISK_HIGH_MIN, source: str = fixed.RISK_SOURCE) -> DataFrame:
    """Base plus the factor deltas, clamped to 0..100, with category and thresholds.

    ``factors``: submission_id, name, delta. Submissions without factors stay
    without a score. The factor rows themselves are the breakdown.
    """
    sums = factors.groupBy("submission_id").agg(F.sum("delta").alias("total_delta"), F.count(F.lit(1)).alias("n_factors"))
    scored = submissions.select("submission_id").join(sums, "submission_id", "left") \
        .withColumn("final_score", F.greatest(F.lit(0), F.least(F.lit(100), F.lit(base) + F.col("total_delta"))))
    return scored.select(
        "submission_id", F.lit(base).alias("base_score"), "total_delta", F.coalesce("n_factors", F.lit(0)).alias("n_factors"), "final_score",
        category(F.col("final_score"), low_max, medium_max, high_min).alias("category"),
        F.struct(F.lit(low_max).alias("low_max"), F.lit(medium_max).alias("medium_max"), F.lit(high_min).alias("high_min")).alias("thresholds_used"),
        F.lit(source).alias("threshold_source"))


def score_breakdown(scores: DataFrame, factors: DataFrame) -> DataFrame:
    """Scores beside their factors: ``score_breakdown`` (JSON of the score) and one row a factor, by name and delta.

    A submission without factors has one row whose ordinal is null.
    """
    numbered = number_within(factors.select("submission_id", "name", "delta"), ["submission_id"], ["name", "delta"], "ordinal")
    score = F.to_json(F.struct("base_score", "final_score", "category", "thresholds_used", "threshold_source"))
    return scores.withColumn("score_breakdown", score).join(numbered, "submission_id", "left").select(
        "submission_id", "score_breakdown", "ordinal", "name", "delta")


# --- claims -----------------------------------------------------------------
def _total(*columns: str) -> Column:
    """Exact money sum: decimals add up the same in any order of tasks."""
    amount = reduce(lambda a, b: a + b, [F.col(c).cast("decimal(18,4)") for c in columns])
    return F.sum(amount).cast("double")


def loss_metrics(claims: DataFrame, premiums: DataFrame | None = None) -> DataFrame:
    """Loss-run figures per submission; loss ratio is incurred / premium in percent."""
    metrics = claims.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("total_claims"), _total("paid").alias("total_paid"), _total("paid", "reserve").alias("total_incurred"),
        F.count_if(F.col("status") == "open").alias("open_claims_count"), F.max("paid").alias("largest_claim_amount"),
        F.min("date_of_loss").cast("date").alias("period_start"), F.max("date_of_loss").cast("date").alias("period_end"))
    if premiums is None:
        return metrics.withColumn("loss_ratio", F.lit(None).cast("double"))
    premium = premiums.select("submission_id", "premium")
    return metrics.join(premium, "submission_id", "left").withColumn(
        "loss_ratio", F.when(F.col("premium") > 0, F.col("total_incurred") / F.col("premium") * 100)).drop("premium")


def severity_trend(claims: DataFrame) -> DataFrame:
    """Mean incurred per policy year and its change on the year before (few years per submission)."""
    yearly = claims.groupBy("submission_id", F.year("date_of_loss").alias("policy_year")).agg(
        F.count(F.lit(1)).alias("n_claims"), (_total("paid", "reserve") / F.count(F.lit(1))).alias("severity"))
    w = Window.partitionBy("submission_id").orderBy("policy_year")
    return yearly.withColumn("previous", F.lag("severity").over(w)).withColumn("change", F.col("severity") - F.col("previous"))


def factor_features(submissions: DataFrame, claims: DataFrame, assembled: DataFrame, issues: DataFrame) -> DataFrame:
    """Inputs for factor weights, per submission. The weights are the user's configuration."""
    trend = severity_trend(claims)
    by_year = trend.groupBy("submission_id").agg(
        F.sum("n_claims").alias("n_claims"), (F.max("policy_year") - F.min("policy_year") + 1).alias("years"), F.count(F.lit(1)).alias("claim_years"),
        F.max_by("change", "policy_year").alias("latest_severity_change"))
    incurred = claims.groupBy("submission_id").agg(_total("paid", "reserve").alias("total_incurred"))

    def revenue(document_type: str, field: str) -> Column:
        mine = (F.col("document_type") == document_type) & (F.col("field_name") == field)
        return F.max(F.when(mine, parse_currency("value")))

    stated = assembled.groupBy("submission_id").agg(
        revenue("ACORD_APPLICATION", "annual_revenue").alias("_a"), revenue("FINANCIAL_STATEMENT", "total_revenue").alias("_f"))
    open_ = issues.filter("not is_resolved").groupBy("submission_id").agg(
        F.count_if(F.col("issue_type") == "MISSING").alias("missing_count"), F.count_if(F.col("issue_type") == "CONFLICT").alias("conflict_count"))
    joined = reduce(lambda a, b: a.join(b, "submission_id", "left"), [by_year, incurred, stated, open_], submissions.select("submission_id"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_claims", "missing_count", "conflict_count")}
    return joined.withColumns(counts).select(
        "submission_id", F.coalesce(F.col("n_claims") / F.col("years"), F.lit(0.0)).alias("claims_per_year"),
        F.coalesce("total_incurred", F.lit(0.0)).alias("total_incurred"), "latest_severity_change",
        F.coalesce(F.col("years") - F.col("claim_years"), F.lit(0)).alias("loss_free_years"),
        (F.abs(F.col("_a") - F.col("_f")) / F.greatest(F.abs("_a"), F.abs("_f"), F.lit(1e-9))).alias("revenue_discrepancy"),
        "missing_count", "conflict_count", (F.col("missing_count") == 0).alias("is_complete"))


def coverage_lines(lines: DataFrame) -> DataFrame:
    """Number of coverage lines each submission asks for."""
    return lines.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_lines"))


# --- decisions --------------------------------------------------------------
def check_values(rows: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with an allowed value, rejected rows)."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def human_decisions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return check_values(rows, "decision", fixed.DECISIONS)


def recommendations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return check_values(rows, "recommendation", fixed.RECOMMENDATIONS)
