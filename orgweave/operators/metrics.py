"""Reports: status counts, precision and coverage with one decimal, gains of one run over another. One aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import percent
from ..functions.text import is_blank


def outcome(got: Column, expected: Column, matches: Column) -> Column:
    """correct, incorrect, unknown, or skip where nothing was expected."""
    return F.when(is_blank(expected), "skip").when(is_blank(got), "unknown").when(matches, "correct").otherwise("incorrect")


def summarize(rows: DataFrame, outcome: str = "outcome", by: list[str] | None = None) -> DataFrame:
    """Counts of the outcomes; precision among those answered and coverage among all that count, in percent."""
    count = lambda *v: F.count_if(F.col(outcome).isin(*v))
    right, wrong, unknown = count("correct"), count("incorrect"), count("unknown")
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), right.alias("correct"), wrong.alias("incorrect"), unknown.alias("unknown"), percent(right, right + wrong).alias("precision_pct"),
        percent(right + wrong, right + wrong + unknown).alias("coverage_pct"), percent(right, right + wrong + unknown).alias("accuracy_pct"))


def summarize_founders(rows: DataFrame) -> DataFrame:
    """Of founder outcomes: how many lists are exact, how many hold right persons only, and how many are answered."""
    count = lambda *v: F.count_if(F.col("outcome").isin(*v))
    exact, partial, wrong, unknown = count("exact_complete"), count("correct_partial"), count("incorrect"), count("unknown")
    return rows.agg(F.count("*").alias("total"), exact.alias("exact"), partial.alias("partial"), wrong.alias("incorrect"), unknown.alias("unknown"),
                    count("not_applicable").alias("not_applicable"), percent(exact, exact + partial + wrong).alias("exact_precision_pct"),
                    percent(exact + partial, exact + partial + wrong).alias("person_precision_pct"), percent(exact + partial + wrong, exact + partial + wrong + unknown).alias("coverage_pct"))


def status_counts(rows: DataFrame, status: str = "status", statuses: tuple[str, ...] = ("found", "potential", "unverified")) -> DataFrame:
    """One row: the number of rows, of each status, and the share that is done."""
    done = F.count_if(F.col(status).isin(*statuses))
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses], percent(done, F.count("*")).alias("progress_pct"))


def unknown_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in columns])


def incremental_gain(before: DataFrame, after: DataFrame, key: str = "company_id", outcome: str = "outcome") -> DataFrame:
    """What a second run gains over a first one on the same rows, and a recommendation."""
    b, a = before.select(key, F.col(outcome).alias("b")), after.select(key, F.col(outcome).alias("a"))
    both = b.join(a, key)
    gained = F.count_if((F.col("a") == "correct") & (F.col("b") != "correct"))
    lost = F.count_if((F.col("b") == "correct") & (F.col("a") != "correct"))
    broken = F.count_if((F.col("a") == "incorrect") & (F.col("b") == "unknown"))
    out = both.agg(F.count("*").alias("total"), gained.alias("gained"), lost.alias("lost"), broken.alias("new_errors"))
    return out.withColumn("recommendation", F.when((F.col("lost") > 0) | (F.col("new_errors") > F.col("gained")), "do_not_adopt").when(F.col("gained") == 0, "no_gain").otherwise("adopt"))


def summarize_run(rows: DataFrame, fields: tuple[str, ...] = ("industry", "headcount", "location", "founders")) -> DataFrame:
    """One row on a run's rows (correct, *fields, high, medium, low, elapsed_ms, timeouts): accuracy, coverage of each field among correct rows, the share of
    unknown fields, the mix of confidences, the mean time and the timeouts."""
    c = F.col
    n, right = F.count("*"), F.count_if(c("correct"))
    blank = {f: F.count_if(is_blank(c(f))) for f in fields}
    sure = {k: F.coalesce(F.sum(k), F.lit(0)) for k in ("high", "medium", "low")}
    return rows.agg(n.alias("companies"), right.alias("correct"), percent(right, n).alias("accuracy_pct"), *[percent(F.count_if(c("correct") & ~is_blank(c(f))), right).alias(f"{f}_coverage_pct") for f in fields],
                    *[b.alias(f"{f}_unknown") for f, b in blank.items()], percent(sum(blank.values(), F.lit(0)), n * len(fields)).alias("unknown_pct"),
                    *[percent(v, sum(sure.values(), F.lit(0))).alias(f"{k}_pct") for k, v in sure.items()], F.floor(F.avg("elapsed_ms") + 0.5).alias("mean_ms"), F.coalesce(F.sum("timeouts"), F.lit(0)).alias("timeouts"))


def best_first(candidates: DataFrame) -> DataFrame:
    """Add ``place`` within a company: by score, of equal scores those of high confidence first, then in order of appearance."""
    w = Window.partitionBy("company_id").orderBy(F.desc("score"), F.desc(F.col("confidence") == "high"), "seq")
    return candidates.withColumn("place", F.row_number().over(w))
