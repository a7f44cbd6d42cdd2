"""Metrics, costs, progress and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# US dollars for a million tokens of (input, cached input, output), by model.
PRICES = {"deepseek-flash": ("0.30", "0.006", "1.20"), "text-embedding-3-small": ("0.02", "0.02", "0")}


def event_metrics(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts, durations and token sums by group."""
    return events.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.sum("duration_ms"), 6).alias("total_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )


def max_concurrency(spans: DataFrame, task: str, start: str, end: str, bucket: float = 3600) -> DataFrame:
    """The most spans of a task that overlap: ends count before starts of the same instant.

    Steps of one instant are summed first. A running sum inside each ``bucket`` (of the times' unit; seconds
    for timestamps) is added to a running sum over the buckets, so that no task sorts all of a task's steps.
    """
    steps = spans.select(task, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x")).select(task, "x.at", "x.d")
    summed = steps.groupBy(task, "at", "d").agg(F.sum("d").alias("d_sum")).withColumn("bucket", F.floor(F.col("at").cast("double") / bucket))
    inside = Window.partitionBy(task, "bucket").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    local = summed.withColumn("running", F.sum("d_sum").over(inside)).groupBy(task, "bucket").agg(F.max("running").alias("most"), F.sum("d_sum").alias("total"))
    before = F.sum("total").over(Window.partitionBy(task).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    return local.withColumn("reached", F.col("most") + before).groupBy(task).agg(F.max("reached").alias("max_concurrency"))


def model_cost(calls: DataFrame) -> DataFrame:
    """calls with cost_usd in exact decimals; null for a model without a price."""
    cost = F.lit(None).cast("decimal(38,12)")
    for model, (i, c, o) in PRICES.items():
        d = lambda col, price: F.col(col).cast("decimal(18,0)") * F.lit(price).cast("decimal(9,6)")
        own = ((F.col("input_tokens") - F.col("cached_tokens")).cast("decimal(18,0)") * F.lit(i).cast("decimal(9,6)") + d("cached_tokens", c) + d("output_tokens", o)) / F.lit("1000000").cast("decimal(9,0)")
        cost = F.when(F.col("model") == model, own).otherwise(cost)
    return calls.withColumn("cost_usd", cost.cast("double"))


def prompt_estimate(texts: DataFrame, by: list[str], chars: Column) -> DataFrame:
    """Tokens of a group's texts, at 3.5 characters each, rounded up."""
    return texts.groupBy(*by).agg(F.count("*").alias("n"), F.ceil(F.sum(chars) / 3.5).cast("long").alias("tokens"))


def progress(steps: DataFrame, run: str, order: list[str], elapsed: Column) -> DataFrame:
    """completed, total, percent, elapsed and eta after each step of a run."""
    whole = Window.partitionBy(run)
    done = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    x = steps.withColumns({"completed": done, "total": F.count("*").over(whole), "elapsed_seconds": elapsed})
    eta = F.when(F.col("completed") < F.col("total"), F.col("elapsed_seconds") / F.col("completed") * (F.col("total") - F.col("completed")))
    return x.withColumns({"progress_percent": F.round(F.col("completed") / F.col("total") * 100, 2), "eta_seconds": F.round(eta, 1)})


def history_check(messages: DataFrame, conversation: str, text: str, most: int = 20, most_chars: int = 4000, most_total: int = 20000) -> DataFrame:
    """Conversations with their counts and whether they keep the limits."""
    x = messages.groupBy(conversation).agg(F.count("*").alias("n"), F.max(F.length(text)).alias("longest"), F.sum(F.length(text)).alias("total"))
    return x.withColumn("valid", (F.col("n") <= most) & (F.col("longest") <= most_chars) & (F.col("total") <= most_total))


def clarification(candidates: DataFrame, scope: str, least: float = 0.6, gap: float = 0.12, most: int = 4) -> DataFrame:
    """scope, options: where the two best candidates (label, confidence) are both likely and near each other."""
    order = Window.partitionBy(scope).orderBy(F.desc("confidence"), "label")
    x = candidates.where(F.col("confidence") >= least).withColumns({"place": F.row_number().over(order), "next": F.lead("confidence").over(order)})
    close = x.where((F.col("place") == 1) & F.col("next").isNotNull() & (F.col("confidence") - F.col("next") <= gap)).select(scope)
    top = x.where(F.col("place") <= most).join(close, scope)
    # Equal labels count once, by their first place.
    firsts = top.groupBy(scope, "label").agg(F.min("place").alias("place"))
    out = firsts.groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda v: v["label"]).alias("options"))
    return out.where(F.size("options") >= 2)


def report_violations(reports: DataFrame) -> DataFrame:
    """reports with the rules they break: negative counts, more tagged than there are, indexed despite failures."""
    rules = {
        "negative count": (F.col("paragraphs") < 0) | (F.col("tagged") < 0) | (F.col("failed") < 0),
        "more tagged than paragraphs": F.col("tagged") > F.col("paragraphs"),
        "indexed despite failures": F.col("indexed") & ((F.col("failed") > 0) | (F.size("errors") > 0)),
    }
    return reports.withColumn("violations", F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull()))


def index_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counters of an index run: chunks, embedded, reused (cache hits and repeats in the batch), removed."""
    return rows.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_if(~F.col("reused")).alias("embedded"), F.count_if("reused").alias("reused"))
