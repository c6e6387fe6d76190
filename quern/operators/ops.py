"""Access logs, metric samples, alerts, load tests and the run registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.stats import nearest_rank
from quern.operators.rangevec import STEP, instant

#: Histogram bounds, gates of a canary, limits of alerts.
LATENCY_BOUNDS = [0.1, 0.5, 1, 2.5, 5, 10, 20, 30, 45, 60, 90, 120, 180, 300]
SCORE_BOUNDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
MIN_REQUESTS, MAX_ERROR_DELTA, MAX_P95_RATIO = 20, 0.01, 1.2
LOW_FAITHFULNESS, HIGH_ERROR_RATIO, SLOW_P95_S = 0.80, 0.05, 120.0


def attribute(log: DataFrame, order: str = "line_no") -> DataFrame:
    """Fill a record's release: its own, else that last seen for its upstream, else unknown."""
    given = F.nullif(F.coalesce("release", F.lit("")), F.lit(""))
    learned = log.filter(given.isNotNull() & (F.coalesce("upstream", F.lit("")) != "")).groupBy("upstream").agg(F.max_by(given, order).alias("__learned"))
    return log.join(learned, "upstream", "left").withColumn("release", F.coalesce(given, "__learned", F.lit("unknown"))).drop("__learned")


def release_stats(log: DataFrame, uri: str = "/ask") -> DataFrame:
    """Per release: requests, errors (5xx), ask_n, ask_p95 (nearest rank), share, error_rate."""
    fine = f"uri = '{uri}' AND status < 500"
    one = log.groupBy("release").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.count_if(F.expr(fine)).alias("ask_n"), nearest_rank("request_time", 95, fine).alias("ask_p95"))
    total = one.agg(F.sum("requests").alias("__t"))
    return one.join(total, F.lit(True)).withColumns({"share": F.col("requests") / F.col("__t"), "error_rate": F.col("errors") / F.col("requests")}).drop("__t")


def pick_release(stats: DataFrame, prefix: str) -> DataFrame:
    """The only release with the prefix; no row if there are none or several."""
    own = stats.filter(F.col("release").startswith(prefix))
    return own.join(own.agg(F.count("*").alias("__n")), F.lit(True)).filter("__n = 1").drop("__n")


def canary_gates(stable: DataFrame, canary: DataFrame, min_requests: int = MIN_REQUESTS, max_error_delta: float = MAX_ERROR_DELTA, max_p95_ratio: float = MAX_P95_RATIO) -> DataFrame:
    """gate, passed for one-row stats of both releases; no rows if either is missing."""
    named = lambda d, p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in ("error_rate", "ask_n", "ask_p95")))
    both = named(stable, "s").join(named(canary, "c"), F.lit(True))
    gates = {
        "enough canary traffic": F.col("c_ask_n") >= min_requests,
        "error rate": F.col("c_error_rate") <= F.col("s_error_rate") + max_error_delta,
        "p95 latency": F.coalesce(F.col("c_ask_p95") <= F.col("s_ask_p95") * max_p95_ratio, F.lit(False)),
    }
    return both.select(F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), ok.alias("passed")) for g, ok in gates.items()))))


def stage_means(samples: DataFrame) -> DataFrame:
    """stage, count, mean_s from samples (stage, kind sum or count, value) of all services."""
    one = samples.groupBy("stage").agg(F.sum(F.when(F.col("kind") == "sum", F.col("value"))).alias("s"), F.sum(F.when(F.col("kind") == "count", F.col("value"))).alias("c"))
    return one.select("stage", F.coalesce("c", F.lit(0.0)).cast("long").alias("count"), F.when(F.col("c") != 0, F.coalesce("s", F.lit(0.0)) / F.col("c")).alias("mean_s"))


def load_summary(rows: DataFrame, name: str = "/ask", keep: list[str] | None = None) -> DataFrame:
    """One run per row of the name (see readers.first_rows()): the columns `keep`, requests,
    failures, rates, percentiles in s."""
    num = lambda c: F.when(~F.col(c).isin("", "N/A"), F.col(c)).try_cast("double")
    own = rows.filter(F.col("Name") == name)
    n, bad = F.coalesce(num("Request Count"), F.lit(0.0)).cast("long"), F.coalesce(num("Failure Count"), F.lit(0.0)).cast("long")
    sec = lambda c: F.coalesce(num(f"`{c}`"), F.lit(0.0)) / 1000
    return own.select(*(keep or []), n.alias("requests"), bad.alias("failures"), F.when(n > 0, bad / n).alias("failure_rate"), num("Requests/s").alias("rps"), sec("50%").alias("p50_s"), sec("95%").alias("p95_s"), sec("99%").alias("p99_s"), sec("Max Response Time").alias("max_s"))


def counter_increase(samples: DataFrame, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Add delta: growth since the sample before; after a reset the new value itself."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts))
    return samples.withColumn("delta", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def windowed_rate(deltas: DataFrame, by: list[str], size: str, slide: str | None, seconds: float) -> DataFrame:
    """window_start, by, increase and rate per second over (sliding) windows of deltas."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return deltas.groupBy(w.alias("w"), *by).agg(F.sum("delta").alias("increase")).select(F.col("w.start").alias("window_start"), *by, "increase", (F.col("increase") / seconds).alias("rate"))


def error_ratio(requests: DataFrame, size: str = "5 minutes") -> DataFrame:
    """window_start, ratio, firing: failed over all requests of tumbling windows."""
    one = requests.groupBy(F.window("ts", size).alias("w")).agg(F.count_if("failed").alias("bad"), F.count("*").alias("n"))
    ratio = F.col("bad") / F.greatest(F.col("n").cast("double"), F.lit(1e-9))
    return one.select(F.col("w.start").alias("window_start"), ratio.alias("ratio"), (ratio > HIGH_ERROR_RATIO).alias("firing"))


def held_for(samples: DataFrame, condition: Column, hold_seconds: int, by: list[str], ts: str = "ts") -> DataFrame:
    """Add firing: the condition has held at every sample for at least hold_seconds."""
    w = Window.partitionBy(*by).orderBy(ts)
    run = F.sum((~F.col("__c")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = samples.withColumn("__c", F.coalesce(condition, F.lit(False))).withColumn("__run", run)
    since = F.min(F.when(F.col("__c"), F.col(ts))).over(Window.partitionBy(*by, "__run").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    long = F.unix_timestamp(ts) - F.unix_timestamp(since) >= hold_seconds
    return marked.withColumn("firing", F.col("__c") & F.coalesce(long, F.lit(False))).drop("__c", "__run")


def low_faithfulness(gauge: DataFrame, least: float = LOW_FAITHFULNESS) -> DataFrame:
    """Samples of the faithfulness gauge (value) with firing: below the least."""
    return gauge.withColumn("firing", F.coalesce(F.col("value") < least, F.lit(False)))


def slow_p95(quantiles: DataFrame, most_seconds: float = SLOW_P95_S) -> DataFrame:
    """95th percentiles in seconds (value) with firing: above the most."""
    return quantiles.withColumn("firing", F.coalesce(F.col("value") > most_seconds, F.lit(False)))


def down(up: DataFrame) -> DataFrame:
    """Samples of the up gauge (value) with firing: the target does not answer."""
    return up.withColumn("firing", F.col("value").eqNullSafe(F.lit(0.0)))


def down_for(up: DataFrame, by: list[str], hold_seconds: int = 60) -> DataFrame:
    """by, at and firing of the up gauge at every step that sees it: the target has not
    answered at any step for hold_seconds.  A gauge that has gone stale does not fire."""
    steps = instant(up, by)
    gap = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(Window.partitionBy(*by).orderBy("at"))) > STEP
    seen = F.sum(F.when(gap, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return held_for(steps.withColumn("__seen", seen), F.col("value").eqNullSafe(F.lit(0.0)), hold_seconds, [*by, "__seen"], "at").drop("__seen")


def drift_alert(windows: DataFrame) -> DataFrame:
    """Windows whose share of low-similarity queries reaches their limit's share."""
    return windows.filter(F.col("off_corpus_share").isNotNull() & (F.col("off_corpus_share") >= F.col("low_similarity_limit") / F.col("n_queries")))


def drift_gauges(report: DataFrame) -> DataFrame:
    """gauge, window, value of a drift report; absent figures give no row."""
    pairs = F.array(F.struct(F.lit("off_corpus_share").alias("gauge"), F.col("off_corpus_share").cast("double").alias("value")), F.struct(F.lit("off_corpus_limit").alias("gauge"), (F.col("low_similarity_limit") / F.col("n_queries")).alias("value")))
    return report.select("window", F.inline(pairs)).filter("value IS NOT NULL")


def cost_per_hour(tokens_per_second: Column, price_per_1000: float) -> Column:
    return tokens_per_second * 3600 / 1000 * price_per_1000


def throughput(calls: DataFrame, by: list[str], start: str = "start", end: str = "end", units: str | None = None) -> DataFrame:
    """Calls (or units) over the wall time from the first start to the last end, in seconds."""
    amount = F.count("*") if units is None else F.sum(units)
    wall = F.max(F.col(end).cast("timestamp").cast("double")) - F.min(F.col(start).cast("timestamp").cast("double"))
    return calls.groupBy(*by).agg(amount.alias("amount"), wall.alias("wall_s")).withColumn("per_s", F.when(F.col("wall_s") > 0, F.col("amount") / F.col("wall_s")))


def grouped_alerts(alerts: DataFrame, interval: int = 60, repeat: int = 14_400, repeat_critical: int = 3_600) -> DataFrame:
    """Notifications per alert name: the first of a group, changes after `interval` seconds,
    and repeats; alerts: ts, alertname, severity, status.  Batch form of the grouping rule."""
    w = Window.partitionBy("alertname").orderBy("ts")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    changed = ~F.lag("status").over(w).eqNullSafe(F.col("status"))
    again = F.when(F.col("severity") == "critical", repeat_critical).otherwise(repeat)
    return alerts.withColumn("notify", gap.isNull() | (changed & (gap >= interval)) | (gap >= again))


def promote(registry: DataFrame, model: str, config: str, scores: dict[str, float | None]) -> DataFrame:
    """The registry with one more version of the model, which takes the alias production.

    Tags are scores to four places, without counts and missing ones.
    """
    tags = {k: f"{v:.4f}" for k, v in scores.items() if v is not None and not k.endswith("_n_scored")}
    made = F.create_map(*(F.lit(x) for kv in tags.items() for x in kv)) if tags else F.create_map().cast("map<string,string>")
    version = registry.filter(F.col("model") == model).agg(F.coalesce(F.max("version") + 1, F.lit(1)).cast("int").alias("version"))
    new = version.select(F.lit(model).alias("model"), "version", F.lit("production").alias("alias"), F.lit(config).alias("config"), made.alias("tags"))
    old = registry.withColumn("alias", F.when(F.col("model") == model, F.lit(None)).otherwise(F.col("alias")))
    return old.unionByName(new)
