"""Accounting for model usage: sums, costs, routes, health, budgets, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import written

KEYS = ("provider", "model", "caller_service", "purpose")


def _key(key: str) -> str:
    return key if key in KEYS else "provider"


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("requests"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")), F.sum("cost").alias("cost")]


def usage_by(ledger: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Usage by provider (or model, caller_service, purpose) in start <= created_at < end, errors left out."""
    rows = ledger.filter((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(end).cast("timestamp")) & (F.col("status") != "error"))
    return rows.groupBy(F.col(_key(key)).alias("key")).agg(*_sums(), F.round(F.avg("latency_ms"), 1).alias("avg_latency")).orderBy(F.desc("total_tokens"), "key")


def usage_report(ledger: DataFrame, key: str, since: str) -> DataFrame:
    """Usage with errors included, by key and in all (is_total), in one pass."""
    rows = ledger.filter(F.col("created_at") >= F.lit(since).cast("timestamp")).withColumn("key", F.col(_key(key)))
    return rows.rollup("key").agg(F.grouping("key").cast("int").alias("is_total"), *_sums(), F.round(F.avg("latency_ms"), 2).alias("avg_latency"))


def service_usage(ledger: DataFrame, service: str) -> DataFrame:
    """One row of totals for a caller; zeros without rows."""
    sums = ledger.filter(F.col("caller_service") == service).agg(*_sums())
    return sums.select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums.columns))


def daily_cost(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.to_date("created_at").alias("day")).agg(F.sum("cost").alias("cost"))


def hourly_usage(ledger: DataFrame) -> DataFrame:
    """The summary by hour, service, provider and model that serves the reports."""
    return ledger.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "caller_service", "provider", "model").agg(
        *_sums(), F.sum("latency_ms").alias("latency_sum"), F.count_if(F.col("status") != "success").alias("errors"), F.count("fallback_from").alias("fallbacks"))


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a * and ? glob."""
    plain = F.regexp_replace(glob, r"([.+^$(){}\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def estimate_cost(ledger: DataFrame, pricing: DataFrame) -> DataFrame:
    """Price each row by the first pricing row (priority, provider, glob, input_price, output_price per 1000) of its provider whose glob
    its model matches; 0 without one. Prices go to the distinct (provider, model) pairs first, and only those join the
    ledger."""
    pairs = ledger.select("provider", "model").distinct()
    fits = pairs.join(pricing, "provider").filter(F.expr("model RLIKE pattern") if "pattern" in pricing.columns else F.rlike("model", glob_pattern(F.col("glob"))))
    best = fits.groupBy("provider", "model").agg(F.min_by(F.struct("input_price", "output_price"), "priority").alias("p"))
    cost = F.col("input_tokens") / 1000 * F.col("p.input_price") + F.col("output_tokens") / 1000 * F.col("p.output_price")
    return ledger.join(best, ["provider", "model"], "left").withColumn("estimated", F.coalesce(cost, F.lit(0.0))).drop("p")


def resolve_routes(requests: DataFrame, purposes: DataFrame, routes: DataFrame, fallback: list[str]) -> DataFrame:
    """The model and provider of each request (id, purpose, model, provider): a purpose gives the model where none is named, a named provider
    wins, else the first route (priority, glob, provider) that the model matches, else the fallback chain's head; unresolved
    without a model."""
    named = requests.join(purposes.select("purpose", F.col("model").alias("default_model")), "purpose", "left").withColumn("model", F.coalesce("model", "default_model"))
    models = named.select("model").distinct().filter("model IS NOT NULL")
    named_by = routes.select("priority", "glob", F.col("provider").alias("routed"))
    plain = ~F.col("glob").rlike(r"[*?]")
    exact = models.join(named_by.filter(plain), F.col("model") == F.col("glob")).select("model", "priority", "routed")
    # models and globs are distinct spellings, not requests: what meets pair by pair is their product
    fits = exact.unionByName(models.join(named_by.filter(~plain), F.rlike("model", glob_pattern(F.col("glob")))).select("model", "priority", "routed"))
    best = fits.groupBy("model").agg(F.min_by("routed", F.struct("priority", "routed")).alias("routed"))
    out = named.join(best, "model", "left")
    provider = F.coalesce("provider", "routed", F.when(F.col("model").isNotNull(), F.lit(fallback[0] if fallback else None)))
    how = F.when(F.col("model").isNull(), "unresolved").when(F.col("provider").isNotNull(), "explicit").when(F.col("routed").isNotNull(), "route").otherwise("fallback")
    return out.select("id", "model", provider.alias("provider"), how.alias("how"))


def provider_health(hourly: DataFrame, budget: int, error_share: tuple[float, float] = (0.05, 0.20), fallbacks: tuple[int, int] = (10, 50)) -> DataFrame:
    """ok, warning or critical for each provider and day: error share, worst hour's fallbacks, tokens against a daily budget."""
    hours = hourly.groupBy("provider", "hour").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("fallbacks").alias("fallbacks"), F.sum("total_tokens").alias("tokens"))
    days = hours.groupBy("provider", F.to_date("hour").alias("day")).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.max("fallbacks").alias("worst_fallbacks"), F.sum("tokens").alias("tokens"))
    share = F.col("errors") / F.col("requests")
    level = F.when((share > error_share[1]) | (F.col("worst_fallbacks") > fallbacks[1]) | (F.col("tokens") > budget), "critical")
    level = level.when((share > error_share[0]) | (F.col("worst_fallbacks") > fallbacks[0]) | (F.col("tokens") > 0.8 * budget), "warning").otherwise("ok")
    return days.withColumn("error_share", F.round(share, 4)).withColumn("level", level)


def token_budget(rows: DataFrame, key: str, limit: int, at: str = "created_at", tokens: str = "tokens_used") -> DataFrame:
    """Tokens of the trailing hour and day at each moment of a key, and whether the day stays under limit.

    Tokens come at their second and leave an hour and a day later, so both sums are running sums of what came and left; they are exact, as tokens are whole
    numbers. A key's seconds are summed inside an hour, and hours are one row each: no task sorts a key's history, and none adds up a window again for
    each of its rows. Rows without a time stand together, by themselves.
    """
    seconds = written(rows.groupBy(F.struct(F.col(key).alias("key")).alias("k"), F.unix_timestamp(at).alias("second")).agg(F.sum(tokens).alias("tokens")), "seconds")
    n = F.when(F.col("tokens").isNotNull(), 1).otherwise(0).cast("long")
    moves = [(0, 1, 1, True), (3600, -1, 0, False), (86400, 0, -1, False)]  # seconds later, what the hour and the day get, whether it is a row of the result
    move = lambda later, h, d, own: F.struct((F.col("second") + later).alias("second"), *(x for name, sign in (("h", h), ("d", d)) for x in ((F.coalesce("tokens", F.lit(0)) * sign).alias(name), (n * sign).alias(f"n{name}"))), F.lit(own).alias("own"), F.when(F.lit(own), F.col("tokens")).alias("tokens"))
    moved = seconds.filter("second IS NOT NULL").select("k", F.explode(F.array(*(move(*m) for m in moves))).alias("m")).select("k", "m.*")
    sums = ["h", "nh", "d", "nd"]
    each = moved.groupBy("k", F.floor(F.col("second") / 3600).alias("hour"), "second").agg(*(F.sum(c).alias(c) for c in sums), F.max("own").alias("own"), F.max("tokens").alias("tokens"))
    before = Window.partitionBy("k").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = each.groupBy("k", "hour").agg(*(F.sum(c).alias(c) for c in sums)).select("k", "hour", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in sums))
    inside = Window.partitionBy("k", "hour").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    run = each.select("k", "hour", "second", "tokens", "own", *(F.sum(c).over(inside).alias(c) for c in sums)).filter("own").join(hours, ["k", "hour"])
    total = lambda c: F.when(F.col(f"n{c}") + F.col(f"n{c}0") > 0, F.col(c) + F.col(f"{c}0"))
    out = run.select("k", "second", "tokens", total("h").alias("last_hour"), total("d").alias("last_day"))
    timeless = seconds.filter("second IS NULL").select("k", "second", "tokens", F.col("tokens").alias("last_hour"), F.col("tokens").alias("last_day"))
    both = out.unionByName(timeless).select(F.col("k.key").alias(key), "second", "tokens", "last_hour", "last_day")
    return both.withColumn("under_limit", F.col("last_day") < limit)


def run_until_budget(rows: DataFrame, key: str, order: list[str], limit: int, tokens: str = "tokens_used") -> DataFrame:
    """The rows of each key's list that are run: those before which the running total has not reached limit. Null tokens count as
    none; rows that are equal in key and order are one after the other in any turn.

    Rows are dealt by ranges of (key, order); each range is summed by itself, and the sums of ranges (one row a key and
    range) are summed before them, so a long list is spread over tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "budget")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "_part").agg(F.sum(tokens).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    sums = sums.filter(F.col("_before") < limit).select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_before")
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    there = dealt.withColumn("_own", F.coalesce(F.sum(tokens).over(inside), F.lit(0))).join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    out = there.withColumn("spent_before", F.col("_before") + F.col("_own")).filter(F.col("spent_before") < limit)
    return out.select(*rows.columns, "spent_before")


def rate_limit_aligned(requests: DataFrame, key: str, limit: int, window: str, at: str = "created_at", id: str = "id") -> DataFrame:
    """Clock-aligned windows: the nth request of a window is allowed while n <= limit."""
    rows = requests.withColumn("w", F.window(at, window)["start"])
    n = F.row_number().over(Window.partitionBy(key, "w").orderBy(at, id))
    return rows.select(id, key, F.col("w").alias("window_start"), n.alias("nth"), (n <= limit).alias("allowed"), F.greatest(F.lit(0), limit - n).alias("remaining"))


def _openings(times: DataFrame, width: int) -> DataFrame:
    """The times (k, hour, t: distinct, hour = t div width) that open a window of `width`: a key's first, then always the first
    that is a window later or more.

    Each time's successor is in the next hour or is the first of a later one. Times after a pause of a window open one
    in any case; from these, marks spread along 1, 4, 16, ... successors, so the rounds are the logarithm (to 4) of the
    windows between two pauses. Raw rows are only sorted inside a key's hour; a key's hours are one row each.
    """
    hours = times.groupBy("k", "hour").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    w = Window.partitionBy("k").orderBy("hour")
    hours = hours.select("k", "hour", F.lag("high").over(w).alias("before"), F.lead("hour").over(w).alias("after"), F.lead("low").over(w).alias("then"), F.lead("low", 2).over(w).alias("later"))
    near = times.join(hours, ["k", "hour"])
    gap = F.col("t") - F.coalesce(F.lag("t").over(Window.partitionBy("k", "hour").orderBy("t")), "before")
    near = near.withColumn("opens", gap.isNull() | (gap >= width))

    # a question stands among the times of the next hour, at t + width; the least time from there on answers it
    asked = near.select("k", (F.col("hour") + 1).alias("hour"), (F.col("t") + width).alias("t"), F.when(F.col("after") == F.col("hour") + 1, F.col("later")).otherwise(F.col("then")).alias("else"), F.col("t").alias("of"))
    put = times.select("k", "hour", "t", F.lit(None).cast("long").alias("else"), F.lit(None).cast("long").alias("of"))
    ahead = Window.partitionBy("k", "hour").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("of").isNull(), F.col("t")), ignorenulls=True).over(ahead)
    answered = put.unionByName(asked).withColumn("next", F.coalesce(answer, F.col("else"))).filter("of IS NOT NULL AND next IS NOT NULL").select("k", F.col("of").alias("t"), "next")

    first = written(near.filter("opens").select("k", "t"), "openings")
    jumps = written(answered.join(first.withColumnRenamed("t", "next"), ["k", "next"], "left_anti").select("k", "t", "next"), "jumps")
    step = lambda marks, jumps: marks.join(jumps, ["k", "t"]).select("k", F.col("next").alias("t"))
    twice = lambda jumps: jumps.join(jumps.select("k", F.col("t").alias("next"), F.col("next").alias("far")), ["k", "next"]).select("k", "t", F.col("far").alias("next"))
    marked = first
    while not jumps.isEmpty():  # jumps over 1, 4, 16, ... windows, each taken up to three times
        one = step(marked, jumps)
        two = step(one, jumps)
        marked = written(marked.unionByName(one).unionByName(two).unionByName(step(two, jumps)).distinct(), "openings")
        jumps = written(twice(twice(jumps)), "jumps")
    return marked


def rate_limit(requests: DataFrame, key: str, limit: int, seconds: int, at: str = "created_at", id: str = "id") -> DataFrame:
    """Windows that a key's first request opens: id, nth, allowed, remaining, reset_in (seconds).

    The windows follow one another only through the opening request; _openings finds these by joins. A span of a window's
    length holds one opening at most, so a request's own is that of its hour or of the hour before. Requests are numbered
    inside their window: what is sorted at once is a key's window, not its history. Times are exact microseconds.
    """
    width = seconds * 1_000_000
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.select(F.col(id).alias("id"), F.col(key).alias("key"), F.struct(F.col(key).alias("key")).alias("k"), t.alias("t"))
    hour = F.floor(F.col("t") / width).cast("long")
    rows = written(rows.withColumn("hour", hour), "requests")
    opened = _openings(rows.filter("t IS NOT NULL").select("k", "hour", "t").distinct(), width).withColumn("hour", hour)
    for name, back in (("here", 0), ("back", 1)):
        rows = rows.join(opened.select("k", (F.col("hour") + back).alias("hour"), F.col("t").alias(name)), ["k", "hour"], "left")
    start = F.when(F.col("here") <= F.col("t"), F.col("here")).otherwise(F.col("back"))
    nth = F.row_number().over(Window.partitionBy("k", "start").orderBy("t", "id")).cast("long")
    out = rows.withColumn("start", start).withColumn("nth", nth)
    reset = F.ceil((F.col("start") + width - F.col("t")) / 1_000_000).cast("long")
    return out.select("id", "key", "nth", (F.col("nth") <= limit).alias("allowed"), F.greatest(F.lit(0).cast("long"), limit - F.col("nth")).alias("remaining"), reset.alias("reset_in"))
