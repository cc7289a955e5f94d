"""Dashboard metrics over the audit log. Inputs are derived audit rows (sources.audit.derive).

"Check rows" are rows that aren't system events. All per-request metrics come from one grouping by request_id, so a log of any
size is shuffled once by a key that spreads evenly; what follows is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import ACTIONS, DECIDED_BY, JUDGE, OUTCOMES


def check_rows(audit: DataFrame) -> DataFrame:
    return audit.filter(~F.col("is_system_event"))


def since(audit: DataFrame, start: str | None) -> DataFrame:
    return audit.filter(F.col("ts_utc") >= F.try_to_timestamp(F.lit(start))) if start else audit


def requests(audit: DataFrame) -> DataFrame:
    """One row per request of the check rows: outcome, first ts, overhead with and without the judge's rows."""
    rows = check_rows(audit).filter("request_id IS NOT NULL")
    grouped = rows.groupBy("request_id").agg(
        F.max(C.strength()).alias("strength"),
        F.min("ts_utc").alias("first_ts"),
        F.sum("latency_ms").alias("overhead_ms"),
        F.sum(F.when(F.col("check") != JUDGE, F.col("latency_ms")).otherwise(0.0)).alias("rules_overhead_ms"),
    )
    return grouped.withColumn("outcome", F.element_at(F.array(*[F.lit(OUTCOMES[a]) for a in ACTIONS]), F.col("strength") + 1))


def totals(per_request: DataFrame) -> DataFrame:
    names = ("allowed", "redacted", "blocked", "flagged")
    return per_request.agg(F.count("*").alias("requests"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def timeline(per_request: DataFrame) -> DataFrame:
    """Requests by the minute of their first check row; only minutes that occur."""
    names = ("blocked", "redacted", "flagged")
    return per_request.groupBy(C.minute_text(F.col("first_ts")).alias("minute")).agg(F.count("*").alias("requests"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


#: Bins of a histogram for each power of e, and ranks whose bins are sent to every task.
PER_POWER, BROADCAST_RANKS = 1024, 200_000


def _bin(value: Column, per_power: int) -> Column:
    """A whole number that grows with a double: its sign and its logarithm; infinite values and NaN are in the last bin."""
    power = F.greatest(F.least(F.log(F.abs(value)), F.lit(799.0)), F.lit(-799.0))
    place = F.floor(power * per_power).cast("long") + 800 * per_power
    return F.when(value > 0, place).when(value < 0, -place).otherwise(0)


def percentiles(rows: DataFrame, values: dict[str, str], keys: tuple[str, ...] = (), per_power: int = PER_POWER) -> DataFrame:
    """Nearest-rank p50 and p95 of several columns (name: column), per key or as one row; 0 without values.

    Exact, in two passes over the rows: the first counts them in a histogram, whose partial counts are small whatever the rows are, and tells which
    bins hold a rank; the second puts the distinct values of those bins in order, about a thousandth of all.
    """
    by = [*keys, "measure"]
    sides = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(column).cast("double").alias("value")) for name, column in values.items()])
    long = rows.select(*keys, F.inline(sides)).filter("value IS NOT NULL").withColumn("bin", _bin(F.col("value"), per_power))
    w = Window.partitionBy(*by)
    sizes = long.groupBy(*by, "bin").agg(F.count("*").alias("size")).withColumn("upto", F.sum("size").over(w.orderBy("bin"))).withColumn("total", F.sum("size").over(w))
    ranks = sizes.withColumn("p", F.explode(F.array(F.lit(50), F.lit(95)))).withColumn("rank", F.greatest(F.ceil(F.col("p") * F.col("total") / 100), F.lit(1)))
    homes = ranks.filter("rank <= upto AND rank > upto - size").select(*by, "bin", "p", (F.col("rank") - F.col("upto") + F.col("size")).alias("rank"))
    homes = homes.groupBy(*by, "bin").agg(F.collect_list(F.struct("p", "rank")).alias("ranks"))
    few = homes.take(BROADCAST_RANKS + 1)
    near = long.join(F.broadcast(rows.sparkSession.createDataFrame(few, homes.schema)) if len(few) <= BROADCAST_RANKS else homes, [*by, "bin"])
    counted = near.groupBy(*by, "bin", "value").agg(F.count("*").alias("n"), F.first("ranks").alias("ranks"))
    placed = counted.withColumn("last", F.sum("n").over(Window.partitionBy(*by, "bin").orderBy("value")))
    found = placed.select(*by, "value", "last", "n", F.inline("ranks")).filter("rank <= last AND rank > last - n")
    pick = lambda name, p: F.coalesce(F.max(F.when((F.col("measure") == name) & (F.col("p") == p), F.col("value"))), F.lit(0.0)).alias(f"{name}_p{p}")
    return found.groupBy(*keys).agg(*[pick(name, p) for name in values for p in (50, 95)])


def overhead(per_request: DataFrame) -> DataFrame:
    return percentiles(per_request, {"overhead_ms": "overhead_ms", "rules_overhead_ms": "rules_overhead_ms"})


def blocks_by(audit: DataFrame, key: str) -> DataFrame:
    """Blocking check rows per check, checkpoint or caller; a null key is left out."""
    return check_rows(audit).filter(F.col("is_block") & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("blocks"))


def blocks_by_all(audit: DataFrame) -> DataFrame:
    """The three block counts in one pass: dimension, key, blocks."""
    rows = check_rows(audit).filter("is_block")
    sides = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("key")) for k in ("check", "checkpoint", "caller_id")])
    return rows.select(F.inline(sides)).filter("key IS NOT NULL").groupBy("dimension", "key").agg(F.count("*").alias("blocks"))


def actions_by_check(audit: DataFrame) -> DataFrame:
    return check_rows(audit).groupBy("check").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])


def decided_by(audit: DataFrame) -> DataFrame:
    """Counts of check rows per kind of decision; kinds that don't occur count 0."""
    counts = check_rows(audit).agg(*[F.count_if(F.col("decided_by") == d).alias(d) for d in DECIDED_BY])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(d).alias("decided_by"), F.col(d).alias("rows")) for d in DECIDED_BY])))


def latency_by_check(audit: DataFrame) -> DataFrame:
    return percentiles(check_rows(audit), {"latency_ms": "latency_ms"}, ("check",))


def latency_by_check_ranked(audit: DataFrame, per_power: int = 4) -> DataFrame:
    """latency_by_check with other bins."""
    return percentiles(check_rows(audit), {"latency_ms": "latency_ms"}, ("check",), per_power)


def judge_latency(audit: DataFrame) -> DataFrame:
    return percentiles(check_rows(audit).filter(F.col("check") == JUDGE), {"jev_latency_ms": "latency_ms"})


def system_events(audit: DataFrame) -> DataFrame:
    return audit.filter("is_system_event").groupBy("check").agg(F.count("*").alias("rows"))


def top_block_reasons(audit: DataFrame, n: int = 10) -> DataFrame:
    rows = check_rows(audit).filter("is_block").groupBy("check", "reason").agg(F.count("*").alias("count"))
    return rows.orderBy(F.desc("count"), "check", "reason").limit(n)


def usage_rows(audit: DataFrame) -> DataFrame:
    """One row per request with its largest (tokens, cost), the earliest id on ties; rows without a request all stay."""
    columns = ("request_id", "caller_id", "date", "tokens", "cost", "id")
    kept = audit.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.max_by(F.struct(*columns[1:]), F.struct("tokens", "cost", -F.col("id"))).alias("u"))
    return kept.select("request_id", "u.*").unionByName(audit.filter("request_id IS NULL").select(*columns))


def usage_today(usage: DataFrame, today: str) -> DataFrame:
    rows = usage.filter((F.col("date") == F.to_date(F.lit(today))) & F.col("caller_id").isNotNull())
    return rows.groupBy("caller_id").agg(F.sum("tokens").alias("tokens_today"), F.sum("cost").alias("cost_today"))


def usage_total(usage: DataFrame) -> DataFrame:
    return usage.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_total"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_total"))


def policy_versions(audit: DataFrame) -> DataFrame:
    return audit.groupBy("policy_version").agg(F.count("*").alias("rows"))


def enabled_checks(checks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Matrix of check x checkpoint: off, block or redact.

    checks(check, on, at array) and checkpoints(checkpoint) are policy tables of a handful of rows, fixed by the service's design.
    """
    rows = checks.crossJoin(F.broadcast(checkpoints))
    runs = F.col("on") & F.array_contains("at", F.col("checkpoint"))
    return rows.select("check", "checkpoint", F.when(~runs, "off").when(F.col("check") == "pii_secrets", "redact").otherwise("block").alias("mode"))
