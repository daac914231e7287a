"""Reports over a request log: batch forms, each exact, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stateful import ordered_scan
from . import machines as M

THROTTLE_LIMIT, THROTTLE_WINDOW_MS = 20, 60_000
# model name part, input and output price per 1000 tokens; the first part that fits wins
PRICES = [("gpt-3.5", "0.0015", "0.002"), ("gpt-35", "0.0015", "0.002"), ("", "0.03", "0.06")]


def throttle_status(calls: DataFrame, limit: int = THROTTLE_LIMIT, window_ms: int = THROTTLE_WINDOW_MS) -> DataFrame:
    """Calls of the agent in the trailing minute, and the wait until the oldest leaves.

    Calls of one agent and millisecond are counted first; the times are bucketed by window length and copied
    into the next bucket, so the window's group is one (agent, minute) of two times ``window_ms`` rows at most.
    All frames only grow: the calls of the trailing minute are those up to now less those before it, and the oldest
    is the time that follows the last one before it. Each row enters a frame once, however dense the calls are.
    """
    b = F.floor(F.col("ts_ms") / window_ms)
    times = calls.where("ts_ms IS NOT NULL").groupBy("agent", "ts_ms").agg(F.count("*").alias("n"))
    times = times.select("agent", "ts_ms", "n", F.explode(F.array(b, b + 1)).alias("bucket"))
    w = W.partitionBy("agent", "bucket").orderBy("ts_ms")
    now, gone = (w.rangeBetween(W.unboundedPreceding, end) for end in (0, -window_ms - 1))
    times = times.select("*", F.lead("ts_ms").over(w).alias("following"))
    times = times.select(
        F.col("agent").alias("of"), F.col("ts_ms").alias("at"), "bucket",
        (F.sum("n").over(now) - F.coalesce(F.sum("n").over(gone), F.lit(0))).alias("calls"),
        F.coalesce(F.max("following").over(gone), F.min("ts_ms").over(now)).alias("oldest"))
    times = times.where(F.col("bucket") == F.floor(F.col("at") / window_ms)).drop("bucket")
    d = calls.join(times, F.col("agent").eqNullSafe(F.col("of")) & (F.col("ts_ms") == F.col("at")))
    throttled = F.col("calls") >= limit
    wait = F.greatest(F.lit(0), window_ms - (F.col("ts_ms") - F.col("oldest")))
    return d.select("request_id", "agent", "calls", throttled.alias("is_throttled"), F.when(throttled, wait).otherwise(0).alias("wait_ms"))


def rate_limit(requests: DataFrame, chunks: int | None = None) -> DataFrame:
    base = requests.select("request_id", "client", "ts_ms")
    return ordered_scan(base, "client", "ts_ms", "request_id", [], M.rate_step, M.rate_live,
                        {"allowed": "boolean", "remaining": "int", "reset_seconds": "int"}, chunks)


def fingerprint(requests: DataFrame) -> DataFrame:
    """SHA-256 over sorted files, objective and sorted agents of a request."""
    files = F.array_join(F.transform(F.array_sort("files"), lambda f: F.concat(f["name"], F.lit(":"), f["size"].cast("string"), F.lit(":"), f["modified"], F.lit("|"))), "")
    data = F.concat(files, F.lit("Objective:"), F.col("objective"), F.lit("|Agents:"), F.array_join(F.array_sort("agents"), ","), F.lit("|"))
    return requests.withColumn("fingerprint", F.base64(F.unhex(F.sha2(data, 256))))


def dedup_requests(requests: DataFrame, chunks: int | None = None) -> DataFrame:
    base = requests.select("request_id", "fingerprint_key", "ts_ms")
    return ordered_scan(base, "fingerprint_key", "ts_ms", "request_id", [], M.dedup_step, M.dedup_live, {"is_duplicate": "boolean"}, chunks)


def _nano(model: Column) -> Column:
    """Price in billionths of a dollar: whole numbers stay exact in a sum."""
    out = None
    for part, inp, outp in PRICES:
        cost = F.col("input_tokens") * int(round(float(inp) * 1e6)) + F.col("output_tokens") * int(round(float(outp) * 1e6))
        cond = F.lower(model).contains(part)
        out = F.when(cond, cost) if out is None else out.when(cond, cost)
    return out


def answer_uses(log: DataFrame, *extra: str) -> DataFrame:
    """A request log as uses of stored answers: key, tokens and price in billionths of a dollar."""
    return log.select("request_id", "agent", "ts_ms", *extra, F.concat_ws("/", "agent", "fingerprint_key", "model").alias("answer_key"),
                      (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), _nano(F.col("model")).alias("nano"))


def reuse_outcomes(log: DataFrame, chunks: int | None = None) -> DataFrame:
    return ordered_scan(answer_uses(log), "answer_key", "ts_ms", "request_id", ["tokens", "nano"], M.reuse_step, M.reuse_live,
                        {"hit": "boolean", "saved_tokens": "bigint", "saved_nano": "bigint"}, chunks)


def response_reuse(log: DataFrame, chunks: int | None = None) -> DataFrame:
    return reuse_outcomes(log, chunks).groupBy("agent").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("saved_tokens").alias("tokens_saved"),
        (F.sum("saved_nano") / 1e9).alias("cost_saved"))


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """Hits, misses and hit rate per agent and overall."""
    d = outcomes.rollup("agent").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return d.select(F.coalesce("agent", F.lit("all")).alias("agent"), "hits", "misses",
                    F.when(total > 0, F.bround(F.col("hits") / total * 100.0, 2)).otherwise(0.0).alias("hit_rate"))


def reuse_by_session(log: DataFrame, idle_ms: int = 30 * 60_000) -> DataFrame:
    """Idle rule alone: a session per burst of uses, all but the first are hits.

    Uses within one idle-length bucket are always one session, so they are counted first;
    what is ordered per key is one row per bucket and not one per use.
    """
    b = F.floor(F.col("ts_ms") / idle_ms)
    pre = log.groupBy("fingerprint_key", b.alias("bucket")).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.count("*").alias("n"))
    w = W.partitionBy("fingerprint_key").orderBy("bucket")
    starts = F.coalesce((F.col("first") - F.lag("last").over(w) >= idle_ms).cast("int"), F.lit(1))
    d = pre.withColumn("starts", starts).withColumn("session", F.sum("starts").over(w))
    return d.groupBy("fingerprint_key", "session").agg(F.min("first").alias("start_ms"), F.sum("n").alias("uses")).select(
        "fingerprint_key", "start_ms", "uses", (F.col("uses") - 1).alias("hits"))


def usage_cost(usage: DataFrame) -> DataFrame:
    """Tokens and cost per analysis and operation; runs on a table or, in update mode, on a stream."""
    return usage.groupBy("client", "operation").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        (F.sum(_nano(F.col("model"))) / 1e9).alias("cost"))


def message_feed(messages: DataFrame) -> DataFrame:
    """Live participation and conflict counts; the same plan serves tables and streams."""
    return messages.groupBy("conv_id", "from_agent").agg(F.count("*").alias("messages"), F.count_if(F.col("type") == "Challenge").alias("challenges"))
