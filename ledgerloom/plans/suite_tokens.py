"""Token, scheduling and cadence questions over the events table, with comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.columns import Span
from ledgerloom.operators import tokens as T
from ledgerloom.plans.oracle_base import money, ratio
from ledgerloom.sources import event_adapter as E
from ledgerloom.streaming import drops as D

MONTH = Span("2024-01-01", "2024-02-01")
SPANS = {"Jan 1-14 baseline": Span("2024-01-01", "2024-01-15"), "Jan 10-25 scheduled": Span("2024-01-10", "2024-01-26")}


def _usage(job, *args):
    return lambda spark, sf: job(E.usage(spark, sf), *args)


def _tie_out(spark, sf_dir):
    usage = E.usage(spark, sf_dir)
    return T.token_tie_out(E.batch_ledger(usage), E.batch_log(usage), ["day", "batch"])


def _batch_cost(spark, sf_dir):
    """Batch output as JSON lines, parsed back with the declared usage schema."""
    usage = E.usage(spark, sf_dir)
    line = F.when(F.col("event_type") == "error", F.lit('{"response":null}')).otherwise(F.format_string(
        '{"response":{"body":{"usage":{"prompt_tokens":%d,"completion_tokens":%d}}}}',
        (F.col("user_id") % 100), F.col("tokens")))
    parsed = usage.select("event_type", F.to_date("used_at").alias("day"), F.from_json(line, T.USAGE_SCHEMA).alias("j"))
    return T.batch_usage_cost(parsed, ["day", "event_type"], F.col("j.response.body.usage"))


def _variance(spark, sf_dir):
    return T.job_variance(E.usage(spark, sf_dir).select(
        (F.col("user_id") % 50).alias("job"), F.to_date("used_at").alias("run_day"),
        F.col("tokens").cast("decimal(20,0)").alias("tokens")))


def _hours_off(spark, sf_dir):
    usage = E.usage(spark, sf_dir).select(F.col("event_type").alias("meter"), "used_at")
    return T.hours_off_share(usage, T.weekly_hours(spark, "8", "18", (0, 1, 2, 3, 4)))


def _daily(spark, sf_dir):
    return D.daily_window(E.usage(spark, sf_dir), ["event_type"], "used_at", "BilledCost")


QUERIES = {
    "token_ledger": _usage(T.token_ledger, MONTH),
    "token_tie_out": _tie_out,
    "unit_economics": _usage(T.unit_economics, MONTH),
    "per_day_baseline": _usage(T.per_day_baseline, SPANS),
    "weekend_detail": _usage(T.weekend_detail, MONTH),
    "meter_anatomy": _usage(T.meter_anatomy, SPANS),
    "batch_usage_cost": _batch_cost,
    "job_variance": _variance,
    "billing_latency": lambda spark, sf: T.billing_latency(
        E.usage(spark, sf).select("used_at"), E.export_ticks(spark, sf)),
    "hours_off_share": _hours_off,
    "absent_dates": lambda spark, sf: T.absent_dates(E.usage(spark, sf), "user_id"),
    "first_seen": lambda spark, sf: D.first_seen(
        E.usage(spark, sf), ["user_id", "event_type"], "used_at"),
    "daily_window": _daily,
    "row_count_drift": lambda spark, sf: D.row_count_drift(_daily(spark, sf), ["event_type"]),
}


def _over(body: str, ctes: str = "") -> str:
    return "WITH " + E.USAGE_SQL + ("," + ctes if ctes else "") + "\n" + body


_IN_MONTH = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"
_TAGGED = """tagged AS (
  SELECT 'Jan 1-14 baseline' AS period, * FROM metered WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-14' UNION ALL
  SELECT 'Jan 10-25 scheduled', * FROM metered WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-25')"""

ORACLE = {
    "token_ledger": _over(f"""
        SELECT day AS charge_date, x_SkuMeterName AS meter, CAST(sum(tokens) AS DOUBLE) AS tokens,
               {money('sum(PricingQuantity)', 6)} AS pricing_qty_1k, {money('sum(BilledCost)', 6)} AS billed_usd
        FROM metered WHERE {_IN_MONTH} GROUP BY ALL"""),
    "token_tie_out": _over("""
        SELECT day, batch, CAST(bt AS DOUBLE) AS billed_tokens, CAST(bc AS DOUBLE) AS billed_usd, CAST(lt AS DOUBLE) AS logged_tokens,
               CAST(lc AS DOUBLE) AS logged_usd, CAST(bt - lt AS DOUBLE) AS token_variance, CAST(bc - lc AS DOUBLE) AS usd_variance,
               CASE WHEN bt IS NULL THEN 'NOT BILLED' WHEN lt IS NULL THEN 'NOT LOGGED'
                    WHEN bt = lt AND bc = lc THEN 'EXACT TIE' ELSE 'VARIANCE' END AS verdict
        FROM (SELECT day, user_id % 10 AS batch, sum(tokens) AS bt, sum(BilledCost) AS bc FROM metered
              WHERE NOT (user_id % 10 = 5 AND day(day) % 11 = 0) GROUP BY ALL)
        FULL JOIN (SELECT day, user_id % 10 AS batch, sum(tokens + CASE WHEN user_id % 10 = 4 AND day(day) % 7 = 0 THEN 1 ELSE 0 END) AS lt,
                          sum(BilledCost) AS lc FROM metered WHERE NOT (user_id % 10 = 3 AND day(day) % 9 = 0) GROUP BY ALL)
        USING (day, batch)"""),
    "unit_economics": _over(f"""
        SELECT meter, CAST(tokens AS DOUBLE) AS tokens, {money('billed', 6)} AS billed_usd,
               {ratio('billed', 'qty', 6, '1')} AS finance_usd_per_1k, {ratio('billed', 'tokens', 6, '1000')} AS engineering_usd_per_1k,
               CASE WHEN meter = 'TOTAL' THEN 'blended' WHEN qty * 1000 = tokens THEN 'coincide (no block rounding)'
                    ELSE 'DIVERGE - pricing structure' END AS views,
               {ratio('interactive', '1000000', 6, '1')} AS interactive_counterfactual_usd
        FROM (SELECT x_SkuMeterName AS meter, tokens, qty, billed, interactive FROM ai UNION ALL
              SELECT 'TOTAL', sum(tokens), sum(qty), sum(billed), sum(interactive) FROM ai)""",
        f"""ai AS (SELECT x_SkuMeterName, sum(tokens) AS tokens, sum(PricingQuantity) AS qty, sum(BilledCost) AS billed,
              sum(tokens * CASE WHEN contains(x_SkuMeterName, 'Inp') THEN 0.10 ELSE 0.40 END) AS interactive
              FROM metered WHERE {_IN_MONTH} GROUP BY ALL)"""),
    "per_day_baseline": _over(f"""
        SELECT period, count(DISTINCT day) AS days_in_data, {money('sum(BilledCost)', 4)} AS total_usd,
               {ratio('sum(BilledCost)', 'count(DISTINCT day)', 4, '1')} AS per_day FROM tagged GROUP BY ALL""", _TAGGED),
    "weekend_detail": _over(f"""
        SELECT day AS d, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend (VM off all day)' ELSE 'weekday' END AS day_type,
               count(*) AS rows_emitted, {money('sum(BilledCost)', 4)} AS billed_usd FROM metered WHERE {_IN_MONTH} GROUP BY ALL"""),
    "meter_anatomy": _over(f"""
        SELECT period, ServiceName, ChargeDescription, count(*) AS rows_, {money('sum(BilledCost)', 4)} AS billed_usd
        FROM tagged GROUP BY ALL""", _TAGGED),
    "batch_usage_cost": _over(f"""
        SELECT day, event_type, count(*) AS responses, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
               CAST(sum(p + c) AS BIGINT) AS total_tokens, {ratio('sum(p) * 0.05 + sum(c) * 0.20', '1000000', 6, '1')} AS est_cost_usd
        FROM (SELECT day, event_type, CASE WHEN event_type = 'error' THEN 0 ELSE user_id % 100 END AS p,
                     CASE WHEN event_type = 'error' THEN 0 ELSE tokens END AS c FROM metered) GROUP BY ALL"""),
    "job_variance": _over(f"""
        SELECT job, run_day, CAST(t AS DOUBLE) AS tokens, CAST(p AS DOUBLE) AS previous, CAST(t - p AS DOUBLE) AS change,
               {ratio('(t - p)', 'p')} AS change_pct
        FROM (SELECT user_id % 50 AS job, day AS run_day, sum(tokens) AS t,
                     lag(sum(tokens)) OVER (PARTITION BY user_id % 50 ORDER BY day) AS p FROM metered GROUP BY user_id % 50, day)
        WHERE p IS NOT NULL"""),
    "billing_latency": _over(f"""
        SELECT day, count(*) AS charges, count(tick) AS delivered, count(*) - count(tick) AS unlogged,
               max(date_diff('day', day, CAST(tick AS DATE))) AS max_days,
               {ratio("max(CAST(floor(epoch(tick - ts)) AS BIGINT))", '3600', 1, '1')} AS max_hours
        FROM (SELECT m.ts, m.day, t.tick FROM metered m ASOF LEFT JOIN ticks t ON m.ts <= t.tick) GROUP BY ALL""",
        """ticks AS (SELECT min(ts) AS tick FROM metered WHERE event_type = 'signup' GROUP BY day HAVING day(day) % 5 <> 0)"""),
    "hours_off_share": _over(f"""
        SELECT event_type AS meter, count(*) AS row_count, count_if(off) AS rows_in_off_hours,
               {ratio('count_if(off)', 'count(*)')} AS usage_off_pct, CAST(118 AS BIGINT) AS hours_off, CAST(168 AS BIGINT) AS hours,
               {ratio('118', '168')} AS hours_off_pct
        FROM (SELECT event_type, isodow(ts) > 5 OR hour(ts) < 8 OR hour(ts) >= 18 AS off FROM metered) GROUP BY ALL"""),
    "absent_dates": _over("""
        SELECT user_id, day + 1 AS absent_from, nxt - 1 AS absent_to, date_diff('day', day, nxt) - 1 AS absent_days
        FROM (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt
              FROM (SELECT DISTINCT user_id, day FROM metered)) WHERE nxt - day > 1"""),
    "first_seen": _over("""
        SELECT user_id, event_type, min(ts) AS first_seen, count(*) AS row_count FROM metered GROUP BY ALL"""),
    "daily_window": _over("""
        SELECT day, event_type, count(*) AS row_count, CAST(sum(BilledCost) AS DOUBLE) AS amount FROM metered GROUP BY ALL"""),
    "row_count_drift": _over("""
        SELECT day, event_type, n AS row_count, lag(n) OVER w AS previous, n - lag(n) OVER w AS change
        FROM (SELECT day, event_type, count(*) AS n FROM metered GROUP BY ALL)
        WINDOW w AS (PARTITION BY event_type ORDER BY day)"""),
}
