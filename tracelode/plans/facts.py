"""The fact table of coded sentences, as the driver's tables carry it, in Spark and as a SQL prefix.

A trace is a user's events in order of (ts, event_id). Labels follow the event type; the first event is ORIENT and the
last RULE. Where events lack an attribute, a remainder of event_id or user_id stands in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The nine categories in print order, the order of their numbers, the broader one of each, and the domains of a coding's flags.
LABELS = ["ORIENT", "PLAN", "DESCRIBE", "SYNTHESIZE", "HYPO", "TEST", "JUDGE", "MONITOR", "RULE"]
#: The order in which label numbers and distributions count them.
NUMBERED = ["ORIENT", "DESCRIBE", "SYNTHESIZE", "HYPO", "TEST", "JUDGE", "PLAN", "MONITOR", "RULE"]
MACRO = {
    "ORIENT": "SETUP",
    "DESCRIBE": "OBSERVE", "SYNTHESIZE": "OBSERVE",
    "HYPO": "INVESTIGATE", "TEST": "INVESTIGATE", "JUDGE": "INVESTIGATE",
    "PLAN": "REGULATE", "MONITOR": "REGULATE",
    "RULE": "CONCLUDE",
}
TEST_CONTEXT = ["post_hypothesis", "pre_hypothesis", "post_rule"]
SPECIFICITY = ["within_panel", "across_panels"]
JUDGEMENT = ["accept", "reject", "uncertain"]
CONFIDENCE = ["high", "medium"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    trace = Window.partitionBy("user_id")
    order = trace.orderBy("ts", "event_id")
    rows = events.withColumn("pos", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(trace))
    e, u = F.col("event_id"), F.col("user_id")
    label = (
        F.when(F.col("pos") == 0, "ORIENT")
        .when(F.col("pos") == F.col("n") - 1, "RULE")
        .when((F.col("event_type") == "view") & (e % 5 == 0), "PLAN")
        .when(F.col("event_type") == "view", "DESCRIBE")
        .when((F.col("event_type") == "click") & (e % 7 == 0), "SYNTHESIZE")
        .when(F.col("event_type") == "click", "TEST")
        .when(F.col("event_type") == "signup", "HYPO")
        .when(F.col("event_type") == "purchase", "JUDGE")
        .otherwise("MONITOR")
    )
    rows = rows.withColumn("label", label)
    status = F.when(F.col("label") == "HYPO", F.element_at(F.array(*map(F.lit, ("novel", "revised", "repeated", "novel"))), (e % 4 + 1).cast("int")))
    judged = F.when(F.col("label") == "JUDGE", F.element_at(F.array(*map(F.lit, ("accept", "reject", "uncertain"))), (e % 3 + 1).cast("int")))
    last_hypo = F.last(F.when(F.col("label") == "HYPO", F.col("pos")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("status", status).withColumn("judgement", judged)
    return rows.select(
        F.col("user_id").alias("trace"), F.col("pos").cast("bigint").alias("sid"), F.col("n").alias("n"), "label", "status", "judgement",
        F.when(F.col("status").isin("revised", "repeated"), last_hypo).cast("bigint").alias("antecedent"),
        F.when(u % 2 == 0, "a").otherwise("b").alias("set"), (u % 4 + 1).alias("task"), (u % 3 != 0).alias("completed"),
        (e % 12 + 1).alias("tokens"), F.when(e % 6 == 0, "medium").otherwise("high").alias("confidence"), "value", F.col("event_id").alias("event_id"),
        F.when(F.col("label") == "TEST", F.when(e % 3 == 0, "within_panel").when(e % 3 == 1, "across_panel").otherwise("across_panels")).alias("specificity"),
        F.when(u % 10 < 5, 4096).when(u % 10 < 9, 6144).otherwise(2048).cast("bigint").alias("budget"),
    )


_LIST = "list_extract([{}], CAST(event_id % {} + 1 AS BIGINT))"
SQL = f"""
r0 AS (SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r1 AS (SELECT *, CASE WHEN pos = 0 THEN 'ORIENT' WHEN pos = n - 1 THEN 'RULE' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'PLAN' WHEN event_type = 'view' THEN 'DESCRIBE'
  WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'SYNTHESIZE' WHEN event_type = 'click' THEN 'TEST' WHEN event_type = 'signup' THEN 'HYPO' WHEN event_type = 'purchase' THEN 'JUDGE' ELSE 'MONITOR' END AS label FROM r0),
r2 AS (SELECT *, CASE WHEN label = 'HYPO' THEN {_LIST.format("'novel', 'revised', 'repeated', 'novel'", 4)} END AS status,
  CASE WHEN label = 'JUDGE' THEN {_LIST.format("'accept', 'reject', 'uncertain'", 3)} END AS judgement,
  last_value(CASE WHEN label = 'HYPO' THEN pos END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_hypo FROM r1),
s AS (SELECT user_id AS trace, pos AS sid, n, label, status, judgement, CASE WHEN status IN ('revised', 'repeated') THEN last_hypo END AS antecedent,
  CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS "set", user_id % 4 + 1 AS task, user_id % 3 <> 0 AS completed, event_id % 12 + 1 AS tokens,
  CASE WHEN event_id % 6 = 0 THEN 'medium' ELSE 'high' END AS confidence, value, event_id,
  CASE WHEN label = 'TEST' THEN CASE event_id % 3 WHEN 0 THEN 'within_panel' WHEN 1 THEN 'across_panel' ELSE 'across_panels' END END AS specificity,
  CASE WHEN user_id % 10 < 5 THEN 4096 WHEN user_id % 10 < 9 THEN 6144 ELSE 2048 END::BIGINT AS budget FROM r2)
"""
