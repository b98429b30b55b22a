"""Queries of admission and conversation. ``events`` is the request log; a user's rows with text are its conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import admission, conversation
from quern.sources.tables import table


def _requests(spark, base):
    return table(spark, base, "events").select("event_id", F.col("user_id").alias("client"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))


def _turns(spark, base):
    """Every event is a turn of its user's conversation, questions and answers in no strict turn; answers carry marks."""
    n = F.col("event_id")
    text = F.concat(F.repeat(F.concat("event_type", F.lit(" ")), (n % 60).cast("int")), F.col("props"), F.when(n % 2 == 0, F.lit("")).otherwise(F.lit("  [S1] [S12]")))
    return table(spark, base, "events").select(F.col("user_id").alias("conv_id"), n.alias("turn"), F.when(n % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(n % 17 > 0, text).alias("text"))


def quota_coupled_windows(spark, base):
    return admission.coupled_windows(_requests(spark, base), 1, 100)


def sliding_log_limiter(spark, base):
    return admission.sliding_log(_requests(spark, base), 3, 86400)


def tumbling_counts(spark, base):
    return admission.window_counts(_requests(spark, base), 86400)


def counter_read(spark, base):
    text = F.when(F.col("event_id") % 4 == 0, "x").when(F.col("event_id") % 4 == 1, F.concat(F.lit("-"), F.col("user_id").cast("string"))).when(F.col("event_id") % 4 == 2, F.col("user_id").cast("string"))
    return table(spark, base, "events").select("event_id", admission.counter_value(text).alias("n"))


def history_budget_server(spark, base):
    kept = conversation.server_history(_turns(spark, base), 6, 1000)
    return kept.select("conv_id", "turn", "role", "text")


def history_budget_client(spark, base):
    return conversation.client_history(_turns(spark, base).where("text is not null"), 1200).select("conv_id", "turn", "role", "text")


def history_budget_replay(spark, base):
    return conversation.client_history(_turns(spark, base).where("text is not null"), 800, keep_one=False, most_turns=6).select("conv_id", "turn")


def transcript_render(spark, base):
    return conversation.transcript(_turns(spark, base).where("text is not null"))


def props_variant(spark, base):
    props = table(spark, base, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return props.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k")).where("k >= 50")


QUERIES = {f.__name__: f for f in (quota_coupled_windows, sliding_log_limiter, tumbling_counts, counter_read, history_budget_server, history_budget_client, history_budget_replay, transcript_render, props_variant)}

_E = "SELECT event_id, user_id AS client, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events"
_T = """t AS (SELECT user_id AS conv_id, event_id AS turn, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN event_id % 17 > 0 THEN repeat(event_type || ' ', event_id % 60) || props || CASE WHEN event_id % 2 = 0 THEN '' ELSE '  [S1] [S12]' END END AS text FROM events)"""

SQL = {
    "quota_coupled_windows": f"""WITH e AS ({_E}), a AS (SELECT *, epoch // 3600 AS c, epoch // 86400 AS d, row_number() OVER (PARTITION BY client, epoch // 3600 ORDER BY epoch, event_id) AS rn FROM e),
b AS (SELECT *, sum(CASE WHEN rn <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY epoch, event_id ROWS UNBOUNDED PRECEDING) AS dr FROM a),
o AS (SELECT *, rn <= 1 AND dr <= 100 AS ok FROM b),
p AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY client, c ORDER BY epoch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM o)
SELECT event_id, ok AS allowed, CASE WHEN NOT ok THEN CASE WHEN prior >= 1 THEN 'client' ELSE 'daily' END END AS scope,
  CAST(CASE WHEN ok THEN 0 WHEN prior >= 1 THEN greatest(1, 3600 - epoch % 3600 + 1) ELSE greatest(1, 86400 - epoch % 86400 + 1) END AS BIGINT) AS retry_after FROM p""",
    "sliding_log_limiter": f"""WITH RECURSIVE e AS ({_E}), r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY epoch, event_id) AS rn FROM e),
w AS (
  SELECT event_id, client, rn, TRUE AS allowed, [epoch] AS log FROM r WHERE rn = 1
  UNION ALL
  SELECT r.event_id, r.client, r.rn, len(list_filter(w.log, lambda x: x > r.epoch - 86400)) < 3,
    CASE WHEN len(list_filter(w.log, lambda x: x > r.epoch - 86400)) < 3 THEN list_append(list_filter(w.log, lambda x: x > r.epoch - 86400), r.epoch) ELSE list_filter(w.log, lambda x: x > r.epoch - 86400) END
  FROM w JOIN r ON r.client = w.client AND r.rn = w.rn + 1)
SELECT event_id, allowed FROM w""",
    "tumbling_counts": f"SELECT client, epoch // 86400 AS bucket, count(*) AS n FROM ({_E}) GROUP BY ALL",
    "counter_read": "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN greatest(user_id, 0) ELSE 0 END AS n FROM events",
    "history_budget_client": f"WITH {_T}, s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t WHERE text IS NOT NULL) SELECT conv_id, turn, role, text FROM s WHERE n <= 1200 OR r = 1",
    "history_budget_replay": f"WITH {_T}, s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t WHERE text IS NOT NULL) SELECT conv_id, turn FROM s WHERE n <= 800 AND r <= 6",
    "history_budget_server": f"""WITH {_T}, c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN trim(text) ELSE trim(regexp_replace(regexp_replace(text, '\\[S\\d+\\]', ' ', 'g'), '\\s+', ' ', 'g')) END AS text FROM t WHERE text IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, length(text) AS n FROM c WHERE text <> ''),
s AS (SELECT *, 1000 - coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l WHERE r <= 6)
SELECT conv_id, turn, role, CASE WHEN n <= b THEN text ELSE rtrim(text[:b - 1]) || '…' END AS text FROM s WHERE b > 1""",
    "transcript_render": f"WITH {_T} SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Visitor: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS transcript FROM t WHERE text IS NOT NULL GROUP BY 1",
    "props_variant": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50",
}
