"""STM over events, as batches with the same results as the streams have (the streams themselves are tested)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import sync as S
from . import query, table_of

C = F.col


@query("op_stm3_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert(spark, sf):
    e = table_of(spark, sf, "events").select("user_id", "event_id", "value")
    first = S.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")
    return S.upserted(first, e.where("event_id % 2 = 1"), "user_id", "event_id")


@query("op_stm4_conflicts", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def conflicts(spark, sf):
    return S.conflicts(table_of(spark, sf, "events"), "user_id", "event_type")


_MOVES = ", ".join(str(m) for m in sorted(S.legal_moves()))
_STAGE = f"{list(S.STAGES)}[least(17, greatest(1, r + CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END)) :: INTEGER]"
JOURNAL_SQL = f"""WITH RECURSIVE e AS (SELECT user_id % 10 * 100000 + day AS operation_id, event_id AS seq, r, stage, CASE WHEN stage = 'confirmation_accepted' THEN 'accepted' WHEN stage = 'receipt_persisted' THEN CASE WHEN value < 40 THEN 'failed' ELSE 'committed' END WHEN value > 99 THEN 'orphaned' ELSE 'running' END AS status
  FROM (SELECT *, {_STAGE} AS stage FROM (SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, row_number() OVER (PARTITION BY user_id % 10, ts::DATE ORDER BY event_id) AS r FROM events))),
m(a, s, b, t) AS (VALUES {_MOVES}),
f AS (SELECT operation_id, seq, r, stage, status, status = 'accepted' AS ok, CASE WHEN status = 'accepted' THEN stage END AS pa, CASE WHEN status = 'accepted' THEN status END AS ps FROM e WHERE r = 1
  UNION ALL SELECT operation_id, seq, r, stage, status, ok, CASE WHEN ok THEN stage ELSE pa END, CASE WHEN ok THEN status ELSE ps END FROM (SELECT e.*, f.pa, f.ps, CASE WHEN f.pa IS NULL THEN e.status = 'accepted' ELSE m.a IS NOT NULL END AS ok FROM f JOIN e ON e.operation_id = f.operation_id AND e.r = f.r + 1 LEFT JOIN m ON m.a = f.pa AND m.s = f.ps AND m.b = e.stage AND m.t = e.status))
SELECT operation_id, seq, stage, status, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS verdict FROM f"""


@query("op_stm5_journal", JOURNAL_SQL)
def journal(spark, sf):
    """Events of a tenth of the users and a day as an operation's records, some of them out of step."""
    e = table_of(spark, sf, "events").withColumn("day", F.unix_date(C("ts").cast("date"))).withColumn("g", C("user_id") % 10)
    r = F.row_number().over(Window.partitionBy("g", "day").orderBy("event_id"))
    at = r + F.when(C("event_type") == "click", 1).when(C("event_type") == "purchase", -1).otherwise(0)
    stage = F.element_at(F.array(*[F.lit(x) for x in S.STAGES]), F.least(F.lit(17), F.greatest(F.lit(1), at)))
    status = F.when(C("stage") == S.FIRST, "accepted").when(C("stage") == S.LAST, F.when(C("value") < 40, "failed").otherwise("committed")).when(C("value") > 99, "orphaned").otherwise("running")
    records = e.withColumn("stage", stage).select((C("g") * 100000 + C("day")).cast("long").alias("operation_id"), C("event_id").alias("seq"), "stage", status.alias("status"))
    return S.journal(records)


@query("op_stm_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows(spark, sf):
    return S.windowed(table_of(spark, sf, "events"), "ts", "1 hour", "10 minutes", "event_type").select(C("window.start").alias("at"), "event_type", "n", "total")
