"""Queries of idle times and of claims, each with the SQL that says the same; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import claims, idle
from .registry import query, table


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, t AS last_us, t + 21600000000 AS released_us FROM e WHERE next - t > 21600000000 OR next IS NULL AND (t + 21600000000) // 1000 <= (SELECT max(t) // 1000 FROM e) - 60000""")
def idle_releases(spark, sf):
    """Users that were away for six hours; the last of each counts once the newest event, less a minute, is as far."""
    r = idle.idle_releases(table(spark, sf, "events"), "user_id", "ts", 360, "60 seconds")
    return r.select("user_id", F.unix_micros("last").alias("last_us"), F.unix_micros("released").alias("released_us"))


SQL_REQUESTS = """before AS (SELECT o_orderkey AS job, o_custkey // 4 AS queue, o_custkey AS project, o_orderstatus = 'F' AS running FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
asked AS (SELECT o_orderkey AS seq, o_orderkey AS job, o_custkey // 4 AS queue, o_custkey AS project FROM orders WHERE o_orderkey NOT IN (SELECT job FROM before)),
done AS (SELECT job, queue, project FROM before WHERE running AND job % 3 = 0),
busy AS (SELECT * FROM before WHERE job NOT IN (SELECT job FROM done)),
new AS (SELECT seq, job, queue, project FROM asked WHERE seq % 5 <> 0 AND project NOT IN (SELECT project FROM busy) QUALIFY row_number() OVER (PARTITION BY project ORDER BY seq) = 1),
waiting AS (SELECT queue, project, job, row_number() OVER (PARTITION BY queue ORDER BY job) AS rank FROM (SELECT queue, project, job FROM busy WHERE NOT running UNION ALL SELECT queue, project, job FROM new)),
workers AS (SELECT queue, worker, seq, row_number() OVER (PARTITION BY queue ORDER BY seq) AS rank FROM (SELECT queue, 'w' || (seq % 7) AS worker, min(seq) AS seq FROM asked WHERE seq % 5 = 0 GROUP BY ALL)),
claims AS (SELECT seq, w.queue, project, job, worker FROM workers w JOIN waiting j ON w.queue = j.queue AND w.rank = j.rank)"""


@query(f"""WITH {SQL_REQUESTS} SELECT 'over' AS kind, job AS seq, CAST(queue AS VARCHAR) AS queue, CAST(project AS VARCHAR) AS project, job, 'me' AS worker FROM done
UNION ALL SELECT 'pending', seq, CAST(queue AS VARCHAR), CAST(project AS VARCHAR), job, NULL FROM new UNION ALL SELECT 'running', seq, CAST(queue AS VARCHAR), CAST(project AS VARCHAR), job, worker FROM claims""")
def claimed_jobs(spark, sf):
    """Customers are projects, four share a queue. A customer's first order is there before; others are a batch of new jobs and of workers that ask."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.expr("o_custkey div 4").cast("string").alias("queue"), F.col("o_custkey").cast("string").alias("project"), F.col("o_orderstatus").alias("s"))
    first = o.where("s <> 'P'").groupBy("project").agg(F.min(F.struct("job", "queue", "s")).alias("m")).select("project", "m.*")
    kinds = F.when(F.col("s") == "F", F.array(F.lit("pending"), F.lit("running"))).otherwise(F.array(F.lit("pending")))
    none = F.lit(None).cast("string")
    before = first.select(F.col("job").alias("seq"), F.explode(kinds).alias("kind"), "queue", "project", "job", none.alias("worker"))
    rest = o.join(first.select("job"), "job", "left_anti")
    asks = F.col("job") % 5 == 0
    requests = rest.select(
        F.col("job").alias("seq"), F.when(asks, "claim").otherwise("enqueue").alias("kind"), "queue", F.when(~asks, F.col("project")).alias("project"), F.when(~asks, F.col("job")).alias("job"),
        F.when(asks, F.concat(F.lit("w"), (F.col("job") % 7).cast("string"))).alias("worker"),
    )
    over = first.where("s = 'F' and job % 3 = 0").select(F.col("job").alias("seq"), F.lit("finish").alias("kind"), none.alias("queue"), none.alias("project"), "job", F.lit("me").alias("worker"))
    return claims.answered(before, requests.unionByName(over))
