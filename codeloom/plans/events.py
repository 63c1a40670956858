"""Event queries: debouncing, sliding windows, JSON properties, caches and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import jobs as J
from .graph import _E, _P, _entities, _files
from .registry import query

_T = "'%Y-%m-%d %H:%M:%S'"


def _second(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"""
    with g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 2 hour then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g)
    select user_id, strftime(min(ts), {_T}) as first, strftime(max(ts), {_T}) as last, count(*) as n, arg_max(event_type, (ts, event_id)) as final_type from s group by user_id, k""")
def debounce_sessions(s, d):
    return J.debounce(table(s, d, "events")).select("user_id", _second("first"), _second("last"), "n", "final_type")


@query(f"""
    with w as (select event_type, value, unnest(range(4)) as i, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as b from (select event_type, value, ts::timestamp as ts from events where ts is not null))
    select event_type, strftime(b - i * interval 6 hour, {_T}) as start, count(*) as n, round(sum(value), 4) as total, max(value) as high from w group by 1, 2""")
def sliding_metric_window(s, d):
    return J.sliding_metrics(table(s, d, "events")).select("event_type", _second("start"), "n", F.round("total", 4).alias("total"), "high")


@query("""select event_id, count(*) over w as n, round(avg(value) over w, 6) as mean from (select *, epoch_us(ts) as u from events) window w as (partition by user_id order by u range between 299999999 preceding and current row)""")
def recent_metric_window(s, d):
    return J.recent_window(table(s, d, "events"), 300, "user_id").select("event_id", "n", F.round("mean", 6).alias("mean"))


@query("""select event_type, k as key, count(*) as n from (select event_type, unnest(json_keys(props::json)) as k from events where props is not null and json_valid(props)) group by all""")
def json_properties(s, d):
    return table(s, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query("""select user_id, count(*) as n, sum(value)::double >= 0 as ok, max(ts) < (select max(ts) from events) - interval 1 day as inactive from events group by user_id""")
def inactive_users(s, d):
    e = table(s, d, "events")
    users = e.groupBy("user_id").agg(F.count("*").alias("n"), (F.sum("value") >= 0).alias("ok"), F.max("ts").alias("last"))
    # the end is one row
    return users.join(F.broadcast(e.agg(F.max("ts").alias("_end")))).select("user_id", "n", "ok", (F.col("last") < F.col("_end") - F.expr("interval 1 day")).alias("inactive"))


@query(f"""
    with c as (select distinct content_hash as h from chunks where content_hash is not null)
    select entity_id, coalesce(content_hash in (select h from c), false) as hit from {_E}""")
def cache_lookup(s, d):
    known = table(s, d, "chunks").select("content_hash").where("content_hash is not null").distinct().withColumn("k", F.lit(True))
    return _entities(s, d).join(known, "content_hash", "left").select("entity_id", F.col("k").isNotNull().alias("hit"))


@query(f"""select file_id from {_P} where file_id not in (select file_id from {_E} where file_id is not null) and (errors is null or len(errors) = 0)""")
def checkpoint_pending(s, d):
    f = _files(s, d)
    return f.join(_entities(s, d).select("file_id").distinct(), "file_id", "left_anti").where("errors is null or size(errors) = 0").select("file_id")


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'processed' when o_orderstatus = 'O' then 'pending' else 'partial' end as state, (epoch(o_orderdate) // 86400)::bigint as day, date_diff('day', o_orderdate, timestamp '2000-01-01')::int as age from orders""")
def durations(s, d):
    state = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("partial")
    return table(s, d, "orders").select("o_orderkey", state.alias("state"), F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("bigint").alias("day"), F.datediff(F.lit("2000-01-01"), "o_orderdate").alias("age"))


@query(f"""
    with e as (select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type)
    select '# TYPE events_total counter' as line union all select 'events_total{{type="' || event_type || '"}} ' || n from e""")
def prometheus_export(s, d):
    from ..sources.sinks import prometheus_lines

    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("value")).select(F.col("event_type").alias("label"), "value")
    return prometheus_lines(n, "events_total", "type", "counter")


@query(f"""select count(*) as n, sum(l_quantity)::double as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as cost, count(distinct l_orderkey) as requests from lineitem""")
def cost_totals(s, d):
    return table(s, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"), F.countDistinct("l_orderkey").alias("requests"))
