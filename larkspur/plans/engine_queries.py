"""Queries over the business and event tables: joins, grouping, windows, streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from larkspur.operators.ranking import PLACES
from larkspur.plans.catalogue import query
from larkspur.sources.readers import table
from larkspur.streaming import streams as S


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, round(avg(l_discount), 6)::DOUBLE AS avg_disc, count(*)::BIGINT AS n
FROM lineitem GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    # Lines are summed up per order before they meet the customers.
    per_order = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left_join_orders(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2 AND c_nationkey = s_nationkey")
def full_join_keys(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, (F.col("c_custkey") == F.col("s_suppkey") * 2) & (F.col("c_nationkey") == F.col("s_nationkey")), "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join_big_orders(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_no_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""WITH bands(band, lo, hi) AS (VALUES ('low', -1000.0, 0.0), ('mid', 0.0, 5000.0), ('high', 5000.0, 10000.0))
SELECT band, count(*)::BIGINT AS n FROM customer JOIN bands ON c_acctbal >= lo AND c_acctbal < hi GROUP BY band""")
def range_join(spark, sf_dir):
    bands = spark.createDataFrame([("low", -1000.0, 0.0), ("mid", 0.0, 5000.0), ("high", 5000.0, 10000.0)], "band string, lo double, hi double")
    return table(spark, sf_dir, "customer").join(F.broadcast(bands), (F.col("c_acctbal") >= F.col("lo")) & (F.col("c_acctbal") < F.col("hi"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT v.event_id, c.event_id AS click_id FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts""")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'click')")
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    # The last click at or before each purchase: one sort per user, no join.
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id")
    last = F.last(click, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("click_id", last).filter("event_type = 'purchase'").select("event_id", "click_id")


@query("SELECT c_mktsegment, n_regionkey, count(*)::BIGINT AS n, round(sum(c_acctbal), 2)::DOUBLE AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)")
def cube_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("c_mktsegment", "n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT p_brand, p_size, count(DISTINCT p_type)::BIGINT AS types FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def grouping_sets(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("larkspur_part")
    return spark.sql("SELECT p_brand, p_size, count(DISTINCT p_type) AS types FROM larkspur_part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")


@query("SELECT lang, source FROM documents INTERSECT SELECT lang, source FROM documents WHERE n_chars > 5000")
def set_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("lang", "source").intersect(d.filter("n_chars > 5000").select("lang", "source"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2)::DOUBLE AS running, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INTEGER AS place FROM orders")
def running_totals(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey")), 2).alias("running"), F.rank().over(w.orderBy(F.col("o_totalprice").desc())).alias("place"))


def as_text(df, *columns):
    """Times as text, which no session's zone changes."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    return as_text(S.window_counts(table(spark, sf_dir, "events"), "1 hour"), "window_start")


@query("""WITH w AS (SELECT (time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR) AS window_start, event_type, value FROM events, range(0, 3) r(i))
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM w GROUP BY ALL""")
def sliding_counts(spark, sf_dir):
    return as_text(S.window_counts(table(spark, sf_dir, "events"), "3 hours", "1 hour"), "window_start")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S.%f') AS session_end, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    return as_text(S.session_counts(table(spark, sf_dir, "events"), "6 hours"), "session_start", "session_end")


@query("""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL), a AS (SELECT i, avg(embedding[i]::DOUBLE) AS y FROM embeddings, range(1, 65) r(i) GROUP BY ALL)
SELECT label, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6)::DOUBLE AS similarity FROM m JOIN a USING (i) GROUP BY label""")
def centroid_drift(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    m = parts.groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("x").alias("c"))
    a = m.groupBy("i").agg((F.sum("s") / F.sum("c")).alias("y"))  # from the labels' sums, not from the rows again
    both = m.select("label", "i", (F.col("s") / F.col("c")).alias("x")).join(a, "i")
    x, y = F.col("x"), F.col("y")
    return both.groupBy("label").agg(F.round(F.sum(x * y) / (F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), PLACES).alias("similarity"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) WHERE e = event_id")
def json_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("k", "v"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL""")
def streamed_counts(spark, sf_dir):
    """Daily counts by a streaming query over the table's files, run to their end."""
    import uuid

    name = f"streamed_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    counts = S.window_counts(stream, "1 day", late="1 hour")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return as_text(spark.table(name), "window_start")
