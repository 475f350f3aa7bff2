"""Queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.functions import scalars as S
from shalebed.operators import asof, hierarchy, intervals, snapshots, timeseries
from shalebed.streaming import chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _spans(t) -> DataFrame:
    """Each order line as days from its shipping on, as many as its quantity."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return t("lineitem").select("l_suppkey", "l_returnflag", "l_linenumber", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


_SPANS = """spans AS (SELECT l_suppkey, l_returnflag, l_linenumber, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS "start",
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT + l_quantity::BIGINT AS "end" FROM lineitem)"""
_MERGE = """, isl AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY {k} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {src}))
SELECT {out}min("start") AS "start", max("end") AS "end" FROM isl GROUP BY {k}, island"""


def _merge(k: str, src: str, gap: int = 0, out: str | None = None) -> str:
    return _MERGE.format(k=k, src=src, gap=gap, out=f"{k}, " if out is None else out)


_DAYS = """days AS (SELECT l_suppkey, l_returnflag, unnest(range("start", "end")) AS d FROM spans)"""


@query(f"WITH {_SPANS}" + _merge("l_suppkey", "spans"))
def interval_union(t):
    return intervals.at_least(_spans(t), ["l_suppkey"], 1)


@query(f"WITH {_SPANS}, {_DAYS}, c AS (SELECT l_suppkey, d AS \"start\", d + 1 AS \"end\" FROM days GROUP BY l_suppkey, d HAVING count(DISTINCT l_returnflag) = 3)" + _merge("l_suppkey", "c"))
def interval_intersect(t):
    sets = intervals.at_least(_spans(t), ["l_suppkey", "l_returnflag"], 1)
    return intervals.at_least(sets, ["l_suppkey"], 3)


@query(f"WITH {_SPANS}, {_DAYS}, c AS (SELECT 1 AS one, d AS \"start\", d + 1 AS \"end\" FROM days GROUP BY d HAVING count(*) >= 500)" + _merge("one", "c", out=""))
def interval_atleast_k(t):
    return intervals.at_least_bucketed(_spans(t), 500, 64)


@query(f"WITH {_SPANS}, {_DAYS}, c AS (SELECT l_suppkey, d AS \"start\", d + 1 AS \"end\" FROM days GROUP BY l_suppkey, d HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') = 0)" + _merge("l_suppkey", "c"))
def interval_difference(t):
    return intervals.difference(_spans(t), ["l_suppkey"], "l_returnflag = 'A'", "l_returnflag = 'R'")


@query(f"WITH {_SPANS}" + _merge("l_suppkey, l_returnflag", "spans", 5))
def interval_coalesce_gap(t):
    return intervals.coalesce(_spans(t), ["l_suppkey", "l_returnflag"], 5)


@query(f"WITH {_SPANS}, {_DAYS}, c AS (SELECT l_suppkey, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::INTEGER AS pri, d AS \"start\", d + 1 AS \"end\" FROM days GROUP BY l_suppkey, d)" + _merge("l_suppkey, pri", "c"))
def interval_priority_overlay(t):
    pri = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return intervals.overlay(_spans(t).withColumn("pri", pri).withColumn("rank", F.col("pri")), ["l_suppkey"], "rank", "pri")


@query("SELECT p_partkey, (floor(p_retailprice / 100) * 100)::BIGINT AS lo, (floor(p_retailprice / 100) * 100 + 100)::BIGINT AS hi FROM part")
def range_lookup(t):
    part = t("part")
    bands = part.select(F.explode(F.sequence(F.lit(0), F.lit(40))).alias("i")).distinct().select((F.col("i") * 100).cast("long").alias("lo"), (F.col("i") * 100 + 100).cast("long").alias("hi"))
    return intervals.lookup(part, bands, "p_retailprice").select("p_partkey", "lo", "hi")


_S = "epoch(ts)::BIGINT"


def _events(t) -> DataFrame:
    return t("events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))


@query(f"SELECT DISTINCT e.event_id, e.user_id FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND epoch(e.ts)::BIGINT >= floor(epoch(p.ts))::BIGINT AND floor(epoch(e.ts)) >= floor(epoch(p.ts)) AND floor(epoch(e.ts)) < floor(epoch(p.ts)) + 86400 WHERE e.event_type = 'click'")
def interval_membership(t):
    e = _events(t)
    ranges = e.where("event_type = 'purchase'").select("user_id", F.col("s").alias("start"), (F.col("s") + 86400).alias("end"))
    return intervals.members(e.where("event_type = 'click'").select("event_id", "user_id", "s"), ranges, ["user_id"], "s").select("event_id", "user_id")


_F = "floor(epoch(ts))::BIGINT"
_CLICK = f"c AS (SELECT event_id, user_id, {_F} AS s FROM events WHERE event_type = 'click'), p AS (SELECT user_id, {_F} AS t, max(event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def _sides(t) -> tuple[DataFrame, DataFrame]:
    e = _events(t).select("event_id", "user_id", "s", "event_type")
    return e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")


@query(f"WITH {_CLICK} SELECT event_id, c.user_id, s, p.t AS at_floor, p.v AS value_floor FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.s >= p.t")
def asof_floor(t):
    a, b = _sides(t)
    return asof.asof(a, b, ["user_id"], "s", "event_id", "floor", 21600)


@query(f"WITH {_CLICK} SELECT event_id, c.user_id, s, p.t AS at_ceiling, p.v AS value_ceiling FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.s <= p.t")
def asof_ceiling(t):
    a, b = _sides(t)
    return asof.asof(a, b, ["user_id"], "s", "event_id", "ceiling", 21600)


@query(f"WITH {_CLICK}, r AS (SELECT event_id, c.user_id, s, p.t, p.v, row_number() OVER (PARTITION BY event_id ORDER BY abs(s - p.t), p.t) AS n FROM c LEFT JOIN p ON c.user_id = p.user_id) SELECT event_id, user_id, s, t AS at_nearest, v AS value_nearest FROM r WHERE n = 1")
def asof_nearest(t):
    a, b = _sides(t)
    return asof.nearest(a, b, ["user_id"], "s", "event_id")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, 'o' || o_orderkey AS nm, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'r' ELSE 'o' END || o_orderkey AS nm, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0)
SELECT * FROM (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN '+' WHEN n.o_orderkey IS NULL THEN '-' WHEN o.nm <> n.nm THEN 'R' WHEN o.o_totalprice <> n.o_totalprice THEN 'M' END AS change, o.nm AS old_name, n.nm AS new_name
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey AND o.o_custkey = n.o_custkey) WHERE change IS NOT NULL""")
def snapshot_diff(t):
    k = F.col("o_orderkey")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old = orders.where(k % 7 != 0).withColumn("nm", F.concat(F.lit("o"), k))
    new = orders.where(k % 13 != 0).withColumn("nm", F.concat(F.when(k % 11 == 0, "r").otherwise("o"), k)).withColumn("o_totalprice", F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return snapshots.diff(old, new, "o_orderkey", "o_custkey", "nm", ["o_totalprice"])


@query("SELECT o_orderkey, 'WRITE' AS op FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey > 5000 UNION ALL SELECT o_orderkey, 'FREE' FROM orders WHERE o_orderstatus = 'F'")
def incremental_delta(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    return snapshots.since(orders, orders.where("o_orderstatus <> 'F'"), "o_orderkey", "o_orderkey", 5000)


@query("WITH v AS (SELECT o_orderkey, o_orderkey AS birth, CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 1000 END AS death FROM orders) SELECT o_orderkey FROM v WHERE birth <= 4000 AND (death IS NULL OR death > 4000)")
def time_travel(t):
    v = t("orders").select("o_orderkey", F.col("o_orderkey").alias("birth"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 1000).alias("death"))
    return snapshots.as_of(v, 4000).select("o_orderkey")


@query("""SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error') AS "left" FROM events GROUP BY ALL HAVING "left" > 0""")
def livelist_cancel(t):
    return snapshots.surviving(t("events").withColumn("k", F.get_json_object("props", "$.k")), ["user_id", "k"], "event_type = 'purchase'", "event_type = 'error'")


@query("SELECT d.doc_id, min(e.doc_id) AS first_id, count(*) AS copies FROM documents d JOIN documents e ON e.text = d.text GROUP BY d.doc_id HAVING count(*) > 1")
def byref_join(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h")).where("h is not null")
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return d.join(first, "h").drop("h")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dict_join(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


def _tree(t) -> DataFrame:
    n = t("nation")
    return (
        t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
        .unionByName(t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))
    )


_TREE = """tree AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
up(id, ancestor, d) AS (SELECT id, id, 0 FROM tree UNION ALL SELECT up.id, t.parent, d + 1 FROM up JOIN tree t ON t.id = up.ancestor WHERE t.parent IS NOT NULL)"""


@query(f"WITH RECURSIVE {_TREE}, loc AS (SELECT id, 'v' || id AS val FROM tree WHERE id IN ('r1', 'r3', 'n2', 'n8', 'n13') OR (id LIKE 'c%' AND substr(id, 2)::BIGINT % 10 = 0)), b AS (SELECT up.id, arg_min(struct_pack(v := val, s := ancestor), d) AS x FROM up JOIN loc ON loc.id = ancestor GROUP BY up.id) SELECT tree.id, coalesce(b.x.v, 'off') AS value, coalesce(b.x.s, 'default') AS source FROM tree LEFT JOIN b USING (id)")
def inherit_property(t):
    tree = _tree(t)
    local = tree.where(F.col("id").isin("r1", "r3", "n2", "n8", "n13") | (F.col("id").startswith("c") & (F.substring("id", 2, 20).try_cast("long") % 10 == 0))).select("id", F.concat(F.lit("v"), "id").alias("value"))
    return hierarchy.inherit(tree, local, "off")


@query(f"WITH RECURSIVE {_TREE}, own AS (SELECT 'c' || o_custkey AS id, count(*) AS n, sum((o_totalprice * 100)::BIGINT) AS cents FROM orders GROUP BY 1) SELECT ancestor AS id, sum(n)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM up JOIN own USING (id) GROUP BY ancestor")
def hierarchy_rollup(t):
    amounts = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return hierarchy.roll_up(_tree(t), amounts, n="count(*)", cents="sum(c)")


@query(f"WITH RECURSIVE {_TREE}, pairs AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey + 1) AS b FROM customer) SELECT a, b, arg_min(x.ancestor, x.d) AS ancestor FROM pairs JOIN up x ON x.id = a JOIN up y ON y.id = b AND y.ancestor = x.ancestor GROUP BY a, b")
def lca(t):
    pairs = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("c"), F.col("c_custkey") + 1).alias("b"))
    return hierarchy.common_ancestor(_tree(t), pairs)


@query("WITH g AS (SELECT sha256(text) AS h, count(*) AS r, max(octet_length(encode(text)))::BIGINT AS size FROM documents GROUP BY 1) SELECT length(bin(r)) - 1 AS bucket, count(*) AS blocks, sum(size)::BIGINT AS bytes, sum(size * r)::BIGINT AS referenced FROM g GROUP BY 1")
def dedup_stats(t):
    g = t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("r"), F.max(F.octet_length("text")).cast("long").alias("size"))
    return g.groupBy(S.bucket("r").cast("long").alias("bucket")).agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"), F.sum(F.col("size") * F.col("r")).alias("referenced"))


@query("WITH g AS (SELECT sha256(text) AS h, count(*) AS r, max(octet_length(encode(text)))::BIGINT AS size FROM documents GROUP BY 1) SELECT floor(100 * sum(size * r) / sum(size))::BIGINT AS percent FROM g")
def dedup_ratio(t):
    g = t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("r"), F.max(F.octet_length("text")).cast("long").alias("size"))
    return g.agg(F.sum(F.col("size") * F.col("r")).alias("a"), F.sum("size").alias("b")).select(S.ratio("a", "b").alias("percent"))


@query("SELECT length(bin(n_chars)) - 1 AS bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars, sum(count(*)) OVER (ORDER BY length(bin(n_chars)) - 1)::BIGINT AS cumulative FROM documents WHERE n_chars >= 1 GROUP BY 1")
def pow2_histogram(t):
    h = t("documents").where("n_chars >= 1").groupBy(S.bucket("n_chars").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return h.withColumn("cumulative", F.sum("n").over(W.orderBy("bucket")))


@query("WITH h AS (SELECT date_diff('day', ts::DATE, DATE '2024-02-01')::BIGINT AS age, count(*) AS n FROM events GROUP BY 1), c AS (SELECT age, n, sum(n) OVER (ORDER BY age DESC) AS older, sum(n) OVER () AS every FROM h) SELECT age, n, older::BIGINT AS older FROM c WHERE older * 100 <= every * 25")
def age_cutoff(t):
    h = t("events").groupBy(F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")).cast("long").alias("age")).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))
    return h.withColumn("older", F.sum("n").over(every.orderBy(F.col("age").desc()))).withColumn("every", F.sum("n").over(every)).where("older * 100 <= every * 25").drop("every")


@query("SELECT 'part' AS kind, l_partkey AS id, count(*) AS objects, sum(l_quantity::BIGINT)::BIGINT AS used FROM lineitem GROUP BY 2 UNION ALL SELECT 'supplier', l_suppkey, count(*), sum(l_quantity::BIGINT)::BIGINT FROM lineitem GROUP BY 2 UNION ALL SELECT 'order', l_orderkey, count(*), sum(l_quantity::BIGINT)::BIGINT FROM lineitem GROUP BY 2")
def accounting_by_kind(t):
    owners = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in (("part", "l_partkey"), ("supplier", "l_suppkey"), ("order", "l_orderkey"))))
    return t("lineitem").select(F.inline(owners), F.col("l_quantity").cast("long").alias("q")).groupBy("kind", "id").agg(F.count("*").alias("objects"), F.sum("q").alias("used"))


@query("WITH u AS (SELECT l_suppkey AS id, sum(l_quantity::BIGINT)::BIGINT AS used FROM lineitem GROUP BY 1), q AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 12000 END AS quota FROM supplier) SELECT coalesce(u.id, q.id) AS id, coalesce(used, 0)::BIGINT AS used, coalesce(quota, 15000)::BIGINT AS quota, coalesce(used, 0) >= coalesce(quota, 15000) AS over FROM u FULL JOIN q ON u.id = q.id")
def over_quota(t):
    used = t("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("used"))
    quota = t("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, 12000).alias("quota"))
    both = used.join(quota, "id", "full_outer").select("id", F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.coalesce("quota", F.lit(15000)).cast("long").alias("quota"))
    return both.withColumn("over", F.col("used") >= F.col("quota"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, (100.0 * count(*) FILTER (event_type = 'error') / count(*))::DOUBLE AS error_percent, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 100 ELSE floor(100 * count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'error')) END::BIGINT AS clicks_per_error FROM events GROUP BY 1")
def conditional_groupby(t):
    g = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select("*", S.percent("errors", "n").alias("error_percent"), S.ratio("clicks", "errors").alias("clicks_per_error"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS used, sum(sum(round(o_totalprice * 100)::BIGINT)) OVER (ORDER BY date_trunc('month', o_orderdate)::DATE)::BIGINT AS through FROM orders GROUP BY 1")
def birth_range_space(t):
    g = t("orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("used"))
    return g.withColumn("through", F.sum("used").over(W.orderBy("month")))


@query("SELECT l_returnflag, b AS bucket, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY b)::BIGINT AS le FROM (SELECT l_returnflag, greatest(12, length(bin(l_extendedprice::BIGINT)) - 1) AS b FROM lineitem) GROUP BY 1, 2")
def cumulative_buckets(t):
    b = F.greatest(F.lit(12), S.bucket(F.round("l_extendedprice").cast("long"))).cast("long")
    return t("lineitem").groupBy("l_returnflag", b.alias("bucket")).agg(F.count("*").alias("n")).withColumn("le", F.sum("n").over(W.partitionBy("l_returnflag").orderBy("bucket")))


@query("WITH r AS (SELECT user_id, event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM events) SELECT user_id % 5 AS grp, arg_min(event_type, p * 1000 + length(event_type)) AS status, min(p)::INTEGER AS precedence FROM r GROUP BY 1")
def health_rollup(t):
    p = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    e = t("events").select((F.col("user_id") % 5).alias("grp"), "event_type", p.alias("p"))
    return e.groupBy("grp").agg(F.min_by("event_type", F.struct("p", F.length("event_type"))).alias("status"), F.min("p").alias("precedence"))


@query("SELECT l_suppkey, bit_xor(l_orderkey) AS parity, count(*) AS n FROM lineitem GROUP BY 1")
def xor_parity(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.bit_xor("l_orderkey").alias("parity"), F.count("*").alias("n"))


@query("SELECT doc_id, length(text)::BIGINT AS n, sum(ord(c))::BIGINT AS a, sum(ord(c)::HUGEINT * (n - i + 1))::BIGINT AS b FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i, length(text) AS n FROM documents WHERE length(text) > 0) GROUP BY doc_id, text")
def order_checksum(t):
    """Running sums a += w, b += a over the characters of a text, in closed form: b weighs each by its distance to the end."""
    d = t("documents").where(F.length("text") > 0).select("doc_id", F.length("text").cast("long").alias("n"), F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("w"))
    a = F.aggregate("w", F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + s["a"] + x).alias("b")))
    return d.select("doc_id", "n", a.alias("s")).select("doc_id", "n", "s.a", "s.b")


@query(f"SELECT event_id, user_id, round(coalesce(value - lag(value) OVER w, 0), 4) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rate_delta_partitioned(t):
    return timeseries.deltas(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", F.round("delta", 4).alias("delta"))


@query("WITH d AS (SELECT ts::DATE AS day, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM events GROUP BY 1) SELECT day, v, (v - coalesce(lag(v) OVER (ORDER BY day), 0))::BIGINT AS delta FROM d")
def rate_delta(t):
    d = t("events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return d.withColumn("delta", F.col("v") - F.coalesce(F.lag("v").over(W.orderBy("day")), F.lit(0)))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def keep_last_n(t):
    return timeseries.keep_last(t("events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id")


@query(f"SELECT event_id, user_id, event_type FROM (SELECT *, {_F} AS s, lag({_F}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR s - p > 14400")
def dup_suppress(t):
    return timeseries.suppress_repeats(_events(t), ["user_id", "event_type"], ["ts", "event_id"], "s", 14400).select("event_id", "user_id", "event_type")


@query('WITH r AS (SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS run FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) SELECT l_suppkey, min(l_partkey) AS "first", max(l_partkey) AS "last", count(*) AS length FROM r GROUP BY l_suppkey, run')
def sequential_streams(t):
    return timeseries.islands(t("lineitem"), ["l_suppkey"], "l_partkey")


_NTH = f"o AS (SELECT *, {_F} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"WITH RECURSIVE {_NTH}, r AS (SELECT user_id, ts, event_id, n, greatest(0, trunc(trunc(value) / 8))::BIGINT AS ewma FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.ts, o.event_id, o.n, greatest(0, r.ewma + trunc((trunc(o.value) - r.ewma) / 8))::BIGINT FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, ts, event_id, ewma FROM r")
def ewma(t):
    return timeseries.moving_average(t("events"), ["user_id"], ["ts", "event_id"], "value", 8)


@query(f"WITH RECURSIVE {_NTH}, r AS (SELECT user_id, ts, event_id, n, s AS b, 1 AS used FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.ts, o.event_id, o.n, CASE WHEN o.s - r.b >= 86400 THEN o.s ELSE r.b END, CASE WHEN o.s - r.b >= 86400 THEN 1 ELSE r.used + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, ts, event_id, used <= 2 AS passed FROM r")
def rate_limit(t):
    return timeseries.limit_rate(_events(t), ["user_id"], ["ts", "event_id"], "s", 86400, 2)


# Times to the quarter of an hour, so some are equal; state: the last time of each tier and the last mark of minutes.
_TIERS = """g AS (SELECT user_id % 40 AS grp, floor(epoch(ts) / 900)::BIGINT * 900 AS s, event_id AS mark FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s, mark) AS n FROM g),
r AS (SELECT grp, s, mark, n, 'month' AS tier, s AS m, NULL::BIGINT AS d, NULL::BIGINT AS i, NULL::BIGINT AS im FROM o WHERE n = 1
 UNION ALL SELECT grp, s, mark, n, tier, CASE tier WHEN 'month' THEN s ELSE m END, CASE tier WHEN 'day' THEN s ELSE d END, CASE tier WHEN 'minute' THEN s ELSE i END, CASE tier WHEN 'minute' THEN mark ELSE im END
 FROM (SELECT o.grp, o.s, o.mark, o.n, r.m, r.d, r.i, r.im, CASE WHEN o.s - r.m >= 2592000 THEN 'month' WHEN r.d IS NULL OR o.s - r.d >= 86400 THEN 'day' WHEN r.i IS NULL OR o.s > r.i OR o.mark > r.im THEN 'minute' END AS tier FROM r JOIN o ON o.grp = r.grp AND o.n = r.n + 1)),
kept AS (SELECT grp, tier, s, coalesce(lead(mark) OVER (PARTITION BY grp, tier, s ORDER BY mark), mark) AS mark, row_number() OVER (PARTITION BY grp, tier ORDER BY s DESC, mark DESC) AS k FROM r WHERE tier IS NOT NULL),
tiers AS (SELECT grp, tier, s, mark FROM kept WHERE k <= 256)"""


def _tiers(t) -> DataFrame:
    g = t("events").select((F.col("user_id") % 40).alias("grp"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900).cast("long").alias("s"), F.col("event_id").alias("mark"))
    return timeseries.tiers(g, ["grp"], "s", "mark")


@query(f"WITH RECURSIVE {_TIERS} SELECT * FROM tiers")
def rrd_tiers(t):
    return _tiers(t)


def _closest(how: str, sign: str, end: str) -> str:
    one = lambda tier: f"(SELECT {end}(struct_pack(s := s, mark := mark)) FROM tiers x WHERE x.grp = q.grp AND x.tier = '{tier}' AND x.s {sign} q.time)"
    return f"""WITH RECURSIVE {_TIERS}, q AS (SELECT DISTINCT l_suppkey % 40 AS grp, epoch(TIMESTAMP '2024-01-01')::BIGINT + 43200 * (l_partkey % 70) AS time FROM lineitem),
c AS (SELECT grp, time, [struct_pack(d := abs(time - month_.s), p := 0, mark := month_.mark), struct_pack(d := abs(time - day_.s), p := 1, mark := day_.mark), struct_pack(d := abs(time - minute_.s), p := 2, mark := minute_.mark)] AS c
 FROM (SELECT *, {one('month')} AS month_, {one('day')} AS day_, {one('minute')} AS minute_ FROM q))
SELECT grp, time, list_min(list_filter(c, lambda x: x.d IS NOT NULL)).mark AS mark FROM c"""


def _asked(t) -> DataFrame:
    return t("lineitem").select((F.col("l_suppkey") % 40).alias("grp"), (F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + 43200 * (F.col("l_partkey") % 70)).alias("time")).distinct()


@query(_closest("floor", "<=", "max"))
def rrd_floor(t):
    return timeseries.closest(_asked(t), _tiers(t), ["grp"], "time", "s", "mark", "floor")




@query("SELECT name, kind, bal, rank() OVER (ORDER BY bal DESC NULLS LAST, name) AS place FROM (SELECT c_name AS name, 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, 's', NULL FROM supplier) ORDER BY bal DESC NULLS LAST, name LIMIT 200")
def typed_sort_topn(t):
    rows = t("customer").select(F.col("c_name").alias("name"), F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal")).unionByName(t("supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind"), F.lit(None).cast("double").alias("bal")))
    order = [F.col("bal").desc_nulls_last(), F.col("name")]
    return rows.orderBy(*order).limit(200).withColumn("place", F.rank().over(W.orderBy(*order)).cast("long"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 50")
def keyset_page(t):
    return t("customer").where("c_custkey > 100").orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'k=' || json_extract_string(props, '$.k') || ';t=' || event_type AS merged FROM events")
def map_merge(t):
    k = F.get_json_object("props", "$.k")
    merged = F.map_concat(F.map_filter(F.create_map(F.lit("k"), k, F.lit("t"), F.lit("none")), lambda a, _: a != "t"), F.create_map(F.lit("t"), F.col("event_type")))
    return t("events").select("event_id", k.cast("long").alias("k"), F.array_join(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("SELECT user_id, k, v FROM (SELECT user_id, json_extract_string(props, '$.k') AS k, arg_max(struct_pack(v := CASE WHEN event_type <> 'error' THEN value END), event_id).v AS v FROM events GROUP BY 1, 2) WHERE v IS NOT NULL")
def upsert_log(t):
    log = t("events").select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return snapshots.latest(log, ["user_id", "k"], "event_id", "v")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def block_stats_rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def block_stats_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT event_type AS type, count(*) AS records, sum(octet_length(encode(props)))::BIGINT AS payload_bytes FROM events GROUP BY ROLLUP (event_type)")
def record_statistics(t):
    return chain.statistics(t("events").select(F.col("event_type").alias("type"), F.col("props").alias("payload")))


@query("WITH r AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM events) SELECT event_id, user_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS depth, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) IN (0, 1) AS valid FROM r")
def nesting_depth(t):
    d = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    depth = F.sum(d).over(W.partitionBy("user_id").orderBy("event_id"))
    return t("events").select("event_id", "user_id", depth.alias("depth"), depth.isin(0, 1).alias("valid"))


def _records(t) -> DataFrame:
    e = t("events")
    kind = F.when(F.col("event_type") == "error", "FREE").when(F.col("event_id") % 4 == 0, "WRITE_BYREF").otherwise("WRITE")
    return e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("object"), F.get_json_object("props", "$.k").cast("long").alias("offset"), F.when(kind == "WRITE_BYREF", None).otherwise(F.col("props")).alias("payload"), (F.col("user_id") - 1).alias("ref_object"), F.get_json_object("props", "$.k").cast("long").alias("ref_offset"))


_RECORDS = "rec AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'FREE' WHEN event_id % 4 = 0 THEN 'WRITE_BYREF' ELSE 'WRITE' END AS type, user_id AS object, json_extract_string(props, '$.k')::BIGINT AS \"offset\", CASE WHEN event_type = 'error' OR event_id % 4 <> 0 THEN props END AS payload FROM events)"


@query(f"WITH {_RECORDS}, f AS (SELECT r.seq, arg_max(w.payload, w.seq) AS p FROM rec r JOIN rec w ON w.type = 'WRITE' AND w.object = r.object - 1 AND w.\"offset\" = r.\"offset\" AND w.seq < r.seq WHERE r.type = 'WRITE_BYREF' GROUP BY r.seq), x AS (SELECT rec.seq, object, \"offset\", CASE WHEN f.p IS NOT NULL THEN 'WRITE' ELSE type END AS type, coalesce(f.p, payload) AS payload FROM rec LEFT JOIN f USING (seq)) SELECT object, \"offset\", r.payload AS payload FROM (SELECT object, \"offset\", arg_max(struct_pack(type := type, payload := payload), seq) AS r FROM x WHERE type IN ('WRITE', 'FREE') GROUP BY 1, 2) WHERE r.type = 'WRITE'")
def stream_apply(t):
    return chain.run(_records(t), chain.resolve_references, chain.apply_writes)


@query(f"WITH {_RECORDS} SELECT seq, type FROM rec WHERE type <> 'FREE' AND NOT (type = 'WRITE' AND object = 3 AND \"offset\" < 50)")
def record_drop(t):
    r = _records(t)
    listed = r.where("object = 3 and offset < 50").select("object", "offset").distinct()
    return chain.run(r, chain.drop_types("FREE"), chain.drop_listed(listed)).select("seq", "type")


@query("SELECT o_orderkey, (o_orderkey & 15)::BIGINT AS low, ((o_orderkey >> 4) & 255)::BIGINT AS mid FROM orders")
def bit_fields(t):
    return t("orders").select("o_orderkey", S.bits("o_orderkey", 0, 4).cast("long").alias("low"), S.bits("o_orderkey", 4, 8).cast("long").alias("mid"))


@query("SELECT c_custkey, 'customer,segment=' || regexp_replace(c_mktsegment, '([,= ])', '\\\\\\1', 'g') || ' nation=' || c_nationkey || 'i' AS line FROM customer")
def influx_lines(t):
    return t("customer").select("c_custkey", F.concat(F.lit("customer,segment="), S.escape_tag("c_mktsegment"), F.lit(" nation="), F.col("c_nationkey"), F.lit("i")).alias("line"))


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#1[1-3]') AND p_size BETWEEN 10 AND 30")
def whole_match_filter(t):
    return t("part").where(F.col("p_brand").rlike(r"^(?:Brand#1[1-3])\z") & F.col("p_size").between(10, 30)).select("p_partkey", "p_brand")


@query("SELECT c_custkey, name, value FROM (UNPIVOT (SELECT c_custkey, c_name, c_mktsegment FROM customer) ON c_name, c_mktsegment INTO NAME name VALUE value)")
def property_rows(t):
    return t("customer").select("c_custkey", "c_name", "c_mktsegment").unpivot(["c_custkey"], ["c_name", "c_mktsegment"], "name", "value")


@query("SELECT l_suppkey, round(stddev_pop(l_quantity), 6) AS sd, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def queue_monitor(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT d.doc_id, sha256(d.text) AS digest FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def unlabelled_digests(t):
    return t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.sha2("text", 256).alias("digest"))
