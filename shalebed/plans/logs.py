"""Queries of logs, listings and values over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.functions import scalars as S
from shalebed.functions import values
from shalebed.operators import intervals, listing, logs
from shalebed.plans.queries import _SPANS, _TREE, _merge, _spans, _tree, query
from shalebed.sources import text


@query(
    f"""WITH {_SPANS.replace('FROM lineitem', ', l_orderkey * 10 + l_linenumber AS seq FROM lineitem')}, days AS (SELECT l_suppkey, seq, CASE l_returnflag WHEN 'R' THEN 'ALLOC' ELSE 'FREE' END AS op, unnest(range("start", "end")) AS d FROM spans),
last AS (SELECT l_suppkey, d AS "start", d + 1 AS "end", row_number() OVER (PARTITION BY l_suppkey, d ORDER BY seq DESC, op) AS k, op FROM days), free AS (SELECT * FROM last WHERE k = 1 AND op = 'FREE')"""
    + _merge("l_suppkey", "free")
)
def free_space_replay(t):
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    log = t("lineitem").select("l_suppkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "ALLOC").otherwise("FREE").alias("op"))
    return intervals.replay(log, ["l_suppkey"], "seq", "op")


@query(f"WITH {_SPANS}, m AS (" + _merge("l_suppkey", "spans").replace(", isl AS", "WITH isl AS", 1) + """), g AS (SELECT l_suppkey, lead("start") OVER (PARTITION BY l_suppkey ORDER BY "start") - "end" AS size FROM m) SELECT length(bin(size)) - 1 AS bucket, count(*) AS n, sum(size)::BIGINT AS total FROM g WHERE size IS NOT NULL GROUP BY 1""")
def free_space_histogram(t):
    g = intervals.gaps(_spans(t), ["l_suppkey"]).withColumn("size", F.col("end") - F.col("start"))
    return g.groupBy(S.bucket("size").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query("SELECT event_id, event_type, (SELECT greatest(100, max(event_id) - 500) - 100 FROM events)::BIGINT AS dropped FROM events WHERE event_id > greatest(100, (SELECT max(event_id) - 500 FROM events)) ORDER BY event_id LIMIT 20")
def event_ring(t):
    return logs.ring_next(t("events"), "event_id", 100, 500, 20).select("event_id", "event_type", "dropped")


@query("""WITH RECURSIVE q AS (SELECT l_suppkey, l_partkey * 40 AS s, l_partkey * 40 + l_quantity::BIGINT AS e FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, e) AS k FROM q),
r AS (SELECT l_suppkey, k, s AS a, e AS b, 1 AS run FROM o WHERE k = 1 UNION ALL SELECT o.l_suppkey, o.k, CASE WHEN o.s - r.b <= 60 AND greatest(o.e, r.b) - r.a <= 1000 THEN r.a ELSE o.s END, CASE WHEN o.s - r.b <= 60 AND greatest(o.e, r.b) - r.a <= 1000 THEN greatest(o.e, r.b) ELSE o.e END, CASE WHEN o.s - r.b <= 60 AND greatest(o.e, r.b) - r.a <= 1000 THEN r.run ELSE r.run + 1 END FROM r JOIN o ON o.l_suppkey = r.l_suppkey AND o.k = r.k + 1)
SELECT l_suppkey, min(a) AS "start", max(b) AS "end", count(*) AS n FROM r GROUP BY l_suppkey, run""")
def io_gather(t):
    r = t("lineitem").select("l_suppkey", (F.col("l_partkey") * 40).alias("start"), (F.col("l_partkey") * 40 + F.col("l_quantity").cast("long")).alias("end"))
    return logs.gather(r, ["l_suppkey"], 60, 1000)


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey < 700, o_orderkey) AS place FROM orders")
def elevator_order(t):
    return logs.elevator(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 700)


@query(
    f"""WITH RECURSIVE {_TREE}, a AS (SELECT id, 'x' AS val FROM tree WHERE id IN ('r1', 'n3')), b AS (SELECT id, CASE id WHEN 'n3' THEN 'x' ELSE 'y' END AS val FROM tree WHERE id IN ('r1', 'n3', 'n8')),
va AS (SELECT up.id, arg_min(val, d) AS v FROM up JOIN a ON a.id = ancestor GROUP BY 1), vb AS (SELECT up.id, arg_min(val, d) AS v FROM up JOIN b ON b.id = ancestor GROUP BY 1)
SELECT tree.id, coalesce(va.v, 'off') AS old, coalesce(vb.v, 'off') AS new FROM tree LEFT JOIN va USING (id) LEFT JOIN vb USING (id) WHERE coalesce(va.v, 'off') <> coalesce(vb.v, 'off')"""
)
def property_changes(t):
    tree = _tree(t)

    def local(**kv: str) -> DataFrame:
        return tree.sparkSession.createDataFrame(list(kv.items()), "id string, value string")

    return logs.inherited_changes(tree, local(r1="x", n3="x"), local(r1="y", n3="x", n8="y"), "off")


@query("WITH w AS (SELECT l_orderkey AS g, l_partkey AS b, unnest(range(0, 64)) AS bit FROM lineitem) SELECT bit::INT AS bit, sum(CASE WHEN (b >> bit) & 1 = 1 AND (g >> bit) & 1 = 0 THEN 1 ELSE 0 END)::BIGINT AS \"set\", sum(CASE WHEN (b >> bit) & 1 = 0 AND (g >> bit) & 1 = 1 THEN 1 ELSE 0 END)::BIGINT AS cleared FROM w WHERE bit < 63 GROUP BY 1 HAVING \"set\" > 0 OR cleared > 0")
def bit_error_histogram(t):
    return logs.bit_errors(t("lineitem"), "l_orderkey", "l_partkey")


@query("WITH n AS (SELECT l_suppkey, l_shipmonth AS name, count(*) AS n, min(l_orderkey) AS o FROM (SELECT *, month(l_shipdate)::VARCHAR AS l_shipmonth FROM lineitem) GROUP BY 1, 2) SELECT l_suppkey, name FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY name = '7' AND l_suppkey % 2 = 0 DESC, n DESC, o) AS k FROM n) WHERE k = 1")
def best_label(t):
    names = t("lineitem").withColumn("name", F.month("l_shipdate").cast("string"))
    return logs.best_name(names.withColumn("want", (F.col("name") == "7") & (F.col("l_suppkey") % 2 == 0)), ["l_suppkey"], "name", "want", "l_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE 1 END::BIGINT AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 5 <> 0")
def log_reload(t):
    """A log of updates (every third key) and removals (every fifth) is flushed by half; base and rest read as before."""
    o = t("orders")
    base = o.select("o_orderkey", F.lit(1).cast("long").alias("seq"), F.col("o_orderstatus").alias("state"))
    log = o.where("o_orderkey % 3 = 0 and o_orderkey % 5 <> 0").select("o_orderkey", F.lit(9).cast("long").alias("seq"), F.lit("late").alias("state"))
    gone = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(5).cast("long").alias("seq"), F.lit(None).cast("string").alias("state"))
    return logs.reload(*logs.flush(base, log.unionByName(gone), "o_orderkey", "seq", "state", 6), "o_orderkey", "seq", "state")


@query("SELECT 0 AS line, rpad('N_NAME', greatest(6, (SELECT max(length(n_name)) FROM nation)::INT), ' ') || '  N_REGIONKEY' AS value UNION ALL SELECT row_number() OVER (ORDER BY n_regionkey DESC, n_name)::INT, rpad(n_name, greatest(6, (SELECT max(length(n_name)) FROM nation)::INT), ' ') || '  ' || lpad(n_regionkey::VARCHAR, 11, ' ') FROM nation")
def listing_lines(t):
    columns = listing.expand("name,all", ["n_name", "n_regionkey"], {"name": ["n_name"]})
    return listing.lines(t("nation"), columns, listing.order([("n_regionkey", False)], name="n_name"), numeric=("n_regionkey",))


@query("SELECT o_orderkey AS object, o_orderstatus AS type FROM orders WHERE (o_orderkey BETWEEN 5 AND 400 AND o_orderstatus = 'F') OR (o_orderkey >= 900 AND o_orderstatus <> 'P') OR o_orderkey = 450")
def object_listing(t):
    o = t("orders").select(F.col("o_orderkey").alias("object"), F.col("o_orderstatus").alias("type"))
    return o.where(listing.object_ranges("5:400:f,900::-p,450", {"f": "F", "o": "O", "p": "P"}))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_path(t):
    return t("events").select("event_id", values.at_path("props", "k", "long").alias("k"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents WHERE text IS NOT NULL")
def unicode_nfc(t):
    return t("documents").where("text is not null").select("doc_id", F.sha2(values.normalize("text"), 256).alias("digest"))


@query("SELECT event_id, 'events,kind=' || event_type || ',who=user\\ ' || user_id || ' id=' || event_id || 'u ' || (epoch_us(ts) * 1000) AS value FROM events")
def line_protocol(t):
    e = t("events").select(F.col("event_type").alias("kind"), F.concat(F.lit("user "), "user_id").alias("who"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return e.select(F.col("id").alias("event_id"), text.line_protocol("events", ["kind", "who"], ["id"], F.col("ts")).alias("value"))
