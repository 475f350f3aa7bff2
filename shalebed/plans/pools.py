"""Queries of whole pools, event streams in batch form, hashes and access, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.functions import hashes, payloads
from shalebed.operators import catalog, listing, versions
from shalebed.plans.catalog import _CAT, _catalog
from shalebed.plans.queries import _RECORDS, _records, query
from shalebed.streaming import events


@query("SELECT 'l' AS dataset, l_orderkey AS birth, l_partkey AS part, NULL::DOUBLE AS price FROM lineitem WHERE l_orderkey > 2000 UNION ALL SELECT 'o', o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderkey > 2000")
def pool_scan(t):
    l = t("lineitem").select(F.col("l_orderkey").alias("birth"), F.col("l_partkey").alias("part"))
    return versions.pool_scan({"o": t("orders").select(F.col("o_orderkey").alias("birth"), F.col("o_totalprice").alias("price")), "l": l}, 2000).select("dataset", "birth", "part", "price")


_VERSIONS = "v AS (SELECT o_orderkey, o_orderkey AS birth, CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 1500 END AS death FROM orders)"


def _versions(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.col("o_orderkey").alias("birth"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 1500).alias("death"))


@query(f"WITH {_VERSIONS} SELECT o_orderkey, birth, CASE WHEN death <= 3000 THEN death END AS death FROM v WHERE birth <= 3000")
def checkpoint_rewind(t):
    return versions.rewind(_versions(t), 3000)


@query(f"WITH {_VERSIONS} SELECT * FROM v WHERE birth <= 3000 AND death > 3000")
def checkpoint_discard(t):
    return versions.held_by_checkpoint(_versions(t), 3000)


_SNAPS = "s AS (SELECT 'tank/r' || c_nationkey % 5 || '/n' || c_nationkey AS dataset, c_custkey::BIGINT AS created, 'tank/r' || c_nationkey % 5 || '/n' || c_nationkey || '@c' || c_custkey AS name FROM customer)"


@query(f"WITH {_SNAPS}, p AS (SELECT dataset, lag(name) OVER (PARTITION BY dataset ORDER BY created, name) AS previous, name AS snapshot, created FROM s) SELECT dataset, previous, snapshot FROM p WHERE created > 40 AND NOT (dataset = 'tank/r1/n6' OR dataset LIKE 'tank/r2/%')")
def send_plan(t):
    fs = F.concat(F.lit("tank/r"), F.col("c_nationkey") % 5, F.lit("/n"), F.col("c_nationkey"))
    c = t("customer").select(F.concat(fs, F.lit("@c"), "c_custkey").alias("name"), F.lit("snapshot").alias("kind"), F.col("c_custkey").cast("long").alias("created"), F.lit(None).cast("string").alias("origin"))
    return versions.send_plan(c, "tank", ("tank/r1/n6", "tank/r2"), 40)


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id BETWEEN 20 AND 900 AND doc_id % 13 = 0")
def scrub(t):
    """Every thirteenth stored digest is of another text."""
    b = t("documents").where("text is not null").select("doc_id", "text", F.col("doc_id").alias("birth"), F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    return versions.scrub(b, "text", "digest", 20, 900).select("doc_id")


@query("""WITH g AS (SELECT c_custkey AS id, 'u' || c_nationkey AS who, 'both' AS scope, unnest(['read', 'write']) AS perm FROM customer),
c AS (SELECT o_orderkey AS seq, o_custkey AS id, 'u' || c_nationkey AS who, 'both' AS scope, CASE o_orderkey % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'send' WHEN 3 THEN 'send' END AS perm, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN 'unset' ELSE 'set' END AS op FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0),
a AS (SELECT id, who, scope, perm, -1 AS seq, 'set' AS op FROM g UNION ALL SELECT id, who, scope, perm, seq, op FROM c),
k AS (SELECT id, who, scope, max(seq) AS cleared FROM a WHERE perm IS NULL GROUP BY ALL), l AS (SELECT id, who, scope, perm, arg_max(op, seq) AS op, max(seq) AS seq FROM a WHERE perm IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT id, who, scope, perm FROM l LEFT JOIN k USING (id, who, scope) WHERE op = 'set' AND (cleared IS NULL OR seq > cleared)""")
def grant_changes(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("u"), "c_nationkey").alias("who"), F.lit("both").alias("scope"))
    k = F.col("o_orderkey") % 5
    perm = F.when(k == 0, "read").when(k == 1, "write").when(k.isin(2, 3), "send")
    changes = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), perm.alias("perm"), F.when(k.isin(0, 1, 4), "unset").otherwise("set").alias("op")).join(c, "id")
    return versions.regrant(c.select("*", F.explode(F.array(F.lit("read"), F.lit("write"))).alias("perm")), changes)


@query("""WITH d AS (SELECT 'c' || o_custkey AS name, sum(o_orderkey)::BIGINT AS used, count(*) AS referenced, sum(o_orderkey * 2)::BIGINT AS logical FROM orders GROUP BY 1), w AS (SELECT 'c' || o_custkey AS name, o_orderstatus AS tag, sum(o_orderkey)::BIGINT AS written FROM orders GROUP BY ALL),
u AS (SELECT 'c' || o_custkey AS name, o_orderkey % 3 AS who, count(*) AS used FROM orders GROUP BY ALL), q AS (SELECT name, unnest(['used', 'referenced', 'ratio', 'written@F', 'userused@1', 'nothing']) AS property FROM d)
SELECT q.name, property, CASE property WHEN 'used' THEN used WHEN 'referenced' THEN referenced WHEN 'ratio' THEN CASE WHEN used > 0 THEN floor(100 * logical / used) ELSE 100 END WHEN 'written@F' THEN (SELECT written FROM w WHERE w.name = q.name AND tag = 'F') WHEN 'userused@1' THEN (SELECT u.used FROM u WHERE u.name = q.name AND who = 1) END::BIGINT AS value FROM q JOIN d USING (name)""")
def computed_properties(t):
    o = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("name"), "o_orderkey", "o_orderstatus")
    d = o.groupBy("name").agg(F.sum("o_orderkey").alias("used"), F.count("*").alias("referenced"), F.sum(F.col("o_orderkey") * 2).alias("logical"))
    w = o.groupBy("name", F.col("o_orderstatus").alias("tag")).agg(F.sum("o_orderkey").alias("written"))
    u = o.groupBy("name", (F.col("o_orderkey") % 3).alias("who")).agg(F.count("*").alias("used"))
    asked = d.select("name", F.explode(F.array(*map(F.lit, ("used", "referenced", "ratio", "written@F", "userused@1", "nothing")))).alias("property"))
    return versions.computed(d, asked, w, u)


@query(f"WITH {_CAT}, q AS (SELECT 'tank/s' || c_custkey AS name FROM customer) SELECT name, name IN (SELECT name FROM cat) AS exists FROM q")
def names_exist(t):
    return versions.exists(_catalog(t), t("customer").select(F.concat(F.lit("tank/s"), "c_custkey").alias("name")))


@query("SELECT event_type AS kind, count(*) AS records, sum(octet_length(encode(props)))::BIGINT AS bytes, min(event_id) AS \"first\", max(event_id) AS \"last\" FROM events GROUP BY ROLLUP (event_type)")
def intent_log(t):
    return versions.log_records(t("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("props").alias("payload")))


@query(f"WITH {_RECORDS} SELECT seq, type || ' object = ' || object || ' offset = ' || \"offset\" || ' length = ' || coalesce(octet_length(encode(payload)), 0) || CASE WHEN payload IS NOT NULL THEN ' data = ' || lower(hex(encode(substr(payload, 1, 16)))) || ' |' || substr(payload, 1, 16) || '|' ELSE '' END AS text FROM rec")
def record_dump(t):
    return versions.record_dump(_records(t))


@query("SELECT l_suppkey, round(exp(avg(ln(l_quantity))), 6) AS mean FROM lineitem GROUP BY 1")
def geometric_means(t):
    return t("lineitem").groupBy("l_suppkey").agg(versions.geometric_mean("l_quantity").alias("mean")).withColumn("mean", F.round("mean", 6))


@query("SELECT l_suppkey, quantile_cont(l_quantity, 0.5) AS median, round(quantile_cont(l_quantity, 0.9), 6) AS tail, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def percentiles(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"), F.round(F.percentile("l_quantity", F.lit(0.9)), 6).alias("tail"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    return t("events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([b, b - INTERVAL '3 hours']) AS start FROM (SELECT event_type, time_bucket(INTERVAL '3 hours', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY 1, 2")
def sliding_windows(t):
    return t("events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "6 hours", "3 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP >= lag(ts::TIMESTAMP) OVER w + INTERVAL '12 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    s = t("events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, user_id FROM (SELECT *, max(epoch(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events) WHERE newest - epoch(ts) > 3600")
def late_events(t):
    """Events that come, by their number, when one of their user over an hour newer has been seen."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.max(at).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    return t("events").withColumn("newest", before).where(F.col("newest") - at > 3600 * 1_000_000).select("event_id", "user_id")


@query("SELECT event_id, 'click' AS handler FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'all' FROM events UNION ALL SELECT event_id, 'view' FROM events WHERE event_type = 'view'")
def event_classes(t):
    e = t("events").select("event_id", F.concat(F.lit("pool.device."), "event_type").alias("class"))
    out = [events.matching(e, name, "class").select("event_id", F.lit(name.split("-")[0]).alias("handler")) for name in ("click-mail", "all-log", "view-count")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT user_id, max(event_id) AS applied, count(*) FILTER (event_id > 500) AS again FROM events GROUP BY 1")
def replay_once(t):
    log = t("events").select("user_id", "event_id")
    applied = log.where("event_id <= 500").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    new = events.replay_once(log, applied, "event_id", ["user_id"])
    return log.groupBy("user_id").agg(F.max("event_id").alias("applied")).join(new.groupBy("user_id").agg(F.count("*").alias("again")), "user_id", "left").select("user_id", "applied", F.coalesce("again", F.lit(0)).alias("again"))


@query(f"WITH {_CAT}, h AS (SELECT replace(name, 's1', '$s1') AS name, kind FROM cat) SELECT * FROM h WHERE name NOT LIKE '%$%'")
def visible_names(t):
    return catalog.visible(_catalog(t).withColumn("name", F.regexp_replace("name", "s1", "\\$s1"))).select("name", "kind")


@query(f"WITH {_CAT} SELECT name, kind, created FROM cat WHERE name LIKE 'tank/all@c%' UNION ALL SELECT 'tank/all#m', 'bookmark', 7")
def bookmark_listing(t):
    marked = catalog.bookmark(_catalog(t), "tank/all@c7", "m")
    return catalog.children(marked, "tank/all", kinds=("snapshot", "bookmark")).select("name", "kind", "created")


@query("SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def pool_order(t):
    names = t("part").select(F.col("p_brand").alias("name")).distinct()
    return names.withColumn("place", F.row_number().over(W.orderBy(*listing.order([]))))


@query("SELECT c_custkey, ((((s + 4242) % m * 131072 + (s + 4242) // 140737488355328) % m + s) % m)::VARCHAR AS draw FROM (SELECT *, c_custkey::UHUGEINT * 1000003 AS s, 18446744073709551616::UHUGEINT AS m FROM customer)")
def seeded_draws(t):
    draw = hashes.first_draw(F.col("c_custkey") * 1000003, 4242)
    return t("customer").select("c_custkey", F.conv(draw.cast("string"), 10, 10).alias("draw"))


@query("SELECT c_custkey, 28::BIGINT AS total, 8 AS distinct_ FROM customer")
def seeded_permutations(t):
    p = t("customer").select("c_custkey", hashes.permutation("c_custkey", 7, 8).alias("p"))
    return p.select("c_custkey", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.array_distinct("p")).alias("distinct_"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def sealed_payloads(t):
    """Texts encrypted with a key each and decrypted again."""
    d = t("documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("p"), F.substring(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), 1, 32).alias("key"))
    sealed = d.select("doc_id", "key", payloads.encrypt("p", F.col("key")).alias("c"))
    return sealed.select("doc_id", F.sha2(payloads.decrypt("c", F.col("key")), 256).alias("digest"))
