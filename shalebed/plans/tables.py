"""Queries of key/value tables, content tables, dead lists, history, devices, streams and counters, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.operators import counters, deadlists, dedup, devices, history, intervals, replication, snapshots, tables
from shalebed.plans.queries import _TREE, _tree, query

_KV = "kv AS (SELECT c_name AS key, c_nationkey::BIGINT AS value FROM customer)"


def _kv(t) -> DataFrame:
    return t("customer").select(F.col("c_name").alias("key"), F.col("c_nationkey").cast("long").alias("value"))


@query(f"WITH {_KV}, w AS (SELECT upper(c_name) AS key FROM customer UNION ALL SELECT 'customer#' || (c_custkey + 100000000) FROM customer) SELECT w.key, (SELECT min(value) FROM kv WHERE lower(kv.key) = lower(w.key)) AS value FROM w")
def table_read(t):
    wanted = t("customer").select(F.upper("c_name").alias("key")).unionByName(t("customer").select(F.concat(F.lit("customer#"), F.col("c_custkey") + 100000000).alias("key")))
    return tables.read(_kv(t), wanted, "key", "value", F.lower)


@query(f"WITH {_KV}, w AS (SELECT unnest(range(40)) AS value) SELECT w.value, min(kv.key) AS key FROM w LEFT JOIN kv ON kv.value & 7 = w.value & 7 GROUP BY 1")
def table_reverse(t):
    kv = _kv(t)
    return tables.reverse(kv, kv.sparkSession.range(40).select(F.col("id").alias("value")), "key", "value", 7)


@query("SELECT l_suppkey AS key, sum(d)::BIGINT AS value FROM (SELECT l_suppkey, l_quantity::BIGINT AS d FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, -l_quantity::BIGINT FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1 HAVING sum(d) <> 0")
def table_increment(t):
    side = lambda flag, sign: t("lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("key")).agg((sign * F.sum(F.col("l_quantity").cast("long"))).alias("value"))
    return tables.increment(side("A", 1), side("R", -1), "key", "value")


@query("WITH k AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT o_custkey AS key, max(o_orderkey) AS value FROM orders GROUP BY 1) SELECT n.key, n.value, n.key IN (SELECT key FROM k) AS refused FROM n")
def table_add(t):
    had = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("value"))
    new = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("value"))
    whole, refused = tables.add(had, new, "key", "value")
    return whole.join(new, ["key", "value"]).withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query("SELECT c_name, c_custkey, substr(md5(c_name), 1, 16) AS hash FROM customer WHERE substr(md5(c_name), 1, 16) > '8000000000000000' ORDER BY hash, c_name LIMIT 100")
def hash_cursor(t):
    return tables.page(t("customer").select("c_name", "c_custkey"), "c_name", ("8000000000000000", "￿"), 100)


@query("""WITH l AS (SELECT substr(md5(o_clerk_key), 1, 2) AS leaf, count(*) AS n FROM (SELECT ('k' || o_orderkey) AS o_clerk_key FROM orders) GROUP BY 1), e AS (SELECT 'k' || o_orderkey AS k FROM orders)
SELECT 'leaf' AS what, (length(bin(n)) - 1)::BIGINT AS size, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'entry', ceil(octet_length(encode(k)) / 3.0)::BIGINT, count(*) FROM e GROUP BY 2""")
def table_shape(t):
    return tables.shape(t("orders").select(F.concat(F.lit("k"), "o_orderkey").alias("key")), "key", 8, 3)


@query("""WITH x AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS size, CASE WHEN user_id % 3 = 0 THEN props END AS target, CASE WHEN event_id % 5 < 2 THEN 1 END AS flags FROM events),
a AS (SELECT *, list_filter(['size' , 'target', 'flags'], lambda n: (n = 'size' AND size IS NOT NULL) OR (n = 'target' AND target IS NOT NULL) OR (n = 'flags' AND flags IS NOT NULL)) AS attributes FROM x)
SELECT substr(md5(array_to_string(attributes, ',')), 1, 8) AS layout, array_to_string(attributes, ',') AS attributes, count(*) AS objects FROM a GROUP BY 1, 2""")
def attribute_layouts(t):
    x = t("events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("size"), F.when(F.col("user_id") % 3 == 0, F.col("props")).alias("target"), F.when(F.col("event_id") % 5 < 2, 1).alias("flags"))
    return tables.layouts(x, ["size", "target", "flags"])[1].withColumn("attributes", F.array_join("attributes", ","))


@query("SELECT event_id AS object, 'size' AS name, event_type AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'flags', user_id::VARCHAR FROM events")
def attribute_reads(t):
    return tables.attributes(t("events").select(F.col("event_id").alias("object"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("size"), F.col("user_id").alias("flags")), ["size", "flags"])


_ENTRIES = "b AS (SELECT doc_id, sha256(text) AS checksum, octet_length(encode(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL), e AS (SELECT CASE WHEN count(*) > 1 THEN 'duplicate' ELSE 'unique' END AS class, checksum, size, count(*) AS refs FROM b GROUP BY 2, 3)"


def _blocks(t) -> DataFrame:
    return t("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").cast("long").alias("size"))


@query(f"WITH {_ENTRIES} SELECT * FROM e WHERE (class, checksum) > ('duplicate', 'c') ORDER BY class, checksum, size LIMIT 60")
def dedup_cursor(t):
    return dedup.page(dedup.entries(_blocks(t), "checksum", "size"), ("duplicate", "c", 0), 60)


@query(f"WITH {_ENTRIES} SELECT class, count(*) AS entries, sum(refs)::BIGINT AS refs FROM e GROUP BY ROLLUP (class)")
def dedup_totals(t):
    return dedup.totals(dedup.entries(_blocks(t), "checksum", "size"))


@query(f"WITH {_ENTRIES}, old AS (SELECT DISTINCT checksum FROM b WHERE doc_id % 3 = 0) SELECT doc_id, checksum IN (SELECT checksum FROM old) OR row_number() OVER (PARTITION BY checksum ORDER BY doc_id) > 1 AS found FROM b WHERE doc_id % 3 <> 0")
def dedup_write(t):
    b = _blocks(t)
    table = dedup.entries(b.where("doc_id % 3 = 0"), "checksum", "size")
    return dedup.write(table, b.where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "seq"), "checksum", "size").select(F.col("seq").alias("doc_id"), "found")


@query(f"""WITH {_ENTRIES}, l AS (SELECT checksum, size, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE 1 END AS delta FROM b WHERE doc_id % 4 < 2), d AS (SELECT checksum, size, sum(delta) AS d FROM l GROUP BY ALL)
SELECT CASE WHEN refs + coalesce(d, 0) > 1 THEN 'duplicate' ELSE 'unique' END AS class, checksum, size, (refs + coalesce(d, 0))::BIGINT AS refs, class AS was FROM e LEFT JOIN d USING (checksum, size) WHERE refs + coalesce(d, 0) > 0""")
def dedup_flush(t):
    b = _blocks(t)
    log = b.where("doc_id % 4 < 2").select("checksum", "size", F.when(F.col("doc_id") % 4 == 0, -1).otherwise(1).alias("delta"))
    return dedup.flush(dedup.entries(b, "checksum", "size"), log)


@query(f"WITH {_ENTRIES} SELECT class, checksum, size, refs FROM (SELECT *, row_number() OVER (ORDER BY checksum) AS k FROM e) WHERE k > 25")
def take_first(t):
    return dedup.take_first(dedup.entries(_blocks(t), "checksum", "size"), ["checksum"], 25)[1].select("class", "checksum", "size", "refs")


@query("""WITH t AS (SELECT l_partkey AS block, count(*) AS refs FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), a AS (SELECT l_partkey AS block, sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END) AS d FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT coalesce(t.block, a.block) AS block, (coalesce(refs, 0) + coalesce(d, 0))::BIGINT AS refs FROM t FULL JOIN a ON t.block = a.block WHERE coalesce(refs, 0) + coalesce(d, 0) > 0""")
def clone_pending(t):
    l = t("lineitem").select(F.col("l_partkey").alias("block"), "l_returnflag")
    return dedup.pending(l.where("l_returnflag = 'N'").groupBy("block").agg(F.count("*").alias("refs")), l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'R'"))


@query("WITH s AS (SELECT l_partkey, max(l_quantity)::BIGINT AS s, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT coalesce(sum(s), 0)::BIGINT AS used, coalesce(sum(s * (n - 1)), 0)::BIGINT AS saved, CASE WHEN coalesce(sum(s), 0) = 0 THEN 100 ELSE floor(sum(s * n) * 100 / sum(s)) END::BIGINT AS ratio FROM s")
def clone_savings(t):
    return dedup.savings(t("lineitem").withColumn("q", F.col("l_quantity").cast("long")), "l_partkey", "q")


@query("WITH f AS (SELECT l_orderkey AS file, l_linenumber AS blkid, max(l_partkey) AS block FROM lineitem GROUP BY ALL), o AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem) SELECT file, blkid, block FROM f, o WHERE NOT (file = o.b AND blkid BETWEEN 2 AND 3) UNION ALL SELECT o.b, blkid + 1, block FROM f, o WHERE file = o.a AND blkid BETWEEN 1 AND 2")
def clone_range(t):
    f = t("lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("blkid")).agg(F.max("l_partkey").alias("block"))
    ends = f.agg(F.min("file").alias("a"), F.max("file").alias("b")).first()
    return dedup.clone_range(f, ends["a"], 1, ends["b"], 2, 2)


@query("WITH r AS (SELECT l_suppkey AS device, l_partkey AS \"offset\", count(*) AS refs FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) SELECT l_orderkey, l_linenumber, coalesce(refs, 0)::BIGINT AS refs FROM lineitem LEFT JOIN r ON device = l_suppkey AND \"offset\" = l_partkey")
def clone_lookup(t):
    l = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("device"), F.col("l_partkey").alias("offset"))
    return dedup.referenced(l, l.where("l_linenumber = 1").groupBy("device", "offset").agg(F.count("*").alias("refs"))).select("l_orderkey", "l_linenumber", "refs")


@query("SELECT a.doc_id, CASE WHEN a.text <> b.text THEN false WHEN a.doc_id % 2 = 0 THEN true END AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL")
def provably_same(t):
    b = _blocks(t).select("doc_id", F.struct("checksum", "size", (F.col("doc_id") % 2 == 0).alias("strong")).alias("a"))
    other = b.select((F.col("doc_id") - 1).alias("doc_id"), F.struct("a.checksum", "a.size", F.lit(True).alias("strong")).alias("b"))
    return b.join(other, "doc_id").select("doc_id", dedup.same_content("a", "b").alias("same"))


@query("SELECT l_orderkey, l_linenumber, NOT (l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 1) AS rewrite FROM lineitem")
def rewrite_predicate(t):
    b = t("lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_returnflag").alias("checksum"), F.col("l_linestatus").alias("compression"), F.col("l_linenumber").alias("copies")).alias("block"))
    return b.select("l_orderkey", "l_linenumber", dedup.needs_rewrite("block", {"checksum": "N", "compression": "O", "copies": 1}).alias("rewrite"))


_DEAD = """m AS (SELECT n_nationkey AS list, k * 700::BIGINT AS mark FROM nation, (SELECT unnest(range(1, 20)) AS k)),
d AS (SELECT o_custkey % 25 AS list, o_orderkey AS block, o_orderkey::BIGINT AS birth, round(o_totalprice)::BIGINT AS size FROM orders),
b AS (SELECT d.*, coalesce((SELECT max(mark) FROM m WHERE m.list = d.list AND mark < birth), 0)::BIGINT AS bucket FROM d)"""


def _dead(t) -> tuple[DataFrame, DataFrame]:
    marks = t("nation").select(F.col("n_nationkey").cast("long").alias("list"), F.explode(F.sequence(F.lit(1), F.lit(19))).alias("k")).select("list", (F.col("k") * 700).cast("long").alias("mark"))
    dead = t("orders").select((F.col("o_custkey") % 25).cast("long").alias("list"), F.col("o_orderkey").alias("block"), F.col("o_orderkey").cast("long").alias("birth"), F.round("o_totalprice").cast("long").alias("size"))
    return deadlists.bucketed(dead, marks), marks


@query(f"WITH {_DEAD} SELECT * FROM b")
def dead_buckets(t):
    return _dead(t)[0]


@query(f"WITH {_DEAD} SELECT list, count(*) AS blocks, sum(size)::BIGINT AS bytes FROM b WHERE birth > 1000 AND birth <= 5000 GROUP BY 1")
def dead_space(t):
    return deadlists.space(_dead(t)[0], 1000, 5000)


@query(f"WITH {_DEAD} SELECT CASE WHEN list = 3 THEN 5 ELSE list END AS list, block, birth, size, CASE WHEN list = 3 THEN coalesce((SELECT max(mark) FROM m WHERE m.list = 5 AND mark < birth), 0) ELSE bucket END::BIGINT AS bucket FROM b")
def dead_merge(t):
    lists, marks = _dead(t)
    return deadlists.merge(lists, 3, 5, marks)


@query(f"WITH {_DEAD} SELECT list, block, birth, size, CASE WHEN list = 7 AND bucket = 1400 THEN 700 ELSE bucket END::BIGINT AS bucket FROM b")
def dead_drop_mark(t):
    lists, marks = _dead(t)
    return deadlists.drop_mark(lists, 7, 1400, marks)


@query(f"WITH RECURSIVE {_TREE}, b AS (SELECT 'c' || o_custkey AS list, o_orderkey AS block FROM orders) SELECT b.list, block FROM b JOIN up ON up.id = b.list AND up.ancestor = 'r2'")
def block_list_nested(t):
    return deadlists.free(t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("list"), F.col("o_orderkey").alias("block")), _tree(t), "r2")


_CHANGED = "c AS (SELECT l_suppkey AS object, l_linenumber AS snapshot, unnest(range(l_partkey, l_partkey + l_quantity::BIGINT)) AS x FROM lineitem WHERE l_linenumber <= 3), r AS (SELECT object, x FROM c GROUP BY ALL HAVING count(DISTINCT snapshot) = 3), g AS (SELECT object, x, x - row_number() OVER (PARTITION BY object ORDER BY x) AS island FROM r), ranges AS (SELECT object, min(x) AS \"start\", max(x) + 1 AS \"end\" FROM g GROUP BY object, island)"


def _redacted(t) -> DataFrame:
    c = t("lineitem").where("l_linenumber <= 3").select(F.col("l_suppkey").alias("object"), F.col("l_linenumber").alias("snapshot"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return deadlists.redaction(c, ["object"], 3)


@query(f"WITH {_CHANGED} SELECT * FROM ranges")
def redaction_list(t):
    return _redacted(t)


@query(f"WITH {_CHANGED} SELECT object, CASE WHEN object = 4 AND \"start\" < 60 THEN 60 ELSE \"start\" END AS \"start\", \"end\" FROM ranges WHERE object > 4 OR (object = 4 AND \"end\" > 60)")
def redaction_resume(t):
    return deadlists.redacted_after(_redacted(t), 4, 60)


@query(f"WITH RECURSIVE {_TREE}, q AS (SELECT 'r' || (4 - r_regionkey) AS root, r_regionkey::BIGINT AS place FROM region) SELECT place, up.id, d AS distance FROM up JOIN q ON up.ancestor = q.root WHERE place > 1 OR (place = 1 AND up.id > 'n13') ORDER BY place, up.id LIMIT 40")
def tree_queue(t):
    roots = t("region").select(F.concat(F.lit("r"), 4 - F.col("r_regionkey")).alias("id"), F.col("r_regionkey").cast("long").alias("place"))
    return deadlists.queue_page(_tree(t), roots, (1, "n13"), 40)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def healed_errors(t):
    good = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return deadlists.healed(t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), good, ["o_orderkey"])


_LOG = "log AS (SELECT event_id AS at_, ts::TIMESTAMP AS time, CASE event_type WHEN 'error' THEN 'internal' ELSE 'command' END AS kind, 'u' || user_id AS who, 'h' || user_id % 3 AS host, event_type || ' ' || props AS text FROM events)"


def _log(t) -> DataFrame:
    return t("events").select(F.col("event_id").alias("at"), F.col("ts").cast("timestamp").alias("time"), F.when(F.col("event_type") == "error", "internal").otherwise("command").alias("kind"), F.concat(F.lit("u"), "user_id").alias("who"), F.concat(F.lit("h"), F.col("user_id") % 3).alias("host"), F.concat("event_type", F.lit(" "), "props").alias("text"))


@query(f"WITH {_LOG} SELECT strftime(time, '%Y-%m-%d.%H:%M:%S') || ' ' || text || ' [user ' || who || ' on ' || host || ']' AS line FROM log WHERE kind = 'command'")
def history_lines(t):
    return _log(t).where(history.shown()).select(history.line(long=True).alias("line"))


@query(f"WITH {_LOG} SELECT strftime(time, '%Y-%m-%d.%H:%M:%S') || ' ' || CASE kind WHEN 'command' THEN text ELSE '[internal] ' || text END AS line FROM log WHERE at_ > 500 ORDER BY at_ LIMIT 70")
def history_page(t):
    return history.page(_log(t), 500, 70).where(history.shown(internal=True)).select(history.line().alias("line"))


@query(f"WITH {_LOG}, s AS (SELECT *, sum(octet_length(encode(text))) OVER (ORDER BY at_ DESC) AS after FROM log) SELECT at_ AS event, kind FROM s WHERE after <= 9000 OR at_ = (SELECT min(at_) FROM log)")
def history_ring(t):
    log = _log(t)
    return history.append(log.where("at <= 700"), log.where("at > 700"), 9000).select(F.col("at").alias("event"), "kind")


@query(f"WITH RECURSIVE {_TREE} SELECT id, max(d) AS depth, string_agg(ancestor, '/' ORDER BY d DESC) AS path FROM up GROUP BY 1")
def device_walk(t):
    return devices.walk(_tree(t)).withColumn("path", F.array_join("path", "/"))


_STATES = "['FAULTED','UNAVAIL','REMOVED','OFFLINE','DEGRADED','ONLINE']"


@query(f"WITH RECURSIVE {_TREE}, s AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN 0 WHEN c_custkey % 53 = 0 THEN 3 WHEN c_custkey % 11 = 0 THEN 4 ELSE 5 END AS r FROM customer) SELECT ancestor AS id, ({_STATES})[min(r) + 1] AS state FROM up JOIN s USING (id) GROUP BY 1")
def device_health(t):
    k = F.col("c_custkey")
    states = t("customer").select(F.concat(F.lit("c"), k).alias("id"), F.when(k % 97 == 0, "FAULTED").when(k % 53 == 0, "OFFLINE").when(k % 11 == 0, "DEGRADED").otherwise("ONLINE").alias("state"))
    return devices.health(_tree(t), states)


@query(f"WITH RECURSIVE {_TREE}, l AS (SELECT 'c' || o_custkey AS id, o_orderkey AS a, o_orderkey * 2 AS s, 1 AS o, round(o_totalprice)::BIGINT AS b, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS e FROM orders), lv AS (SELECT id FROM up GROUP BY id HAVING max(d) = 1) SELECT ancestor AS id, sum(a)::BIGINT AS alloc, (sum(s) - sum(a))::BIGINT AS free, sum(o)::BIGINT AS ops, sum(b)::BIGINT AS bytes, sum(e)::BIGINT AS errors FROM up JOIN l USING (id) WHERE ancestor IN (SELECT id FROM lv) GROUP BY 1")
def device_summary(t):
    leaves = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("o_orderkey").alias("alloc"), (F.col("o_orderkey") * 2).alias("space"), F.lit(1).alias("ops"), F.round("o_totalprice").cast("long").alias("bytes"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("errors"))
    return devices.summary(_tree(t), leaves, 1)


_SAMPLES = "s AS (SELECT user_id % 6 AS device, floor(epoch(ts) / 21600)::BIGINT * 21600 AS sample, count(*) AS n, sum(round(value)::BIGINT) AS v FROM events GROUP BY 1, 2), c AS (SELECT device, sample, sum(n) OVER w AS ops, sum(v) OVER w AS bytes FROM s WINDOW w AS (PARTITION BY device ORDER BY sample))"


@query(f"WITH {_SAMPLES} SELECT device, sample, round((ops - lag(ops) OVER w)::DOUBLE / (sample - lag(sample) OVER w), 9) AS ops, round((bytes - lag(bytes) OVER w)::DOUBLE / (sample - lag(sample) OVER w), 9) AS bytes FROM c WINDOW w AS (PARTITION BY device ORDER BY sample) QUALIFY lag(sample) OVER w IS NOT NULL")
def sampled_rates(t):
    s = t("events").groupBy((F.col("user_id") % 6).alias("device"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600) * 21600).alias("sample")).agg(F.count("*").alias("n"), F.sum(F.round("value").cast("long")).alias("v"))
    line = W.partitionBy("device").orderBy("sample")
    c = s.select("device", "sample", F.sum("n").over(line).alias("ops"), F.sum("v").over(line).alias("bytes"))
    return devices.sampled(c, ["device"], "sample", ["ops", "bytes"], skip_first=True).select("device", "sample", F.round("ops", 9).alias("ops"), F.round("bytes", 9).alias("bytes"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN sum(round(value)::BIGINT)::DOUBLE / count(*) FILTER (event_type = 'click') ELSE 0 END AS average FROM events GROUP BY 1")
def average_latency(t):
    rows = t("events").select("user_id", F.round("value").cast("long").alias("time"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("n"))
    return devices.latency(rows, ["user_id"], "time", "n")


@query("SELECT ts::DATE AS day, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'click') AS writes, sum(CASE event_type WHEN 'click' THEN round(value)::BIGINT ELSE 0 END)::BIGINT AS nwritten FROM events GROUP BY 1")
def group_counters(t):
    kind = F.col("event_type")
    return t("events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_if(kind == "view").alias("reads"), F.count_if(kind == "click").alias("writes"), F.sum(F.when(kind == "click", F.round("value").cast("long")).otherwise(0)).alias("nwritten"))


@query("WITH l AS (SELECT l_suppkey AS guid, l_partkey AS device, l_orderkey AS txg, l_linenumber AS time, l_orderkey || '/' || l_linenumber AS config FROM lineitem), b AS (SELECT guid, arg_max(config, txg * 10 + time) AS config, max(txg) AS txg, count(DISTINCT device) AS devices FROM l GROUP BY 1) SELECT * FROM b")
def newest_labels(t):
    l = t("lineitem").select(F.col("l_suppkey").alias("guid"), F.col("l_partkey").alias("device"), F.col("l_orderkey").alias("txg"), F.col("l_linenumber").alias("time"), F.concat("l_orderkey", F.lit("/"), "l_linenumber").alias("config"))
    return devices.newest_labels(l, "guid", "device")


@query("""WITH p AS (SELECT CASE p_partkey % 4 WHEN 0 THEN '/dev/disk/by-id/d' || p_partkey || 'x-part1' WHEN 1 THEN '/dev/d' || p_partkey || 'x' WHEN 2 THEN '/mnt/d' || p_partkey || 'x' ELSE '/dev/mapper/d' || p_partkey || 'xp1' END AS path FROM part), s AS (SELECT 'd' || s_suppkey || 'x' AS name FROM supplier)
SELECT name, path FROM s JOIN p ON regexp_full_match(path, '/dev(/disk/by-id|/mapper)?/' || name || '(-part1|p1)?')""")
def device_paths(t):
    k = F.col("p_partkey")
    d = F.concat(F.lit("d"), k, F.lit("x"))
    paths = t("part").select(F.when(k % 4 == 0, F.concat(F.lit("/dev/disk/by-id/"), d, F.lit("-part1"))).when(k % 4 == 1, F.concat(F.lit("/dev/"), d)).when(k % 4 == 2, F.concat(F.lit("/mnt/"), d)).otherwise(F.concat(F.lit("/dev/mapper/"), d, F.lit("p1"))).alias("path"))
    return devices.match_paths(t("supplier").select(F.concat(F.lit("d"), "s_suppkey", F.lit("x")).alias("name")), paths)


@query("SELECT l_suppkey AS pool, string_agg(DISTINCT f, ',' ORDER BY f) AS missing FROM (SELECT l_suppkey, l_returnflag || l_linenumber AS f FROM lineitem WHERE l_quantity > 45) WHERE f NOT IN ('A1', 'N1', 'R1', 'N2') GROUP BY 1")
def missing_features(t):
    p = t("lineitem").select(F.col("l_suppkey").alias("pool"), F.concat("l_returnflag", "l_linenumber").alias("feature"), F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("refs"))
    return devices.missing_features(p, ["A1", "N1", "R1", "N2"]).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH RECURSIVE {_TREE}, f AS (SELECT id, CASE WHEN id LIKE 'c%' THEN substr(id, 2)::BIGINT % 4 WHEN id = 'r1' THEN 2 ELSE length(id) END::BIGINT AS project, id < 'n2' AS inherit, id NOT LIKE 'c%' AS directory FROM tree) SELECT f.id, project, inherit FROM f JOIN up ON up.id = f.id AND ancestor = 'r1' WHERE project <> 2 OR (directory AND NOT inherit)")
def other_projects(t):
    i = F.col("id")
    files = _tree(t).select("id", F.when(i.startswith("c"), F.substring("id", 2, 20).try_cast("long") % 4).when(i == "r1", 2).otherwise(F.length("id")).cast("long").alias("project"), (i < "n2").alias("inherit"), (~i.startswith("c")).alias("directory"))
    return devices.other_projects(_tree(t), files, "r1")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events")
def enriched_columns(t):
    out = t("events").select("event_id", F.concat(F.lit("k="), F.get_json_object("props", "$.k"), F.lit(" kind="), "event_type", F.lit(" noise\nk=0")).alias("output"))
    return devices.enriched(out, "event_id", "output", ["k", "kind"])


_VERSIONS = """o AS (SELECT o_custkey AS object, o_orderkey % 40 AS blkid, max(o_orderkey) AS birth, 100::BIGINT AS size FROM orders WHERE o_orderkey < 4000 AND o_custkey % 9 <> 0 GROUP BY ALL),
n AS (SELECT o_custkey AS object, o_orderkey % 40 AS blkid, max(o_orderkey) AS birth, 100::BIGINT AS size FROM orders WHERE o_custkey % 7 <> 0 AND o_orderkey % 40 > 5 GROUP BY ALL),
w AS (SELECT * FROM n WHERE birth > 3000), go AS (SELECT DISTINCT object FROM o WHERE object NOT IN (SELECT object FROM n)), gr AS (SELECT object, object - row_number() OVER (ORDER BY object) AS island FROM go),
h AS (SELECT object, blkid, blkid - row_number() OVER (PARTITION BY object ORDER BY blkid) AS island FROM o WHERE object NOT IN (SELECT object FROM go) AND (object, blkid) NOT IN (SELECT (object, blkid) FROM n)),
rec AS (SELECT min(object)::BIGINT AS object, 'FREEOBJECTS' AS kind, 0::BIGINT AS "offset", count(*)::BIGINT AS length FROM gr GROUP BY island UNION ALL SELECT object, 'OBJECT', 0, 0 FROM (SELECT object FROM w UNION SELECT object FROM h) UNION ALL SELECT object, 'FREE', min(blkid) * 100, count(*) * 100 FROM h GROUP BY object, island UNION ALL SELECT object, 'WRITE', blkid * 100, size FROM w)"""


def _stream(t) -> DataFrame:
    o = t("orders").withColumn("blkid", F.col("o_orderkey") % 40)
    table = lambda df: df.groupBy(F.col("o_custkey").alias("object"), "blkid").agg(F.max("o_orderkey").alias("birth"), F.lit(100).cast("long").alias("size"))
    return replication.records(table(o.where("o_orderkey < 4000 and o_custkey % 9 <> 0")), table(o.where("o_custkey % 7 <> 0 and blkid > 5")), 3000, 100)


@query(f"WITH {_VERSIONS} SELECT * FROM rec")
def send_records(t):
    return _stream(t)


@query(f"WITH {_VERSIONS} SELECT * FROM rec WHERE object > 50 OR (object = 50 AND (kind = 'OBJECT' OR \"offset\" >= 1000))")
def send_resumed(t):
    return replication.resumed(_stream(t), 50, 1000)


@query(f"WITH {_VERSIONS} SELECT *, row_number() OVER (ORDER BY object, CASE kind WHEN 'FREEOBJECTS' THEN 0 WHEN 'OBJECT' THEN 1 ELSE 2 END, \"offset\", kind) AS place FROM rec ORDER BY place LIMIT 300")
def send_order(t):
    first = _stream(t).orderBy(*replication.order()).limit(300)
    return first.withColumn("place", F.row_number().over(W.orderBy(*replication.order())))


@query("SELECT l_suppkey, (sum(l_quantity::BIGINT * 512) + floor(sum(l_quantity::BIGINT * 1024) / 8192) * 184)::BIGINT AS bytes FROM lineitem GROUP BY 1")
def size_estimate(t):
    b = t("lineitem").select("l_suppkey", (F.col("l_quantity").cast("long") * 1024).alias("size"), (F.col("l_quantity").cast("long") * 512).alias("psize"))
    return replication.estimate(b, ["l_suppkey"], 8192, compressed=True)


@query("WITH b AS (SELECT o_orderkey AS id, o_custkey % 5 AS object, o_orderkey % 3 AS level, o_orderkey % 17 AS blkid FROM orders) SELECT *, row_number() OVER (ORDER BY CASE WHEN object = 0 THEN blkid * 32 ELSE object END, CASE WHEN object = 0 THEN 0 ELSE blkid * (1024 ** level)::BIGINT END, level DESC, object, blkid, id) AS place FROM b ORDER BY place LIMIT 200")
def mark_order(t):
    b = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("object"), (F.col("o_orderkey") % 3).alias("level"), (F.col("o_orderkey") % 17).alias("blkid"))
    order = [*replication.mark_order(b), F.col("id")]
    return b.orderBy(*order).limit(200).withColumn("place", F.row_number().over(W.orderBy(*order)))


@query("""WITH s AS (SELECT floor(o_orderkey / 4096) AS b, sum(round(o_totalprice)::BIGINT) AS s FROM orders WHERE o_orderkey > 1000 GROUP BY 1), c AS (SELECT *, sum(s) OVER (ORDER BY b) AS upto, min(b) OVER () AS b0, sum(s) OVER () AS every FROM s), k AS (SELECT * FROM c WHERE upto <= 300000000 OR b = b0)
SELECT (SELECT max(o_orderkey) FROM orders WHERE floor(o_orderkey / 4096) <= (SELECT max(b) FROM k)) AS "last", max(upto)::BIGINT AS scanned, (max(every) - max(upto))::BIGINT AS "left", 100.0 * max(upto) / max(every) AS percent FROM k""")
def scan_progress(t):
    o = t("orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    return replication.scan_step(o, 1000, "o_orderkey", "size", 300_000_000)[1]


@query("WITH e AS (SELECT user_id % 8 AS b, sum(CASE event_type WHEN 'click' THEN 3 ELSE -1 END) AS s FROM events GROUP BY 1), g AS (SELECT sum(s - ((s % 64) + 64) % 64) AS ignored, sum(s - s % 64) AS given, count(*) AS n, sum(s) AS exact FROM e) SELECT (given - n * 64)::BIGINT AS lower, (given + n * 64)::BIGINT AS upper, exact::BIGINT AS exact, sign(exact - 100)::INT AS sign, CASE WHEN given + n * 64 < 100 OR given - n * 64 > 100 THEN 'bounds' ELSE 'exact' END AS by FROM g")
def counter_bounds(t):
    e = t("events").select((F.col("user_id") % 8).alias("b"), F.when(F.col("event_type") == "click", 3).otherwise(-1).alias("d"))
    counted = counters.bounds(e, "b", "d", 64)
    return counted.crossJoin(counters.compare(counted, 100))


@query("SELECT size, count(*) AS n FROM (SELECT user_id, ts::DATE AS d, count(*) AS size FROM events GROUP BY ALL) GROUP BY 1")
def batch_sizes(t):
    return counters.batch_sizes(t("events").select("user_id", F.col("ts").cast("date").alias("d")), ["user_id", "d"])


@query("WITH n AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS time, sum(CASE event_type WHEN 'error' THEN -2 ELSE 1 END) AS blocks FROM events GROUP BY 1 HAVING sum(CASE event_type WHEN 'error' THEN -2 ELSE 1 END) > 0), r AS (SELECT *, sum(blocks) OVER (ORDER BY time) - blocks AS before FROM n) SELECT min(time) AS \"first\", max(time) AS \"last\", sum(blocks)::BIGINT AS blocks FROM r GROUP BY floor(before / 50)")
def log_summary(t):
    e = t("events").withColumn("time", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600))
    return counters.log_rows(e.where("event_type <> 'error'").select("time", F.lit(1).alias("blocks")), e.where("event_type = 'error'").select("time", F.lit(2).alias("blocks")), 50)


@query("SELECT count(*) AS keys, count(*) AS numbers, true AS fits FROM (SELECT DISTINCT c_name FROM customer)")
def unique_numbers(t):
    n = t("customer").count()
    bits = max(4, (2 * n - 1).bit_length())
    got = counters.unique_numbers(t("customer"), "c_name", bits)
    return got.agg(F.count_distinct("c_name").alias("keys"), F.count_distinct("number").alias("numbers"), (F.max("number") < (1 << bits)).alias("fits"))


@query('WITH l AS (SELECT l_suppkey, l_partkey AS k, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS op FROM lineitem GROUP BY ALL) SELECT l_suppkey, k FROM l WHERE op <> \'R\'')
def log_condensed(t):
    """Allocated places after the log, as the rewritten log holds them."""
    log = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "ALLOC").otherwise("FREE").alias("op"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"))
    kept, smaller = replication.condense(log, intervals.replay(log, ["l_suppkey"], "seq", "op"), 0.95)
    return kept.select("l_suppkey", F.explode(F.sequence("start", F.col("end") - 1)).alias("k"))


@query("""WITH RECURSIVE obj AS (SELECT r_regionkey AS object, NULL::BIGINT AS parent, 'r' || r_regionkey AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, 'n ' || n_nationkey FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'é' || c_custkey FROM customer),
p AS (SELECT object, '/' || name AS path FROM obj WHERE parent IS NULL UNION ALL SELECT o.object, p.path || '/' || o.name FROM p JOIN obj o ON o.parent = p.object),
d AS (SELECT object, path, CASE object % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN 'M' ELSE 'R' END AS change, object >= 1000 AS file FROM p)
SELECT object, change || chr(9) || CASE WHEN file THEN 'F' ELSE '/' END || chr(9) || replace(replace('/mnt' || path, ' ', '\\0040'), 'é', '\\0303\\0251') || CASE change WHEN 'R' THEN ' -> ' || replace(replace('/mnt' || path, ' ', '\\0040'), 'é', '\\0303\\0251') || '.new' WHEN 'M' THEN chr(9) || '(+1)' ELSE '' END AS line FROM d""")
def change_lines(t):
    text = lambda a, b: F.concat(F.lit(a), F.col(b)).alias("name")
    long = lambda c: c.cast("long")
    objects = t("region").select(long(F.col("r_regionkey")).alias("object"), F.lit(None).cast("long").alias("parent"), text("r", "r_regionkey"))
    objects = objects.unionByName(t("nation").select(long(100 + F.col("n_nationkey")).alias("object"), long(F.col("n_regionkey")).alias("parent"), text("n ", "n_nationkey")))
    objects = objects.unionByName(t("customer").select(long(1000 + F.col("c_custkey")).alias("object"), long(100 + F.col("c_nationkey")).alias("parent"), text("é", "c_custkey")))
    p = snapshots.paths(objects)
    k = F.col("object") % 4
    d = p.select("object", F.when(k == 0, "+").when(k == 1, "-").when(k == 2, "M").otherwise("R").alias("change"), F.when(F.col("object") >= 1000, "file").otherwise("directory").alias("type"), F.col("path").alias("old_name"), F.when(k == 3, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("new_name"), F.lit(1).alias("links"))
    return d.select("object", snapshots.change_line("/mnt", classify=True).alias("line"))
