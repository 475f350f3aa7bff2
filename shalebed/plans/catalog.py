"""Queries of catalogs, access, objects and payloads over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.functions import patterns, payloads
from shalebed.operators import access, catalog, objects, procedures
from shalebed.plans.queries import _TREE, _tree, query


def _catalog(t) -> DataFrame:
    """Regions and nations as file systems, a snapshot of tank/all for each customer and a clone for each supplier."""

    def rows(df: DataFrame, name: str, kind: str = "filesystem", created: str = "0", origin: str = "null") -> DataFrame:
        return df.selectExpr(f"{name} AS name", f"'{kind}' AS kind", f"cast({created} AS long) AS created", f"cast({origin} AS string) AS origin")

    out = rows(t("region"), "concat('tank/r', r_regionkey)")
    out = out.unionByName(rows(t("nation"), "concat('tank/r', n_regionkey, '/n', n_nationkey)"))
    out = out.unionByName(rows(t("customer"), "concat('tank/all@c', c_custkey)", "snapshot", "c_custkey"))
    out = out.unionByName(rows(t("supplier"), "concat('tank/s', s_suppkey)", "filesystem", "1000000 + s_suppkey", "concat('tank/all@c', 3 * s_suppkey)"))
    return out.unionByName(rows(t("region").where("r_regionkey = 0"), "explode(array('tank', 'tank/all'))"))


_CAT = """cat AS (SELECT 'tank/r' || r_regionkey AS name, 'filesystem' AS kind, 0::BIGINT AS created, NULL::VARCHAR AS origin FROM region
 UNION ALL SELECT 'tank/r' || n_regionkey || '/n' || n_nationkey, 'filesystem', 0, NULL FROM nation
 UNION ALL SELECT 'tank/all@c' || c_custkey, 'snapshot', c_custkey, NULL FROM customer
 UNION ALL SELECT 'tank/s' || s_suppkey, 'filesystem', 1000000 + s_suppkey, 'tank/all@c' || 3 * s_suppkey FROM supplier
 UNION ALL SELECT unnest(['tank', 'tank/all']), 'filesystem', 0, NULL)"""


@query(f"WITH {_CAT} SELECT name, kind, created, origin FROM cat WHERE name = 'tank' OR (name LIKE 'tank/%' AND name NOT LIKE 'tank/%/%')")
def catalog_children(t):
    return catalog.children(_catalog(t), "tank", 1)


@query(f"WITH {_CAT} SELECT name, kind, created, origin FROM cat WHERE kind = 'snapshot' AND (created BETWEEN 10 AND 20 OR created = 30 OR created <= 3)")
def catalog_snapshot_span(t):
    return catalog.snapshot_span(_catalog(t), "tank/all@c10%c20,c30,%c3")


@query(f"WITH {_CAT} SELECT CASE WHEN name = 'tank/all' OR name LIKE 'tank/all@%' THEN 'tank/east' || substr(name, 9) ELSE name END AS name, kind, created, CASE WHEN origin LIKE 'tank/all@%' THEN 'tank/east' || substr(origin, 9) ELSE origin END AS origin FROM cat")
def catalog_rename(t):
    return catalog.rename(_catalog(t), "tank/all", "tank/east")


@query(f"WITH {_CAT} SELECT CASE WHEN kind = 'snapshot' AND created <= 12 THEN 'tank/s4' || substr(name, 9) ELSE name END AS name, kind, created, CASE WHEN name = 'tank/s4' THEN NULL WHEN name = 'tank/all' THEN 'tank/s4@c12' WHEN substr(origin, 11)::BIGINT <= 12 THEN 'tank/s4' || substr(origin, 9) ELSE origin END AS origin FROM cat")
def catalog_promote(t):
    return catalog.promote(_catalog(t), "tank/s4")


@query(
    f"""WITH {_CAT}, p AS (SELECT CASE WHEN kind = 'snapshot' AND created <= 12 THEN 'tank/main' || substr(name, 9) WHEN name = 'tank/s4' THEN 'tank/main' ELSE name END AS name, kind, created,
  CASE WHEN name = 'tank/s4' THEN NULL WHEN name = 'tank/all' THEN 'tank/main@c12' WHEN substr(origin, 11)::BIGINT <= 12 THEN 'tank/main' || substr(origin, 9) ELSE origin END AS origin FROM cat)
SELECT * FROM p WHERE name <> 'tank/all@c14' UNION ALL SELECT 'tank/main@now', 'snapshot', 3000000, NULL"""
)
def procedure_run(t):
    c = _catalog(t)
    holds = c.where("name = 'tank/all@c20'").select("name", F.lit("keep").alias("tag"))
    return procedures.run(c, holds, [("promote", "tank/s4"), ("rename", "tank/s4", "tank/main"), ("snapshot", "tank/main", "now", 3_000_000), ("destroy", "tank/all@c14")])


@query(f"WITH {_CAT} SELECT name, kind, created, origin FROM cat WHERE kind <> 'snapshot' OR created <= 100")
def catalog_rollback(t):
    return catalog.rollback(_catalog(t), "tank/all@c100")


@query(f"WITH {_CAT} SELECT name, kind, created, origin FROM cat UNION ALL SELECT name || '@daily', 'snapshot', 2000000, NULL FROM cat WHERE kind = 'filesystem' AND (name = 'tank/r1' OR name LIKE 'tank/r1/%')")
def catalog_snapshot(t):
    return catalog.snapshot(_catalog(t), "daily", 2_000_000, "tank/r1")


def _doomed(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _catalog(t)
    extra = t("region").where("r_regionkey = 0").select(F.explode(F.array(F.lit("tank/none"), F.lit("tank/r1"))).alias("name"))
    return c, c.where("kind = 'snapshot' AND created % 10 = 0").select("name", F.lit("keep").alias("tag")), c.where("kind = 'snapshot' AND created % 2 = 0").select("name").unionByName(extra)


_DOOM = f"""{_CAT}, asked AS (SELECT name FROM cat WHERE kind = 'snapshot' AND created % 2 = 0 UNION ALL SELECT unnest(['tank/none', 'tank/r1'])),
no AS (SELECT 'tank/none' AS name, 'missing' AS reason UNION ALL SELECT 'tank/r1', 'has children' UNION ALL SELECT name, 'held' FROM cat WHERE kind = 'snapshot' AND created % 10 = 0
 UNION ALL SELECT name, 'cloned' FROM asked WHERE name IN (SELECT origin FROM cat))"""


@query(f"WITH {_DOOM} SELECT name, reason FROM no")
def catalog_refusals(t):
    return catalog.refusals(*_doomed(t))


@query(f"WITH {_DOOM} SELECT name, kind, created, origin FROM cat WHERE name NOT IN (SELECT name FROM asked) OR name IN (SELECT name FROM no)")
def catalog_destroy(t):
    return catalog.destroy(*_doomed(t))


@query(f"WITH {_CAT} SELECT name FROM cat WHERE kind = 'snapshot' OR origin IS NOT NULL")
def catalog_dependents(t):
    return catalog.dependents(_catalog(t), "tank/all")


@query("SELECT count(*) AS blocks, sum(round(o_totalprice)::BIGINT)::BIGINT AS bytes FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 1000 AND o_orderkey + 700 > 1200 AND o_orderkey + 700 <= 4000")
def snapshot_reclaimable(t):
    b = t("orders").select(F.col("o_orderkey").alias("birth"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 700).alias("death"), F.round("o_totalprice").cast("long").alias("size"), F.lit(1000).alias("before"))
    return catalog.reclaimable(b, 1200, 4000)


_GRANTS = [("r1", "ann", "below", "@ops"), ("r1", "staff", "both", "mount"), ("n3", "bob", "local", "send"), ("r2", "everyone", "below", "mount"), ("n8", "ann", "both", "@ops")]
_SETS = [("r1", "@ops", "snapshot"), ("r1", "@ops", "send"), ("n8", "@ops", "hold")]
_WHO, _PERMS = ["ann", "bob", "eve"], ["send", "mount", "hold", "snapshot"]


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


@query(
    f"""WITH RECURSIVE {_TREE}, g(id, who, scope, perm) AS (VALUES {_values(_GRANTS)}), s(id, name, perm) AS (VALUES {_values(_SETS)}),
flat AS (SELECT * FROM g WHERE perm NOT LIKE '@%' UNION SELECT g.id, who, scope, s.perm FROM g JOIN s ON s.id = g.id AND s.name = g.perm),
asked AS (SELECT id, unnest({_WHO}) AS who, p AS perm FROM tree, (SELECT unnest({_PERMS}) AS p) )
SELECT id, who, perm, EXISTS (SELECT 1 FROM up JOIN flat f ON f.id = up.ancestor WHERE up.id = a.id AND f.perm = a.perm AND (f.who = a.who OR f.who = 'everyone' OR (f.who = 'staff' AND a.who = 'bob'))
  AND (f.scope = 'both' OR f.scope = CASE WHEN up.d = 0 THEN 'local' ELSE 'below' END)) AS allowed FROM asked a"""
)
def permission_access(t):
    tree = _tree(t)
    spark = tree.sparkSession
    asked = tree.select("id", F.explode(F.lit(_WHO)).alias("who")).select("*", F.explode(F.lit(_PERMS)).alias("perm"))
    return access.allowed(tree, spark.createDataFrame(_GRANTS, "id string, who string, scope string, perm string"), spark.createDataFrame(_SETS, "id string, name string, perm string"), spark.createDataFrame([("bob", "staff")], "who string, member_of string"), asked)


@query(
    f"""WITH RECURSIVE {_TREE}, used AS (SELECT 'c' || c_custkey AS id, round(c_acctbal)::BIGINT AS amount FROM customer), taken AS (SELECT ancestor AS id, sum(amount) AS taken FROM up JOIN used USING (id) GROUP BY 1),
lim AS (SELECT id, CASE WHEN id LIKE 'r%' THEN 200000 ELSE 40000 END AS quota FROM tree WHERE id NOT LIKE 'c%'), room AS (SELECT lim.id AS ancestor, quota - coalesce(taken, 0) AS room FROM lim LEFT JOIN taken USING (id))
SELECT 'c' || c_custkey AS id, 1000::BIGINT AS amount, min(room)::BIGINT AS available, coalesce(1000 <= min(room), true) AS fits FROM customer LEFT JOIN up ON up.id = 'c' || c_custkey LEFT JOIN room USING (ancestor) GROUP BY 1"""
)
def quota_admission(t):
    tree = _tree(t)
    own = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.round("c_acctbal").cast("long").alias("amount"))
    limits = tree.where("not startswith(id, 'c')").select("id", F.when(F.col("id").startswith("r"), 200000).otherwise(40000).cast("long").alias("quota"))
    return access.admit(tree, own, limits, own.select("id", F.lit(1000).cast("long").alias("amount")))


@query("""WITH b AS (SELECT l_orderkey AS object, l_linenumber AS n, hex(lpad(max(l_partkey)::VARCHAR, 8, '0')) AS h FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL)
SELECT object, coalesce(max(substr(h, 11, 6)) FILTER (n = 1), '000000') || coalesce(max(h) FILTER (n = 2), '0000000000000000') || coalesce(max(substr(h, 1, 4)) FILTER (n = 3), '0000') AS payload FROM b WHERE n <= 3 GROUP BY 1""")
def object_range_read(t):
    """Bytes 5 to 18 of blocks of 8, some of which are holes."""
    b = t("lineitem").where("l_partkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("object"), (F.col("l_linenumber") - 1).alias("blkid")).agg(F.max("l_partkey").alias("k"))
    return objects.read_range(b.select("object", "blkid", F.encode(F.lpad(F.col("k").cast("string"), 8, "0"), "UTF-8").alias("payload")), 8, 5, 13).select("object", F.hex("payload").alias("payload"))


@query("SELECT min(o_orderkey) AS object, (SELECT min(k) FROM (SELECT o_orderkey + 1 AS k FROM orders WHERE o_orderkey > 50) WHERE k NOT IN (SELECT o_orderkey FROM orders)) AS hole FROM orders WHERE o_orderkey > 50 AND o_custkey > 100")
def next_object(t):
    o = t("orders").select(F.col("o_orderkey").alias("object"), F.col("o_custkey").alias("birth"))
    holes = objects.next_object(o, 50, 0, holes=True).select(F.col("object").alias("hole"))
    return objects.next_object(o, 50, 100).join(holes, F.lit(True))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'FREE' ELSE 'ALLOC' END AS op, l_partkey AS start, l_quantity::BIGINT AS length, l_partkey * 65536 + CASE l_returnflag WHEN 'R' THEN 32768 ELSE 0 END + l_quantity::BIGINT - 1 AS word FROM lineitem")
def segment_words(t):
    op = F.when(F.col("l_returnflag") == "R", "FREE").otherwise("ALLOC")
    w = t("lineitem").select("l_orderkey", "l_linenumber", objects.encode_segment(op, "l_partkey", F.col("l_quantity").cast("long")).alias("word"))
    return w.select("l_orderkey", "l_linenumber", "word", objects.decode_segment("word").alias("s")).select("l_orderkey", "l_linenumber", "word", "s.*")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey * 100 AS "start", l_partkey * 100 + l_quantity::BIGINT * 20 AS "end" FROM lineitem), m AS (SELECT p_partkey * 100 AS lo, p_partkey * 100 + 80 AS hi, p_partkey * 7000 AS "to" FROM part)
SELECT id, greatest("start", lo) AS "start", least("end", hi) AS "end", "to" + greatest("start", lo) - lo AS "to" FROM r JOIN m ON "start" < hi AND lo < "end" """)
def remap_ranges(t):
    r = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 100).alias("start"), (F.col("l_partkey") * 100 + F.col("l_quantity").cast("long") * 20).alias("end"))
    m = t("part").select((F.col("p_partkey") * 100).alias("lo"), (F.col("p_partkey") * 100 + 80).alias("hi"), (F.col("p_partkey") * 7000).alias("to"))
    return objects.remap(r, m, 512)


@query("""WITH e AS (SELECT o_custkey % 25 AS head, o_orderkey AS object, o_orderkey AS birth, CASE o_orderstatus WHEN 'F' THEN o_orderkey + 900 END AS death FROM orders),
d AS (SELECT n_name AS name, n_nationkey AS head, NULL AS created FROM nation UNION ALL SELECT n_name || '@' || k, n_nationkey, k * 500 FROM nation, (SELECT unnest(range(1, 9)) AS k))
SELECT name, object FROM e JOIN d USING (head) WHERE CASE WHEN created IS NULL THEN death IS NULL ELSE birth <= created AND (death IS NULL OR created < death) END""")
def damaged_datasets(t):
    e = t("orders").select((F.col("o_custkey") % 25).alias("head"), F.col("o_orderkey").alias("object"), F.col("o_orderkey").alias("birth"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 900).alias("death"))
    n = t("nation")
    snaps = n.select("n_name", "n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select(F.concat("n_name", F.lit("@"), "k").alias("name"), F.col("n_nationkey").alias("head"), (F.col("k") * 500).alias("created"))
    heads = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("head"), F.lit(None).cast("int").alias("created"))
    return objects.damaged(e, heads.unionByName(snaps))


@query("""WITH x AS (SELECT c_custkey, encode(c_name || c_mktsegment) AS v FROM customer), h AS (SELECT c_custkey, rpad(hex(v), ((octet_length(v) + 3) // 4 * 8)::INT, '0') AS h FROM x),
w AS (SELECT c_custkey, (length(h) // 8)::HUGEINT AS n, i::HUGEINT AS i, ('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::BIGINT::HUGEINT AS w FROM h, unnest(range(0, length(h) // 8)) AS u(i))
SELECT c_custkey, (sum(w) % 18446744073709551616)::VARCHAR AS a, (sum(w * (n - i)) % 18446744073709551616)::VARCHAR AS b, (sum(w * ((n - i) * (n - i + 1) // 2)) % 18446744073709551616)::VARCHAR AS c, (sum(w * ((n - i) * (n - i + 1) * (n - i + 2) // 6)) % 18446744073709551616)::VARCHAR AS d FROM w GROUP BY 1""")
def word_checksums(t):
    c = t("customer").select("c_custkey", payloads.fletcher4(F.encode(F.concat("c_name", "c_mktsegment"), "UTF-8")).alias("s"))
    return c.select("c_custkey", "s.*")


@query("SELECT doc_id // 8 AS stripe, (doc_id % 8)::INT AS col, sha256(text) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 8 IN (1, 4, 6)")
def parity_rebuild(t):
    """Digests of eight documents and three parities; three digests are lost and rebuilt."""
    d = t("documents").where("text is not null").select(F.expr("doc_id div 8").alias("stripe"), (F.col("doc_id") % 8).cast("int").alias("col"), F.unhex(F.sha2("text", 256)).alias("digest"))
    lost = F.col("col").isin(1, 4, 6)
    return payloads.reconstruct(d.where(~lost), payloads.parity(d, "stripe", "col", "digest"), d.where(lost).select("stripe", "col"), "stripe", "col", "digest").withColumn("digest", F.lower(F.hex("digest")))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS size, true AS smaller FROM documents WHERE text IS NOT NULL")
def payload_codecs(t):
    d = t("documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("p")).withColumn("c", payloads.compress("p", "zstd-3"))
    back = payloads.decompress("c.codec", "c.payload")
    return d.select("doc_id", F.sha2(back, 256).alias("digest"), F.octet_length(back).cast("long").alias("size"), (F.octet_length("c.payload") <= F.octet_length("p")).alias("smaller"))


@query(r"""SELECT c_custkey, nullif(regexp_extract(c_name, '#0*([0-9]+)', 1), '') AS number, length(split_part(c_name, '#', 1)) + 1 AS "first", regexp_replace(lower(c_mktsegment), '[aeiou]', '<\0>', 'g') AS vowels, substr(c_name, -4) AS tail, reverse(c_mktsegment) AS back, c_mktsegment || '/' || c_mktsegment AS twice FROM customer""")
def string_patterns(t):
    low = F.lower("c_mktsegment")
    return t("customer").select("c_custkey", patterns.match("c_name", "#0*(%d+)").alias("number"), patterns.find("c_name", "#").getField("first").alias("first"), patterns.gsub(low, "[aeiou]", "<%0>").alias("vowels"), patterns.sub("c_name", -4).alias("tail"), F.reverse("c_mktsegment").alias("back"), patterns.rep("c_mktsegment", 2, "/").alias("twice"))
