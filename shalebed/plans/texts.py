"""Queries of names, numbers, words, nested and packed values and listings, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.functions import nested, packed, words
from shalebed.functions import scalars as S
from shalebed.operators import hierarchy, listing
from shalebed.plans.catalog import _CAT, _catalog
from shalebed.plans.queries import _TREE, _tree, query


def _human(x: str, base: int, units: str, first: str = "") -> str:
    """SQL of a number within five columns: whole multiples, else two, one or no decimals."""
    out = f"CAST({x} AS VARCHAR) || '{first}'"
    for i, unit in enumerate(units.split(","), 1):
        size = base**i
        r = f"({x} / {size}.0)::DOUBLE"
        text = f"CASE WHEN {x} % {size} = 0 THEN ({x} // {size})::VARCHAR WHEN length(printf('%.2f', {r})) <= 4 THEN printf('%.2f', {r}) WHEN length(printf('%.1f', {r})) <= 4 THEN printf('%.1f', {r}) ELSE printf('%.0f', {r}) END"
        out = f"CASE WHEN {x} >= {size} THEN {text} || '{unit}' ELSE {out} END"
    return out


@query(f"SELECT l_orderkey, l_linenumber, {_human('v', 1024, 'K,M,G,T,P,E')} AS bytes, {_human('v', 1000, 'K,M,G,T,P,E')} AS counted, CASE WHEN v = 0 THEN '-' WHEN v >= 1000000000 THEN v // 1000000000 || 's' WHEN v >= 1000000 THEN v // 1000000 || 'ms' WHEN v >= 1000 THEN v // 1000 || 'us' ELSE v || 'ns' END AS time FROM (SELECT l_orderkey, l_linenumber, (l_partkey * l_orderkey * 1009 * (1 + l_linenumber * 997))::BIGINT AS v FROM lineitem)")
def human_numbers(t):
    # As a decimal, for the product of long keys leaves 64 bits.
    v = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey").cast("decimal(15,0)") * F.col("l_orderkey").cast("decimal(15,0)") * ((1 + F.col("l_linenumber") * 997) * 1009).cast("decimal(8,0)")).alias("v"))
    return v.select("l_orderkey", "l_linenumber", S.human_size("v").alias("bytes"), S.human_count("v").alias("counted"), S.human_time("v").alias("time"))


_NUMBERS = "n AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN o_orderkey || 'K' WHEN 1 THEN o_orderkey || 'GiB' WHEN 2 THEN '0x' || hex(o_orderkey) WHEN 3 THEN o_orderkey || '.5m' WHEN 4 THEN 'x' || o_orderkey WHEN 5 THEN '900719925474' || (1000 + o_orderkey % 9000) WHEN 6 THEN o_orderkey || 'Q' ELSE ' ' || o_orderkey || ' ' END AS text FROM orders)"


@query(f"WITH {_NUMBERS} SELECT k, text, CASE k % 8 WHEN 0 THEN k * 1024 WHEN 1 THEN k * 1073741824 WHEN 2 THEN k WHEN 3 THEN k * 1048576 + 524288 WHEN 5 THEN text::BIGINT WHEN 7 THEN k END::BIGINT AS value FROM n")
def parsed_numbers(t):
    k = F.col("o_orderkey")
    s = k.cast("string")
    text = F.when(k % 8 == 0, F.concat(s, F.lit("K"))).when(k % 8 == 1, F.concat(s, F.lit("GiB"))).when(k % 8 == 2, F.concat(F.lit("0x"), F.hex(k))).when(k % 8 == 3, F.concat(s, F.lit(".5m"))).when(k % 8 == 4, F.concat(F.lit("x"), s)).when(k % 8 == 5, F.concat(F.lit("900719925474"), (1000 + k % 9000).cast("string"))).when(k % 8 == 6, F.concat(s, F.lit("Q"))).otherwise(F.concat(F.lit(" "), s, F.lit(" ")))
    return t("orders").select(k.alias("k"), text.alias("text")).withColumn("value", S.parse_size("text"))


_NAMES = ["tank/a b", "tank/.", "tank/..", "tank//x", "tank@s@t", "tank@s/x", "/tank", "tank/", "tank/a%b", "tank/é", "", "tank#m", "tank@s#m", "@s", "tank@", "mirror", "9tank", "tank:1-2_3.4", "ta,nk", "@set", "a/b/c@d"]
_FORMS = "n AS (SELECT c_custkey, replace((" + str(_NAMES) + ")[1 + c_custkey % 21], 'tank', 'tank' || c_custkey) AS name FROM customer)"


@query(
    f"WITH {_FORMS}, v AS (SELECT *, regexp_full_match(name, '[A-Za-z0-9_.: %-]+(/[A-Za-z0-9_.: %-]+)*([@#][A-Za-z0-9_.: %-]+)?') AND NOT regexp_matches(name, '(^|[/@#])[.][.]?($|[/@#])') AND octet_length(encode(name)) < 256 AS entity FROM n)"
    " SELECT c_custkey, name, entity, entity AND name NOT LIKE '%#%' AS dataset, entity AND name LIKE '%@%' AS snapshot, entity AND name LIKE '%#%' AS bookmark, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_.: -]*') AND name NOT IN ('mirror', 'raidz', 'draid') AS pool, regexp_full_match(name, '@[A-Za-z0-9_.: -]+') AS set_, split_part(split_part(name, '@', 1), '#', 1) AS head, len(string_split(split_part(split_part(name, '@', 1), '#', 1), '/')) - 1 AS depth FROM v"
)
def name_checks(t):
    name = F.regexp_replace(F.element_at(F.array(*map(F.lit, _NAMES)), (1 + F.col("c_custkey") % 21).cast("int")), F.lit("tank"), F.concat(F.lit("tank"), F.col("c_custkey").cast("string")))
    n = t("customer").select("c_custkey", name.alias("name"))
    checks = [S.valid_name("name", k).alias("set_" if k == "set" else k) for k in ("entity", "dataset", "snapshot", "bookmark", "pool", "set")]
    return n.select("c_custkey", "name", *checks, S.dataset("name").alias("head"), S.depth("name").cast("long").alias("depth"))


_STATES = str(list(words.STATES))


@query(f"SELECT l_orderkey, l_linenumber, ({_STATES})[l_linenumber + 1] AS label, list_position(list_transform({_STATES}, lambda x: lower(x)), lower(({_STATES})[l_linenumber + 1])) - 1 AS number, CASE WHEN l_linenumber IN (1, 2) THEN 'OFFLINE' WHEN l_linenumber = 3 THEN 'REMOVED' WHEN l_linenumber = 4 THEN CASE WHEN l_partkey % 16 IN (2, 13) THEN 'FAULTED' WHEN l_partkey % 16 = 14 THEN 'SPLIT' ELSE 'UNAVAIL' END WHEN l_linenumber = 5 THEN 'FAULTED' WHEN l_linenumber = 6 THEN 'DEGRADED' WHEN l_linenumber = 7 THEN 'ONLINE' ELSE 'UNKNOWN' END AS state FROM lineitem")
def state_labels(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", words.label("l_linenumber", words.STATES).alias("label"), words.number(words.label("l_linenumber", words.STATES), words.STATES).alias("number"), words.state_name("l_linenumber", F.col("l_partkey") % 16).alias("state"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, ((epoch_us(ts) % 1000000) * 1000)::BIGINT AS nanoseconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' AS text FROM events")
def event_times(t):
    return t("events").select("event_id", words.event_time("ts").alias("s")).select("event_id", "s.*")


@query("SELECT user_id, rpad(repeat('#', floor(20 * count(*) FILTER (event_type = 'click') / count(*))::INT), 20, ' ') AS bar FROM events GROUP BY 1")
def percent_bars(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("c"), F.count("*").alias("n")).select("user_id", words.bar("c", "n", 20).alias("bar"))


@query("""WITH l AS (SELECT c_custkey, string_split(c_mktsegment || '-' || c_nationkey || '-x', '-') AS a FROM customer)
SELECT c_custkey, array_to_string(a[2:3], '+') AS joined, array_to_string(list_concat([a[1], 'new'], a[2:]), ',') AS inserted, array_to_string(list_concat(a[1:1], a[3:]), ',') AS removed, a[2] AS second, a[4] AS fourth, array_to_string(list_sort(a), ',') AS sorted, array_to_string(list_concat(a[1:2], []), ',') AS shorter FROM l""")
def list_library(t):
    l = t("customer").select("c_custkey", F.split(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("-x")), "-").alias("a"))
    second, _, fourth = words.unpack("a", 2, 4)
    text = lambda c: F.array_join(c, ",")
    return l.select("c_custkey", words.concat("a", "+", 2, 3).alias("joined"), text(words.insert("a", F.lit("new"), 2)).alias("inserted"), text(words.remove("a", 2)).alias("removed"), second.alias("second"), fourth.alias("fourth"), text(words.sort("a")).alias("sorted"), text(words.remove("a")).alias("shorter"))


@query("SELECT p_partkey, p_partkey AS decimal, p_partkey AS hexadecimal, -p_partkey AS negative, NULL::BIGINT AS none, CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE 'nil' END AS text, CASE WHEN p_size > 25 THEN 'number' ELSE 'nil' END AS kind FROM part")
def base_library(t):
    k = F.col("p_partkey")
    size = F.when(F.col("p_size") > 25, F.col("p_size"))
    return t("part").select("p_partkey", words.to_number(F.concat(F.lit(" "), k.cast("string"))).alias("decimal"), words.to_number(F.concat(F.lit("0x"), F.hex(k))).alias("hexadecimal"), words.to_number(F.concat(F.lit("-"), F.conv(k.cast("string"), 10, 2)), 2).alias("negative"), words.to_number(F.concat(k.cast("string"), F.lit("z"))).alias("none"), words.to_text(size).alias("text"), words.kind("int", size).alias("kind"))


_JSON_CHAR = """CASE WHEN c = '"' THEN '\\"' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = '\\' THEN '\\\\' WHEN c = chr(12) THEN '\\f' WHEN c = chr(9) THEN '\\t' WHEN c = chr(8) THEN '\\b' WHEN ord(c) < 32 OR (ord(c) > 127 AND ord(c) <= 65535) THEN '\\u' || lpad(lower(hex(ord(c))), 4, '0') WHEN ord(c) > 65535 THEN '' ELSE c END"""


@query(f"""SELECT doc_id, '{{"doc_id":' || doc_id || ',"text":' || coalesce('"' || array_to_string(list_transform(string_split(text, ''), lambda c: {_JSON_CHAR}), '') || '"', 'null') || ',"lang":' || coalesce('"' || lang || '"', 'null') || '}}' AS json FROM documents""")
def json_listing(t):
    return listing.json_lines(t("documents"), ["doc_id", "text", "lang"]).select("doc_id", "json")


@query("SELECT c_custkey, 'key: ' || c_custkey || chr(10) || 'owner:' || chr(10) || '    name: ''' || c_name || '''' || chr(10) || '    codes[0]: ' || c_nationkey || chr(10) || '    codes[1]: 7' || chr(10) || 'segment: <' || c_mktsegment || '>' AS text FROM customer")
def nested_lines(t):
    c = t("customer").select("c_custkey", F.struct(F.col("c_custkey").alias("key"), F.struct(F.col("c_name").alias("name"), F.array(F.col("c_nationkey").cast("int"), F.lit(7)).alias("codes")).alias("owner"), F.struct(F.col("c_mktsegment").alias("s")).alias("segment")).alias("v"))
    printers = {"struct<s:string>": lambda x: F.concat(F.lit("<"), x["s"], F.lit(">"))}
    return c.select("c_custkey", F.array_join(nested.lines(F.col("v"), c.schema["v"].dataType, printers), "\n").alias("text"))


@query("SELECT c_custkey, 'name=' || c_name || ';nation=x' || c_nationkey || ';segment=new' AS pairs, 'nation=' || c_nationkey || ';nation=x' || c_nationkey || ';name=' || c_name AS every, c_name AS found FROM customer")
def nested_builders(t):
    c = F.col
    text = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";")
    first = nested.add(nested.add(nested.empty(), nested.pair("segment", "string", "c_mktsegment")), nested.pair("name", "string", "c_name"))
    second = nested.add(nested.add(nested.empty(), nested.pair("nation", "int", "c_nationkey")), nested.pair("nation", "string", F.concat(F.lit("x"), c("c_nationkey").cast("string"))), unique="type")
    changed = nested.add(nested.add(first, nested.pair("nation", "string", F.concat(F.lit("x"), c("c_nationkey").cast("string")))), nested.pair("segment", "string", F.lit("new")))
    every = nested.merge(second, nested.remove(first, "segment"))
    return t("customer").select("c_custkey", text(changed).alias("pairs"), text(every).alias("every"), nested.lookup(every, "name").alias("found"))


@query("SELECT c_custkey, (c_nationkey = 7)::INT AS decimal, (c_nationkey = 16)::INT AS hexadecimal, -1 AS wrong, regexp_full_match(c_mktsegment, 'B.*|M.*')::INT AS pattern, (c_mktsegment = 'BUILDING')::INT AS text, -1 AS no_text FROM customer")
def typed_match(t):
    nation, segment = nested.pair("n", "int", "c_nationkey"), nested.pair("s", "string", "c_mktsegment")
    return t("customer").select("c_custkey", nested.match(nation, "7").alias("decimal"), nested.match(nation, "0x10").alias("hexadecimal"), nested.match(nation, "seven").alias("wrong"), nested.match(segment, "B.*|M.*", pattern=True).alias("pattern"), nested.match(segment, "BUILDING").alias("text"), nested.match(nation, "7", pattern=True).alias("no_text"))


_INT = "lpad(hex({0}), {1}, '0')"
_XDR_TEXT = "(lpad(hex(octet_length(encode({0}))), 8, '0') || rpad(hex(encode({0})), ((octet_length(encode({0})) + 3) // 4 * 8)::INT, '0'))"


@query(
    f"WITH x AS (SELECT c_custkey, c_name, {_XDR_TEXT.format('c_name')} AS value, octet_length(encode(c_name)) AS n FROM customer) SELECT c_custkey, '01010000' || '0000000000000001' || '0000002000000020' || {_XDR_TEXT.format(repr('key'))} || '0000000700000001' || lpad(hex(c_custkey), 16, '0')"
    f" || lpad(hex(24 + length(value) // 2), 8, '0') || lpad(hex(24 + (n + 1 + 7) // 8 * 8), 8, '0') || {_XDR_TEXT.format(repr('name'))} || '0000000900000001' || value || '0000000000000000' AS packed, c_name AS name FROM x"
)
def packed_values(t):
    p = t("customer").select("c_custkey", packed.pack(F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))).alias("p"))
    return p.select("c_custkey", F.hex("p").alias("packed"), F.get_json_object(packed.unpack("p"), "$.name").alias("name"))


@query("SELECT o_orderkey AS object, o_custkey * 512 AS \"offset\", 'tank/c' || o_custkey || '@s' AS toname FROM orders")
def resume_tokens(t):
    text = F.to_json(F.struct(F.col("o_orderkey").alias("object"), (F.col("o_custkey") * 512).alias("offset"), F.concat(F.lit("tank/c"), F.col("o_custkey").cast("string"), F.lit("@s")).alias("toname")))
    back = t("orders").select(packed.from_token(packed.token(text)).alias("j"))
    return back.select(F.get_json_object("j", "$.object").cast("long").alias("object"), F.get_json_object("j", "$.offset").cast("long").alias("offset"), F.get_json_object("j", "$.toname").alias("toname"))


@query(f"WITH {_CAT} SELECT name, row_number() OVER (ORDER BY split_part(name, '@', 1), name LIKE '%@%', CASE WHEN name LIKE '%@%' THEN created END, name) AS place FROM cat")
def default_order(t):
    return _catalog(t).select("name", F.row_number().over(W.orderBy(*listing.dataset_order())).alias("place"))


@query("SELECT name, mountpoint, row_number() OVER (ORDER BY mountpoint DESC NULLS FIRST, name DESC NULLS FIRST) AS place FROM (SELECT c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN '/' || c_mktsegment || '/' || c_nationkey END AS mountpoint FROM customer)")
def unmount_order(t):
    m = t("customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))).alias("mountpoint"))
    return m.select("name", "mountpoint", F.row_number().over(W.orderBy(*listing.mount_order(unmount=True))).alias("place"))


_LOCAL = "loc AS (SELECT id, 'v' || id AS val FROM tree WHERE id IN ('r1', 'r3', 'n2', 'n8') OR (id LIKE 'c%' AND substr(id, 2)::BIGINT % 10 = 0)), b AS (SELECT up.id, arg_min(struct_pack(v := val, s := ancestor), d) AS x FROM up JOIN loc ON loc.id = ancestor GROUP BY up.id), g AS (SELECT tree.id, coalesce(b.x.v, 'off') AS value, coalesce(b.x.s, 'default') AS source FROM tree LEFT JOIN b USING (id))"


@query(f"WITH RECURSIVE {_TREE}, {_LOCAL}, k AS (SELECT id, value, CASE WHEN id LIKE 'c%7' THEN 'temporary' WHEN source = 'default' THEN 'default' WHEN source = id THEN CASE WHEN id LIKE '%0' THEN 'received' ELSE 'local' END ELSE 'inherited' END AS origin FROM g) SELECT * FROM k WHERE origin IN ('received', 'inherited', 'temporary')")
def value_sources(t):
    tree = _tree(t)
    i = F.col("id")
    local = tree.where(i.isin("r1", "r3", "n2", "n8") | (i.startswith("c") & (F.substring("id", 2, 20).try_cast("long") % 10 == 0))).select("id", F.concat(F.lit("v"), "id").alias("value"))
    found = hierarchy.inherit(tree, local, "off").withColumn("t", i.startswith("c") & i.endswith("7")).withColumn("r", i.endswith("0"))
    return found.withColumn("origin", listing.source_kind(temporary="t", received="r")).where(F.col("origin").isin("received", "inherited", "temporary")).select("id", "value", "origin")
