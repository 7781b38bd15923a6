"""Relational constructs, each once, as Spark SQL over the supplied tables. A construct's twin is the same text where both engines read it alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, relation, table

relation("rel_filter_nullable", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE (NULL IS NULL OR o_orderstatus = NULL) AND o_totalprice > 200000")
relation("rel_case_coalesce", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'fair' END AS kind, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l FROM {customer}")
relation("rel_distinct_from", "SELECT c_custkey FROM {customer} WHERE nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM 'MACHINERY'")
relation("rel_any_like", "SELECT p_partkey FROM {part} WHERE p_type IN ('STANDARD', 'PROMO') OR lower(p_name) LIKE '%e%' OR p_brand LIKE 'Brand#1%'")
relation("rel_array_overlap", "SELECT doc_id FROM {documents} WHERE arrays_overlap(split(lang, ''), array('e', 'x'))", "SELECT doc_id FROM {documents} WHERE list_has_any(string_split(lang, ''), ['e', 'x'])")
relation("rel_regex", "SELECT p_partkey FROM {part} WHERE p_brand RLIKE '[12]$' AND NOT (p_name RLIKE '(?i)^a')", "SELECT p_partkey FROM {part} WHERE regexp_matches(p_brand, '[12]$') AND NOT regexp_matches(p_name, '(?i)^a')")
relation("rel_row_compare", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE struct(l_orderkey, l_linenumber) < struct(500L, 3)", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_linenumber) < (500, 3)")
relation("rel_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, get_json_object(to_json(named_struct('a', event_type)), '$.a') AS a FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS a FROM {events}")
relation("rel_cast", "SELECT event_id, CAST(CAST(value AS INT) AS STRING) AS v, try_cast(event_type AS INT) IS NULL AS bad FROM {events}", "SELECT event_id, CAST(CAST(trunc(value) AS INT) AS VARCHAR) AS v, TRY_CAST(event_type AS INT) IS NULL AS bad FROM {events}")
relation("rel_inner_join", "SELECT o_orderkey, c_mktsegment, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
relation("rel_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
relation("rel_join_using", "SELECT doc_id, lang, quality FROM {documents} JOIN {labels} USING (doc_id)")
relation("rel_self_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
relation("rel_either_direction", "SELECT s, count(*) AS n FROM (SELECT l_partkey AS s FROM {lineitem} UNION ALL SELECT l_suppkey FROM {lineitem}) GROUP BY s", "SELECT k AS s, (SELECT count(*) FROM lineitem WHERE l_partkey = k) + (SELECT count(*) FROM lineitem WHERE l_suppkey = k) AS n FROM (SELECT DISTINCT l_partkey AS k FROM lineitem UNION SELECT DISTINCT l_suppkey FROM lineitem)")
relation("rel_range_join", "SELECT e.event_id, count(*) AS n FROM {events} e JOIN {events} f ON e.user_id = f.user_id AND f.event_id BETWEEN e.event_id - 500 AND e.event_id GROUP BY e.event_id")


@query("SELECT c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
def rel_lateral(spark, sf):
    """The dearest order of each customer: one aggregate and a join. Spark's lateral LIMIT orders all rows, then sorts them by customer, which loses that order when it spills."""
    # ~ turns the order of keys round, for all of them; nulls come last in both
    dearest = F.max_by("o_orderkey", F.struct("o_totalprice", F.bitwise_not("o_orderkey")))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(dearest.alias("o_orderkey"))
    return table(spark, sf, "customer").join(o, "c_custkey").select("c_custkey", "o_orderkey")


relation("rel_semi_join", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
relation("rel_anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
relation("rel_anti_null_safe", "SELECT c_custkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 250000 WHERE o_orderkey IS NULL")
relation("rel_mark_join", "SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished FROM {customer}")
relation("rel_unnest", "SELECT doc_id, count(DISTINCT w) AS words FROM (SELECT doc_id, explode(split(text, ' ')) AS w FROM {documents}) GROUP BY doc_id", "SELECT doc_id, count(DISTINCT w) AS words FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM {documents}) GROUP BY doc_id")
relation("rel_group_having", "SELECT l_suppkey, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 20")
relation("rel_filter_clause", "SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS cut, round(sum(l_quantity) FILTER (WHERE l_tax < 0.04), 2) AS q, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
relation("rel_ordered_array", "SELECT o_custkey, array_join(transform(sort_array(collect_list(struct(o_orderdate, o_orderkey))), x -> x.o_orderkey), ',') AS keys FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM {orders} GROUP BY o_custkey")
relation("rel_string_agg", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names, bool_or(n_nationkey > 20) AS late, bool_and(n_nationkey < 30) AS small FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, bool_or(n_nationkey > 20) AS late, bool_and(n_nationkey < 30) AS small FROM {nation} GROUP BY n_regionkey")
relation("rel_distinct_on", "SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS latest FROM {orders} GROUP BY o_custkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS latest FROM {orders} ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
relation("rel_top_counts", "SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM (SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY p_brand, p_type)) WHERE k <= 12")
relation("rel_lag", "SELECT o_orderkey, prev FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}) WHERE prev IS NOT NULL")
relation("rel_head_per_topic", "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_totalprice DESC NULLS LAST, o_orderkey) AS k FROM {orders}) WHERE k = 1")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def rel_global_rank(spark, sf):
    """Ranks over all rows, dealt by ranges: no task sees all."""
    from ..operators.evidence import global_rank

    return global_rank(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), F.desc("s_acctbal"), F.col("s_suppkey"), name="place").select("s_suppkey", "place")


relation("rel_continuation_rank", "SELECT c_custkey, CAST(100000 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS rank FROM {customer}")
relation("rel_nulls_order", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_custkey) AS INT) AS k FROM {customer}")
relation("rel_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
relation("rel_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
relation("rel_keyset_page", "SELECT o_orderkey, o_custkey FROM {orders} WHERE struct(o_custkey, o_orderkey) > struct(100L, 50L) ORDER BY o_custkey, o_orderkey LIMIT 30", "SELECT o_orderkey, o_custkey FROM {orders} WHERE (o_custkey, o_orderkey) > (100, 50) ORDER BY o_custkey, o_orderkey LIMIT 30")
relation("rel_position_order", "SELECT n_nationkey, array_position(array('CHINA', 'JAPAN', 'INDIA'), n_name) AS p FROM {nation}", "SELECT n_nationkey, coalesce(list_position(['CHINA', 'JAPAN', 'INDIA'], n_name), 0)::BIGINT AS p FROM {nation}")
relation("rel_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind FROM {customer} UNION ALL SELECT 's' FROM {supplier}) GROUP BY kind")
relation("rel_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
relation("rel_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), m AS (SELECT max(t) AS top FROM big) SELECT o_custkey, round(t / top, 6) AS share FROM big, m WHERE t > 0.5 * top")
# LIMIT ALL lifts the engine's limit of a million rows, at which recursion fails
relation("rel_recursive_lineage", "WITH RECURSIVE w AS (SELECT c_custkey AS id, c_custkey AS anc, 0 AS depth FROM {customer} UNION ALL SELECT id, anc DIV 2, depth + 1 FROM w WHERE anc > 1 AND depth < 64) SELECT id, anc, depth FROM w LIMIT ALL", "WITH RECURSIVE w AS (SELECT c_custkey AS id, c_custkey AS anc, 0 AS depth FROM {customer} UNION ALL SELECT id, anc // 2, depth + 1 FROM w WHERE anc > 1 AND depth < 64) SELECT id, anc, depth FROM w")
relation("rel_recursive_paths", "WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b, n_regionkey AS kind FROM {nation}), w AS (SELECT a, b, array(a, b) AS path, 1 AS hops FROM e UNION ALL SELECT w.a, e.b, concat(path, array(e.b)), hops + 1 FROM w JOIN e ON e.a = w.b WHERE hops < 2 AND NOT array_contains(path, e.b)) SELECT a, b, hops, array_join(path, '>') AS path FROM w", "WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b, n_regionkey AS kind FROM {nation}), w AS (SELECT a, b, [a, b] AS path, 1 AS hops FROM e UNION ALL SELECT w.a, e.b, list_append(path, e.b), hops + 1 FROM w JOIN e ON e.a = w.b WHERE hops < 2 AND NOT list_contains(path, e.b)) SELECT a, b, hops, array_to_string(path, '>') AS path FROM w")
relation("rel_strings", "SELECT n_nationkey, upper(n_name) AS u, left(n_name, 3) AS l, length(n_name) AS n, concat_ws('-', n_name, CAST(n_regionkey AS STRING)) AS c, regexp_replace(n_name, '[AEIOU]', '_') AS r, md5(n_name) AS m FROM {nation}", "SELECT n_nationkey, upper(n_name) AS u, left(n_name, 3) AS l, length(n_name)::INT AS n, concat_ws('-', n_name, CAST(n_regionkey AS VARCHAR)) AS c, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS r, md5(n_name) AS m FROM {nation}")
relation("rel_dates", "SELECT o_orderkey, CAST(unix_timestamp(o_orderdate) AS BIGINT) AS epoch, date_format(o_orderdate + INTERVAL 36 HOURS, 'yyyy-MM-dd') AS later, CAST(floor((unix_timestamp(TIMESTAMP '2000-01-01 00:00:00') - unix_timestamp(o_orderdate)) / 3600) AS BIGINT) AS age FROM {orders}", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, strftime(o_orderdate + INTERVAL 36 HOURS, '%Y-%m-%d') AS later, CAST(floor((epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(o_orderdate)) / 3600) AS BIGINT) AS age FROM {orders}")
relation("rel_math", "SELECT p_partkey, round(exp(-p_size / 10.0D), 6) AS e, round(ln(p_size + 1.0D), 6) AS l, round(pow(p_size, 1.5D), 4) AS p, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a FROM {part}", "SELECT p_partkey, round(exp(-p_size / 10.0::DOUBLE), 6) AS e, round(ln(p_size + 1.0::DOUBLE), 6) AS l, round(pow(p_size, 1.5), 4) AS p, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a FROM {part}")
relation("rel_arrays", "SELECT doc_id, size(split(text, '\\n')) AS lines, size(array_distinct(split(text, '\\n'))) AS own, concat(array(lang), array(source))[1] AS second FROM {documents}", "SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, len(list_distinct(string_split(text, chr(10))))::INT AS own, source AS second FROM {documents}")
relation("rel_conditional_aggregate", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS o FROM {orders} GROUP BY o_orderpriority")
relation("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")


@query("""SELECT e.event_id, max(o.event_id) AS seen FROM events e JOIN events o ON o.user_id = e.user_id AND o.event_type = 'signup' AND o.event_id <= e.event_id GROUP BY e.event_id""")
def rel_as_of(spark, sf):
    """The latest signup of the user up to each event: one window over the user's events, no join."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", seen.alias("seen")).filter("seen is not null")


@query("""SELECT d.doc_id, p.path FROM (SELECT doc_id, lang || '.' || source || '.' || (doc_id % 3) AS path FROM documents) d JOIN (VALUES ('en'), ('fr.src1'), ('de.src2.1')) AS p(path) ON d.path = p.path OR starts_with(d.path, p.path || '.')""")
def rel_prefix_hierarchy(spark, sf):
    """Paths below given ones: ancestors are spread out, so that the join is one of equals."""
    from ..operators.retrieval import prefixes

    path = F.concat_ws(".", "lang", "source", (F.col("doc_id") % 3).cast("string"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(prefixes(path)).alias("path"))
    return d.join(F.broadcast(spark.createDataFrame([("en",), ("fr.src1",), ("de.src2.1",)], "path string")), "path").select("doc_id", "path")


@query("""WITH f AS (SELECT o_orderkey AS id, 0 AS band FROM orders WHERE o_orderkey % 50 = 3 ORDER BY o_orderdate, o_orderkey LIMIT 200), q AS (SELECT 200 - count(*) AS room FROM f),
b AS (SELECT id, 1 AS band FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderkey % 50 <> 3), q WHERE k <= floor(room * 0.75)),
n AS (SELECT id, 2 AS band FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderkey % 50 <> 3 AND o_orderkey NOT IN (SELECT id FROM b)), q WHERE k <= room - floor(room * 0.75)) SELECT * FROM f UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n""")
def rel_fair_quota(spark, sf):
    """Two hundred orders: those in the foreground first, then three quarters of the room for the oldest and a quarter for the newest."""
    from ..operators.retrieval import fair_share

    return fair_share(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 50 == 3).alias("foreground")), 200)


@query("""SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.z') IS NOT NULL AS has_z, CAST(json_extract(props, '$.k') AS INT) = 3 AS holds, json_merge_patch(props, '{"m":1}')::VARCHAR AS patched, 'a' || (event_id % 3) LIKE 'a1%' OR event_type LIKE '%gn%' AS liked FROM events""")
def rel_json_like_any(spark, sf):
    """Keys of JSON, containment and a set key; LIKE ANY."""
    from ..functions import documents as J

    e = table(spark, sf, "events")
    liked = F.expr("concat('a', event_id % 3) like any ('a1%') or event_type like any ('%gn%', 'zz%')")
    return e.select("event_id", J.has_key(F.col("props"), "k").alias("has_k"), J.has_key(F.col("props"), "z").alias("has_z"), J.contains(F.col("props"), {"k": 3}).alias("holds"), F.replace(J.with_key(F.col("props"), "m", F.lit(1)), F.lit(" "), F.lit("")).alias("patched"), liked.alias("liked"))


@query("""WITH old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 2 = 0) SELECT k, v FROM new UNION ALL SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new)""")
def rel_upsert(spark, sf):
    """Insert or update: the newest row of a key wins."""
    from ..sources.tables import upsert

    c = table(spark, sf, "customer")
    return upsert(c.filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v")), ["k"])


@query("""WITH old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 2 = 0) SELECT k, v FROM old UNION ALL SELECT k, v FROM new WHERE k NOT IN (SELECT k FROM old)""")
def rel_insert_ignore(spark, sf):
    """Insert what is not there."""
    from ..sources.tables import insert_missing

    c = table(spark, sf, "customer")
    return insert_missing(c.filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v")), ["k"])


@query("""SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def rel_update_delete(spark, sf):
    """Update and delete by another table, as a rewritten one."""
    from ..sources.tables import delete_using, update_using

    c, s, o = (table(spark, sf, t) for t in ("customer", "supplier", "orders"))
    cleared = update_using(c.select("c_custkey", "c_nationkey", "c_acctbal"), s.filter("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")), ["c_nationkey"], {"c_acctbal": F.lit(0.0)})
    return delete_using(cleared, o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("""SELECT event_type, date_diff('minute', TIMESTAMP '2024-01-01', ts) // 1440 AS day, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY ALL""")
def rel_job_rates(spark, sf):
    """Arrivals per type and day, as windows of event time."""
    e = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))
    return e.select("event_type", F.datediff(F.col("w.start"), F.lit("2024-01-01")).cast("long").alias("day"), "n", "mean")
