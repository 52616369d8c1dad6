"""Queries of joins, aggregates, windows, sets, samples and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import pairs as P
from docloom.functions import text as T
from docloom.operators import crosswalk as C
from docloom.operators import relational as R
from docloom.operators import report
from docloom.operators.linkage import append_new, consecutive_no
from docloom.plans.base import Plans, read, toks
from docloom.sources import connectors, writers

plans = Plans()


@plans.add(
    "SELECT user_id, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2) GROUP BY 1"
)
def entropy_by_group(spark, sf):
    return R.entropy(read(spark, sf, "events"), ["user_id"], "event_type").select("user_id", F.round("entropy", 6).alias("entropy"))


@plans.add("SELECT p_name, max(p_partkey) AS id FROM part GROUP BY 1")
def max_id_by_name(spark, sf):
    return read(spark, sf, "part").groupBy("p_name").agg(F.max("p_partkey").alias("id"))


@plans.add(
    "WITH g AS (SELECT l_returnflag || l_linestatus AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem GROUP BY 1, 2 HAVING count(*) > 100) SELECT a AS name FROM g UNION SELECT b FROM g"
)
def blacklist_having(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("a"), F.col("l_suppkey").cast("string").alias("b")).agg(F.count("*").alias("n")).where("n > 100")
    return g.select(F.explode(F.array("a", "b")).alias("name")).distinct()


@plans.add(
    f"WITH t AS (SELECT doc_id, unnest(list_distinct({toks('lower(text)')})) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents) "
    "SELECT term, count(*)::BIGINT AS df, round(log10((any_value(n) // (count(*) + 1)) + 1), 6) AS idf FROM t, n GROUP BY 1"
)
def idf(spark, sf):
    d = read(spark, sf, "documents")
    n = d.agg(F.countDistinct("doc_id").alias("n"))
    df = d.select(F.explode_outer(F.array_distinct(T.tokens(F.lower("text")))).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    # One row: the size of the corpus.
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log10(F.expr("n div (df + 1)") + 1), 6).alias("idf"))


@plans.add(
    "SELECT c_name, max(s_suppkey) AS last_supplier FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE year(o_orderdate) = 1997 AND n_regionkey = 1 GROUP BY 1"
)
def positives_star_join(spark, sf):
    o = read(spark, sf, "orders").where(F.year("o_orderdate") == 1997)
    c = read(spark, sf, "customer").join(read(spark, sf, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("c_name").agg(F.max("s_suppkey").alias("last_supplier"))


@plans.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def negatives_not_exists(spark, sf):
    o = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000")
    return read(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@plans.add(
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
)
def negatives_in_semi(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return o.join(read(spark, sf, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@plans.add("SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45 WHERE l_orderkey IS NULL")
def left_null_anti(spark, sf):
    li = read(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    return read(spark, sf, "part").join(li, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@plans.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || 's'), o_orderkey LIMIT 1000")
def sample_hash_limit(spark, sf):
    """Sampling: the limit is the feature."""
    return R.sample_exact(read(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_totalprice")


_MINUTE = "CAST(floor(epoch_us(ts) / 60000000) AS BIGINT)"


def _minutes(e):
    return e.withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("bigint"))


@plans.add(
    f"WITH e AS (SELECT event_id, user_id, event_type, {_MINUTE} AS moment FROM events), i AS (SELECT event_id AS interval_id, user_id, moment AS s, moment + 600 AS f FROM e WHERE event_type = 'signup') "
    "SELECT e.event_id, i.interval_id FROM e JOIN i USING (user_id) WHERE e.moment > i.s AND e.moment < i.f"
)
def containing_interval(spark, sf):
    e = _minutes(read(spark, sf, "events")).select("event_id", "user_id", "event_type", "at")
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("interval_id"), F.col("at").alias("s"), (F.col("at") + 600).alias("f"))
    return R.inside(e, i, "user_id", "at", "s", "f").select("event_id", "interval_id")


@plans.add(
    f"WITH e AS (SELECT event_id, user_id, event_type, {_MINUTE} AS moment FROM events) SELECT a.event_id AS event_id_a, b.event_id AS event_id_b FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase' AND b.moment BETWEEN a.moment - 700 AND a.moment + 300"
)
def band_neighbours(spark, sf):
    e = _minutes(read(spark, sf, "events")).select("event_id", "user_id", "event_type", "at")
    return R.band(e, "user_id", "at", "event_type", 700, 300, "purchase").select("event_id_a", "event_id_b")


@plans.add("SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS is_first FROM conversations")
def first_in_group(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", (F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))).alias("is_first"))


@plans.add("SELECT DISTINCT year(o_orderdate)::INT AS year, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def distinct_docs_by_year(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return o.join(read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("year", "l_suppkey").distinct()


@plans.add("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'MACHINERY'")
def natural_key_lookup(spark, sf):
    c = read(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return read(spark, sf, "orders").where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@plans.add("SELECT c_custkey, coalesce(min(o_orderkey), -1) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def first_match_or_default(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").withColumn("first_order", F.coalesce("first_order", F.lit(-1).cast("bigint")))


@plans.add(
    "WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS b, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS c FROM events) "
    "SELECT user_id, event_id, n_set FROM (SELECT *, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) AS n_set, row_number() OVER (PARTITION BY user_id ORDER BY ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) DESC, event_id) AS n FROM e) WHERE n = 1"
)
def most_complete_row(spark, sf):
    e = read(spark, sf, "events")
    gap = lambda k, c: F.when(F.col("event_id") % k != 0, F.col(c))
    e = e.select("event_id", "user_id", gap(3, "value").alias("a"), gap(5, "event_type").alias("b"), gap(7, "props").alias("c"))
    return R.most_complete(e, "user_id", ["a", "b", "c"], ["event_id"]).select("user_id", "event_id", "n_set")


@plans.add("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_version(spark, sf):
    return R.latest(read(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@plans.add("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def dedup_keep_first(spark, sf):
    return R.keep_first(read(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@plans.add(
    f"WITH d AS (SELECT DISTINCT user_id, {_MINUTE} // 60 AS hour FROM events), r AS (SELECT user_id, hour, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS run FROM d) SELECT user_id, min(hour) AS first, max(hour) AS last, count(*)::BIGINT AS length FROM r GROUP BY user_id, run"
)
def gaps_islands(spark, sf):
    e = _minutes(read(spark, sf, "events")).withColumn("hour", F.expr("at div 60"))
    return R.runs(e, ["user_id"], "hour")


@plans.add("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations")
def running_offset(spark, sf):
    return R.running_offset(read(spark, sf, "conversations"), ["conv_id"], ["turn"], F.length("text")).select("conv_id", "turn", F.col("offset").cast("bigint").alias("offset"))


@plans.add(
    "WITH s AS (SELECT user_id, event_id, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT user_id, event_id, (sum((event_type <> 'purchase')::INT) OVER (PARTITION BY user_id, g ORDER BY event_id))::BIGINT AS run FROM s"
)
def consecutive_no_runs(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return consecutive_no(e, ["user_id"], ["event_id"], F.col("event_type") == "purchase").select("user_id", "event_id", "run")


@plans.add("SELECT doc_id, quality, (((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || 'f'), doc_id)) - 1) % 5)::INT AS fold FROM labels")
def stratified_folds(spark, sf):
    return R.stratified_folds(read(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 5)


@plans.add("SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS place FROM part) WHERE place <= 5")
def topn_per_group(spark, sf):
    return R.top_n(read(spark, sf, "part"), ["p_brand"], [F.col("p_retailprice").desc(), "p_partkey"], 5).select("p_brand", "p_partkey", "place")


@plans.add("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@plans.add(
    "WITH c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), s AS (SELECT s_nationkey AS k FROM supplier) "
    "SELECT 'both' AS kind, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'either', k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'missing', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT k FROM s)"
)
def set_ops(spark, sf):
    c = read(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return tag(c.intersect(s), "both").unionAll(tag(c.union(s).distinct(), "either")).unionAll(tag(connectors.missing(n, s, ["k"]), "missing"))


@plans.add(
    "WITH b AS (SELECT page_id, (['H. Con. Res. ', 'H.J. Res. ', 'H.R. ', 'H. Res. ', 'S. Con. Res. ', 'S.J. Res. ', 'S. Res. ', 'S. '])[page_id % 8 + 1] || page_id AS name FROM pages) "
    "SELECT page_id, CASE WHEN contains(name, 'H. Con. Res.') THEN 'hconres' WHEN contains(name, 'H.J. Res.') THEN 'hjres' WHEN contains(name, 'H.R.') THEN 'hr' WHEN contains(name, 'H. Res.') THEN 'hres' WHEN contains(name, 'S. Con. Res.') THEN 'sconres' WHEN contains(name, 'S.J. Res.') THEN 'sjres' WHEN contains(name, 'S. Res.') THEN 'sres' ELSE 's' END || regexp_extract(name, '(\\d+)', 1) AS folder FROM b"
)
def bill_type_case(spark, sf):
    kinds = F.array(*map(F.lit, ("H. Con. Res. ", "H.J. Res. ", "H.R. ", "H. Res. ", "S. Con. Res. ", "S.J. Res. ", "S. Res. ", "S. ")))
    name = F.concat(F.get(kinds, (F.col("page_id") % 8).cast("int")), F.col("page_id").cast("string"))
    return read(spark, sf, "pages").select("page_id", C.bill_folder(name).alias("folder"))


_LAWS = [f"{congress}-{number}" for congress, number in C.LAW_DOCUMENTS]
_LAWS_SQL = "(VALUES " + ", ".join(f"('{law}', {', '.join(map(repr, d))})" for law, docs in zip(_LAWS, C.LAW_DOCUMENTS.values(), strict=True) for d in docs) + ") AS laws(law, doc_type, chamber, number)"


@plans.add(
    f"WITH s AS (SELECT s_suppkey, unnest(string_split(([{', '.join(repr('P.L. ' + x) for x in _LAWS)}])[s_suppkey % {len(_LAWS)} + 1] || '&&' || 'H. Rept. 109-' || s_suppkey, '&&')) AS cited FROM supplier), "
    "k AS (SELECT s_suppkey, cited, regexp_extract_all(cited, '\\d+') AS n FROM s) "
    f"SELECT s_suppkey, string_split(law, '-')[1]::INT AS congress, doc_type, chamber, number FROM k JOIN {_LAWS_SQL} ON law = n[1] || '-' || n[2] WHERE contains(cited, 'P.L.') "
    "UNION ALL SELECT s_suppkey, n[1]::INT, 'report', 'house', n[2] FROM k WHERE contains(cited, 'Rept.')"
)
def citation_explode(spark, sf):
    laws = F.array(*(F.lit(f"P.L. {x}") for x in _LAWS))
    said = F.concat(F.get(laws, (F.col("s_suppkey") % len(_LAWS)).cast("int")), F.lit("&&"), F.lit("H. Rept. 109-"), F.col("s_suppkey").cast("string"))
    s = read(spark, sf, "supplier").select("s_suppkey", F.explode(C.all_citations_2005(said)).alias("c"))
    return s.select("s_suppkey", "c.congress", "c.doc_type", "c.chamber", "c.number")


# Citations of the later years, one for each way of citing, and what they name: congress, type, chamber, number.
_CITED_2009 = (
    ("Div. A, Defense, 2008, ", "110", "bill", "house", "'hr2638'"),
    ("Div. B, Commerce, ", "111", "bill", "house", "'hr1105'"),
    ("H. Report 110-", "110", "report", "house", "k"),
    ("S. Report 110-", "110", "report", "senate", "k"),
    ("S. ", "111", "bill", "senate", "'s' || k"),
    ("nothing before ", None, None, None, None),
)
_CITED_2010 = (
    ("Div. A ", "111", "bill", "house", "'hr3288'"),
    ("H.R. ", "111", "bill", "house", "'hr' || k"),
    ("S. ", "111", "bill", "senate", "'s' || k"),
    ("Senate Report 111-", "111", "report", "senate", "k"),
    ("House Report 111-", "111", "report", "house", "k"),
    ("Joint Explanatory Statement 111-", "111", "report", "house", "k"),
    ("P.L. 111-88 no. ", "111", "bill", "house", "'hr2996'"),
    ("nothing before ", None, None, None, None),
)


def _cited_sql(year: int, table: tuple) -> str:
    said = lambda i, quote: "CASE n " + " ".join(f"WHEN {n} THEN {repr(row[i]) if quote else row[i]}" for n, row in enumerate(table) if row[i]) + " END"
    return f"SELECT s_suppkey, {year} AS year, ({said(1, False)})::INT AS congress, {said(2, True)} AS doc_type, {said(3, True)} AS chamber, {said(4, False)} AS number FROM (SELECT s_suppkey, s_suppkey::VARCHAR AS k, s_suppkey % {len(table)} AS n FROM supplier)"


@plans.add(_cited_sql(2009, _CITED_2009) + " UNION ALL " + _cited_sql(2010, _CITED_2010))
def citation_tables(spark, sf):
    """Citations of 2009 and 2010, each way of citing."""
    s = read(spark, sf, "supplier").select("s_suppkey")
    out = []
    for year, table, parse in ((2009, _CITED_2009, C.citation_2009), (2010, _CITED_2010, C.citation_2010)):
        said = F.concat(F.get(F.array(*(F.lit(row[0]) for row in table)), (F.col("s_suppkey") % len(table)).cast("int")), F.col("s_suppkey").cast("string"))
        out.append(s.select("s_suppkey", F.lit(year).alias("year"), parse(said).alias("c")).select("s_suppkey", "year", "c.congress", "c.doc_type", "c.chamber", "c.number"))
    return out[0].unionAll(out[1])


@plans.add(
    "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), "
    "h AS (SELECT 0 AS level, 's' || s_suppkey AS start, 's' || s_suppkey AS node FROM supplier UNION ALL SELECT level + 1, start, parent FROM h JOIN e ON node = child WHERE level < 3) SELECT level::INT AS level, node, count(*)::BIGINT AS n FROM h GROUP BY 1, 2"
)
def category_bfs(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        read(spark, sf, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
        .unionAll(read(spark, sf, "region").select(key("r", "r_regionkey"), F.lit("all")))
        .unionAll(read(spark, sf, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey")))
    )
    start = read(spark, sf, "supplier").select(key("s", "s_suppkey").alias("node"))
    return R.hierarchy(edges, start, 3).select("level", "node", F.col("paths").alias("n"))


@plans.add(
    # A ring of nations under each region, with short cuts: what each supplier's nation reaches, each node once, at its least level.
    "WITH RECURSIVE e AS (SELECT n_nationkey AS child, (n_nationkey + 5) % 25 AS parent FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 10) % 25 FROM nation WHERE n_nationkey % 2 = 0), "
    "h AS (SELECT 0 AS level, s_suppkey AS start, s_nationkey AS node FROM supplier UNION SELECT level + 1, start, parent FROM h JOIN e ON node = child WHERE level < 6) "
    "SELECT start, node::BIGINT AS node, min(level)::INT AS level FROM h GROUP BY 1, 2"
)
def category_cycle(spark, sf):
    """A hierarchy with cycles, gone through from many starts at once; each node is met once."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("child"))
    edges = n.select("child", ((F.col("child") + 5) % 25).alias("parent")).unionAll(n.where("child % 2 = 0").select("child", ((F.col("child") + 10) % 25).alias("parent")))
    start = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("start"), F.col("s_nationkey").cast("long").alias("node"))
    return R.hierarchy(edges, start, 6, keep=("start",), once=True).select("start", "node", "level")


@plans.add(
    "SELECT a.s_suppkey AS a, b.s_suppkey AS b, (a.s_acctbal > 5000) = (b.s_acctbal > 5000) AS same_side, round(abs(a.s_acctbal - b.s_acctbal), 6) AS apart FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_nationkey <> 0"
)
def self_pairs(spark, sf):
    s = read(spark, sf, "supplier").withColumn("rich", F.col("s_acctbal") > 5000)
    p = R.self_pairs(s, "s_nationkey", "s_suppkey", none=0)
    same, apart = P.same_features("a", "b", ["rich"]), P.difference_features("a", "b", ["s_acctbal"])
    return p.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), F.map_contains_key(same, "IS_SAME_rich").alias("same_side"), F.round(F.element_at(apart, "ABS_DIFFERENCE_s_acctbal"), 6).alias("apart"))


@plans.add(
    "WITH p AS (SELECT c_custkey, (c_custkey % 180) - 90.0 AS lat1, (c_custkey % 360) - 180.0 AS lon1, (c_nationkey * 7 % 180) - 90.0 AS lat2, (c_nationkey * 13 % 360) - 180.0 AS lon2 FROM customer) "
    "SELECT c_custkey, round(acos(greatest(-1.0, least(1.0, sin(radians(90.0 - lat1)) * sin(radians(90.0 - lat2)) * cos(radians(lon1) - radians(lon2)) + cos(radians(90.0 - lat1)) * cos(radians(90.0 - lat2))))), 5) AS distance FROM p"
)
def sphere_distance(spark, sf):
    c = read(spark, sf, "customer")
    at = lambda e: F.expr(f"cast({e} as double)")
    d = P.sphere_distance(at("(c_custkey % 180) - 90.0"), at("(c_custkey % 360) - 180.0"), at("(c_nationkey * 7 % 180) - 90.0"), at("(c_nationkey * 13 % 360) - 180.0"))
    return c.select("c_custkey", F.round(d, 5).alias("distance"))


@plans.add("SELECT c_custkey, coalesce(try_cast(substr(c_name, 1 + c_custkey::INT % 12) AS INT), 7) AS n, coalesce(try_cast(c_mktsegment AS DOUBLE), 2.0) AS gpa FROM customer")
def typed_defaults(spark, sf):
    part = F.expr("substring(c_name, 1 + cast(c_custkey % 12 as int))")
    return read(spark, sf, "customer").select("c_custkey", P.cast_or(part, "int", 7).alias("n"), P.cast_or(F.col("c_mktsegment"), "double", 2.0).alias("gpa"))


@plans.add(
    "WITH p AS (SELECT n_nationkey, n_name, n_nationkey * 1000 + 50000 AS population FROM nation), t AS (SELECT c_nationkey AS k, " + ", ".join(f"count(*) FILTER (WHERE year(o_orderdate) = {y}) AS p{y}" for y in range(1995, 2002)) + ", count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) "
    "SELECT n_name, " + ", ".join(f"p{y}::BIGINT AS p{y}" for y in range(1995, 2002)) + ", total::BIGINT AS total, round(total * 10000 / population, 6) AS total_pc FROM t JOIN p ON k = n_nationkey"
)
def state_pivot_per_capita(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    j = o.join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    t = report.pivot_counts(j, "c_nationkey", "year", list(range(1995, 2002)))
    people = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", (F.col("n_nationkey") * 1000 + 50000).alias("population"))
    columns = [f"p{y}" for y in range(1995, 2002)]
    rate = report.per_capita(t, people, "c_nationkey", [*columns, "total"])
    return rate.join(people.select("c_nationkey", "n_name"), "c_nationkey").select("n_name", *columns, "total", F.round("total_pc", 6).alias("total_pc"))


@plans.add(
    "WITH t AS (SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2) SELECT c_mktsegment, c_nationkey, n, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey)::INT AS place FROM t) WHERE place <= 5"
)
def top_recipients(spark, sf):
    t = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return report.top_by(t, "c_mktsegment", "c_nationkey", "n").select("c_mktsegment", "c_nationkey", "n", "place")


@plans.add(
    "WITH b AS (SELECT quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM customer) SELECT c_custkey, (1 + (c_acctbal >= q[2])::INT + (c_acctbal >= q[3])::INT + (c_acctbal >= q[4])::INT + (c_acctbal >= q[5])::INT)::INT AS class FROM customer, b"
)
def quantile_bins(spark, sf):
    c = read(spark, sf, "customer")
    # One row of breaks.
    b = report.quantile_breaks(c, "c_acctbal")
    return c.crossJoin(F.broadcast(b)).select("c_custkey", report.interval_of(F.col("c_acctbal"), F.col("breaks")).cast("int").alias("class"))


@plans.add("SELECT n_nationkey, metric, value FROM (UNPIVOT (SELECT n_nationkey, n_regionkey::BIGINT AS region, length(n_name)::BIGINT AS letters FROM nation) ON region, letters INTO NAME metric VALUE value)")
def metric_choice(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("region"), F.length("n_name").cast("bigint").alias("letters"))
    return report.long_form(n, "n_nationkey", ["region", "letters"])


@plans.add("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') x WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_custkey = x.o_custkey AND f.o_orderpriority = x.o_orderpriority)")
def idempotent_append(spark, sf):
    """What an append may write: keys that are not there yet."""
    o = read(spark, sf, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    new = o.where("o_orderstatus = 'O'").groupBy(*keys).agg(F.min("o_orderkey").alias("o_orderkey"))
    return append_new(o.where("o_orderstatus = 'F'").select(*keys), new, keys)


@plans.add("SELECT o_orderkey, (row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) + 500)::BIGINT AS id FROM orders")
def surrogate_keys(spark, sf):
    return writers.with_surrogate(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], after=500)


@plans.add("SELECT o_orderkey, coalesce(d, o_totalprice) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def update_by_id(spark, sf):
    new = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    return writers.updated(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), new, "o_orderkey", "o_totalprice")


@plans.add("SELECT doc_id, (i - 1)::INT AS position, x AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def exploded_children(spark, sf):
    return writers.children(read(spark, sf, "documents").withColumn("lines", F.split("text", "\n")), "doc_id", "lines", "line")
