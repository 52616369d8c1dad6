"""Queries of text functions and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import names as N
from docloom.functions import text as T
from docloom.operators import features as X
from docloom.operators import tables
from docloom.plans.base import Plans, grams, norm, read, toks
from docloom.session import dealt
from docloom.sources import readers

plans = Plans()


def _hashed(sf, spark, f):
    return read(spark, sf, "documents").select("doc_id", F.md5(f(F.col("text"))).alias("hash"), F.length(f(F.col("text"))).cast("bigint").alias("n"))


def _hash_sql(x: str) -> str:
    return f"SELECT doc_id, md5({x}) AS hash, length({x})::BIGINT AS n FROM documents"


@plans.add(_hash_sql(norm("text")))
def normalize_text(spark, sf):
    return _hashed(sf, spark, T.normalize)


@plans.add(_hash_sql(norm("text", " ")))
def normalize_rule_variant(spark, sf):
    return _hashed(sf, spark, T.normalize_rule)


@plans.add(_hash_sql(norm("text", lower=False)))
def normalize_no_lower(spark, sf):
    return _hashed(sf, spark, T.normalize_no_lower)


@plans.add(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, length(text)::BIGINT AS n_chars FROM (SELECT doc_id, text, {toks(norm('text'))} AS t FROM documents)")
def token_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.tokens(T.normalize(F.col("text")))).cast("bigint").alias("n_tokens"), F.length("text").cast("bigint").alias("n_chars"))


@plans.add(
    f"SELECT doc_id, len({grams('t', 2)})::BIGINT AS n2, len({grams('t', 3)})::BIGINT AS n3, md5(array_to_string(list_sort({grams('t', 2)}), ' ')) AS hash "
    f"FROM (SELECT doc_id, {toks(norm('text'))} AS t FROM documents)"
)
def shingle_counts(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", T.tokens(T.normalize(F.col("text"))).alias("t"))
    two, three = T.shingles(F.col("t"), 2), T.shingles(F.col("t"), 3)
    return d.select("doc_id", F.size(two).cast("bigint").alias("n2"), F.size(three).cast("bigint").alias("n3"), F.md5(F.array_join(F.array_sort(two), " ")).alias("hash"))


@plans.add(
    "SELECT doc_id, starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends, contains(text, 'tion') AS holds, contains(text, '') AS holds_empty, "
    "regexp_matches(text, 'county|County|COUNTY') AS county, contains(lower(text), 'president') AS president FROM documents"
)
def string_predicates(spark, sf):
    c = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id",
        T.is_prefix(F.lit("The"), c).alias("starts"),
        T.is_postfix(F.lit("."), c).alias("ends"),
        T.is_infix(F.lit("tion"), c).alias("holds"),
        T.is_infix(F.lit(""), c).alias("holds_empty"),
        N.has_county(c).alias("county"),
        F.contains(F.lower(c), F.lit("president")).alias("president"),
    )


@plans.add(
    "SELECT doc_id, len(regexp_extract_all(text, '\\p{Lu}'))::BIGINT AS caps, len(regexp_extract_all(text, '[.]'))::BIGINT AS dots, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS digits, "
    "CASE WHEN length(text) = 0 THEN 0.0 ELSE round(len(regexp_extract_all(text, '[.]')) / length(text), 6) END AS percent_dots, "
    "CASE WHEN length(text) = 0 THEN 0.0 ELSE round(len(regexp_extract_all(text, '[0-9]')) / length(text), 6) END AS percent_digits, "
    f"coalesce(t[1] = 'for', false) AS starts_with_for FROM (SELECT doc_id, text, {toks(norm('text'))} AS t FROM documents)"
)
def text_stats(spark, sf):
    c = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id",
        T.num_caps(c).cast("bigint").alias("caps"),
        T.num_dots(c).cast("bigint").alias("dots"),
        T.num_digits(c).cast("bigint").alias("digits"),
        F.round(T.percent_dots(c), 6).alias("percent_dots"),
        F.round(T.percent_digits(c), 6).alias("percent_digits"),
        T.starts_with_for(T.tokens(T.normalize(c))).alias("starts_with_for"),
    )


@plans.add(
    "SELECT doc_id, n_alpha, n - n_alpha AS n_other, CASE WHEN n = 0 THEN 0.0 ELSE round(n_alpha / n, 6) END AS percent_alpha, CASE WHEN n = 0 THEN 0.0 ELSE round(n_caps / n, 6) END AS percent_capitalized FROM ("
    "SELECT doc_id, len(t)::BIGINT AS n, len(list_filter(t, lambda x: regexp_full_match(x, '\\p{L}+')))::BIGINT AS n_alpha, len(list_filter(t, lambda x: regexp_matches(x, '^\\p{Lu}')))::BIGINT AS n_caps "
    f"FROM (SELECT doc_id, {toks(norm('text', lower=False))} AS t FROM documents))"
)
def alpha_token_stats(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", T.tokens(T.normalize_no_lower(F.col("text"))).alias("t"))
    alpha = F.size(T.alpha_tokens(F.col("t")))
    return d.select(
        "doc_id",
        alpha.cast("bigint").alias("n_alpha"),
        (F.size("t") - alpha).cast("bigint").alias("n_other"),
        F.round(T.percent_alpha(F.col("t")), 6).alias("percent_alpha"),
        F.round(T.percent_capitalized(F.col("t")), 6).alias("percent_capitalized"),
    )


FORBIDDEN = ("The", "the", "Idiot", "stupid", "Und", "und")


@plans.add(
    "SELECT doc_id, len(u)::BIGINT AS n, md5(array_to_string(list_sort(u), ' ')) AS hash FROM (SELECT doc_id, list_distinct(list_transform(list_filter(t, lambda x: NOT list_contains(['The', 'the', 'Idiot', 'stupid', 'Und', 'und'], x)), lambda x: lower(x))) AS u "
    f"FROM (SELECT doc_id, {toks(norm('text', lower=False))} AS t FROM documents))"
)
def unigram_bag(spark, sf):
    u = T.unigrams(F.col("text"), F.array(*map(F.lit, FORBIDDEN)))
    return read(spark, sf, "documents").select("doc_id", u.alias("u")).select("doc_id", F.size("u").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("u"), " ")).alias("hash"))


@plans.add(
    f"SELECT b.g AS bigram, count(*)::BIGINT AS n_docs FROM (SELECT unnest({grams('t', 2)}) AS g FROM (SELECT {toks(norm('text'))} AS t FROM documents)) b GROUP BY 1"
)
def bigram_bag(spark, sf):
    # Few bigrams are seen twice in a task: what it counts before the shuffle is as large as its texts, so tasks are many, not large.
    texts = dealt(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    # The words are a projection of their own: inside the shingles they would be made again for each use.
    d = texts.select(T.tokens(T.normalize(F.col("text"))).alias("t"))
    return d.select(F.explode_outer(T.shingles(F.col("t"), 2)).alias("bigram")).where("bigram is not null").groupBy("bigram").agg(F.count("*").alias("n_docs"))


@plans.add(
    "SELECT doc_id, len(list_filter(t, lambda x: regexp_matches(x, '^\\$*-*[0-9,]+$')))::BIGINT AS n_money, len(list_filter(t, lambda x: regexp_matches(x, '\\.{2,}')))::BIGINT AS n_dots, len(list_filter(t, lambda x: ends_with(rtrim(x, '.'), ':')))::BIGINT AS n_colon "
    f"FROM (SELECT doc_id, {toks('text')} AS t FROM documents)"
)
def money_cell_flags(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    n = lambda f: F.size(F.filter("t", f)).cast("bigint")
    return d.select("doc_id", n(T.is_money).alias("n_money"), n(T.has_dots).alias("n_dots"), n(T.ends_with_colon).alias("n_colon"))


@plans.add(
    "SELECT doc_id, len(c)::BIGINT AS n_cells, md5(array_to_string(list_transform(c, lambda x: trim(rtrim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '.'), '-')), '#')) AS hash FROM (SELECT doc_id, string_split(text, ' | ') AS c FROM documents)"
)
def cell_cleaning(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", T.cells(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("bigint").alias("n_cells"), F.md5(F.array_join(F.transform("c", T.clean_cell), "#")).alias("hash"))


@plans.add(
    "WITH names AS (SELECT 'Nation_' || n_nationkey AS full_name, 'N' || n_nationkey AS abbr FROM nation), "
    "lists AS (SELECT list(full_name) AS f, list(abbr) AS a FROM names), "
    f"d AS (SELECT c_custkey, {toks('said')} AS t FROM (SELECT c_custkey, c_name || ' of ' || CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'Nation_' || c_nationkey ELSE 'N' || c_nationkey END || CASE WHEN c_custkey % 2 = 0 THEN ' etc' ELSE '' END AS said FROM customer)) "
    "SELECT c_custkey, list_has_any(t, list_concat(f, list_transform(f, lambda x: upper(x)), a)) AS has_state, list_contains(list_concat(f, a), t[-1]) AS ends_with_state, "
    "(list_filter(list_transform(t, lambda w: CASE WHEN list_contains(a, w) THEN w WHEN list_contains(f, w) THEN replace(w, 'Nation_', 'N') WHEN list_contains(list_transform(f, lambda x: upper(x)), w) THEN replace(w, 'NATION_', 'N') END), lambda x: x IS NOT NULL))[1] AS state FROM d, lists"
)
def lookup_first_state(spark, sf):
    key = F.col("c_nationkey").cast("string")
    place = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NATION_"), key)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Nation_"), key)).otherwise(F.concat(F.lit("N"), key))
    said = F.concat(F.col("c_name"), F.lit(" of "), place, F.when(F.col("c_custkey") % 2 == 0, " etc").otherwise(""))
    names = read(spark, sf, "nation").select(F.concat(F.lit("Nation_"), "n_nationkey").alias("f"), F.concat(F.lit("N"), "n_nationkey").alias("a"))
    # A row of lookup arrays.
    entry = F.array(*(F.struct(k.alias("k"), F.col("a").alias("v")) for k in (F.upper("f"), F.col("f"), F.col("a"))))
    lists = names.agg(F.collect_list("f").alias("f"), F.collect_list("a").alias("a"), F.map_from_entries(F.flatten(F.collect_list(entry))).alias("m"))
    d = read(spark, sf, "customer").select("c_custkey", T.tokens(said).alias("t")).crossJoin(lists)
    return d.select("c_custkey", N.has_state(F.col("t"), F.col("f"), F.col("a")).alias("has_state"), N.ends_with_state(F.col("t"), F.col("f"), F.col("a")).alias("ends_with_state"), N.state_of(F.col("t"), F.col("m")).alias("state"))


@plans.add(
    "WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS city FROM part), l AS (SELECT list(city) AS c FROM w) "
    "SELECT doc_id, len(list_filter(c, lambda x: contains(text, x) OR contains(text, upper(x))))::BIGINT AS n_cities, list_min(list_filter(c, lambda x: contains(text, x) OR contains(text, upper(x)))) AS city FROM documents, l"
)
def substring_theta(spark, sf):
    cities = read(spark, sf, "part").select(F.split("p_name", " ")[0].alias("city"))
    d = read(spark, sf, "documents").select("doc_id", "text")
    return N.places(d, "doc_id", "text", cities, "city").select("doc_id", "n_cities", "city")


# Parts stand for entities, their types for those of entities.
_ENTITIES = "SELECT p_partkey AS entity_id, p_brand AS document_id, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Person' WHEN p_type = 'STANDARD' THEN 'City' ELSE 'Company' END AS entity_type, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part"
_POLITICIANS = "SELECT DISTINCT p_name AS politician FROM part WHERE p_retailprice < 950 AND p_size > 48"


def _entities(spark, sf):
    p = read(spark, sf, "part")
    kind = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "Person").when(F.col("p_type") == "STANDARD", "City").otherwise("Company")
    entities = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("document_id"), kind.alias("entity_type"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return entities, p.where("p_retailprice < 950 AND p_size > 48").select(F.col("p_name").alias("politician"))


@plans.add(f"SELECT DISTINCT entity_id, politician AS name FROM ({_ENTITIES}), ({_POLITICIANS}) WHERE entity_type = 'Person' AND (contains(name, politician) OR contains(name, upper(politician)))")
def person_mentions(spark, sf):
    """Politicians that entities of persons name, in either case; other entities are not looked at."""
    entities, politicians = _entities(spark, sf)
    return N.persons_named(entities, "entity_id", "entity_type", "name", politicians, "politician")


@plans.add(
    f"WITH e AS ({_ENTITIES}), c AS (SELECT document_id, entity_type, count(*) AS n FROM e GROUP BY 1, 2), f AS (SELECT document_id, 'TYPE_' || entity_type || ':' || n || '.0' AS f FROM c "
    f"UNION ALL SELECT document_id, 'POLITICIAN:' || CASE WHEN bool_or(entity_type = 'Person' AND EXISTS (SELECT 1 FROM ({_POLITICIANS}) WHERE contains(name, politician) OR contains(name, upper(politician)))) THEN '1.0' ELSE '0.0' END FROM e GROUP BY 1) "
    "SELECT document_id, string_agg(f, ' ' ORDER BY f) AS features FROM f GROUP BY 1"
)
def entity_type_features(spark, sf):
    """Entity types of each document and whether one of its persons is a politician."""
    entities, politicians = _entities(spark, sf)
    return X.entity_groups(entities, "document_id", "entity_id", "entity_type", "name", politicians, "politician").select("document_id", X.render(F.col("features")).alias("features"))


@plans.add(
    "WITH s AS (SELECT doc_id, unnest(string_split(text, ' | ')) AS cell FROM documents), p AS (SELECT doc_id, regexp_split_to_array(cell, '[:;, ]') AS p FROM s) "
    "SELECT doc_id, bool_or(x > 0.7) AS has_sponsor, round(avg((x > 0.7)::INT), 6) AS density FROM (SELECT doc_id, len(list_filter(p, lambda w: list_contains(['the', 'and', 'of', 'la', 'de', 'und', 'der'], w))) / len(p) AS x FROM p) GROUP BY doc_id"
)
def sponsor_ratio(spark, sf):
    known = F.array(*map(F.lit, ("the", "and", "of", "la", "de", "und", "der")))
    cells = read(spark, sf, "documents").select("doc_id", F.explode(T.cells(F.col("text"))).alias("cell"))
    x = N.name_share(F.col("cell"), known) > 0.7
    return cells.groupBy("doc_id").agg(F.bool_or(x).alias("has_sponsor"), F.round(F.avg(x.cast("int")), 6).alias("density"))


@plans.add(
    "SELECT page_id, md5(s) AS hash, length(s)::BIGINT AS n FROM (SELECT page_id, regexp_replace(regexp_replace(html, '[\\r\\n]', '', 'g'), '(?i)<script.*?</script>|<noscript.*?</noscript>|<style.*?</style>', '', 'g') AS s FROM pages)"
)
def html_preprocess(spark, sf):
    s = T.strip_html(F.col("html"))
    return read(spark, sf, "pages").select("page_id", F.md5(s).alias("hash"), F.length(s).cast("bigint").alias("n"))


@plans.add("SELECT page_id, sha1(url) AS content_id, string_split(url, '/')[-1] AS last, substr(url, 1, 4) AS year FROM pages")
def url_parts(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", T.content_id(u).alias("content_id"), T.last_segment(u).alias("last"), T.year_of(u).alias("year"))


@plans.add(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'bill' ELSE 'report' END AS doc_type, CASE WHEN o_orderkey % 3 < 2 THEN (100 + o_custkey % 12)::INT END AS congress, "
    "CASE WHEN o_orderkey % 3 = 2 THEN '' WHEN o_orderstatus = 'F' THEN 'senate' ELSE 'house' END AS chamber, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 's' ELSE 'hr' END || o_orderkey WHEN 1 THEN o_orderkey::VARCHAR ELSE '' END AS number, "
    "CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'enr' ELSE 'ih' END END AS version FROM orders"
)
def path_metadata(spark, sf):
    """Where documents lie, written by the path builders and read back: bills, reports, and files that are neither."""
    o = read(spark, sf, "orders")
    congress, kind = (100 + F.col("o_custkey") % 12).cast("int"), F.col("o_orderkey") % 3
    number = F.concat(F.when(F.col("o_orderstatus") == "F", "s").otherwise("hr"), F.col("o_orderkey").cast("string"))
    version = F.when(F.col("o_orderpriority") == "5-LOW", "enr").otherwise("ih")
    chamber = F.when(F.col("o_orderstatus") == "F", "senate").otherwise("house")
    at = F.when(kind == 0, readers.bill_path(congress, number, version)).when(kind == 1, readers.report_path(congress, chamber, F.col("o_orderkey"))).otherwise("notes")
    d = o.select("o_orderkey", F.concat(F.lit("file:/data/"), at, F.lit("/document.txt")).alias("path"))
    return readers.with_path_metadata(d).select("o_orderkey", "doc_type", "congress", "chamber", "number", "version")


_SAID = "SELECT event_id, unnest([0, 1]) AS i, event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"


@plans.add(
    f"SELECT event_id, 'urn:e' AS uri, 'w' || i AS entity_text, event_type AS entity_type, (k + 100 * i + event_id)::INT AS entity_offset, (i + 2)::INT AS entity_length, 'U' || user_id AS entity_inferred_name, CASE WHEN user_id % 2 = 0 THEN 'page' || user_id END AS entity_url FROM ({_SAID})"
)
def json_explode(spark, sf):
    """Instances of the entities in an annotator's answers, shifted to their place in the document."""
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    said = F.array(*(F.struct((F.col("k") + 100 * i).alias("offset"), F.lit(i + 2).alias("length"), F.lit(f"w{i}").alias("exact")) for i in (0, 1)))
    page = F.when(F.col("user_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("page"), "user_id").alias("id"))))
    entity = F.struct(F.lit("entities").alias("_typeGroup"), F.col("event_type").alias("_type"), F.concat(F.lit("U"), "user_id").alias("name"), said.alias("instances"), page.alias("resolutions"))
    topic = F.struct(F.lit("topics").alias("_typeGroup"), F.lit(None).cast("string").alias("_type"), F.lit("t").alias("name"), F.lit(None).cast("array<struct<offset:int,length:int,exact:string>>").alias("instances"), F.lit(None).cast("array<struct<id:string>>").alias("resolutions"))
    answers = e.select("event_id", F.to_json(F.create_map(F.lit("urn:e"), entity, F.lit("urn:t"), topic)).alias("response"))
    return readers.annotations(answers, offset=F.col("event_id").cast("int"))


@plans.add(
    "SELECT event_type AS type_group, count(*)::BIGINT AS n, max(event_id) AS last_id FROM events GROUP BY 1"
)
def type_group_counts(spark, sf):
    """Regroups JSON objects keyed by an id by the type inside them."""
    e = read(spark, sf, "events").select("event_id", F.to_json(F.create_map(F.concat(F.lit("urn:"), "event_id"), F.struct(F.col("event_type").alias("_typeGroup"), F.col("event_type").alias("name")))).alias("response"))
    g = readers.by_type_group(e).withColumnRenamed("event_id", "id")
    return g.groupBy("type_group").agg(F.sum("n").alias("n"), F.max("id").alias("last_id"))


@plans.add(
    "SELECT doc_id, substring(text, 1, 2048) AS entity_text, CASE WHEN length(text) >= 4096 THEN substring(text, 1, 4050) ELSE text END AS excerpt, substring(text, greatest(10 - 60, 0) + 1, 10) || '<<' || substring(text, 11, 10) || '>>' || substring(text, 21, 60) AS snippet FROM documents"
)
def truncations(spark, sf):
    from docloom.sources.writers import cut_excerpt, cut_to

    c = F.col("text")
    return read(spark, sf, "documents").select("doc_id", cut_to(c, 2048).alias("entity_text"), cut_excerpt(c).alias("excerpt"), T.window(c, F.lit(10), F.lit(20)).alias("snippet"))


def _drawn(spark, sf, line):
    """A text for each order with a table of its lines; ``line`` draws one."""
    li = read(spark, sf, "lineitem").join(read(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice", line.alias("line")).alias("r"))
    drawn = F.concat(F.lit(" A TABLE OF LINES\n\n"), F.array_join(F.transform("rs", lambda r: r["line"]), ""))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rs")).select(F.col("l_orderkey").alias("doc_id"), drawn.alias("text"))


def _amount():
    return F.concat(F.lit("  "), F.lpad(F.format_number("l_extendedprice", 0), 12, " "), F.lit("\n"))


def _drawn_tables(spark, sf):
    """Dotted tables, a line for each entry."""
    return _drawn(spark, sf, F.concat(F.rpad(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_brand"), 40, "."), _amount()))


def _drawn_requests(spark, sf):
    """Dotted tables with columns that hold names alone, as tables of requests do: after the amount who asked and where, for which the words of a part's name stand."""
    word = lambda n: F.get(F.split("p_name", " "), F.lit(n))
    amount = F.lpad(F.format_number("l_extendedprice", 0), 12, " ")
    name = F.rpad(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_brand"), 40, ".")
    return _drawn(spark, sf, F.concat(name, F.lit("  "), amount, F.lit("  "), F.rpad(word(1), 10, " "), F.lit("  "), word(0), F.lit("\n")))


def _drawn_entries(spark, sf):
    """Dotted tables, two lines for each entry: the name, and further in the brand with the amount."""
    return _drawn(spark, sf, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("\n"), F.rpad(F.concat(F.lit("  of_"), "p_brand"), 40, "."), _amount()))


_LINES = (
    "l AS (SELECT l_orderkey AS document_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS n, replace(p_name, ' ', '_') AS name, p_brand AS brand, format('{:,}', round_even(l_extendedprice, 0)::BIGINT) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey), "
)
_ENTROPY = "SELECT document_id, -sum(k / t * ln(k / t)) AS e FROM (SELECT document_id, v, count(*) AS k, sum(count(*)) OVER (PARTITION BY document_id) AS t FROM {of} GROUP BY 1, 2) GROUP BY 1"
_ROW = "document_id, 0 AS table_no, row_no, entity_text, 'table_row' AS entity_type, entity_offset, entity_length, entity_inferred_name, 'dots_table' AS source, n_cells"


@plans.add(
    f"WITH {_LINES} v AS (SELECT *, name || '_' || brand AS v FROM l), h AS ({_ENTROPY.format(of='v')}), "
    "r AS (SELECT document_id, n AS row_no, v || ' | ' || amount AS entity_text, 19 + 55 * n AS entity_offset, 55 AS entity_length, CASE WHEN e >= 1.2 THEN v ELSE '' END AS entity_inferred_name, 2::BIGINT AS n_cells FROM v JOIN h USING (document_id)) "
    f"SELECT {_ROW} FROM r"
)
def table_rows(spark, sf):
    """Rows of tables laid out as text: a table for each order, drawn from its lines."""
    return tables.extract_rows(_drawn_tables(spark, sf)).withColumn("n_cells", F.size("cells").cast("bigint")).drop("cells")


@plans.add(
    # Lines of the text, and what the parser must make of them: entries of two lines are one row, but for the table's first.
    f"WITH {_LINES} k AS (SELECT document_id, 2 * n AS line, name AS v, length(name) + 1 AS long, '' AS amount FROM l UNION ALL SELECT document_id, 2 * n + 1, 'of_' || brand, 55, amount FROM l), "
    f"o AS (SELECT *, 19 + coalesce(sum(long) OVER (PARTITION BY document_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM k), h AS ({_ENTROPY.format(of='k')}), "
    "g AS (SELECT document_id, CASE WHEN e < 1.2 OR line < 2 THEN line ELSE line // 2 + 1 END AS row_no, string_agg(v, ' ' ORDER BY line) AS v, max(amount) AS amount, min(begins)::INT AS entity_offset, (sum(long) + count(*) - 1)::INT AS entity_length FROM o JOIN h USING (document_id) GROUP BY 1, 2), "
    f"i AS ({_ENTROPY.format(of='g')}), "
    "r AS (SELECT document_id, row_no::INT AS row_no, v || ' | ' || amount AS entity_text, entity_offset, entity_length, CASE WHEN e >= 1.2 THEN v ELSE '' END AS entity_inferred_name, 2::BIGINT AS n_cells FROM g JOIN i USING (document_id)) "
    f"SELECT {_ROW} FROM r"
)
def table_entries(spark, sf):
    """Entries that go over two lines and share one amount."""
    return tables.extract_rows(_drawn_entries(spark, sf)).withColumn("n_cells", F.size("cells").cast("bigint")).drop("cells")


@plans.add(
    f"WITH {_LINES} c AS (SELECT document_id, count(*)::INT AS n_rows, string_agg(rpad(name || '_' || brand, 40, '.') || '  ' || lpad(amount, 12, ' ') || chr(10), ' ' ORDER BY n) AS content FROM l GROUP BY 1) "
    "SELECT document_id, 0 AS table_no, 19 AS \"offset\", 55 * n_rows AS length, 'dots' AS kind, '' AS headers, '' AS title, md5(content) AS body, md5(content) AS content, n_rows FROM c"
)
def table_blocks(spark, sf):
    """Tables found in text, each with its place and content."""
    t = tables.extract_tables(_drawn_tables(spark, sf))
    return t.withColumns({c: F.md5(c) for c in ("body", "content")})


_RULE = "-" * 56 + "\n"
_HEAD = _RULE + "Article".ljust(42) + "Amount\n" + _RULE


def _drawn_dashes(spark, sf):
    """Dashed tables with a head: the name on one line, the brand with the amount on the next, and a line that parts entries."""
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("\n"), F.rpad(F.concat(F.lit("of_"), "p_brand"), 38, " "), _amount(), F.lit("=\n"))
    d = _drawn(spark, sf, line)
    return d.select("doc_id", F.concat(F.substring("text", 1, 19), F.lit(_HEAD), F.expr("substring(text, 20)"), F.lit(_RULE)).alias("text"))


_ENTRY = (
    "q AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS k, (182 + coalesce(sum(length(name) + 56) OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS begins, length(name) + 1 AS long FROM l), "
    "j AS (SELECT document_id, n, name || ' of_' || brand AS v, amount, begins, long + 54 AS length, k, long FROM q), "
    # With the last run left as it is, its two lines are rows of their own.
    "d AS (SELECT false AS flush, document_id, n AS row_no, v, amount, begins, length FROM j WHERE n < k - 1 UNION ALL SELECT false, document_id, n, name, '', begins, long FROM q WHERE n = k - 1 UNION ALL SELECT false, document_id, n + 1, 'of_' || brand, amount, begins + long, 53 FROM q WHERE n = k - 1 "
    "UNION ALL SELECT true, document_id, n, v, amount, begins, length FROM j), "
    "e AS (SELECT flush, document_id, -sum(c / t * ln(c / t)) AS e FROM (SELECT flush, document_id, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY flush, document_id) AS t FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2) "
)


@plans.add(
    f"WITH {_LINES} {_ENTRY} SELECT flush, document_id, row_no::INT AS row_no, 'dashes' AS kind, 'Article,Amount' AS headers, v || ' | ' || amount AS entity_text, begins::INT AS entity_offset, length::INT AS entity_length, CASE WHEN e >= 1.2 THEN v ELSE '' END AS entity_inferred_name FROM d JOIN e USING (flush, document_id)"
)
def dashed_tables_sql(spark, sf):
    """The parser as a table function of SQL, on dashed tables, by both readings of the last run."""
    tables.register(spark)
    return spark.sql(
        "SELECT flush_last_run AS flush, document_id, r.row_no, t.kind, t.headers, r.entity_text, r.entity_offset, r.entity_length, r.entity_inferred_name "
        "FROM drawn_tables_of(TABLE(SELECT doc_id, text, explode(array(false, true)) AS flush_last_run FROM {docs})) AS t, LATERAL explode(t.rows) AS x(r)",
        docs=_drawn_dashes(spark, sf),
    )


@plans.add(f"WITH {_LINES} c AS (SELECT document_id, count(*)::INT AS n_rows, max(CASE WHEN n = 0 THEN name || '_' || brand || ' | ' || amount END) AS first_row FROM l GROUP BY 1) SELECT document_id, 'dots' AS kind, 19 AS \"offset\", 55 * n_rows AS length, n_rows, first_row FROM c")
def dotted_tables_sql(spark, sf):
    """The same on dotted tables: tables and rows of one parse."""
    tables.register(spark)
    return spark.sql("SELECT document_id, kind, offset, length, size(rows) AS n_rows, rows[0].entity_text AS first_row FROM drawn_tables_of(TABLE({docs}))", docs=_drawn_tables(spark, sf))


@plans.add()
def score_documents(spark, sf):
    """Documents to scored candidate rows, with a model fitted on which rows are of widgets; states, cities and sponsors are words that some rows have and others lack."""
    from docloom.operators import ml, scoring
    from docloom.session import written

    names = F.array(F.lit("ring"), F.lit("gear"))
    states = F.create_map(F.lit("red"), F.lit("RD"), F.lit("small"), F.lit("SM"))
    rows = written(scoring.rows_with_sponsors(tables.parsed_rows(_drawn_requests(spark, sf)), names), "rows")  # drawn and parsed once
    cities = read(spark, sf, "part").select(F.get(F.split("p_name", " "), F.lit(1)).alias("city")).where("city < 'h'")
    places = scoring.Places(F.array(F.lit("red"), F.lit("small")), F.array(F.lit("RD"), F.lit("SM")), cities)
    ready = scoring.row_vectors(rows.withColumn("label", F.contains("entity_text", F.lit("widget")).cast("int")), names, places)
    return scoring.scored_rows(ready, ml.forest(trees=5, depth=5).fit(ready), names, states)


_STATES, _ABBREVIATIONS, _CITIES, _NAMES, _PREFIXES = ("The", "Une"), ("la", "der"), ("tion", "Haus"), ("the", "and", "of", "la", "de", "und", "der"), ("The", "Of", "In")


def _listed(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@plans.add(
    f"WITH w AS (SELECT doc_id, text, {toks(norm('text'))} AS t, {toks(norm('text', lower=False))} AS k FROM documents), "
    "c AS (SELECT *, len(t) AS n, length(text) AS long, len(list_filter(t, lambda x: regexp_full_match(x, '\\p{L}+'))) AS alpha, len(regexp_extract_all(text, '[.]')) AS dots, len(regexp_extract_all(text, '[0-9]')) AS digits FROM w), "
    "f AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{Lu}'))::DOUBLE AS NUM_ALL_CAPS, dots::DOUBLE AS NUM_DOTS, CASE WHEN long = 0 THEN 0.0 ELSE dots / long END AS PERCENT_DOTS, digits::DOUBLE AS NUM_DIGITS, CASE WHEN long = 0 THEN 0.0 ELSE digits / long END AS PERCENT_DIGITS, "
    "n::DOUBLE AS NUM_WORDS, long::DOUBLE AS LENGTH, coalesce(t[1] = 'for', false)::INT::DOUBLE AS STARTS_WITH_FOR, CASE WHEN len(k) = 0 THEN 0.0 ELSE len(list_filter(k, lambda x: regexp_matches(x, '^\\p{Lu}'))) / len(k) END AS PERCENT_CAPITALIZED, "
    "alpha::DOUBLE AS ALPHA_TOKENS, CASE WHEN n = 0 THEN 0.0 ELSE alpha / n END AS PERCENT_ALPHA_TOKENS, (n - alpha)::DOUBLE AS NON_ALPHA_TOKENS, CASE WHEN n = 0 THEN 0.0 ELSE 1 - alpha / n END AS PERCENT_NON_ALPHA_TOKENS, "
    f"list_has_any(k, list_concat({_listed(_STATES)}, {_listed(tuple(map(str.upper, _STATES)))}, {_listed(_ABBREVIATIONS)}))::INT::DOUBLE AS GEO_HAS_STATE, regexp_matches(text, 'county|County|COUNTY')::INT::DOUBLE AS GEO_HAS_COUNTY, "
    f"coalesce(list_contains(list_concat({_listed(_STATES)}, {_listed(_ABBREVIATIONS)}), k[-1]), false)::INT::DOUBLE AS GEO_ENDS_WITH_STATE, ({' OR '.join(f'contains(text, {x!r}) OR contains(text, {x.upper()!r})' for x in _CITIES)})::INT::DOUBLE AS GEO_HAS_CITY, "
    f"(len(list_filter(string_split(text, ' | '), lambda z: len(list_filter(regexp_split_to_array(z, '[:;, ]'), lambda x: list_contains({_listed(_NAMES)}, x))) / len(regexp_split_to_array(z, '[:;, ]')) > 0.7)) > 0)::INT::DOUBLE AS SPONSOR_PRESENT, "
    + ", ".join(f"CASE WHEN starts_with(text, '{x}') THEN 1.0::DOUBLE END AS PREFIX_{x}" for x in _PREFIXES)
    + ", len(list_distinct(t))::DOUBLE AS N_UNIGRAMS FROM c) "
    "SELECT doc_id, feature, round(value, 6) AS value FROM (UNPIVOT f ON COLUMNS(* EXCLUDE doc_id) INTO NAME feature VALUE value)"
)
def feature_groups(spark, sf):
    """Sparse features of every document, from several generators in a row."""
    c = F.col("text")
    listed = lambda values: F.array(*map(F.lit, values))
    kept = F.col("kept")  # tokens that three generators look at
    d = X.pipe(
        read(spark, sf, "documents").select("doc_id", "text", T.kept_tokens(c).alias("kept")),
        X.group("simple", X.simple_text(c, kept)),
        X.group("unigrams", X.unigram_bag(c, kept=kept)),
        X.group("geo", X.geo(c, listed(_STATES), listed(_ABBREVIATIONS), listed(_CITIES), kept=kept)),
        X.group("sponsor", X.sponsor(c, listed(_NAMES))),
        X.group("prefixes", N.prefix_features(c, list(_PREFIXES))),
        # A group that is there already is not made again.
        X.group("simple", F.create_map(F.lit("WRONG"), F.lit(1.0))),
    )
    n = F.create_map(F.lit("N_UNIGRAMS"), F.size("unigrams").cast("double"))
    return d.select("doc_id", F.explode(F.map_concat("simple", "geo", "sponsor", "prefixes", n)).alias("feature", "value")).withColumn("value", F.round("value", 6))


@plans.add(
    f"SELECT doc_id, md5(array_to_string(list_transform(list_sort(list_distinct({toks(norm('text'))})), lambda x: 'UNIGRAM_' || x || ':1.0'), ' ')) AS hash FROM documents"
)
def rendered_features(spark, sf):
    """A feature group as text, ``name:value`` in the order of names."""
    return read(spark, sf, "documents").select("doc_id", F.md5(X.render(X.unigram_bag(F.col("text")))).alias("hash"))


def _bags(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang", X.presence(T.tokens(F.lower("text")), "W_").alias("words"), F.create_map(F.concat(F.lit("SOURCE_"), "source"), F.lit(1.0)).alias("source"))


_NAMES_SEEN = (
    f"WITH d AS (SELECT doc_id, lang, {toks('lower(text)')} AS t, source FROM documents), u AS (SELECT doc_id, lang, 'W_' || unnest(t) AS name, generate_subscripts(t, 1) AS place FROM d UNION ALL SELECT doc_id, lang, 'SOURCE_' || source, 1000000000 FROM d), "
)


@plans.add(_NAMES_SEEN + "f AS (SELECT name, min(doc_id) AS seen, arg_min(place, (doc_id, place)) AS place FROM u GROUP BY 1) SELECT name, row_number() OVER (ORDER BY seen, place) - 1 AS \"index\" FROM f")
def feature_index(spark, sf):
    """A number for each feature, as they are first seen."""
    return X.feature_index(_bags(spark, sf), ["words", "source"], "doc_id")


@plans.add(
    _NAMES_SEEN + "f AS (SELECT name, lang <> 'en' AS later, min(doc_id) AS seen, arg_min(place, (doc_id, place)) AS place FROM u GROUP BY 1, 2), "
    "g AS (SELECT * FROM f WHERE NOT later OR name NOT IN (SELECT name FROM f WHERE NOT later)) SELECT name, row_number() OVER (ORDER BY later, seen, place) - 1 AS \"index\" FROM g"
)
def feature_space_union(spark, sf):
    """The features of one part of the documents, and after them those that only the others have."""
    bags = _bags(spark, sf)
    return X.feature_space_union(X.feature_index(bags.where("lang = 'en'"), ["words", "source"], "doc_id"), bags.where("lang <> 'en'"), ["words", "source"], "doc_id")


@plans.add(
    f"WITH d AS (SELECT doc_id, source, list_distinct({toks('lower(text)')}) AS t FROM documents) SELECT doc_id, (len(t) + 1)::BIGINT AS n_features, (len(t) + 1)::DOUBLE AS total FROM d"
)
def sparse_vectors(spark, sf):
    """Documents as positions and values in the space of all features: as many as each has."""
    bags = _bags(spark, sf)
    v = X.sparse(bags, "doc_id", ["words", "source"], X.feature_index(bags, ["words", "source"], "doc_id"))
    return v.select("doc_id", F.size(F.array_distinct("positions")).cast("long").alias("n_features"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))
