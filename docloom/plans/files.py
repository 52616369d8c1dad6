"""Queries of readers and writers: tables are written as the files that a source has, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import tables
from docloom.plans.base import Plans, read
from docloom.session import scratch
from docloom.sources import connectors, readers, services, store, writers

plans = Plans()


@plans.add("SELECT CAST(c_custkey AS VARCHAR) AS earmark_id, c_name AS short_description, nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ', \"' || c_nationkey || '\"' END, '') AS full_text FROM customer")
def csv_extract(spark, sf):
    """An extract with names in capitals, commas and quotes in its fields, and empty fields."""
    at = scratch(spark, "csv")
    said = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.col("c_mktsegment"), F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')))
    writers.delimited(read(spark, sf, "customer").select(F.col("c_custkey").alias("EARMARK ID"), F.col("c_name").alias("Short Description"), said.alias("Full Text")), at)
    df = readers.csv(spark, at)
    return df.withColumn("full_text", F.nullif("full_text", F.lit("")))


@plans.add("SELECT CAST(s_suppkey AS VARCHAR) AS \"EARMARK_ID\", s_name AS \"CITATION_REFERENCE\" FROM supplier")
def csv_by_header(spark, sf):
    """Some columns of a file, found by their names in its header."""
    at = scratch(spark, "csv")
    writers.delimited(read(spark, sf, "supplier").select(F.lit("x").alias("OTHER"), F.col("s_name").alias("CITATION_REFERENCE"), F.col("s_suppkey").alias("EARMARK_ID")), at)
    return readers.csv_columns(spark, at, ["EARMARK_ID", "CITATION_REFERENCE"])


@plans.add("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, NULL AS city FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'n' || s_nationkey FROM supplier")
def yearly_extracts(spark, sf):
    """Extracts of several years, one under the other by column name."""
    a, b = scratch(spark, "csv"), scratch(spark, "csv")
    writers.delimited(read(spark, sf, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("Name")), a)
    writers.delimited(read(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("City"), F.col("s_name").alias("Name"), F.col("s_suppkey").alias("ID")), b)
    return readers.extracts(spark, [a, b])


@plans.add("SELECT c_custkey AS item_id, c_nationkey::BIGINT AS document_id, 'p' || c_nationkey AS page_number, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS excerpt FROM customer")
def item_document_links(spark, sf):
    """Links of items and documents from a file: ids as numbers, empty excerpts missing."""
    at = scratch(spark, "csv")
    excerpt = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name"))
    writers.delimited(read(spark, sf, "customer").select(F.col("c_custkey").alias("Earmark ID"), F.col("c_nationkey").alias("Document ID"), F.concat(F.lit("p"), "c_nationkey").alias("Page Number"), excerpt.alias("Excerpt")), at)
    return readers.item_documents(spark, at)


@plans.add("SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, s_name AS page FROM supplier WHERE s_suppkey % 5 > 0")
def page_mapping(spark, sf):
    """A mapping without a header; lines with too few fields are left out."""
    at = scratch(spark, "tsv")
    line = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name"))
    writers.lines(read(spark, sf, "supplier").select(line.alias("line")), "line", at)
    return readers.tsv(spark, at, ["entity_id", "page"])


@plans.add("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'")
def id_list(spark, sf):
    at = scratch(spark, "ids")
    writers.lines(read(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey", at)
    return readers.ids(spark, at)


@plans.add(
    "SELECT c_custkey AS \"StudentKey\", CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 60000 + c_nationkey END AS \"ZipCode\", CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE 3.5 END AS \"GPA\", c_nationkey::INT AS \"ThisGradeSchoolKey\", c_custkey % 2 = 1 AS \"Food\", c_mktsegment = 'MACHINERY' AS \"Male\", 0.6::DOUBLE AS \"AttendanceRate\" FROM customer"
)
def student_records(spark, sf):
    """Students with typed fields, and defaults where a value does not parse."""
    at, key = scratch(spark, "csv"), F.col("c_custkey")
    text = dict.fromkeys(("CatchmentSchool", "NextGradeSchoolKey", "EighthMathISAT", "EighthReadingISAT", "Latitude", "Longitude", "AttendanceRate"), F.lit("?"))
    flags = dict.fromkeys(("ESL", "LEP", "SpecialED"), F.lit("No"))
    df = read(spark, sf, "customer").select(
        key.alias("StudentKey"), F.when(key % 3 == 0, "unknown").otherwise((F.col("c_nationkey") + 60000).cast("string")).alias("ZipCode"), F.when(key % 2 == 0, "x").otherwise("3.5").alias("GPA"),
        F.col("c_nationkey").alias("ThisGradeSchoolKey"), F.when(key % 2 == 1, "Yes").otherwise("No").alias("Food"), F.when(F.col("c_mktsegment") == "MACHINERY", "Male").otherwise("Female").alias("Gender"),
        *(c.alias(k) for k, c in (text | flags).items()),
    )
    writers.delimited(df, at)
    return readers.students(spark, at).select("StudentKey", "ZipCode", "GPA", "ThisGradeSchoolKey", "Food", "Male", "AttendanceRate")


@plans.add("SELECT 'state' AS kind, 'Nation_' || n_nationkey AS name, 'N' || n_nationkey AS other FROM nation UNION ALL SELECT 'city', 'Town ' || n_regionkey, NULL FROM nation GROUP BY n_regionkey UNION ALL SELECT 'person', 'Last' || n_nationkey, 'First' FROM nation")
def lookup_tables(spark, sf):
    """States, cities and legislators from files without headers."""
    n, key = read(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    a, b, c = (scratch(spark, "csv") for _ in range(3))
    writers.delimited(n.select(F.concat(F.lit("Nation_"), key), F.concat(F.lit("N"), key)), a, header=False)
    writers.delimited(n.select(key, F.concat(F.lit("Town "), F.col("n_regionkey").cast("string")), F.lit("x")), b, header=False)
    writers.delimited(n.select(F.concat(F.lit("Last"), key), F.lit("First")), c, header=False)
    out = readers.states(spark, a).select(F.lit("state").alias("kind"), "name", F.col("abbreviation").alias("other"))
    out = out.unionAll(readers.cities(spark, b).select(F.lit("city"), "city", F.lit(None).cast("string")))
    return out.unionAll(readers.legislators(spark, c).select(F.lit("person"), "last_name", "first_name"))


@plans.add("SELECT (105 + n_nationkey % 5)::INT AS congress, 'Nationx' || chr((97 + n_nationkey)::INT) AS surname FROM nation WHERE n_nationkey % 5 > 2 AND n_nationkey <> 9")
def surnames_by_congress(spark, sf):
    """Surnames of legislators of later congresses; names that are none are left out."""
    at = scratch(spark, "csv")
    name = F.concat(F.upper(F.concat(F.lit("nationx"), F.char(F.col("n_nationkey") + 97))), F.when(F.col("n_nationkey") == 9, "2").otherwise(""), F.lit(", Ann"))
    writers.delimited(read(spark, sf, "nation").select(F.col("n_nationkey") % 5 + 105, name), at, header=False)
    return readers.surnames(spark, [at], after=107)


@plans.add("SELECT 'N' || n_nationkey AS state, CAST(n_nationkey * 3 AS VARCHAR) AS \"Total\" FROM nation")
def dashboard_facts(spark, sf):
    """A file whose lines end in a carriage return alone."""
    at = scratch(spark, "facts")
    n = read(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("state"), (F.col("n_nationkey") * 3).alias("Total"))
    writers.delimited(n, at, line="\r")
    return readers.regional_facts(spark, at)


@plans.add("SELECT '1 7:' || quality || ' 9:0.5' AS value, 1 AS label FROM labels WHERE toxic = 1 UNION ALL SELECT '-1 7:' || quality || ' 9:0.5', 0 FROM labels WHERE toxic <> 1")
def sparse_lines(spark, sf):
    """A sparse text format, with the class of each line."""
    at = scratch(spark, "svm")
    line = F.concat(F.when(F.col("toxic") == 1, "1").otherwise("-1"), F.lit(" 7:"), F.col("quality").cast("string"), F.lit(" 9:0.5"))
    writers.lines(read(spark, sf, "labels").select(line.alias("line")), "line", at)
    return readers.svm_light(spark, at)


@plans.add("SELECT doc_id, quality, fold FROM (SELECT doc_id, quality, (((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || 'f'), doc_id)) - 1) % 4)::INT AS fold FROM labels) WHERE fold <> 2")
def fold_files(spark, sf):
    """Rows written by fold; one fold is left out when they are read, without opening its files."""
    from docloom.operators.relational import stratified_folds

    at = scratch(spark, "folds")
    writers.folds(stratified_folds(read(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 4), at)
    return spark.read.parquet(at).where("fold <> 2").select("doc_id", "quality", "fold")


@plans.add("SELECT event_id, (SELECT count(*) FROM events)::BIGINT AS n FROM events")
def chunk_files(spark, sf):
    """Rows in files of a bounded number of rows each, none of them larger."""
    at = scratch(spark, "chunks")
    writers.chunks(read(spark, sf, "events").select("event_id"), at, rows=700)
    df = spark.read.parquet(at).select("event_id", F.col("_metadata.file_path").alias("file"))
    fits = df.groupBy("file").agg(F.count("*").alias("k")).agg(F.max("k").alias("most"), F.sum("k").alias("n")).where("most <= 700")
    # One row of totals.
    return df.select("event_id").crossJoin(F.broadcast(fits.select("n")))


@plans.add("SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS date, 'ih' AS version, o_custkey AS meta_document FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderdate::DATE::VARCHAR, 'enr', o_custkey FROM orders WHERE o_orderstatus = 'O'")
def stored_documents(spark, sf):
    """A table of the store: refreshed, added to, and added to once more without any row coming twice."""
    at = scratch(spark, "store")
    o = read(spark, sf, "orders")
    rows = lambda status, version: o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.lit(version).alias("version"), F.col("o_custkey").alias("meta_document"))
    writers.append(rows("P", "old"), f"{at}/documents")
    writers.refresh(rows("F", "ih"), f"{at}/documents")
    for _ in range(2):
        writers.append_missing(rows("O", "enr").unionAll(rows("F", "ih")), f"{at}/documents", ["id"])
    return readers.store(spark, at, "documents").withColumn("date", F.col("date").cast("string"))


@plans.add("SELECT c_mktsegment || ' list' AS title, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def list_titles(spark, sf):
    """Titles of list items that link to a page; other lines have none."""
    listed = F.col("c_custkey") % 2 == 0
    said = F.concat(F.when(listed, "*[[").otherwise("see "), "c_mktsegment", F.lit(" list"), F.when(listed, "]]").otherwise(""))
    return readers.wiki_list(read(spark, sf, "customer").select(said.alias("value"))).groupBy("title").agg(F.count("*").alias("n"))


@plans.add("SELECT s_suppkey || '/enr/v' || s_suppkey AS path, 'http://x/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey || '/ih/w' || s_suppkey, 'http://y/' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 1")
def versions_to_fetch(spark, sf):
    """Versions of bills that a service lists and that are not stored yet."""
    s, key = read(spark, sf, "supplier"), F.col("s_suppkey").cast("string")
    version = lambda code, mark, host: F.struct(F.lit(code).alias("version_code"), F.concat(F.lit(mark), key).alias("bill_version_id"), F.struct(F.concat(F.lit(host), key).alias("html")).alias("urls"))
    listed = F.when(F.col("s_suppkey") % 3 > 0, F.array(version("enr", "v", "http://x/"), version("ih", "w", "http://y/")))
    records = s.select(F.to_json(F.struct(key.alias("bill_id"), listed.alias("versions"))).alias("record"))
    stored = s.where("s_suppkey % 3 = 2").select(F.concat(key, F.lit("/ih/w"), key).alias("path"))
    return connectors.missing(connectors.bill_versions(records), stored, ["path"])


@plans.add("SELECT doc_id AS document_id, 0 AS table_no, 'row of ' || doc_id || chr(10) AS content FROM documents UNION ALL SELECT doc_id, 1, lang || chr(10) FROM documents")
def marked_tables(spark, sf):
    """Tables that a reader marked in a text, each by its tag."""
    key = F.col("doc_id").cast("string")
    text = F.concat(F.lit("before\n<dashTable>\nrow of "), key, F.lit("\n</dashTable>\nbetween\n<dotTable>\n"), F.col("lang"), F.lit("\n</dotTable>\n"))
    return tables.labelled_tables(read(spark, sf, "documents").select("doc_id", text.alias("text")))


@plans.add("SELECT doc_id AS document_id, (i - 1)::INT AS chunk, (40 * (i - 1))::INT AS \"offset\", substr(text, (40 * (i - 1) + 1)::BIGINT, 40) AS text FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text, unnest(generate_series(1, ceil(length(text) / 40)::BIGINT)) AS i FROM documents WHERE length(text) > 0)")
def text_chunks(spark, sf):
    """Texts cut for a service that takes so many characters at once; these have no line breaks to cut behind."""
    flat = read(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return connectors.chunked(flat, 40)


@plans.add("SELECT (100 + n_regionkey)::INT AS congress, CASE WHEN n_nationkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber, unnest(generate_series(1, (n_nationkey // 10 + 1)::BIGINT))::INT AS number FROM nation WHERE n_nationkey IN (SELECT max(n_nationkey) FROM nation GROUP BY n_regionkey, n_nationkey % 2)")
def report_numbers(spark, sf):
    """Numbers of all reports up to the last of each congress and chamber."""
    n = read(spark, sf, "nation").select((F.col("n_regionkey") + 100).cast("int").alias("congress"), F.when(F.col("n_nationkey") % 2 == 0, "house").otherwise("senate").alias("chamber"), "n_nationkey")
    last = n.groupBy("congress", "chamber").agg(F.floor(F.max("n_nationkey") / 10 + 1).alias("last"))
    return connectors.report_ids(last)


@plans.add("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (o_orderkey // 250 + 1)::BIGINT AS page FROM orders")
def service_pages(spark, sf):
    """Records of a paged service, fetched by executors, some pages a partition; only the last page's number is asked for beforehand."""
    rows = services.pages(spark, "docloom.sources.services:TableService", path=f"{sf}/orders.parquet", key="o_orderkey", columns="o_orderkey,o_custkey,o_orderstatus,o_totalprice", page="250", per_partition="10")
    record = F.from_json("record", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").alias("r")
    return rows.select(record, F.col("number").alias("page")).select("r.*", "page")


@plans.add("SELECT s_suppkey, s_nationkey, 'v' || s_suppkey || '/' || s_nationkey AS path FROM supplier")
def service_stream(spark, sf):
    """What a service has that was not fetched yet: two runs of a stream over a service that grows in between, each record once."""
    at = scratch(spark, "stream")

    def run(**more) -> None:
        new = services.new_pages(spark, "docloom.sources.services:TableService", path=f"{sf}/supplier.parquet", key="s_suppkey", columns="s_suppkey,s_nationkey", page="5", per_partition="2", **more)
        new.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run(last="1")
    run()
    run()
    r = spark.read.schema(services.SCHEMA).parquet(f"{at}/rows").select(F.from_json("record", "s_suppkey long, s_nationkey int").alias("r")).select("r.*")
    return r.withColumn("path", F.concat(F.lit("v"), "s_suppkey", F.lit("/"), "s_nationkey"))


@plans.add(
    "WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus IN ('F', 'O')), p AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'), "
    "u AS (SELECT id, CASE WHEN status = 'F' AND price > 100000 THEN 'X' ELSE status END AS status, price FROM a UNION ALL SELECT * FROM p) SELECT * FROM u WHERE NOT (status = 'O' AND price < 1000) "
    "UNION ALL SELECT -1 - id, 'copy', price FROM u WHERE status = 'X'"
)
def committed_store(spark, sf):
    """A table that is appended to, updated by key, appended what it lacks, and refreshed from its own rows; each step a version."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    table = store.Table(spark, scratch(spark, "committed"), "id long, status string, price double")
    table.append(o.where("status in ('F', 'O')"))
    table.update(o.where("status = 'F' and price > 100000").withColumn("status", F.lit("X")), "id", "status")
    for _ in range(2):
        table.append_missing(o, ["id"])
    table.refresh(lambda rows: rows.where("not (status = 'O' and price < 1000)").unionAll(rows.where("status = 'X'").select(-1 - F.col("id"), F.lit("copy"), "price")))
    return table.read()


@plans.add(
    "WITH s AS (SELECT user_id, event_id, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events), "
    "r AS (SELECT *, (sum((event_type <> 'purchase')::INT) OVER (PARTITION BY user_id, g ORDER BY event_id))::BIGINT AS run FROM s) SELECT user_id AS item, event_id AS answer, event_type = 'purchase' AS yes, run, run > 10 AS decided FROM r"
)
def arriving_answers(spark, sf):
    """Runs of "no" in answers that arrive in two parts, some of them twice, by a stream that is started again for each."""
    from docloom.streaming import answers as A

    at = scratch(spark, "answers")
    e = read(spark, sf, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("answer"), (F.col("event_type") == "purchase").alias("yes"))
    middle = e.agg(F.percentile_approx("answer", 0.5)).first()[0]
    for part in (e.where(F.col("answer") <= middle), e.where(F.col("answer") > middle - 10)):
        writers.append(part.repartition(2, "item"), f"{at}/in")
        for _ in range(2):
            A.follow(spark.readStream.schema(e.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("item long, answer long, yes boolean, run long, decided boolean").parquet(f"{at}/out")


@plans.add(
    "SELECT event_id, 'urn:a' AS uri, event_type AS entity_type, 'U' || user_id AS entity_inferred_name, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_id::INT END AS entity_offset, CASE WHEN user_id % 4 = 0 THEN 'p' || user_id END AS entity_url FROM events WHERE event_id % 5 <> 0"
)
def answers_of_any_form(spark, sf):
    """Answers with fields that nobody knows, with fields of another type, and answers that are no JSON."""
    e, key = read(spark, sf, "events"), F.col("user_id").cast("string")
    place = F.when(F.col("user_id") % 3 == 0, F.lit('"far"')).otherwise(F.col("event_id").cast("string"))
    page = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit(',"resolutions":[{"id":"p'), key, F.lit('","score":{"x":[1,2]}}]'))).when(F.col("user_id") % 4 == 1, ',"resolutions":"none"').otherwise("")
    part = F.concat(F.lit('{"urn:a":{"_typeGroup":"entities","_type":"'), "event_type", F.lit('","name":"U'), key, F.lit('","new":{"deep":[{"er":1}]},"instances":[{"offset":'), place, F.lit(',"exact":"w","odd":null}]'), page, F.lit('},"urn:b":{"_typeGroup":["no","text"]},"doc":7}'))
    answer = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"urn:a":'), "event_type")).otherwise(part)
    found = readers.annotations(e.select("event_id", answer.alias("response")))
    return found.select("event_id", "uri", "entity_type", "entity_inferred_name", "entity_offset", "entity_url")
