"""Readers: CSV and TSV extracts, document trees, metadata in JSON and XML, lookup tables, stored models' inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.names import surname
from docloom.functions.pairs import cast_or
from docloom.schemas import schema


def store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the document store; its schema is fixed, so no file is opened to find it."""
    return spark.read.schema(schema(name)).parquet(f"{folder}/{name}")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on a database; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """A table of a database read through ``parts`` connections, each with a range of ``column`` (numbers, dates or times).

    The bounds are asked for first and only set where ranges begin: rows beyond them, which came meanwhile, are in the
    first or last range, rows without a value in the first. A column of one value or none is read through one connection.
    """
    said = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    least, most = jdbc(spark, url, f"SELECT MIN({said}) AS a, MAX({said}) AS b FROM {table}", **options).first()
    source = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if least is not None and least < most:
        source = source.options(partitionColumn=column, lowerBound=str(least), upperBound=str(most), numPartitions=parts)
    return source.load()


def csv(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """A CSV with a header, read as text; names in lower case with ``_`` for spaces."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', **options)
    return df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))


def csv_columns(spark: SparkSession, path: str, columns: list[str], **options: str) -> DataFrame:
    """Some columns of a CSV, by their names in the header."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', **options).select(*(F.col(f"`{c}`") for c in columns))


def extracts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Yearly extracts one under the other by column name; missing columns are null."""
    out = None
    for p in paths:
        df = csv(spark, p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def repaired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both columns empty where either is missing."""
    gone = F.col(a).isNull() | F.col(b).isNull()
    return df.withColumns({c: F.when(gone, "").otherwise(F.col(c)) for c in (a, b)})


def tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A TSV without header; lines with fewer fields than ``names`` are left out."""
    fields = F.split("value", "\t")
    return spark.read.text(path).where(F.size(fields) >= len(names)).select(*(F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)))


def item_documents(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, document_id, page_number, excerpt`` of a CSV of links; ids stay text until the writer casts them, empty excerpts are null."""
    df = csv(spark, path).select("earmark_id", "document_id", "page_number", "excerpt")
    return df.select(F.col("earmark_id").try_cast("bigint").alias("item_id"), F.col("document_id").try_cast("bigint").alias("document_id"), "page_number", F.nullif(F.trim("excerpt"), F.lit("")).alias("excerpt"))


def ids(spark: SparkSession, path: str) -> DataFrame:
    """A file with an id on each line; empty lines are left out, and a line that is no id is an error."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").cast("bigint").alias("id"))


STUDENT_DEFAULTS = {
    "ZipCode": ("int", 0),
    "GPA": ("double", 2.0),
    "CatchmentSchool": ("int", 0),
    "ThisGradeSchoolKey": ("int", 0),
    "NextGradeSchoolKey": ("int", 0),
    "EighthMathISAT": ("int", 40),
    "EighthReadingISAT": ("int", 40),
    "Latitude": ("double", 1.0),
    "Longitude": ("double", 1.0),
    "AttendanceRate": ("double", 0.6),
}


def students(spark: SparkSession, path: str) -> DataFrame:
    """Students with typed fields and defaults where a value does not parse."""
    df = spark.read.csv(path, header=True)
    typed = {c: cast_or(F.col(c), kind, default) for c, (kind, default) in STUDENT_DEFAULTS.items()}
    flags = {c: F.coalesce(F.col(c) == "Yes", F.lit(False)) for c in ("Food", "ESL", "LEP", "SpecialED")}
    return df.withColumns({**typed, **flags, "StudentKey": F.col("StudentKey").cast("bigint"), "Male": F.coalesce(F.col("Gender") == "Male", F.lit(False))})


# Lookup tables.


def states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="name string, abbreviation string")


def cities(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path)
    return df.select(F.col(df.columns[1]).alias("city")).distinct()


def surnames(spark: SparkSession, paths: list[str], after: int | None = None) -> DataFrame:
    """``congress, surname`` of legislators, of congresses after ``after``."""
    df = spark.read.csv(paths, schema="congress int, name string").select("congress", surname(F.col("name")).alias("surname")).where("surname is not null").distinct()
    return df if after is None else df.where(F.col("congress") > after)


def legislators(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="last_name string, first_name string")


def regional_facts(spark: SparkSession, path: str) -> DataFrame:
    """Pre-aggregated facts of a dashboard; lines may end in a carriage return alone."""
    return spark.read.csv(path, header=True, inferSchema=False)


# Documents.


def document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts below a folder, with their paths: files called ``document.txt`` or without an extension."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    return df.where((F.col("file") == "document.txt") | ~F.contains("file", F.lit(".")))


def with_path_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    """``congress, chamber, number, version, doc_type`` from where a document lies.

    Bills: ``<congress>/bills/<type>/<number>/text-versions/<version>/``, reports:
    ``<congress>/<chamber>/<number>/``.
    """
    bill = r"/(\d+)/bills/([a-z]+)/([a-z0-9]+)/text-versions/([^/]+)/"
    report = r"/(\d+)/(house|senate)/(\d+)/"
    p = F.col(path)
    is_bill = p.rlike(bill)
    got = lambda i: F.regexp_extract(p, bill, i)
    rep = lambda i: F.regexp_extract(p, report, i)
    return (
        df.withColumn("doc_type", F.when(is_bill, "bill").when(p.rlike(report), "report"))
        .withColumn("congress", F.when(is_bill, got(1)).otherwise(rep(1)).try_cast("int"))
        .withColumn("chamber", F.when(is_bill, F.when(F.startswith(got(2), F.lit("s")), "senate").otherwise("house")).otherwise(rep(2)))
        .withColumn("number", F.when(is_bill, got(3)).otherwise(rep(3)))
        .withColumn("version", F.when(is_bill, got(4)))
    )


def bill_path(congress: Column, number: Column, version: Column) -> Column:
    kind = F.regexp_replace(number, "[^A-Za-z]", "")
    return F.concat_ws("/", congress.cast("string"), F.lit("bills"), kind, number, F.lit("text-versions"), version)


def report_path(congress: Column, chamber: Column, number: Column) -> Column:
    return F.concat_ws("/", congress.cast("string"), chamber, number.cast("string"))


def versions(tree: DataFrame) -> DataFrame:
    """Versions that lie in a tree of bills."""
    return with_path_metadata(tree).where("doc_type = 'bill'").select("congress", "number", "version").distinct()


def issue_dates(spark: SparkSession, folder: str) -> DataFrame:
    """``path, issued_on`` from the JSON metadata of bill versions."""
    df = spark.read.schema("issued_on string").json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="data.json")
    return df.select(F.col("_metadata.file_path").alias("path"), F.to_date("issued_on", "yyyy-MM-dd").alias("issued_on"))


def issued_on(c: Column) -> Column:
    """The date of issue in a bill version's JSON; null where it has none."""
    return F.get_json_object(c, "$.issued_on").try_cast("date")


def report_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``path, date_issued, year, associated_bills`` from XML metadata; tag names in any case."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="mods.xml").select(F.col("_metadata.file_path").alias("path"), "value")
    return with_report_metadata(df, "value").drop("value")


def with_report_metadata(df: DataFrame, c: str) -> DataFrame:
    """``df`` with ``date_issued, year, associated_bills`` of the XML in a column; null, null and empty where it has none."""
    # Names in one case, prefixes and name spaces away: one path finds what any writer of such files called it.
    plain = F.regexp_replace(F.lower(c), r"(</?)[a-z0-9]+:|\sxmlns(:[a-z0-9]+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "$1")
    mods = F.from_xml(plain, "origininfo struct<dateissued:array<string>>", {"mode": "PERMISSIVE"})
    bills = F.regexp_extract(c, r"(?is)<associatedBills\b[^>]*>\s*(.*?)\s*</associatedBills>", 1)
    found = df.withColumns({"date_issued": F.trim(F.get(mods["origininfo"]["dateissued"], F.lit(0))), "associated_bills": bills})
    return found.withColumn("year", F.substring("date_issued", 1, 4))


def svm_light(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a sparse text format with the class of their first character."""
    return spark.read.text(path).select("value", (F.substring("value", 1, 1) == "1").cast("int").alias("label"))


def wiki_list(df: DataFrame, c: str = "value") -> DataFrame:
    """Titles of list items that link to a page."""
    return df.select(F.explode(F.regexp_extract_all(F.col(c), F.lit(r"\*+\[+([\w ]+)\]+"), F.lit(1))).alias("title"))


# Annotations in JSON.

# Answers are objects keyed by an id, in no fixed form: they are kept as VARIANT, and what is asked for is taken out by path. Fields that nobody
# asks for cost nothing; one that can't be read as what is expected is null; an answer that is no JSON, or no object, has no parts.


def _parts(df: DataFrame, c: str) -> DataFrame:
    """The other columns, ``uri`` and ``part`` (VARIANT) for each part of the answers in ``c``."""
    keep = [x for x in df.columns if x != c]
    said = df.select(*keep, F.try_parse_json(c).alias("_answer")).where(F.schema_of_variant("_answer").startswith("OBJECT"))
    each = said.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_answer").outer()))
    return each.select(*keep, F.col("key").alias("uri"), F.col("value").alias("part"))


def _of(c: str, path: str, kind: str = "string") -> Column:
    """What lies at ``path``, names and places with slashes between them, as ``kind``; null if it can't be one. As text anything can: lists and objects are their JSON."""
    return F.try_variant_get(c, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("/")), kind)


def annotations(df: DataFrame, c: str = "response", offset: Column | None = None) -> DataFrame:
    """A row for each instance of each entity in an annotator's answer, offsets shifted by ``offset``."""
    keep = [x for x in df.columns if x != c]
    e = _parts(df.withColumn("_shift", F.lit(0) if offset is None else offset), c).where(_of("part", "_typeGroup") == "entities")
    named = e.select(*keep, "uri", "_shift", _of("part", "_type").alias("entity_type"), _of("part", "name").alias("entity_inferred_name"), _of("part", "resolutions/0/id").alias("entity_url"), _of("part", "instances", "variant").alias("_list"))
    i = named.where("_list is not null").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    return i.select(*keep, "uri", _of("value", "exact").alias("entity_text"), "entity_type", (_of("value", "offset", "int") + F.col("_shift")).alias("entity_offset"), _of("value", "length", "int").alias("entity_length"), "entity_inferred_name", "entity_url")


def response_summary(df: DataFrame, c: str = "response") -> DataFrame:
    """``kind, type, name, relevance`` of the topics, entities and relations of an annotator's answer."""
    keep = [x for x in df.columns if x != c]
    e = _parts(df, c).where(_of("part", "_typeGroup").isin("topics", "entities", "relations"))
    return e.select(*keep, _of("part", "_typeGroup").alias("kind"), _of("part", "_type").alias("type"), F.coalesce(_of("part", "name"), _of("part", "categoryName")).alias("name"), _of("part", "relevance", "double").alias("relevance"))


def by_type_group(df: DataFrame, c: str = "response") -> DataFrame:
    """``type_group, n, uris`` of an answer: its parts regrouped."""
    keep = [x for x in df.columns if x != c]
    return _parts(df, c).groupBy(*keep, _of("part", "_typeGroup").alias("type_group")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("uri")).alias("uris"))  # the parts of one answer
