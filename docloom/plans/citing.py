"""Queries of citations: every way of citing, the documents that it leads to, and the texts of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import crosswalk as C
from docloom.plans.base import Plans, read

plans = Plans()

# Ways of citing, one or more for each branch, with all that they must name: congress, type, chamber, number. "{k}" is a supplier's number.
_SAID_2005 = (
    ("P.L. 108-444", ((108, "bill", "senate", "s2965"),)),
    ("P.L. 109-13 no. {k}", ((109, "bill", "house", "hr1268"), (109, "report", "house", "16"), (109, "report", "house", "72"), (109, "report", "senate", "52"))),
    ("P.L. 1-{k}", ()),
    ("H. Rept. 109-{k}", ((109, "report", "house", "{k}"),)),
    ("S. Rept. 109-{k}", ((109, "report", "senate", "{k}"),)),
    ("Senate Report 108-{k}", ((108, "report", "senate", "{k}"),)),
    ("House Report 108-{k}", ((108, "report", "house", "{k}"),)),
    ("H.R. 108-{k} Conference Report", ((108, "report", "house", "{k}"),)),
    ("H.R. 4818", ((108, "bill", "house", "hr4818"), (108, "report", "house", "599"), (108, "report", "house", "792"), (108, "report", "senate", "346"))),
    ("H.R. 9{k}", ((108, "bill", "house", "hr9{k}"),)),
    ("S. Bill 7{k}", ((108, "bill", "senate", "s7{k}"),)),
    ("Conference Report 108-{k}", ()),
    ("nothing {k}", ()),
)
# As before, with the hint that a version is told by.
_SAID_2008 = (
    ("H. Rept. 110-{k}", ((110, "report", "house", "{k}", None),)),
    ("P.L. 110-116 no. {k}", ((110, "bill", "house", "hr3222", None),)),
    ("P.L. 110-161", ((110, "bill", "house", "hr2764", "P.L. 110-161"),)),
    ("Division B, Commerce {k}", ((110, "bill", "house", "hr2764", "Division B, Commerce {k}"),)),
)


def _named(ways: tuple) -> str:
    quoted = lambda x: "NULL::VARCHAR" if x is None else repr(x)
    rows = (f"({n}, {', '.join(map(quoted, (*d, None)[:5]))})" for n, (_, documents) in enumerate(ways) for d in documents)
    return f"(VALUES {', '.join(rows)}) AS w(n, congress, doc_type, chamber, number, hint)"


def _said(ways, n):
    """The way of citing with the number ``n``, with the supplier's number in it."""
    return F.replace(F.get(F.array(*(F.lit(w if isinstance(w, str) else w[0]) for w in ways)), n.cast("int")), F.lit("{k}"), F.col("s_suppkey").cast("string"))


@plans.add(
    f"WITH c AS (SELECT s_suppkey, s_suppkey % {len(_SAID_2005)} AS n FROM supplier UNION ALL SELECT s_suppkey, (5 * s_suppkey + 2) % {len(_SAID_2005)} FROM supplier) "
    "SELECT s_suppkey, 2005 AS year, congress, doc_type, chamber, replace(number, '{k}', s_suppkey::VARCHAR) AS number, hint FROM c JOIN " + _named(_SAID_2005) + " USING (n) "
    "UNION ALL SELECT s_suppkey, 2008, congress, doc_type, chamber, replace(number, '{k}', s_suppkey::VARCHAR), replace(hint, '{k}', s_suppkey::VARCHAR) FROM supplier JOIN " + _named(_SAID_2008) + f" ON n = s_suppkey % {len(_SAID_2008)}"
)
def citation_ways(spark, sf):
    """Citations of 2005, two in each text, and of 2008: every branch, those that name no document among them."""
    s, k = read(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey")
    both = F.concat_ws("&&", _said(_SAID_2005, k % len(_SAID_2005)), _said(_SAID_2005, (5 * k + 2) % len(_SAID_2005)))
    first = s.select("s_suppkey", F.lit(2005).alias("year"), F.explode(C.all_citations_2005(both)).alias("c"))
    then = s.select("s_suppkey", F.lit(2008).alias("year"), C.citation_2008(_said(_SAID_2008, k % len(_SAID_2008))).alias("c"))
    return first.unionAll(then).select("s_suppkey", "year", "c.congress", "c.doc_type", "c.chamber", "c.number", "c.hint")


_SAID_2010 = ("H.R. 9{k}", "S. 9{k}", "Senate Report 111-9{k}", "House Report 111-9{k}", "P.L. 111-88 no. {k}")
_SUBJECTS = ("Agriculture", "Commerce", "Energy", "Financial", "Interior", "Labor", "Transportation", "Nothing")
_LETTERS = "ABCDEFI"


@plans.add(
    # A later version is the latest; of two of one day the least name is; a division has a version of its own.
    "WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS v FROM supplier) "
    "SELECT k AS item_id, CASE k % 5 WHEN 0 THEN 40 * k + v WHEN 1 THEN 40 * k + 10 + v WHEN 2 THEN 40 * k + 20 WHEN 3 THEN 40 * k + 30 ELSE -22 END AS document_id FROM s "
    f"UNION ALL SELECT k, -11 - k % {len(_SUBJECTS)} FROM s WHERE k % {len(_SUBJECTS)} < {len(_LETTERS)}"
)
def cited_documents(spark, sf):
    """From citations to documents: bills in their latest version, reports, and the divisions of a law of many bills."""
    s, k = read(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey")
    divided = F.concat(F.lit("Div. X, "), F.get(F.array(*map(F.lit, _SUBJECTS)), (k % len(_SUBJECTS)).cast("int")), F.lit(" "), k.cast("string"))
    items = s.select(k.alias("item_id"), F.array_compact(F.array(C.citation_2010(_said(_SAID_2010, k % len(_SAID_2010))), C.citation_2009(divided))).alias("citations"))

    inline = lambda names, *rows: F.expr("inline(array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, row, strict=True)) + ")" for row in rows) + "))")
    kinds = inline(
        ("nth", "number", "senate", "bill"),
        ("0L", "concat('hr9', s_suppkey)", "false", "true"), ("1L", "concat('s9', s_suppkey)", "true", "true"), ("2L", "concat('9', s_suppkey)", "true", "false"), ("3L", "concat('9', s_suppkey)", "false", "false"),
    )
    own = s.select("s_suppkey", kinds)
    meta = own.selectExpr("4 * s_suppkey + nth AS id", "111 AS congress", "number", "senate", "bill").unionAll(spark.sql("SELECT * FROM VALUES (-1L, 111, 'hr1105', false, true), (-2L, 111, 'hr2996', false, true)"))
    divisions = ", ".join(f"({-11 - i}L, -1L, 'CPRT-111JPRT47494-Division{x}')" for i, x in enumerate(_LETTERS))
    documents = (
        own.selectExpr("4 * s_suppkey + nth AS meta_document", "explode(if(bill, array('ih', 'eh'), array(''))) AS version").selectExpr("10 * meta_document + if(version = 'eh', 1, 0) AS id", "meta_document", "version")
        .unionAll(spark.sql(f"SELECT * FROM VALUES (-21L, -2L, 'ih'), (-22L, -2L, 'eh'), {divisions}"))
    )
    days = inline(("version", "issued_on"), ("'ih'", "'2009-01-05'"), ("'eh'", "concat('2009-01-0', 4 + s_suppkey % 3)"))
    versions = own.where("bill").select(F.lit(111).alias("congress"), "number", days).unionAll(spark.sql("SELECT * FROM VALUES (111, 'hr2996', 'ih', '2009-06-01'), (111, 'hr2996', 'eh', '2009-06-02')"))
    return C.to_documents(items, documents, meta, versions)


@plans.add(
    "WITH p AS (SELECT p_partkey, p_partkey % 4 AS n, p_partkey % 8 AS m FROM part) SELECT p_partkey, "
    f"CASE WHEN n <> 0 THEN 'eh' WHEN m < {len(_LETTERS)} THEN 'CPRT-111JPRT47494-Division' || '{_LETTERS}'[m + 1] END AS version, CASE WHEN n = 1 THEN 'DivisionQ' ELSE '' END AS division FROM p"
)
def division_versions(spark, sf):
    """The version and the name of a division, from texts that name it, name it otherwise, or don't."""
    k = F.col("p_partkey")
    subject = F.get(F.array(*map(F.lit, _SUBJECTS)), (k % len(_SUBJECTS)).cast("int"))
    hint = F.concat(F.get(F.array(*map(F.lit, ("Div. Q, ", "Division Q, ", "On ", "Divisions, "))), (k % 4).cast("int")), subject)
    return read(spark, sf, "part").select("p_partkey", C.division_version(hint).alias("version"), C.division_name(hint).alias("division"))


@plans.add(
    "WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<html><body><pre>' || html WHEN 1 THEN '<body><pre>' || html ELSE html END AS t FROM pages), b AS (SELECT page_id, t, CASE WHEN strpos(t, '<body><pre>') > 1 THEN substr(t, strpos(t, '<body><pre>') + 11) ELSE t END AS body FROM r) "
    "SELECT page_id, sha1(t) AS content_id, length(body)::INT AS n_chars, md5(body) AS body_md5 FROM b"
)
def report_bodies(spark, sf):
    """Reports without what stands before their text, and ids made of their contents."""
    k = F.col("page_id") % 3
    said = F.when(k == 0, F.concat(F.lit("<html><body><pre>"), "html")).when(k == 1, F.concat(F.lit("<body><pre>"), "html")).otherwise(F.col("html"))
    body = read(spark, sf, "pages").select("page_id", said.alias("t")).withColumn("body", T.after_preamble(F.col("t")))
    return body.select("page_id", T.content_id(F.col("t")).alias("content_id"), F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))
