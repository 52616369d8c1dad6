"""Readers, connectors and features against small inputs worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import crosswalk, features, linkage, matching, ml, relational, report, scoring, tables, training
from docloom.sources import connectors, readers, writers
from docloom.sources.configuration import Configuration


def test_configuration(tmp_path):
    at = tmp_path / "c.cfg"
    at.write_text("[keys]\nconn=host=x dbname=%y\ndata=/d/\n")
    c = Configuration.read(str(at))
    assert c.connection == "host=x dbname=%y"
    assert [c.folder(k) for k in ("reports", "bills", "classification", "extracts", "laws")] == ["/d/congress_reports", "/d/bills", "/d/classification_data", "/d/OMB", "/d/plaws"]
    at.write_text("[keys]\nconn=x\n")
    with pytest.raises(Exception, match="data"):
        Configuration.read(str(at))


class Answer:
    def __init__(self, host):
        self.host = host

    def request(self, method, path):
        assert method == "HEAD"
        if self.host == "away":
            raise OSError("no route")
        self.status = 200 if path == "/there" else 404

    def getresponse(self):
        return self

    def close(self):
        pass


def test_head_status():
    assert [connectors.head_status(p, h, Answer) for p, h in (("/there", "x"), ("/gone", "x"), ("/there", "away"))] == [200, 404, None]


def test_pages_and_versions(spark):
    bills = ['{"bill_id":"hr1-111","versions":[{"version_code":"ih","bill_version_id":"hr1-111-ih","urls":{"html":"http://a"}},{"version_code":"enr","bill_version_id":"hr1-111-enr","urls":{"html":"http://b"}}]}', '{"bill_id":"hr2-111"}']
    records = spark.createDataFrame([(b,) for b in bills], "record string")
    assert sorted(map(tuple, connectors.bill_versions(records).collect())) == [("hr1-111/enr/hr1-111-enr", "http://b"), ("hr1-111/ih/hr1-111-ih", "http://a")]


def test_downloads_and_archives(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/mods.xml", "<m/>")
        z.writestr("a/x.htm", "h")
        z.writestr("a/y.pdf", "p")
    urls = spark.createDataFrame([("good",), ("bad",)], "url string")
    data = held.getvalue()

    def fetch(url):
        if url == "bad":
            raise OSError("404")
        return data

    got = connectors.download(urls, fetch)
    assert {(r["url"], r["content"] is None, r["error"]) for r in got.collect()} == {("good", False, None), ("bad", True, "404")}
    archives = got.where("content is not null").withColumnRenamed("url", "path")
    assert sorted(r["member"] for r in connectors.unzipped(archives).collect()) == ["a/mods.xml", "a/x.htm"]
    assert connectors.unzipped(archives, wanted="x\\.htm$", renamed="2010.csv").first()["member"] == "2010.csv"
    chunks = connectors.chunked(spark.createDataFrame([(1, "ab\ncd")], "doc_id long, text string"), 3)
    said = connectors.annotated(chunks, lambda t: f'{{"u":{{"_typeGroup":"entities","_type":"T","name":"{t.strip()}","instances":[{{"offset":0,"length":2,"exact":"{t.strip()}"}}]}}}}')
    assert sorted((r["entity_offset"], r["entity_text"]) for r in readers.annotations(said, offset=F.col("offset").cast("int")).collect()) == [(0, "ab"), (3, "cd")]


def test_report_metadata(spark, tmp_path):
    for n, x in enumerate(('<mods:mods xmlns:mods="http://x" a="b"><mods:originInfo><mods:dateIssued encoding="w3cdtf">2009-05-06</mods:dateIssued></mods:originInfo><extension><associatedBills>H.R. 5</associatedBills></extension></mods:mods>', "<mods><originInfo><DATEISSUED> 2010 </DATEISSUED></originInfo></mods>", "broken <x")):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "mods.xml").write_text(x)
    got = {r["path"].split("/")[-2]: r for r in readers.report_metadata(spark, str(tmp_path)).collect()}
    assert (got["0"]["date_issued"], got["0"]["year"], got["0"]["associated_bills"]) == ("2009-05-06", "2009", "H.R. 5")
    assert got["1"]["year"] == "2010" and got["2"]["date_issued"] is None


def test_ids_are_checked(spark, tmp_path):
    (tmp_path / "ids").write_text("1\n\n 22 \n")
    assert sorted(r["id"] for r in readers.ids(spark, str(tmp_path / "ids")).collect()) == [1, 22]
    (tmp_path / "bad").write_text("1\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.ids(spark, str(tmp_path / "bad")).collect()


def test_citation_of_2008_and_reports(spark):
    c = spark.createDataFrame([("H. Rept. 110-197",), ("P.L. 110-116",), ("Division G",)], "s string").select(crosswalk.citation_2008(F.col("s")).alias("c")).select("c.*").collect()
    assert [(r["doc_type"], r["number"], r["hint"]) for r in c] == [("report", "197", None), ("bill", "hr3222", None), ("bill", "hr2764", "Division G")]
    reports = spark.createDataFrame([(1, 110, "H.R. 5"), (2, 110, "H.R. 5"), (3, 110, "S. 9")], "report_id long, congress int, cited string")
    bills = spark.createDataFrame([(10, 110, "hr5", "ih", "2008-01-01"), (11, 110, "hr5", "enr", "2008-02-01"), (12, 110, "s9", "is", "2008-01-01")], "bill_id long, congress int, folder string, version string, issued_on string")
    assert {(r["report_id"], r["bill_id"]) for r in crosswalk.reports_to_bills(reports, bills).collect()} == {(2, 11), (3, 12)}
    d = spark.createDataFrame([("Div. E, Interior",), ("Division E of x",), ("x",)], "s string").select(crosswalk.division_version(F.col("s")).alias("v"), crosswalk.division_name(F.col("s")).alias("n")).collect()
    assert [(r["v"], r["n"]) for r in d] == [("CPRT-111JPRT47494-DivisionE", ""), ("eh", "DivisionE"), ("eh", "")]


def test_latest_goes_by_names_too(spark):
    df = spark.createDataFrame([(1, "ih", "2008-01-01"), (1, "enr", "2008-03-01"), (1, "eas", "2008-03-01")], "k int, v string, d string")
    assert tuple(relational.latest(df, "k", "v", "d").first()) == (1, "eas", "2008-03-01")


def test_small_texts(spark):
    df = spark.createDataFrame([("x<body><pre>rest", "kitten", "sitting")], "a string, b string, c string")
    r = df.select(T.after_preamble(F.col("a")).alias("a"), T.fuzzy_distance(F.col("b"), F.col("c")).alias("d"), T.random_id().alias("i"), T.window(F.col("b"), F.lit(1), F.lit(3), 2).alias("w")).first()
    assert r["a"] == "rest" and r["d"] == 3 and len(r["i"]) == 10 and r["i"].isalnum() and r["w"] == "k<<it>>te"


def test_feature_generators(spark):
    df = spark.createDataFrame([("Name, Sum ,", ["City", "City", "Person"]), (None, [])], "h string, k array<string>")
    rows = df.select(features.table_header(F.col("h")).alias("h"), features.entity_types(F.col("k"), F.lit(True)).alias("t"), features.categories(F.col("k")).alias("c")).collect()
    assert rows[0]["h"] == {"HEADER_name": 1.0, "HEADER_ sum ": 1.0} and rows[1]["h"] == {"NO_HEADERS_FOUND": 1.0}
    assert rows[0]["t"] == {"TYPE_City": 2.0, "TYPE_Person": 1.0, "POLITICIAN": 1.0} and rows[1]["c"] == {"NO_WIKIPEDIA_PAGE_WAS_FOUND": 1.0}
    assert spark.range(1).select(features.president_row(F.lit("The PRESIDENT, Smith")).alias("p")).first()["p"] == {"ROW_HAS_PRESIDENT": 1.0}
    bags = spark.createDataFrame([({"a": 1.0, "b": 1.0},), ({"b": 1.0},)], "g map<string,double>")
    assert sorted(r["name"] for r in features.vocabulary(bags, ["g"]).collect()) == ["a", "b"]


def test_models_are_stored(spark, tmp_path):
    d = ml.vectors(spark.createDataFrame([(i, i % 2, [float(i % 2), i / 50]) for i in range(50)], "id int, label int, x array<double>"), "x")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[ml.forest(trees=2, depth=2)]).fit(d)
    ml.save(model, str(tmp_path / "m"))
    want, got = (ml.with_score(m.transform(d)).orderBy("id").select("score").collect() for m in (model, ml.load(str(tmp_path / "m"))))
    assert want == got
    r = ml.hold_out(d.where("id < 30"), d.where("id >= 30"), ml.forest(trees=2, depth=2)).first()
    assert (r["precision"], r["recall"]) == (1.0, 1.0)
    train, test = ml.split(d, "label", "id")
    assert (train.count(), test.count()) == (34, 16) and {r[0] for r in test.groupBy("label").count().select("count").collect()} == {8}
    pairs = d.select("id", F.col("label").alias("k"), F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    from pyspark.ml.feature import VectorAssembler

    linked = ml.forest(trees=2, depth=2).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(pairs.withColumn("label", F.col("k"))))
    out = scoring.score_links(pairs, linked, ["a", "b"], ["k"])
    assert out.count() == 25 and out.where("place = 1").count() == 1


def test_training_sets(spark):
    documents = spark.createDataFrame([(1, "2009-01-01"), (2, "2008-01-01")], "id long, d string").withColumn("date", F.to_date("d"))
    entities = spark.createDataFrame([(10, "a", 1), (11, "a", 1), (12, "b", 1), (13, "c", 2)], "id long, entity_inferred_name string, document_id long")
    links = spark.createDataFrame([(5, 7, 1)], "id long, item_id long, document_id long")
    matches = spark.createDataFrame([(5, 10), (5, 11)], "item_document_id long, matched_entity_id long")
    items = spark.createDataFrame([(7,)], "item_id long")
    assert [tuple(r) for r in ml.positives(matches, entities, links, items, documents, 2009).collect()] == [("a", 11)]
    assert [tuple(r) for r in ml.negatives(entities, documents, matches, 2009, 10).collect()] == [("b", 12)]
    assert ml.negatives(entities, documents, matches, 2009, 10, within=documents.select(F.lit(2).alias("document_id"))).count() == 0
    both = training.training_set(ml.positives(matches, entities, links, items, documents, 2009), ml.negatives(entities, documents, matches, 2009, 10))
    assert {(r["entity_id"], r["label"]) for r in both.collect()} == {(11, 1), (12, 0)}


def test_rule_matches_keep_equals(spark):
    items = spark.createDataFrame([(1, "water works in Springfield", None), (2, "", "bridge")], "item_id long, a string, b string")
    links = spark.createDataFrame([(50, 1, 9), (51, 2, 9), (52, 1, 8)], "id long, item_id long, document_id long")
    entities = spark.createDataFrame([(100, 9, "Water works | in Springfield"), (101, 9, "water works in | springfield"), (102, 9, "water works"), (103, 8, "works in Springfield now"), (104, 7, "water works in Springfield"), (105, 9, None)], "entity_id long, document_id long, entity_inferred_name string")
    got = matching.rule_matches(items, links, entities, ["a", "b"])
    assert sorted((r["item_id"], r["document_id"], r["entity_id"], round(r["score"], 3)) for r in got.collect()) == [(1, 9, 100, 1.0), (1, 9, 101, 1.0)]
    stored = matching.to_store(got, links)
    assert sorted((r["item_document_id"], r["matched_entity_id"], r["manual_match"]) for r in stored.collect()) == [(50, 100, False), (50, 101, False)]
    assert matching.scored_pairs(items, links, entities, ["a", "b"]).where("item_id = 1 and document_id = 8").first()["score"] == pytest.approx(0.5)
    labels = spark.createDataFrame([(1, 0.9, "a"), (2, 0.5, "b"), (3, 0.01, "c")], "e int, s double, n string")
    assert [r[0] for r in labels.select(linkage.auto_label(F.col("s"))).collect()] == ["match", "ask", "skip"]


def test_table_reports(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "$1,000"]), (1, 0, ["a", "b"]), (1, 0, ["a", "10"])], "document_id long, table_no int, cells array<string>")
    assert {(r["cell"], r["n"]) for r in tables.rare_cells(rows).collect()} == {("b", 1), ("10", 1)}
    a = spark.createDataFrame([(1, 0, "x")], "document_id long, table_no int, content string")
    b = spark.createDataFrame([(1, 1, "y")], "document_id long, table_no int, content string")
    assert sorted(map(tuple, tables.side_by_side(a, b).collect())) == [(1, 0, "x", None), (1, 1, None, "y")]
    assert sorted(map(tuple, tables.table_counts(a, b).collect())) == [(1, 1, 1)]


def test_updates_and_children(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, writers.updated(df, spark.createDataFrame([(2, "c")], "id int, v string"), "id", "v").collect())) == [(1, "a"), (2, "c")]
    writers.refresh(df, str(tmp_path / "t"))
    writers.refresh(df.where("id = 1"), str(tmp_path / "t"))
    writers.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert sorted(map(tuple, writers.children(df.withColumn("x", F.array(F.lit("p"), F.lit("q"))), "id", "x", "y").collect())) == [(1, 0, "p"), (1, 1, "q"), (2, 0, "p"), (2, 1, "q")]
    wide = report.long_form(spark.createDataFrame([(1, 5, 6)], "r int, a int, b int"), "r", ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, "a", 5), (1, "b", 6)]
