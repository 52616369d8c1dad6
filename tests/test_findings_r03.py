"""Work that must not be done for each pair, each pass or each page."""

import itertools
import json

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docloom.functions import pairs as P
from docloom.functions import stems
from docloom.operators import linkage, tables
from docloom.plans import catalogue
from docloom.sources import connectors, services, writers
from docloom.streaming import answers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_pairs(query: str) -> str:
    """The part of a plan that lies above the join that makes the pairs."""
    last = next(line for line in query.split("\n") if "Join" in line)
    return query.split(last)[0]


def test_cells_are_made_for_records_not_for_pairs(spark):
    """F7"""
    assert "regexp_replace" not in above_pairs(plan(catalogue.queries()["pair_features"](spark, SF)))
    left = spark.createDataFrame([(1, "red ring", "Red, ring | of gold | "), (2, "", ""), (3, "a b c", "a b | c")], "a long, entity string, entity_raw string")
    right = spark.createDataFrame([(7, "a red ring of gold"), (8, ""), (9, "a b c")], "b long, item string")
    want = linkage.cell_features(left.crossJoin(right), "entity", ["item"])
    got = linkage.cell_features(linkage.with_cells(left, "entity").crossJoin(linkage.with_grams(right, ["item"])), "entity", ["item"]).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_entries_are_counted_without_a_map(spark):
    """F8"""
    assert "map" not in above_pairs(plan(catalogue.queries()["student_pair_features"](spark, SF)))
    some = [(z, s, lang) for z in (None, 1, 2) for s in (None, 1, 5) for lang in (None, "English")]
    kind = "struct<ZipCode:int,ThisGradeSchoolKey:int,Language:string,Gender:string,BirthCountry:string,HomeLanguage:string>"
    rows = [((*x, "Male", "x", None), (*y, "Male", None, "Spanish")) for x, y in itertools.product(some, some)]
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}").select(F.size(P.other_features("a", "b")).alias("want"), P.n_other_features("a", "b").alias("got"))
    assert df.where("want <> got").count() == 0 and {r.want for r in df.collect()} == {5, 6, 7, 8}


def test_a_readers_pairs_of_blocks_are_made_once(spark):
    """F10"""
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 9), (None, 1), (4, 3)], "item_id long, size int")
    chosen = spark.createDataFrame([(10, 1), (11, 2), (12, 2), (13, 3), (13, 2), (99, 2)], "entity_id long, size int")
    entities = spark.createDataFrame([(10, 1), (11, 2), (12, 1), (13, 3)], "entity_id long, document_id long")
    links = spark.createDataFrame([(5, 1, 1), (4, 1, 1), (6, 1, 2), (7, 2, 3), (8, 4, None)], "id long, item_id long, document_id long")
    want = writers.manual_matches(items.join(chosen, "size").select("item_id", "entity_id"), entities, links)
    got = writers.manual_matches_of_blocks(items, chosen, "size", entities, links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    query = plan(catalogue.queries()["manual_matches"](spark, SF))
    assert "_i#" in query and "Exchange" not in above_pairs(query)


def test_pages_of_a_row_group_are_read_once(tmp_path, monkeypatch):
    """F13"""
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"k": [7, 0, 3, 11, 12, 3], "v": list("abcdef")}), path)
    options = {"path": path, "key": "k", "columns": "v,k", "page": "4"}
    service, reads = services.TableService(options), []
    rows = services.TableService._rows
    monkeypatch.setattr(services.TableService, "_rows", lambda self, *a: reads.append(a) or rows(self, *a))
    got = [[json.loads(r) for r in services.TableService(options).fetch(n)] for n in (1, 2, 3, 4, 5, 1)]
    assert [[r["k"] for r in page] for page in got] == [[0, 3, 3], [7], [11], [12], [], [0, 3, 3]] and got[1] == [{"v": "a", "k": 7}]
    assert len(reads) == 1 and service.exists(4) and not service.exists(5)
    pq.write_table(pa.table({"k": [1, 2], "v": ["new", "er"]}), path)
    assert [json.loads(r)["v"] for r in services.TableService(options).fetch(1)] == ["new", "er"]


def test_chunks_are_passed_on_in_small_batches(spark, monkeypatch):
    """F15"""
    monkeypatch.setattr(connectors, "CHUNKS", 50)
    seen = spark.createDataFrame([(i, "x" * 900 + str(i)) for i in range(5)] + [(7, None), (8, "")], "doc_id long, text string").coalesce(1)
    sizes = connectors.chunked(seen, 10).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert sum(r.n for r in sizes.collect()) == 5 * 91
    out = connectors.chunked(seen, 10).where("document_id = 3").orderBy("chunk").collect()
    assert "".join(r.text for r in out) == "x" * 900 + "3" and [r.offset for r in out] == list(range(0, 901, 10))


def test_stems_of_a_batch_are_made_some_texts_at_a_time(monkeypatch):
    """F19"""
    texts = pa.array(["Running rings", None, "", "ponies; caresses", "x " * 50, "hopping"])
    want, held, one = stems.stemmed(texts), [], stems._stemmed
    monkeypatch.setattr(stems, "BYTES", 20)
    monkeypatch.setattr(stems, "_stemmed", lambda t: held.append(len(t)) or one(t))
    assert stems.stemmed(texts).equals(want) and want.to_pylist()[:4] == ["run ring", None, "", "poni ; caress"]
    assert len(held) > 2 and sum(held) == 6 and stems.stemmed(texts[:0]).to_pylist() == []


def test_state_is_asked_once_for_each_item():
    """F16"""
    calls = []

    class State:
        rows = []

        def get(self):
            calls.append("get")
            return iter(list(self.rows))

        def appendValue(self, row):
            calls.append("append")
            self.rows.append(row)

    runs = answers.Runs(2)
    runs.init(type("Handle", (), {"getListState": lambda self, *a: State(), "getValueState": lambda self, *a: State(), "getMapState": lambda self, *a: State()})())
    ask = lambda rows: [r for f in runs.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["answer", "yes"])]), None) for r in f["run"].tolist()]
    assert ask([(k, False) for k in range(100)]) == list(range(1, 101)) and ask([(99, False), (100, False), (100, True)]) == [101] and ask([(5, True)]) == []
    assert calls == ["get", "append", "get", "append", "get"]


def test_rows_and_tables_are_made_without_what_they_do_not_show(spark):
    """F14, F18, F21, F22"""
    text = " LIST\n\n" + "".join(f"{n:.<30}  {a:>9}\n" for n, a in (("one_thing", "1,000"), ("two_things", "20"), ("three", "300")))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none"), (4, text + "\n\n" + text)], "doc_id long, text string")
    whole = tables.parsed(docs)
    assert sorted(map(str, tables.extract_rows(docs).collect())) == sorted(map(str, tables.rows_of(whole).collect())) != []
    assert sorted(map(str, tables.extract_tables(docs).collect())) == sorted(map(str, tables.tables_of(whole).select(tables.extract_tables(docs).columns).collect()))
    assert ", rows#" in plan(tables.tables_of(whole)) and ", rows#" not in plan(tables.extract_tables(docs))
