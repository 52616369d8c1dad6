"""Answers of annotators in any form, and answers of readers that arrive bit by bit."""

import random

import pytest

from docloom.sources import readers
from docloom.streaming import answers as A


def test_answers_of_any_form(spark):
    good = '{"a": {"_typeGroup": "entities", "_type": "City", "name": "Ulm", "new": {"x": [1, {"y": 2}]}, "instances": [{"offset": 3, "length": 4, "exact": "Ulm", "odd": 1}, {"exact": "U"}], "resolutions": [{"id": "u"}]}, "t": {"_typeGroup": "topics", "categoryName": "c", "relevance": 0.5}}'
    odd = '{"b": {"_typeGroup": "entities", "_type": ["no"], "instances": [{"offset": "far", "length": 2.0}], "resolutions": {}}, "c": 1, "d": null, "e": {"_typeGroup": "entities"}, "f": {"_typeGroup": "relations", "relevance": "high"}}'
    df = spark.createDataFrame([(1, good), (2, odd), (3, "{"), (4, None), (5, "[1]"), (6, "{}"), (7, "null")], "id long, response string")
    key = lambda r: (r.id, r.uri, r.entity_text or "")
    got = [tuple(r) for r in sorted(readers.annotations(df).collect(), key=key)]
    assert got == [(1, "a", "U", "City", None, None, "Ulm", "u"), (1, "a", "Ulm", "City", 3, 4, "Ulm", "u"), (2, "b", None, '["no"]', None, 2, None, None)]
    told = sorted((r.id, r.kind, r.type, r.name, r.relevance) for r in readers.response_summary(df).where("kind <> 'entities'").collect())
    assert told == [(1, "topics", None, "c", 0.5), (2, "relations", None, None, None)]
    groups = {(r.id, r.type_group): (r.n, r.uris) for r in readers.by_type_group(df).collect()}
    assert groups == {(1, "entities"): (1, ["a"]), (1, "topics"): (1, ["t"]), (2, "entities"): (2, ["b", "e"]), (2, "relations"): (1, ["f"]), (2, None): (2, ["c", "d"])}


@pytest.fixture
def stream(spark, tmp_path):
    schema = "item long, answer long, yes boolean"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(most=2):
        A.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"), most).awaitTermination()
        return sorted(map(tuple, spark.read.schema("item long, answer long, yes boolean, run long, decided boolean").parquet(str(tmp_path / "out")).collect()))

    return add, run


def test_runs_go_on_where_they_stopped(stream):
    add, run = stream
    r = random.Random(6)
    answers = [(i, k, r.random() < 0.3) for i in range(4) for k in range(30)]
    want, length = [], {}
    for i, k, yes in answers:
        length[i] = 0 if yes else length.get(i, 0) + 1
        want.append((i, k, yes, length[i], length[i] > 2))
    first, second = [a for a in answers if a[1] < 13], [a for a in answers if a[1] >= 11]
    r.shuffle(first)
    r.shuffle(second)
    add([*first, first[0], (None, 1, True), (1, None, True)])
    assert run() == sorted(w for w in want if w[1] < 13)
    assert run() == sorted(w for w in want if w[1] < 13)  # nothing new
    add(second)
    assert run() == sorted(want)


def test_a_null_answer_is_no(stream):
    add, run = stream
    add([(1, 1, None), (1, 2, False), (1, 3, None), (1, 4, True), (1, 5, None)])
    assert run() == [(1, 1, False, 1, False), (1, 2, False, 2, False), (1, 3, False, 3, True), (1, 4, True, 0, False), (1, 5, False, 1, False)]
