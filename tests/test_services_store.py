"""Numbered services as sources, and tables with commits."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.sources import services, store

STUB = "tests.stub_service:Folder"


def fill(folder, numbers):
    for n in numbers:
        (folder / str(n)).write_text("".join(f"r{n}.{k}\n" for k in range(n % 3)))


def log(folder, what):
    return [line.split()[1] for line in (folder / "log").read_text().splitlines() if line.startswith(what)]


def test_pages_are_fetched_in_partitions(spark, tmp_path):
    fill(tmp_path, range(1, 24))
    df = services.pages(spark, STUB, folder=str(tmp_path), per_partition=5)
    assert df.rdd.getNumPartitions() == 5
    got = sorted((r.number, r.position, r.record) for r in df.collect())
    assert got == [(n, k, f"r{n}.{k}") for n in range(1, 24) for k in range(n % 3)]
    assert Counter(log(tmp_path, "fetch")) == Counter(map(str, range(1, 24)))
    assert len(set(log(tmp_path, "exists"))) < 12  # doubling and halving, no walk


def test_the_last_number_can_be_given_and_none_may_exist(spark, tmp_path):
    fill(tmp_path, range(1, 9))
    (tmp_path / "log").write_text("")
    few = services.pages(spark, STUB, folder=str(tmp_path), per_partition=3, last=4, first=2)
    assert {r.number for r in few.collect()} == {2, 4} and log(tmp_path, "exists") == []
    empty = tmp_path / "empty"
    empty.mkdir()
    assert services.pages(spark, STUB, folder=str(empty)).count() == 0


def test_failures_are_tried_again_then_raised(spark, tmp_path):
    fill(tmp_path, range(1, 4))
    assert services.pages(spark, STUB, folder=str(tmp_path), fail=2, wait=0.01).count() == 3
    for f in tmp_path.glob("tries-*"):
        f.unlink()
    with pytest.raises(Exception, match="try again"):
        services.pages(spark, STUB, folder=str(tmp_path), fail=9, attempts=2, wait=0.01).collect()


def test_a_stream_fetches_what_is_new_and_nothing_twice(spark, tmp_path):
    folder, out = tmp_path / "service", str(tmp_path / "out")
    folder.mkdir()

    def run():
        new = services.new_pages(spark, STUB, folder=str(folder), per_partition=2)
        new.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    fill(folder, range(1, 6))
    run()
    run()
    fill(folder, range(6, 12))
    run()
    assert sorted(r.record for r in spark.read.parquet(out).collect()) == sorted(f"r{n}.{k}" for n in range(1, 12) for k in range(n % 3))
    assert Counter(log(folder, "fetch")) == Counter(map(str, range(1, 12)))


# The store.


@pytest.fixture
def table(spark, tmp_path):
    return store.Table(spark, f"file://{tmp_path}/t", "id long, what string")


def rows(spark, *found):
    return spark.createDataFrame(found, "id long, what string")


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_versions(spark, table):
    assert table.version() == 0 and held(table) == []
    assert table.append(rows(spark, (1, "a"), (2, "b"))) == 1
    assert table.append_missing(rows(spark, (2, "z"), (3, "c"), (3, "c")), ["id"]) == 2
    assert table.append_missing(rows(spark, (2, "z"), (3, "c")), ["id"]) == 3
    assert table.update(rows(spark, (1, "A"), (9, "none")), "id", "what") == 4
    assert held(table) == [(1, "A"), (2, "b"), (3, "c")] and held(table, 1) == [(1, "a"), (2, "b")]
    assert table.refresh(lambda now: now.where("id > 1").unionAll(now.where("id = 3"))) == 5  # reads its own table
    assert held(table) == [(2, "b"), (3, "c"), (3, "c")]
    assert table.refresh(rows(spark)) == 6 and held(table) == []
    assert table.vacuum() == 5 and table.vacuum() == 0 and held(table) == []


def test_two_writers_double_no_row(spark, table):
    table.append(rows(spark, *((i, "old") for i in range(5))))
    errors = []

    def write(name):
        try:
            table.append_missing(rows(spark, *((i, name) for i in range(3, 40))), ["id"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and table.version() == 4
    assert sorted(i for i, _ in held(table)) == list(range(40))


def test_who_comes_second_works_on_the_new_version(spark, table):
    table.append(rows(spark, (1, "a")))
    tries = []

    def work(now):
        tries.append(now.count())
        if len(tries) == 1:
            table.append(rows(spark, (2, "b")))  # another writer is first
        return now.withColumn("what", F.upper("what"))

    assert table.refresh(work) == 3 and tries == [1, 2]
    assert held(table) == [(1, "A"), (2, "B")] and table.vacuum() == 2  # what was worked out in vain is gone already


def test_a_failed_task_leaves_the_table_as_it_was(spark, table):
    table.append(rows(spark, (1, "a")))
    with pytest.raises(Exception):
        table.append(rows(spark, (2, "b")).withColumn("what", F.raise_error(F.lit("no"))))
    assert table.version() == 1 and held(table) == [(1, "a")]


def test_a_claim_of_a_dead_writer_is_given_up(spark, table, monkeypatch):
    table.append(rows(spark, (1, "a")))
    claim, fs = table._at("_versions", "0000000002.claim")
    fs.create(claim, False).close()
    monkeypatch.setattr(store, "DEAD", 0.2)
    assert table.append(rows(spark, (2, "b"))) == 2 and held(table) == [(1, "a"), (2, "b")]
