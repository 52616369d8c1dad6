"""The search for near-duplicates against brute force, on small tables with odd rows and on a whole table."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import neardup
from docloom.llm.common import counted_join


def test_similar_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows, family = [], {}
    for g in range(25):
        base = [word() for _ in range(r.randint(120, 400))]
        for k in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(k and len(base) // 100 + 1):
                copy[r.randrange(len(copy))] = word()
            family[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    for bucket in (4096, 2):
        got = {x["id"]: x["component_id"] for x in neardup.similar(df, bucket=bucket).collect()}
        assert got == {i: min(j for j in family if family[j] == family[i]) for i in family}


def shingles_of(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard_groups(rows):
    """Brute force: each id with the least one that links of Jaccard similarity 0.8 reach."""
    sets = {i: shingles_of(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def test_links_have_the_similarity(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(200)]
        copy = list(base)
        for k in r.sample(range(5, 195), r.randint(4, 9)):
            copy[k] = word()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    want = jaccard_groups(rows)
    assert 5 < len(set(want.values())) - 25 < 20
    got = {x["id"]: x["component_id"] for x in neardup.similar(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == want


def test_all_links_are_found(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    common = [word() for _ in range(60)]
    rows = [(0, "a b"), (1, "a b"), (2, "a b c"), (3, "")]
    for k in range(60):
        base = [word() for _ in range(r.randint(60, 300))] + common
        more = [word() for _ in range(len(base) * r.randint(12, 30) // 100)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join((base + more, more + base, base[len(more) :])[k % 3]))]
    want = jaccard_groups(rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for bucket in (4096, 5):
        assert {x["id"]: x["component_id"] for x in neardup.similar(df, bucket=bucket).collect()} == want


def test_sketches_only_rule_out(spark):
    r = np.random.default_rng(5)
    for n in (3, 40, 700, 9000):
        base = r.integers(0, 2**63, n).astype(np.uint64)
        for share in (0.0, 0.02, 0.1, 0.5):
            other = base.copy()
            k = int(n * share)
            other[:k] = r.integers(0, 2**63, k).astype(np.uint64)
            more = r.integers(0, 2**63, n // 7).astype(np.uint64)
            for x, y in ((base, other), (base, np.concatenate([other, more]))):
                x, y = np.unique(x), np.unique(y)
                differ = len(np.setxor1d(x, y))
                assert neardup.apart(neardup.parity(x), neardup.parity(y)) <= differ
                assert neardup.apart(neardup.fine_parity(x), neardup.fine_parity(y)) <= differ


def test_shingles_are_told_apart():
    words = lambda t: neardup.word_hashes(t, neardup._Hashes())
    sets = lambda t: set(neardup.shingle_set(words(t), 5).tolist())
    assert sets("a b c d e f") == sets("A b  c\td e\nf") and len(sets("a b c d e f")) == 2
    assert len({frozenset(sets(t)) for t in ("a b", "b a", "a", "a a", "a a a", "", "ab", "a b c d e", "e d c b a")}) == 9
    assert sets(None) == sets("  ") == set()


def test_one_stays_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [
        (1, base, "a"), (1, "another text that is wholly unlike the first of them", "b"), (2, base + " more", "c"), (None, base, "d"), (None, "no id and no copy of anything else here", "e"),
        (3, None, "f"), (4, "", "g"), (5, "\n ", "h"), (6, long, "i"), (7, long + " y", "j"), (8, "short", "k"), (8, "short", "k"), (8, "short", "l"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_row string").withColumns({c: F.lit(1) for c in ("node", "c", "key", "id", "h", "size")}).repartition(3)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((x["doc_id"] or 0, x["near_row"]) for x in kept.collect())
    assert [g for g in got if g[0] != 8] == [(0, "e"), (1, "a"), (1, "b"), (3, "f"), (6, "i")]
    assert sum(g[0] == 8 for g in got) == 1
    assert neardup.keep_one(df.where("false")).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Members that differ pairwise by little, in crowded buckets, with others that share a passage with them."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = []
    for _ in range(60):
        copy = list(base)
        copy[r.randrange(100)] = word()
        rows.append((len(rows), " ".join(copy)))
    for _ in range(40):
        rows.append((len(rows), " ".join([word() for _ in range(90)] + base[:25])))
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    want = jaccard_groups(rows)
    for bucket, hot in ((4096, 1 << 20), (8, 5)):
        assert {x["id"]: x["component_id"] for x in neardup.similar(df, bucket=bucket, hot=hot).collect()} == want


@pytest.mark.parametrize("name", ["sf0.01"])
def test_whole_table(spark, name):
    """Every pair at 0.8 or more is one group, and no document goes without one; by an inverted index of all shingles."""
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    sets = {x["doc_id"]: frozenset(shingles_of((x["text"] or "").lower())) for x in docs.collect()}
    at = {}
    for d, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(d)
    both = Counter(p for ds in at.values() for p in combinations(sorted(ds), 2))
    links = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    kept = {x["doc_id"] for x in neardup.keep_one(docs).collect()}
    assert kept == {d for d in sets if find(d) == d} and len(links) > 50


def test_rows_of_one_place_are_told_apart(spark, tmp_path):
    from pyspark.sql import functions as F

    r = random.Random(8)
    a, b, c = (" ".join(f"w{r.randint(0, 10_000)}" for _ in range(40)) for _ in range(3))
    spark.createDataFrame([(1, [a, b]), (2, [a, c])], "doc_id long, texts array<string>").coalesce(1).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    once = read.select("doc_id", F.explode("texts").alias("text"))
    assert sorted(x.text for x in neardup.keep_one(once).collect()) == sorted([a, b, c])
    assert sorted(x.text for x in neardup.keep_one(once.union(once)).collect()) == sorted([a, b, c])
    plain = read.select("doc_id", F.col("texts")[1].alias("text")).where("doc_id > 0")
    assert neardup._is_scan(plain) and not neardup._is_scan(once) and not neardup._is_scan(plain.union(plain))
    assert sorted(x.text for x in neardup.keep_one(plain).collect()) == sorted([b, c])


def test_columns_of_the_names_used_inside_pass_through(spark, tmp_path):
    names = ["near_row", "near_row_file", "near_row_no", "Near_Row_Place", "id", "component_id", "key", "node", "h"]
    rows = [(1, "one two three four five six", *names), (2, "one two three four five six", *names), (3, None, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    df.write.parquet(str(tmp_path / "t"))
    for docs in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = neardup.keep_one(docs)
        assert got.columns == df.columns and sorted(tuple(x) for x in got.collect()) == sorted((rows[0], rows[2]))


def test_hot_keys_are_joined_in_parts(spark):
    rows = [(k, i) for k, n in ((7, 40), (8, 3), (9, 1), (None, 4)) for i in range(n)]
    many = spark.createDataFrame(rows, "k long, id long").repartition(3)
    few = spark.createDataFrame([(7, "a", 40), (8, "b", 3), (9, "c", 1), (10, "d", 50)], "k long, of string, n long")
    want = sorted(map(tuple, many.join(few, "k").collect()))
    for most in (1, 3, 10, 1000):
        got = counted_join(many, few, "k", "n", "id", most)
        assert got.columns == ["k", "id", "of", "n"]
        assert sorted(map(tuple, got.collect())) == want
    parts = counted_join(many, few, "k", "n", "id", 10)._jdf.queryExecution().analyzed().toString()
    assert "hot_part" in parts and "hot_part" not in counted_join(many, few, "k", "n", "id")._jdf.queryExecution().analyzed().toString()
    assert counted_join(many.where("false"), few.where("false"), "k", "n", "id", 1).count() == 0


def test_copies_of_one_hot_set(spark):
    """A third of all rows is one text, and another third near copies of it."""
    base = [f"w{i}" for i in range(80)]
    rows = [(100 + i, " ".join(base)) for i in range(30)] + [(i + 1, " ".join([*base, f"x{i}"])) for i in range(30)] + [(200 + i, f"text {i} has other words than {i + 1} or {i * 7} has") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (4, 1 << 20):
        assert sorted(x["doc_id"] for x in neardup.keep_one(df, hot=hot).collect()) == [1, *range(200, 230)]
