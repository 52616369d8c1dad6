"""Hard negatives, prefix-wise BPE and the audit of filters against plain recomputations."""

import math
import random
import re
from itertools import permutations

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm import audit, bpe, negatives, prefix_bpe, queries

# Hard negatives.

ROWS = "vec_id long, label int, vector array<double>, anchor boolean, n long, slot string"


def brute_negatives(rows, s):
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    whole = {id(r): [int(math.floor(s.scale * x)) for x in r[2]] for r in fine}
    out = []
    for a in fine:
        if not a[3]:
            continue
        scored = [(-sum(x * y for x, y in zip(whole[id(a)], whole[id(r)], strict=True)), r[0], r[1]) for r in fine if len(r[2]) == len(a[2])]
        for ps, p, _ in sorted(x[:2] + (0,) for x in scored if x[2] == a[1] and x[1] != a[0])[: s.positives]:
            inside = sorted((v, i) for v, i, label in scored if label != a[1] and s.low * -ps <= 100 * -v <= s.high * -ps)
            out += [(a[0], p, k, i, -ps, -v) for k, (v, i) in enumerate(inside[: s.negatives], 1)]
    return sorted(out)


def mined(spark, rows, s):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, s).collect())


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 2000])
def test_negatives_equal_brute_force(spark, chunk_bytes):
    r = random.Random(1)
    rows = [(i if i % 9 else i // 2, r.randint(0, 3), [r.randint(-2, 6) / 2 for _ in range(4)], i % 10 == 0) for i in range(300)]  # many ties; some ids repeat
    rows += [(5, None, [1.0] * 4, True), (None, 1, [1.0] * 4, True), (7, 1, None, True), (8, 1, [1.0, None, 2.0, 3.0], True), (9, 1, [1.0, math.nan, 2.0, 3.0], True), (11, 1, [math.inf, 1.0, 1.0, 1.0], False)]
    rows += [(400 + i, i % 3, [float(r.randint(1, 5)) for _ in range(2)], i == 0) for i in range(40)]  # another length of vector
    rows += [(500 + i, i % 2, [], i == 0) for i in range(6)]
    s = negatives.Settings(scale=2, chunk_bytes=chunk_bytes)
    want = brute_negatives(rows, s)
    assert want and mined(spark, rows, s) == want


def test_negatives_beyond_float64(spark):
    r = random.Random(2)
    rows = [(i, i % 3, [float(r.randint(1, 1 << 27)) + r.choice([0, 1]) for _ in range(3)] if i % 2 else [float(r.randint(1, 9)) for _ in range(3)], i % 11 == 0) for i in range(120)]
    s = negatives.Settings(scale=1)
    assert mined(spark, rows, s) == brute_negatives(rows, s)
    with pytest.raises(Exception, match="beyond 64 bits"):
        mined(spark, [(1, 1, [1e30], True), (2, 1, [1e30], False)], s)


def test_negatives_of_many_equal_rows_and_of_none(spark):
    s = negatives.Settings()
    rows = [(i, int(i % 5 == 0), [0.5, 0.25], i in (0, 5)) for i in range(5000)] + [(9000 + i, 0, [0.2, 0.25], False) for i in range(30)]
    got = mined(spark, rows, s)
    assert got == brute_negatives(rows, s) and len(got) == 2 * 5 * 10
    assert mined(spark, [], s) == [] and mined(spark, [(1, 1, [1.0], True)], s) == []


def test_best_merges_in_any_order():
    import numpy as np

    r = np.random.default_rng(3)
    s, ids = r.integers(0, 6, (4, 300)).astype(float), r.permutation(300)
    best = negatives.Best(4, 7)
    for a in range(0, 300, 40):
        best.offer(0, s[:, a : a + 40], ids[a : a + 40], s[:, a : a + 40] != 5)
    for row in range(4):
        want = sorted((-v, i) for v, i in zip(s[row].tolist(), ids.tolist(), strict=True) if v != 5)[:7]
        assert list(zip((-best.score[row]).tolist(), best.id[row].tolist(), strict=True)) == want


# Prefixes.


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.spec_of(public_tokenizers.path("byte_bpe_50k.json"))


def texts_of_all_kinds():
    r = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext", " ", "  ", "\n", "\t", "a", "ab", "the", "'s", "'ll", "1", "23", "é", "ß", "…", "—", "日本", "👍🏽", "́", " ", "!!", "--------", "ing", "\x00", "𝒳", "Ⅷ", "½", "\x85", "\x1c", "aaaa", "\r\n", ".", ","]
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    out += ["".join(chr(r.choice([r.randint(0, 127), r.randint(0, 0x2FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    return [*out, "a" * 30_000, "ab" * 20_000, "-" * 5000 + " x", "é" * 3000, "<|endoftext|>" * 50, ""]


def test_prefixes_give_the_librarys_ids(vocabulary):
    library, texts = Tokenizer.from_str(vocabulary), texts_of_all_kinds()
    ids, counts = prefix_bpe.PrefixEncoder(vocabulary).encode(texts)
    at = 0
    for text, n, want in zip(texts, counts.tolist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == want.ids, text[:80]
        assert bpe.decode(vocabulary, ids[at : at + n].astype(int))[0].tobytes().decode() == library.decode(want.ids, skip_special_tokens=False)
        at += n


def test_known_characters_have_the_librarys_classes(vocabulary):
    e, library = prefix_bpe.PrefixEncoder(vocabulary), Tokenizer.from_str(vocabulary)
    for c in (chr(i) for i in range(0x2100)):
        if e.known.fullmatch(c):
            for text in (f"a{c}1", f" {c} {c}", f"{c}{c}a"):
                assert e._matches(text) == [bpe.raw_of(m) for m, _ in library.pre_tokenizer.pre_tokenize_str(text)]


def test_every_prefix_has_one_last_token(vocabulary):
    t, library = prefix_bpe.tokens(vocabulary), Tokenizer.from_str(vocabulary)
    for word in ("internationalisation", " hyperparameterization", "aaaaaaaaaaaaa", " zzxqqv"):
        for n in range(1, len(word) + 1):
            assert t.encode(word[:n].encode()) == library.encode(word[:n], add_special_tokens=False).ids
    assert t.encode(b"") == []


def test_a_vocabulary_of_two_ways_to_a_token_is_refused():
    import json

    chars = bpe.byte_chars()
    vocab = {c: i for i, c in enumerate(chars)} | {"ab": 256, "bc": 257, "abc": 258}
    spec = {"added_tokens": [], "model": {"vocab": vocab, "merges": [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]}}
    with pytest.raises(ValueError, match="two merges"):
        prefix_bpe.Tokens(json.dumps(spec))


def test_prefixes_over_tables(spark, vocabulary):
    rows = [(1, None, 1), (2, "", 2), (3, "it's <|endoftext|> here", 3), (3, "ça  va\n", 4), (None, "x" * 50_000, 5)]
    got = sorted(prefix_bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), vocabulary).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens))
    library = Tokenizer.from_str(vocabulary)
    want = {t or "": library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows}
    assert sorted((bytes(r.decoded).decode(), r.n_tokens) for r in got) == sorted((t or "", len(want[t or ""])) for _, t, _ in rows)
    assert prefix_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_prefix_query_is_the_library_on_the_whole_table(spark, sf, vocabulary):
    import hashlib

    import numpy as np

    library = Tokenizer.from_str(vocabulary)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_prefix_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


# Audit.


def brute_audit(docs, labels):
    def flags(i, text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        caps = sum("A" <= c <= "Z" for c in text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * caps > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}

    says = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    facts = [(lang or "", flags(i, t or ""), says(i, 1), says(i, 2)) for i, t, lang in docs]
    out = []
    for part in {f[0] for f in facts}:
        mine, shapley, rows = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            alive = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in alive if f[1][x]]
                failing = sum(f[1][x] for f in mine)
                alive = [f for f in alive if not f[1][x]]
                shapley[x] += len(gone)
                rows.append((part, "".join(order), step, x, len(alive), len(gone), failing - len(gone), sum(f[1][x] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*r[:3], *r[4:], shapley[r[3]]) for r in rows]
    return sorted(out)


def test_audit_equals_every_order_one_by_one(spark):
    r = random.Random(4)
    word = lambda: r.choice(["a", "b#", "Cap", "word", "x" * 9, "ÀB"]) + str(r.randint(0, 60))
    docs = [(i, " \t".join(word() for _ in range(r.choice([0, 3, 99, 100, 130]))), r.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[r.randrange(60)][1], r.choice(["en", "fr"])) for i in range(40)]
    docs += [(200, None, "en"), (201, None, None), (3, docs[3][1], "de"), (3, "other", "de"), (None, docs[5][1], "en"), (None, None, "fr"), (5, "A" * 5, "en")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 140, 2)] + [(4, None, None), (4, 1, None), (None, 1, 1)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, lang string, digest int")
    l = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")  # noqa: E741
    assert sorted(tuple(x) for x in audit.audit(d, l).collect()) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    d, l = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")  # noqa: E741
    assert audit.audit(d, l).collect() == []
    one = audit.audit(spark.createDataFrame([(1, "x", "en")], d.schema), l).collect()
    assert len(one) == 600 and sum(r.removed for r in one) == 120 and {r.shapley for r in one if r.filter_order[r.step - 1] == "A"} == {120}


def test_audit_shuffles_by_id_not_by_text(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = audit.counted(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
