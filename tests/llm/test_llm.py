"""The training-data operators against brute force, round trips and held-out cases, on small tables with odd rows."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import audio, blocks, bpe, extract, hashed, lstm, packing, privacy, quality, repetition, simhash, toxicity, warc
from docloom.llm.sample_pages import MARK, Pages

LONG = "word " * 3000 + "end " * 50
TEXTS = [
    (1, "Ab cd, ef. Ab cd, ef.\nline one two\nline one two\n"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "  two  spaces\t\ttabs\n\n\nlines  "),
    (6, "same text here for all of us to see"),
    (7, "same text here for all of us to see"),
    (7, "same text here for all of us to see"),
    (None, "no id here and ü中文🙂 odd signs"),
    (9, "x" * 70000),
    (10, "<|endoftext|> don't we'll nbsp \u0085"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    # Names that operators use themselves must not get in their way.
    return df.selectExpr("doc_id", "text", "'en' lang", "cast(length(text) as long) n_chars", "1 fp", "2 key", "'x' row", "3 id", "4 near_id", "5 doc")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows_of(df):
    return sorted(map(repr, df.collect()))


# Repetition.


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_repetition(docs, nothing):
    r = random.Random(1)
    cases = [t for _, t in TEXTS if t != LONG] + ["".join(r.choice("ab \n#é ") for _ in range(r.randint(0, 120))) for _ in range(400)]
    for text in cases:
        m = repetition.measure(text)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute_repeats(text)
    found = repetition.repetition(docs)
    assert found.count() == len(TEXTS) and repetition.repetition(nothing).count() == 0
    for x in found.collect():
        assert x["base_failed"] == (x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])
    kept = repetition.keep_unrepetitive(docs)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()


# SimHash.


def brute_fingerprint(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for _, t in TEXTS:
        assert simhash.fingerprint(t, 3) == brute_fingerprint(t, 3)


def test_golay_code():
    least, weight, others = simhash._decoder()
    assert sorted(np.unique(weight, return_counts=True)[1].tolist()) == [1, 23, 253, 1771]
    assert (others[weight == 3] != 0).all() and (others[weight < 3] == 0).all()
    x = np.arange(0, 1 << 23, 997)
    found, holds = simhash.codewords(x)
    assert holds.sum(axis=1).tolist() == [6 if w == 3 else 1 for w in weight[simhash._remainder(x)]]


def close_to(f, n, r):
    for i in r.sample(range(64), n):
        f ^= 1 << i
    return f


def brute_components(fps, most):
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("bucket", "most"), [(2048, 2), (2, 2), (2048, 1), (2, 1), (2, 0)])
def test_links_are_complete(spark, bucket, most):
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(r.randint(0, 4)):
            fps.append(close_to(f, r.randint(1, 2), r))
            fps.append(close_to(fps[-1], r.randint(1, 3), r))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    got = {x["node"]: x["root"] for x in simhash.components(simhash.links(df, most, bucket)).collect()}
    want = brute_components(fps, most)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    unsigned = {f % (1 << 64): v % (1 << 64) for f, v in got.items()}
    assert [g for g in groups(unsigned) if len(g) > 1] == [g for g in groups(want) if len(g) > 1]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_near_duplicates(docs, nothing):
    found = {}
    for x in simhash.near_duplicates(docs, 3).collect():
        found.setdefault(x["doc_id"], []).append(x)
    assert found[2][0]["fingerprint"] == "0" * 16 and found[2][0]["component_id"] == found[3][0]["component_id"] == 2
    assert {x["component_id"] for x in found[7]} == {6} and found[6][0]["copies"] == 3
    assert found[None][0]["component_id"] is None
    assert simhash.near_duplicates(nothing, 3).count() == 0


# Personal data.


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(4)
    for k in range(6000):
        t = "".join(r.choice("aB.@-+%_19 00()é,5") for _ in range(r.randint(0, 40)))
        assert [s[:3] for s in privacy.base_spans(t)] == brute_spans(t), t
    for t in ("4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5", "9" * 5000, "+1 (988) 555-2485", "1.2.3.300"):
        assert [s[:3] for s in privacy.base_spans(t)] == brute_spans(t)


def test_disclosing_terms(spark, docs, nothing):
    filler = [f"plain{i} words of no{i} matter go here" for i in range(40)]
    rows = [(i, f"{filler[i]} zorblax quux{chr(97 + i) * 3} ann.{1}@mail.example.com and the rest") for i in range(5)] + [(i, f"{filler[i]} and the rest") for i in range(5, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in privacy.private_spans(df).collect()}
    text = dict(rows)
    for i in range(5):
        spans = [s.split(":") for s in got[i]["spans"].split(",")]
        said = [text[i][int(a) : int(b)] for k, a, b in spans if k == "term"]
        assert "zorblax" in said and "rest" not in said and "quux" not in "".join(said)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "term").encode()).hexdigest()
    assert got[9]["spans"] == "" and got[9]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {x["doc_id"]: x["text"] for x in privacy.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "zorblax" not in clean[0] and clean[20] == text[20]
    done = privacy.sanitise(docs)
    assert done.columns == docs.columns and rows_of(done) == rows_of(docs)
    assert privacy.private_spans(docs).count() == len(TEXTS) and privacy.private_spans(nothing).count() == 0


def test_terms_far_from_mentions(spark):
    far = " and the rest" * 20
    rows = [(i, f"zorblax{far} ann.1@mail.example.com and the rest") for i in range(4)] + [(4, f"Zorblax alone{far}")] + [(i, f"number{far}") for i in range(5, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in privacy.private_spans(df).collect()}
    assert all(got[i].startswith("term:0:7,email:") for i in range(4)) and got[4] == "term:0:7" and got[5] == ""
    clean = {x["doc_id"]: x["text"] for x in privacy.sanitise(df).collect()}
    assert not any("zorblax" in t.lower() for t in clean.values()) and clean[5] == dict(rows)[5]


def test_terms_of_unique_values(spark):
    rows = [(i, f"common words mailbox{chr(97 + i)} zorblax ann.{i}@mail{i % 2}.example.com") for i in range(12)]
    rows += [(i, f"common words {'rareword' if i % 50 == 0 else 'other'} here") for i in range(12, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in privacy.private_spans(df).collect()}
    assert all("term:13:" not in got[i]["spans"] and got[i]["n_term"] == 1 and f"term:{rows[i][1].index('zorblax')}:" in got[i]["spans"] for i in range(12))
    assert all(got[i]["n_term"] == 0 for i in range(12, 400))


# Byte-level BPE and packing.


@pytest.fixture(scope="module")
def multi():
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def single():
    return bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(n, seed):
    r = random.Random(seed)
    alphabet = [*"aab  \n\t  é'sßst llñ中文字🙂0123٣,.!-_=\r", " ", "\u0085", "\x1c", " the", "'ll", "<|endoftext|>", "aaaaa", "     ", "\n\n", "..", ","]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_are_those_of_whole_texts(multi, single):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = Tokenizer.from_str(single)
    texts = odd_texts(3000, 5) + [t or "" for _, t in TEXTS]
    for spec, ids_of in ((multi, own.encode_ordinary), (single, lambda t: plain.encode(t, add_special_tokens=False).ids)):
        e = bpe.Encoder(spec, memo=2000)
        for k in range(0, len(texts), 500):
            ids, n = e.encode(texts[k : k + 500])
            ends = np.cumsum(n)
            for t, a, b in zip(texts[k : k + 500], ends - n, ends, strict=True):
                assert ids[a:b].tolist() == ids_of(t), t


def test_decoding(multi, docs, nothing):
    out = bpe.encode_decode(docs, multi, offsets=True).collect()
    assert sorted(x["decoded"].decode() for x in out) == sorted(t or "" for _, t in TEXTS)
    for x in out:
        ids = np.frombuffer(x["ids"], "<u4").astype(np.int64)
        raw, ends = bpe.decode(multi, ids)
        assert np.array_equal(ends, np.frombuffer(x["byte_ends"], "<i8"))
        first, last, split = bpe.char_offsets(raw, ends)
        text = raw.tobytes().decode()
        assert x["split_tokens"] == split.sum() and all(text[a:b] for a, b in zip(first, last, strict=True) if b > a)
        d = bpe.TextDecoder(multi)
        assert "".join([d.feed(ids[k : k + 1]) for k in range(len(ids))] + [d.feed(ids[:0], last=True)]) == text
    assert bpe.encode_decode(nothing, multi).count() == 0


def test_packing(single, docs, nothing):
    plain = Tokenizer.from_str(single)
    got = packing.pack(docs.repartition(3), single).collect()
    by_doc, by_sequence = {}, {}
    for x in got:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append(x)
    for d in {d for d, _ in TEXTS}:
        texts = [t or "" for i, t in TEXTS if i == d]
        pieces = sorted(by_doc[d], key=lambda x: x["start"])
        assert sum(x["length"] for x in pieces) == sum(x["doc_tokens"] for x in pieces if x["start"] == 0)
        if len(texts) == 1:
            ids = np.array([*plain.encode(texts[0], add_special_tokens=False).ids, 0], "<u4")
            assert b"".join(x["ids"] for x in pieces) == ids.tobytes()
    for s in by_sequence.values():
        s.sort(key=lambda x: x["offset"])
        n = sum(x["length"] for x in s)
        assert n <= 1024 and n & (n - 1) == 0 and [x["offset"] for x in s] == np.cumsum([0, *(x["length"] for x in s)])[:-1].tolist()
    for x in packing.digests(packing.pack(docs, single)).collect():
        whole = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in TEXTS if i == x["doc_id"]]
        assert any(x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) and x["doc_tokens"] == len(ids) for ids in whole)
    assert packing.encoder(single).encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]
    assert packing.pack(nothing, single).count() == 0


def test_packer_fills_windows():
    r = random.Random(6)
    p = packing.Packer(256, 16)
    total = 0
    for d in range(400):
        n = r.choice([1, 3, 17, 60, 130, 255, 256, 257, 700])
        total += n
        p.add(d, np.arange(n, dtype=np.uint32))
        if d % 50 == 0:
            p.close()
    p.close(last=True)
    assert sum(len(x.ids) for _, w in p.done for x in w) == total
    assert all(sum(len(x.ids) for x in w) == size and size & (size - 1) == 0 for size, w in p.done)


# WARC.


def test_warc(spark, tmp_path):
    rows = [(i, f"u{i}", ["a", "b", None, "", "é\r\n\r\nWARC/1.1"][i % 5]) for i in range(37)] + [(36, "x", "b"), (None, None, "zz"), (None, "q", "zz"), (99, "big", "y" * 200000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("x")).repartition(3)
    for least in (0, 2):
        got = warc.round_trip(spark, df, least).collect()
        assert len(got) == len(rows)
        digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        largest = {}
        for i, _, h in rows:
            largest[digest(h)] = max(largest.get(digest(h), -1), -1 if i is None else i)
        assert sorted((repr(x["page_id"]), x["payload_digest"], x["payload_bytes"]) for x in got) == sorted((repr(i), digest(h), len((h or "").encode())) for i, _, h in rows)
        for x in got:
            if x["payload_bytes"] < least:
                assert x["record_type"] == "response" and x["refers_to"] is None
            elif x["record_type"] == "revisit":
                assert (-1 if x["refers_to"] is None else x["refers_to"]) == largest[x["payload_digest"]]
        for d in largest:
            same = [x for x in got if x["payload_digest"] == d]
            if same[0]["payload_bytes"] >= least:
                assert sum(x["record_type"] == "response" for x in same) == 1
    assert warc.round_trip(spark, df.where("false")).count() == 0


def test_members_stand_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", "t" * i) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    raw, into = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    written = warc.write(df, raw, archive_bytes=3000)
    warc.normalise(written, raw, into)
    archives = sorted((tmp_path / "out").glob("*.warc.gz"))
    assert len(archives) > 1
    for a in archives:
        whole = gzip.decompress(a.read_bytes())
        assert whole.count(b"WARC/1.1\r\n") == len((a.parent / a.name.replace(".warc.gz", ".index.jsonl")).read_text().splitlines())
    pieces = warc.inflated(io.BytesIO(gzip.compress(b"a" * 10) + gzip.compress(b"b" * 10)), 7)
    assert b"".join(pieces) == b"a" * 10 + b"b" * 10


# Audio.


def test_audio(docs, nothing):
    got = audio.digests(audio.features(audio.store(docs))).collect()
    text = {}
    for d, t in TEXTS:
        text[d] = (t or "").encode()
    for x in got:
        raw = text[x["doc_id"]]
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(p) + 44, hashlib.sha256(audio.wave(p)).hexdigest())
    assert len({x["feature"] for x in got if x["doc_id"] in (6, 7)}) == 1
    assert audio.features(audio.store(nothing)).count() == 0


def test_resampling_and_tensors():
    u8 = np.random.default_rng(0).integers(0, 256, 1000).astype(np.uint8)
    n = -(-len(u8) * audio.UP // audio.DOWN)
    assert np.array_equal(audio.resample(u8, 0, n), np.concatenate([audio.resample(u8, k, min(96, n - k)) for k in range(0, n, 96)]))
    t = np.arange(4000) / audio.RATE
    y = audio.resample((128 + 100 * np.sin(2 * np.pi * 500 * t)).astype(np.uint8), 0, 3000)
    assert np.abs(y[50:-50] - 100 / 128 * np.sin(2 * np.pi * 500 * np.arange(3000) / audio.OUT_RATE)[50:-50]).max() < 0.02
    bands, _ = audio.log_mel(u8)
    out = audio.tensors(audio.stream(bands))
    assert out.schema.field("log_mel").type == audio.TENSOR
    e = np.array([0, 0, 9, 5, 9, 0, 0, 5, 0, 9, 9, 0.0])
    assert audio.segments(e) == [(2, 5), (9, 11)]


# Learned models.


def test_lstm_gradient():
    m = lstm.BiLstm.new(6, 3, np.random.default_rng(0))
    for d in (m.forward, m.backward):
        d[:] = [a.astype(np.float64) for a in d]
    m.out, m.bias = m.out.astype(np.float64), m.bias.astype(np.float64)
    x = np.random.default_rng(1).standard_normal((4, 3, 6))
    mask = np.array([[1, 1, 1], [1, 0, 1], [1, 0, 1], [1, 0, 0]], bool)
    y = np.random.default_rng(2).integers(0, 2, (4, 3)).astype(float)
    _, g = m.gradient(x, mask, y)
    for p, a in zip(m.parameters, g, strict=True):
        i = np.unravel_index(p.size // 2, p.shape)
        o = p[i]
        p[i] = o + 1e-2
        hi = m.gradient(x, mask, y)[0]
        p[i] = o - 1e-2
        lo = m.gradient(x, mask, y)[0]
        p[i] = o
        assert (hi - lo) / 2e-2 == pytest.approx(a[i], abs=1e-4)


def test_main_text(spark, sf):
    model = extract.labeller()
    source, vectors, right, every = Pages(1234), extract.Vectors(), 0, 0
    for _ in range(150):
        found = vectors.parse(source.page())
        truth = [b.text.startswith(MARK) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "").strip() or "x"
        p = extract.label(model, vectors, [found])[0] >= 0.5
        right += sum(a == b for a, b in zip(p, truth, strict=True))
        every += len(truth)
    assert right / every > 0.98  # held out
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {x["page_id"]: x for x in extract.main_text(pages).collect()}
    for x in pages.collect():
        inner = x["html"].split("<article>")[1].split("</article>")[0]
        want = [" ".join(blocks.html.unescape(re.sub("<[^>]*>", " ", s)).split()) for s in re.split("</?(?:h1|p)>", inner)]
        assert got[x["page_id"]]["text"] == "\n".join(filter(None, want))
        assert got[x["page_id"]]["n_chars"] == len(got[x["page_id"]]["text"])
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>"), (4, "u", "<script>x<p>y"), (5, "u", "<" * 3000 + "<b" * 3000), (6, "u", "<b>" * 3000 + "x")], "page_id long, url string, html string")
    out = {x["page_id"]: x for x in extract.main_text(odd.withColumn("text", F.lit(1))).collect()}
    assert out[1]["text"] == out[2]["text"] == out[4]["text"] == "" and out[1]["url"] is None


def test_blocks():
    paths = blocks.Paths()
    said = lambda h: [b.text for b in blocks.blocks(h, paths)]
    assert said("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert said("<p>a <b>b</b>&amp;c<br>d</p><!-- x --><style>y</style><script>'</p>'</script>z") == ["a b&c d", "z"]
    assert said("<head><title>t</title><p>x") == ["x"]
    assert said("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert said("<p class='a>b'>c</p>") == ["c"]


def labelled_docs(spark, n=400):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 80))]
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["idiot", "scum", "pathetic"])
        if poor:
            words = [w + r.choice(["%%%", "###"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark, docs, nothing):
    df, labels, truth = labelled_docs(spark)
    half = labels.where("doc_id < 250")
    chain = toxicity.fit(df, half, toxicity.Settings())
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score(df, chain).collect()}
    held = [(got[i], bool(t)) for i, q, t in truth if i >= 250 and q]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert toxicity.keep_civil(docs, chain).columns == docs.columns
    assert toxicity.score(docs, chain).count() == len(TEXTS) and toxicity.score(nothing, chain).count() == 0
    none = toxicity.fit(df, labels.where("false"), toxicity.Settings())
    assert toxicity.score(df, none).where("toxic").count() == 0
    one = toxicity.fit(df, labels.where("toxic = 0"), toxicity.Settings())
    assert toxicity.score(df, one).where("toxic").count() == 0


def test_quality(spark, docs, nothing):
    df, labels, truth = labelled_docs(spark)
    s = quality.Settings()
    model = quality.fit(df, labels.where("doc_id < 250"), s)
    assert (np.diff(model.thresholds) > 0).all()
    got = {x["doc_id"]: x for x in quality.score(df, model, s).collect()}
    held = [(got[i]["kept"], bool(q)) for i, q, _ in truth if i >= 250]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(x["p_ge_1"] >= x["p_ge_2"] for x in got.values())
    assert quality.score(docs, model, s).count() == len(TEXTS) and quality.score(nothing, model, s).count() == 0
    empty = quality.fit(df, labels.where("false"), s)
    assert quality.score(df, empty, s).where("not kept").count() == 0


def test_minimiser():
    a = np.diag([1.0, 10.0, 100.0])
    w = hashed.minimise(lambda w: (0.5 * float(w @ a @ w) - float(w.sum()), a @ w - 1), np.zeros(3))
    assert w == pytest.approx([1, 0.1, 0.01], abs=1e-3)


# The pipeline.


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {x["doc_id"]: x["text"] for x in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        after = {x["doc_id"]: x["text"] for x in out.collect()}
        assert set(after) <= set(before)
        if name == "quality_rules":
            assert set(after) == {d for d, t in before.items() if repetition.measure(t).kept(repetition.Rules())}
        elif name == "simhash_near_dedup":
            assert len({t for t in after.values()}) == len(after)
        elif name == "pii":
            assert set(after) == set(before) and not any(privacy.base_spans(t) for t in after.values())
        before, docs = after, spark.createDataFrame(out.collect(), out.schema)
    assert P.run(spark, sf).agg(F.countDistinct("doc_id")).first()[0] == len(before)


def test_queries_are_registered():
    from docloom.llm import queries

    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 14))
