"""Information-theoretic sanitisation: personal data, and the terms around it that give it away.

Base spans are e-mail and IP addresses, card and telephone numbers, found by
pattern. Each value is a protected entity, and so is what it shares with others:
person and domain of an address, network, issuer, beginning of a number, and the
kind; most values occur once, and terms are learnt from these groups. The words of a document outside its
mentions are terms; the corpus tells how much a term reveals of an entity. With
probabilities counted in documents, the pointwise mutual information

    PMI(e, t) = log2( p(e, t) / (p(e) p(t)) ),   p(e, t): t in a document of e,

divided by the information IC(e) = -log2 p(e) is the share of the entity's
information that the term discloses: 1 if the term never occurs without it.
Terms at ``generalise`` or more, seen with the entity in ``support`` documents at
least, are spans wherever they occur, in texts without a mention too; in
sanitised text they become a placeholder, and from ``remove`` on they go altogether.
A group is in many documents and meets rare words by chance; there the meetings
must have a log-likelihood ratio of ``evidence`` (about one in a million by chance).

Counts cover the whole corpus. Pairs are made only for entities of ``support``
documents. Document counts of terms are needed only for terms that some entity
meets ``support`` times: a bit table of fixed size screens words before they are
counted, and the exact join afterwards leaves no false ones. Pairs and terms are
aggregated before they are shuffled. Up to :data:`MOST_TERMS` disclosing terms are sent to the workers, more are joined.

Defined cases: a null text counts as empty and has no spans; rows with equal or
null ids are separate documents; a text that is nothing but a number or
has no words has base spans only; spans with one start are listed in the order of :data:`KINDS`,
and where replacements overlap the one that begins first stands; a share that equals a limit reaches it;
very long texts are scanned whole, in time linear in them, a block of rows at a time;
an empty table gives an empty result; other columns, whatever their names,
pass through :func:`sanitise` untouched.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, on_workers, parts, passes, per_batch, screen_of, uncut

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class Limits:
    """``evidence``: the log-likelihood ratio from which a term and a group of values meet by more than chance."""

    support: int = 3
    evidence: float = 24.0
    generalise: float = 0.6
    remove: float = 0.9


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += int(d) * 2 - 9 * (d > "4")
    return total % 10 == 0


def _emails(text: str):
    """As the pattern finds them from the left; in time linear in the text."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            a = at
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < at:
                end = m.end()
                yield a, end
                at = end
                continue
        at += 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of personal data, by start, then kind; ends are exclusive."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    out.sort()
    return out


def _key(s: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))).view(np.int64))


def places(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Places of the words that lie in no mention; what touches a mention is part of it."""
    covered: list[list[int]] = []  # mentions, those that touch as one
    for a, _, b, _ in spans:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    out = []
    for m in _WORD.finditer(text):
        k = bisect_left(starts, m.end()) - 1
        if k < 0 or covered[k][1] <= m.start():
            out.append(m.span())
    return out


def words_of(text: str) -> set[str]:
    """The words of a text in lower case; found first and lowered then, as in :func:`places`."""
    return {w.lower() for piece in set(text.split()) for w in ([piece] if piece.isalpha() and len(piece) > 2 else _WORD.findall(piece))}


def groups(kind: int, value: str) -> list[str]:
    """What values of one kind have in common: person and domain, network, issuer, the number's beginning; and the kind."""
    if kind == 0:
        person, _, domain = value.rpartition("@")
        out = [f"@{domain}", f"{person}@"]
    elif kind == 1:
        out = [".".join(value.split(".")[:k]) + "." for k in (2, 3)]
    elif kind == 2:
        out = [value[:6] + "*"]
    else:
        out = [value[:4] + "*", value[:-4] + "*"]
    return ["*", *out]


def entities(spans: list[tuple[int, int, int, str]]) -> tuple[set[int], set[int]]:
    """Of the values themselves, and of the groups that they are in."""
    each = {(kind, value) for _, kind, _, value in spans}
    return {_key(f"{KINDS[k]}:{v}") for k, v in each}, {_key(f"{KINDS[k]}:{g}") for k, v in each for g in groups(k, v)}


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """``es, gs, ts``: values, their groups and terms of each row that has mentions; cut off from what came before."""

    def go(batch: pa.RecordBatch) -> pa.RecordBatch:
        es, gs, ts = [], [], []
        for x in batch.column(0):
            text = x.as_py() or ""
            if spans := base_spans(text):
                values, wider = entities(spans)
                es.append(sorted(values))
                gs.append(sorted(wider))
                ts.append([_key(w) for w in {text[s:f].lower() for s, f in places(text, spans)}])
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(es, longs), pa.array(gs, longs), pa.array(ts, longs)], names=["es", "gs", "ts"])

    return cut(per_batch(docs.select("text"), go, "es array<long>, gs array<long>, ts array<long>", by=0), "privacy-scan")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``t, df``: in how many rows of ``docs`` each term of ``terms(t)`` occurs."""
    spark = docs.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(screen_of(terms, "t"))

    def go(batches):
        bits = np.frombuffer(sent.value, np.int64)
        for batch in (part for whole in batches for part in parts(whole, 0)):
            out = []
            for x in batch.column(0):
                words = words_of(x.as_py() or "")
                if not words:
                    continue
                h = _hashes(list(words))
                out.append(h[passes(bits, h)])
            if out:
                # One row for each term and batch.
                t, n = np.unique(np.concatenate(out), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["t", "n"])

    return docs.select("text").mapInArrow(go, "t long, n long").groupBy("t").agg(F.sum("n").alias("df")).join(terms, "t", "left_semi")


def disclosures(docs: DataFrame, limits: Limits) -> DataFrame:
    """``e, t, share``: pairs whose term discloses that share of the entity, ``generalise`` or more."""
    scanned = scan(docs)
    named = F.explode(F.concat(F.transform("es", lambda e: F.struct(e.alias("e"), F.lit(False).alias("wide"))), F.transform("gs", lambda e: F.struct(e.alias("e"), F.lit(True).alias("wide"))))).alias("x")
    met_in = cut(scanned.select(named).groupBy("x.e", "x.wide").agg(F.count("*").alias("df_e")).where(F.col("df_e") >= limits.support), "privacy-entities")
    # Entities of too few documents have no term; they are left out before any pair is made.
    each = scanned.select(F.explode(F.concat("es", "gs")).alias("e"), "ts").join(met_in.select("e"), "e")
    met = cut(each.select("e", F.explode("ts").alias("t")).groupBy("e", "t").agg(F.count("*").alias("both")).where(F.col("both") >= limits.support), "privacy-pairs")
    df_t = term_counts(docs, met.select("t").distinct())
    n = docs.count()
    pmi = F.log2(F.col("both") * F.lit(float(max(n, 1))) / (F.col("df_e") * F.col("df")))
    # An entity of every document has no information to disclose.
    share = F.when(F.col("df_e") < n, pmi / -F.log2(F.col("df_e") / F.lit(float(max(n, 1))))).otherwise(0.0)
    # How far a group and a term are from independent: twice the log of the likelihood ratio of their meetings.
    chance = F.col("df_e") * F.col("df") / F.lit(float(max(n, 1)))
    sure = 2 * (F.col("both") * F.log(F.col("both") / chance) - F.col("both") + chance) >= limits.evidence
    told = met.join(df_t, "t").join(met_in, "e").where(~F.col("wide") | sure).select("e", "t", share.alias("share"))
    out = cut(told.where(F.col("share") >= limits.generalise), "privacy-terms")
    uncut(scanned, met_in, met)
    return out


#: Terms that are sent to all workers, at most; counted before.
MOST_TERMS = 1_000_000
NONE = np.empty(0, np.int64), np.empty(0, np.float64)


def _marked(rows: DataFrame, docs: DataFrame, limits: Limits, f, schema, most: int) -> DataFrame:
    """``f(batch, told)`` over blocks of ``rows``, which have a column ``text``; ``told(i)`` gives the terms of row ``i``, ascending, and the most that each discloses.

    Up to ``most`` terms are sent to the workers, the same for all rows. More are joined to the words of each text; then texts are shuffled.
    """
    got = disclosures(docs, limits)
    terms, text = got.groupBy("t").agg(F.max("share").alias("share")), rows.columns.index("text")
    if terms.limit(most + 1).count() <= most:
        t = terms.toArrow().sort_by("t")  # at most ``most`` rows
        uncut(got)
        sent = rows.sparkSession.sparkContext.broadcast((t.column("t").to_numpy(), t.column("share").to_numpy()))
        return per_batch(rows, lambda batch: f(batch, lambda i: sent.value), schema, by=text)
    numbered = cut(rows.withColumn("told_row", F.monotonically_increasing_id()), "privacy-rows")
    screen = rows.sparkSession.sparkContext.broadcast(screen_of(terms, "t"))

    def said(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, at, found = np.frombuffer(screen.value, np.int64), [], []
        for row, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = _hashes(list(words_of(x.as_py() or "")))
            h = h[passes(bits, h)]
            at.append(np.full(len(h), row))
            found.append(h)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(found))], names=["told_row", "t"])

    met = per_batch(numbered.select("told_row", "text"), said, "told_row long, t long", by=1).join(terms, "t")
    told = met.groupBy("told_row").agg(F.sort_array(F.collect_list(F.struct("t", "share"))).alias("told"))  # the different words of a text at most
    joined = numbered.join(told, "told_row", "left").select(*rows.columns, F.col("told.t").alias("told_t"), F.col("told.share").alias("told_share"))
    n = len(rows.columns)

    def own(batch: pa.RecordBatch):
        t, share = batch.column(n), batch.column(n + 1)
        return lambda i: (t[i].values.to_numpy(), share[i].values.to_numpy()) if t[i].is_valid else NONE

    return per_batch(joined, lambda batch: f(batch, own(batch)), schema, by=text)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)).view(np.int64)


def term_places(text: str, spans: list[tuple[int, int, int, str]], t: np.ndarray, share: np.ndarray) -> list[tuple[int, int, float]]:
    """``(start, end, share)`` of every occurrence of the terms ``t`` outside mentions."""
    words = words_of(text) if len(t) else ()
    if not words:
        return []
    words = list(words)
    h = _hashes(words)
    at = np.minimum(np.searchsorted(t, h), len(t) - 1)
    said = {words[i]: float(share[at[i]]) for i in np.nonzero(t[at] == h)[0]}
    if not said:
        return []
    return [(s, f, said[w]) for s, f in places(text, spans) if (w := text[s:f].lower()) in said]


def private_spans(docs: DataFrame, limits: Limits | None = None, most: int = MOST_TERMS) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: counts, a digest of the base spans, and all spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_term"]

    def go(batch: pa.RecordBatch, told) -> pa.RecordBatch:
        rows = []
        for i, x in enumerate(batch.column(1)):
            text = x.as_py() or ""
            spans = base_spans(text)
            base = [s[:3] for s in spans]
            terms = term_places(text, spans, *told(i))
            count = [0] * 4
            for s in spans:
                count[s[1]] += 1
            rows.append((*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + [(s, 4, f) for s, f, _ in terms]), len(terms)))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS[:4]) + "base_sha256 string, spans string, n_term long"
    return _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs, limits or Limits(), go, schema, most)


def sanitised(text: str, spans: list[tuple[int, int, int, str]], terms: list[tuple[int, int, float]], limits: Limits) -> str:
    """The text with its spans replaced: personal data by its kind, terms by a placeholder or by nothing."""
    edits = [(s, f, f"[{KINDS[kind].upper()}]") for s, kind, f, _ in spans]
    edits += [(s, f, "" if share >= limits.remove else "[TERM]") for s, f, share in terms]
    out, at = [], 0
    for s, f, new in sorted(edits):
        if s >= at:
            out += (text[at:s], new)
        at = max(at, f)
    out.append(text[at:])
    return "".join(out)


def sanitise(docs: DataFrame, limits: Limits | None = None, most: int = MOST_TERMS) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of ``text``; ``n_chars``, if there, follows."""
    limits = limits or Limits()
    names = docs.columns

    def go(batch: pa.RecordBatch, told) -> pa.RecordBatch:
        new = []
        for i, x in enumerate(batch.column(0)):
            text = x.as_py() or ""
            spans = base_spans(text)
            terms = term_places(text, spans, *told(i))
            new.append(sanitised(text, spans, terms, limits) if spans or terms else x.as_py())
        cols = dict(zip(names, batch.column(1).flatten(), strict=True))
        if "n_chars" in cols:
            kind = cols["n_chars"].type
            cols["n_chars"] = pa.array([None if x is None else len(x) for x in new], kind)
        cols["text"] = pa.array(new, cols["text"].type)
        return pa.RecordBatch.from_arrays([cols[k] for k in names], names=names)

    return _marked(docs.select("text", F.struct("*").alias("doc")), docs, limits, go, docs.schema, most)
