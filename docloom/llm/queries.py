"""The queries of this subpackage: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import audio, audit, bpe, extract, negatives, packing, prefix_bpe, privacy, quality, repetition, simhash, toxicity, warc
from docloom.llm.common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.Settings()))


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32(hex_digest: str) -> str:
    """SQL for the base32 form of 40 hexadecimal digits: five of them are four characters."""
    parts = []
    for k in range(8):
        v = f"('0x' || substr({hex_digest}, {5 * k + 1}, 5))::INT"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


OP3_SQL = (
    "WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages), g AS (SELECT x, max(page_id) AS m FROM d GROUP BY x) "
    f"SELECT page_id, payload_bytes, {_base32('x')} AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM d JOIN g USING (x)"
)


def op4_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.private_spans(table(spark, sf_dir, "documents"))


def _op4_sql(limits: privacy.Limits) -> str:
    """Matches with their places, from the pieces between them; then entities, terms and counts in documents."""

    def found(kind: int, pattern: str) -> str:
        return f"SELECT r, {kind} AS kind, unnest(regexp_split_to_array(t, '{pattern}')) AS before, unnest(list_append(regexp_extract_all(t, '{pattern}'), NULL)) AS said, generate_subscripts(regexp_split_to_array(t, '{pattern}'), 1) AS i FROM d WHERE regexp_matches(t, '{pattern}')"

    def placed(source: str) -> str:
        upto = "OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND"
        start = f"(sum(length(before)) {upto} CURRENT ROW) + coalesce(sum(length(said)) {upto} 1 PRECEDING), 0))::BIGINT"
        return f"SELECT r, kind, said, s, s + length(said) AS f FROM (SELECT r, kind, said, {start} AS s FROM ({source})) WHERE said IS NOT NULL"

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]")
    luhn = "list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN v[i]::INT WHEN v[i]::INT > 4 THEN v[i]::INT * 2 - 9 ELSE v[i]::INT * 2 END)) % 10 = 0"
    holds = f"CASE kind WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(said, '.'), lambda x: length(ltrim(x, '0')) > 3 OR right(x, 4)::INT > 255)) = 0 WHEN 2 THEN length(v) BETWEEN 12 AND 19 AND {luhn} ELSE length(v) BETWEEN 9 AND 15 END"
    value = "CASE kind WHEN 0 THEN lower(said) WHEN 1 THEN said ELSE regexp_replace(said, '[^0-9]', '', 'g') END"
    groups = (
        "CASE kind WHEN 0 THEN ['*', '@' || string_split(v, '@')[-1], left(v, -length(string_split(v, '@')[-1]))] WHEN 1 THEN ['*', array_to_string(string_split(v, '.')[1:2], '.') || '.', array_to_string(string_split(v, '.')[1:3], '.') || '.'] "
        "WHEN 2 THEN ['*', v[1:6] || '*'] ELSE ['*', v[1:4] || '*', left(v, -4) || '*'] END"
    )
    word = r"[\p{L}\p{Nl}\p{No}]{3,}"
    pmi = "log2(b.n * total / (e.n * c.n))"
    chance = "e.n * c.n / total"
    listed = "string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || f, ',' ORDER BY s, kind, f)"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT count(*)::DOUBLE AS total FROM d), m AS ({placed(' UNION ALL '.join(found(k, p) for k, p in enumerate(patterns)))}), "
        f"base AS (SELECT r, kind, s, f, v FROM (SELECT *, {value} AS v FROM m) WHERE {holds}), "
        f"w AS (SELECT r, lower(said) AS term, s, f FROM ({placed(found(4, word))})), "
        "o AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.f AND w.s < b.f)), "
        f"x AS (SELECT DISTINCT r, kind, false AS wide, v AS e FROM base UNION SELECT DISTINCT r, kind, true, unnest({groups}) FROM base), "
        f"e AS (SELECT kind, wide, e, count(*) AS n FROM x GROUP BY ALL HAVING count(*) >= {limits.support}), ts AS (SELECT DISTINCT r, term FROM o WHERE r IN (SELECT r FROM base)), "
        f"b AS (SELECT kind, wide, e, term, count(*) AS n FROM x JOIN e USING (kind, wide, e) JOIN ts USING (r) GROUP BY ALL HAVING count(*) >= {limits.support}), c AS (SELECT term, count(DISTINCT r) AS n FROM w GROUP BY 1), "
        f"told AS (SELECT DISTINCT term FROM b JOIN e USING (kind, wide, e) JOIN c USING (term), n WHERE e.n < total AND {pmi} / -log2(e.n / total) >= {limits.generalise} AND (NOT wide OR 2 * (b.n * ln(b.n / ({chance})) - b.n + {chance}) >= {limits.evidence})), "
        "every AS (SELECT r, kind, s, f FROM base UNION ALL SELECT r, 4, s, f FROM o WHERE term IN (SELECT term FROM told)), "
        f"a AS (SELECT r, {', '.join(f'count(*) FILTER (WHERE kind = {k}) AS n{k}' for k in range(5))}, {listed} AS spans, coalesce({listed} FILTER (WHERE kind < 4), '') AS base FROM every GROUP BY r) "
        "SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n4, 0) AS n_term FROM d LEFT JOIN a USING (r)"
    )


def op5_tier_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    spec = bpe.load(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), spec))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.features(audio.store(table(spark, sf_dir, "documents"))))


def op8_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def _op8_sql(rules: repetition.Rules) -> str:
    """Words one by one, n-grams by the words after each, and what lies inside those that occur twice."""
    lengths = sorted(rules.ngram_chars)
    after = ", ".join(f"lead(word, {k}) OVER q AS w{k}" for k in range(1, lengths[-1]))
    gram = lambda n: " || ' ' || ".join(["word", *(f"w{k}" for k in range(1, n))])
    twice = ", ".join(f"({gram(n)}) IS NOT NULL AND count(*) OVER (PARTITION BY r, {gram(n)}) > 1 AS g{n}" for n in lengths)
    inside = ", ".join(f"bool_or(g{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in lengths)
    sums = ", ".join(f"coalesce(sum(length(word)) FILTER (WHERE in{n}), 0) AS c{n}" for n in lengths)
    share = lambda c: f"CASE WHEN word_chars = 0 THEN 0.0::DOUBLE ELSE {c}::DOUBLE / word_chars END"
    space = r"[^ \t\n\x0B\f\r]"
    verdict = " OR ".join([f"{share('dup_chars')} > {rules.line_chars}", f"n_symbols > {rules.symbol_words} * n_words", *(f"{share(f'c{n}')} > {most}" for n, most in rules.ngram_chars.items())])
    failed = f"n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT r, regexp_extract_all(t, '{space}+') AS w FROM d), "
        f"u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w), a AS (SELECT *, {after} FROM u WINDOW q AS (PARTITION BY r ORDER BY i)), g AS (SELECT r, i, word, {twice} FROM a), n AS (SELECT r, word, {inside} FROM g), "
        f"s AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE in5) AS n_repeat_words, {sums} FROM n GROUP BY r), "
        f"x AS (SELECT r, line, count(*) - 1 AS again, length(regexp_replace(line, '[ \t\x0B\f\r]', '', 'g')) AS chars FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{space}') GROUP BY r, line), "
        "y AS (SELECT r, sum(again) AS n_dup_lines, sum(again * chars) AS dup_chars FROM x GROUP BY r), "
        "z AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, "
        f"coalesce(dup_chars, 0) AS dup_chars, {', '.join(f'coalesce(c{n}, 0) AS c{n}' for n in lengths)} FROM d LEFT JOIN s USING (r) LEFT JOIN y USING (r)) "
        f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT ({failed} OR {verdict}) AS kept, {share('dup_chars')} AS dup_line_share, {share('c5')} AS dup_5gram_share, {share('c10')} AS dup_10gram_share FROM z"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    spec = bpe.load(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), spec)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), quality.Settings()
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), settings), settings)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) label", "embedding vector", "vec_id % 100 = 0 anchor")
    return negatives.mine(rows)


def _op11_sql(s: negatives.Settings) -> str:
    return (
        "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, "
        f"list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "a AS (SELECT row_number() OVER () AS n, * FROM v WHERE vec_id % 100 = 0), "
        "s AS (SELECT a.n, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM a JOIN v b ON len(a.v) = len(b.v)), "
        f"p AS (SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS j FROM s WHERE same AND vec_id <> anchor_id QUALIFY j <= {s.positives}), "
        "r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, (row_number() OVER (PARTITION BY p.n, j ORDER BY s.score DESC, s.vec_id))::INT AS rank "
        f"FROM p JOIN s ON s.n = p.n AND NOT same AND {s.low} * positive_score <= 100 * s.score AND 100 * s.score <= {s.high} * positive_score) "
        f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= {s.negatives}"
    )


def op12_prefix_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    spec = prefix_bpe.spec_of(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return prefix_bpe.digests(table(spark, sf_dir, "documents"), spec)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op13_sql() -> str:
    """Every order one by one: the first filter of the order that a document fails removes it."""
    values = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
    fails = lambda f: f"CASE {f} WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"
    earlier = " OR ".join(f"(step > {k} AND {fails(f'o[{k}]')})" for k in range(1, 5))
    some = lambda where, what="n": f"coalesce(sum({what}) FILTER (WHERE {where}), 0)::BIGINT"
    here = f"({fails('f')}) AND NOT ({earlier})"
    return (
        "WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents), "
        "x AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w), "
        "l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1), "
        "g AS (SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL), "
        f"s AS (SELECT o, step, o[step] AS f FROM (VALUES {values}) AS v(o), range(1, 6) AS r(step)), "
        f"y AS (SELECT part, o AS filter_order, step::INT AS step, f, {some(f'NOT ({earlier}) AND NOT ({fails("f")})')} AS kept, {some(here)} AS removed, {some(f'({fails("f")}) AND ({earlier})')} AS redundant, "
        f"{some(f'({fails("f")}) AND a::INT + b::INT + c::INT + d::INT + e::INT = 1')} AS unique_fails, {some(here, 'good')} AS good_lost, {some(here, 'toxic')} AS toxic_lost FROM g, s GROUP BY ALL) "
        "SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_toxicity_chain, op3_warc_normaliser, op4_disclosure_spans, op5_tier_packing, op6_golay_simhash, op7_audio_features, op8_repetition_coverage, op9_byte_bpe, op10_ordinal_quality, op11_hard_negatives, op12_prefix_bpe, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    """The others need models, tokenizers, hashes or filters that SQL lacks."""
    return {"op3_warc_normaliser": OP3_SQL, "op4_disclosure_spans": _op4_sql(privacy.Limits()), "op8_repetition_coverage": _op8_sql(repetition.Rules()), "op11_hard_negatives": _op11_sql(negatives.Settings()), "op13_filter_audit": _op13_sql()}
