"""Byte-level BPE by dynamic programming over prefixes, without merging.

An automaton over the vocabulary is in the state of the longest suffix of what it has read that begins a token, and gives
the tokens that end there. Of these exactly one is the last token of the encoding of the prefix: the one that, put after the
last token of the prefix before it, stays two tokens when merges are done by rank. Whether two tokens stay two is told by
undoing their merges, latest first, and looking at every moment whether the two pieces at the border would have merged by then. The last tokens of all
prefixes are kept; following them back from the end gives the ids.

This holds for vocabularies in which each token is made by one merge; :func:`spec_of` refuses others. Texts are cut by the file's own rules first: special tokens, then the
pattern of byte-level vocabularies; characters outside :data:`KNOWN` are classified by the library's own splitter, so that editions of Unicode don't matter.
Different pieces between spaces are encoded once and remembered in bounded memory (:class:`docloom.llm.bpe.Encoder`).

Defined cases are those of :mod:`docloom.llm.bpe`: null counts as empty; a special token that stands in a text is its id; a match of any length is
encoded whole, in memory of a few bytes for each of its bytes; rows that repeat an id are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from docloom.llm import bpe

#: The pattern of byte-level vocabularies with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are the same in all editions of Unicode that matter: Latin, Greek, Cyrillic, general punctuation, currency.
KNOWN = r"\x00-\x7F\xA0-ɏΑ-ΡΣ-ώА-я‐-‧‰-⁞₠-€"
#: Answers of pair tests and encodings of matches that are remembered; forgotten all at once beyond this.
MOST_PAIRS, MOST_MATCHES, MOST_MATCH = 1 << 20, 100_000, 64


def spec_of(path: str) -> str:
    """The tokenizer file's JSON, if its model and rules are those that this module encodes."""
    spec = bpe.load(path)
    j = json.loads(spec)
    m, split = j["model"], j["pre_tokenizer"] or {}
    plain = m["type"] == "BPE" and not any(m.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or j["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        raise ValueError("not a plain byte-level BPE file")
    if any(a[x] for a in j["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
        raise ValueError("special tokens that take what stands beside them are not known here")
    return spec


class Tokens:
    """A vocabulary's merges, as they are made and undone, and the automaton of its tokens."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.vocab = vocab
        self.rank = [-1] * (max(vocab.values()) + 1)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.rank)
        self.made: dict[tuple[int, int], int] = {}  # rank by the two tokens
        for r, (x, y) in enumerate(merges):
            token = vocab[x + y]
            if self.halves[token]:
                raise ValueError("a token is made by two merges")
            self.rank[token], self.halves[token], self.made[vocab[x], vocab[y]] = r, (vocab[x], vocab[y]), r
        self.length = [0] * len(self.rank)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            raw = bpe.raw_of(token)
            self.length[i] = len(raw)
            if len(raw) == 1 or self.halves[i] and self._stays(*self.halves[i], self.rank[i]):
                self.automaton.add_word(raw.decode("latin-1"), i)  # a token that no encoding ends in would never be chosen: it is left out
        self.automaton.make_automaton()

    def _stays(self, x: int, y: int, until: float = float("inf")) -> bool:
        """Whether ``x`` and ``y`` beside each other merge at no rank below ``until``.

        The pieces at the border, ``x`` and ``y``, are both there from the later of their ranks on until one of them is used up, at ``until``.
        A right half is used up together with what stands to its left, which comes first among equal merges; a left half
        with what stands to its right, which comes last.
        """
        rank, halves, made = self.rank, self.halves, self.made
        while True:
            r = made.get((x, y))
            if r is not None and r < until:
                return False
            if halves[x] is None and halves[y] is None:
                return True
            if rank[x] > rank[y]:
                until, x = rank[x], halves[x][1]
            else:  # of two equal tokens the right one is made last
                until, y = rank[y] + 1, halves[y][0]

    def encode(self, raw: bytes) -> list[int]:
        """Ids of the bytes of a match."""
        length, pairs = self.length, self.pairs
        last = array("i", bytes(4 * (len(raw) + 1)))  # of each prefix; one more than the id, 0 where not yet known
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            if last[end + 1]:
                continue
            start = end + 1 - length[token]
            if start:
                before = last[start] - 1
                key = before << 32 | token
                stays = pairs.get(key)
                if stays is None:
                    if len(pairs) >= MOST_PAIRS:
                        pairs.clear()
                    stays = pairs[key] = self._stays(before, token)
                if not stays:
                    continue
            last[end + 1] = token + 1
        out, at = [], len(raw)
        while at:
            out.append(last[at] - 1)
            at -= length[out[-1]]
        return out[::-1]


@lru_cache(2)
def tokens(spec: str) -> Tokens:
    return Tokens(spec)


class PrefixEncoder(bpe.Encoder):
    """An encoder whose pieces are encoded by :class:`Tokens`; the library only gives the classes of rare characters."""

    def __init__(self, spec: str, memo: int = 600_000, memo_chars: int = 12 << 20):
        self.tokens, self.matches = tokens(spec), {}
        self.special = {a["content"]: a["id"] for a in json.loads(spec)["added_tokens"]}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern, self.known = regex.compile(PATTERN), regex.compile(f"[{KNOWN}]*+")
        super().__init__(spec, memo, memo_chars)

    def _matches(self, text: str) -> list[bytes]:
        if self.known.fullmatch(text):
            return [m.encode() for m in self.pattern.findall(text)]
        return [bpe.raw_of(m) for m, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _of_match(self, raw: bytes) -> list[int]:
        if len(raw) > MOST_MATCH:
            return self.tokens.encode(raw)
        ids = self.matches.get(raw)
        if ids is None:
            if len(self.matches) >= MOST_MATCHES:
                self.matches.clear()
            ids = self.matches[raw] = self.tokens.encode(raw)
        return ids

    def ids_of(self, piece: str) -> list[int]:
        if self.cuts and self.cuts.search(piece):
            out = []
            for part in self.cuts.split(piece):
                out += [self.special[part]] if part in self.special else self.ids_of(part) if part else []
            return out
        out = []
        for raw in self._matches(piece):
            out += self._of_match(raw)
        return out

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.ids_of(p) for p in pieces]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts


@lru_cache(2)
def encoder(spec: str, memo: int = 600_000) -> PrefixEncoder:
    return PrefixEncoder(spec, memo, 20 * memo)


def encode_decode(docs: DataFrame, spec: str) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: its ids and what they decode to; the columns of :func:`docloom.llm.bpe.encode_decode`. No shuffle."""
    return bpe.encode_decode(docs, spec, encoder_of=encoder)


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """The columns of :func:`docloom.llm.bpe.digests`."""
    return bpe.digests(docs, spec, encoder_of=encoder)
