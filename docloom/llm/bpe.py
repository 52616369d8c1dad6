"""Byte-level BPE over Arrow batches with the ``tokenizers`` library.

A byte-level vocabulary spells bytes as printable characters (the byte table).
Ranks of the ``tiktoken`` kind are turned into such a vocabulary and its merges;
each match of the pattern is then encoded separately.

Both vocabularies here split texts by a pattern that no match can cross a single
space with, where the characters on both sides are not white space: the space
opens a new match. :class:`Encoder` cuts texts there and hands each different
piece to the library once, keeping ids of pieces in a bounded memory. The ids
are those of the whole text; only the work is less.

Defined cases: null counts as the empty text, which has no ids. A special token of
the file that stands in a text is its id, as the library's plain call gives it;
vocabularies made of ranks have none, there it is ordinary text. Rows that repeat an id are
encoded one by one. Texts of any length are encoded whole, in blocks of rows; a text longer
than a block is a block of its own. An empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from docloom.llm.common import BLOCK_BYTES, on_workers, parts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A vocabulary file is read by the driver and sent to the executors; it may not be larger.
MOST_VOCABULARY_BYTES = 64 << 20


# The byte table.


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_chars())}


def spelled(raw: bytes) -> str:
    table = byte_chars()
    return "".join(table[b] for b in raw)


def raw_of(token: str) -> bytes:
    table = char_bytes()
    return bytes(table[c] for c in token)


# Tokenizers.


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that merge into this one last, as merging by rank goes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    most = ranks[token]
    while len(parts) > 2:
        rank, at = min(((ranks.get(a + b, most), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(most, 0))
        if rank >= most:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def json_of_ranks(lines: bytes, pattern: str) -> str:
    """A ``tokenizers`` file for ranks given as lines of base64 and number."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        if halves := _halves(token, ranks):
            merges.append([spelled(halves[0]), spelled(halves[1])])
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
            "post_processor": None,
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {spelled(t): r for t, r in ranks.items()}, "merges": merges},
        }
    )


@lru_cache(4)
def load(path: str, pattern: str | None = None) -> str:
    """The tokenizer in ``path`` as JSON; files of ranks need the pattern."""
    if os.path.getsize(path) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    with open(path, "rb") as f:
        data = f.read()
    return json_of_ranks(data, pattern) if pattern else data.decode()


# Encoding.

_CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Ids of texts.

    ``memo`` pieces are remembered at most, of ``memo_chars`` characters in all; when
    there are more, those that have not come twice since are forgotten.
    """

    def __init__(self, spec: str, memo: int = 600_000, memo_chars: int = 12 << 20):
        self.tokenizer = Tokenizer.from_str(spec)
        self.memo, self.memo_chars = memo, memo_chars
        self._forget()

    def _forget(self) -> None:
        self.after_space: dict[str, int] = {}  # piece without the space before it
        self.as_is: dict[str, int] = {}
        self.marks: dict[str, int] = {}  # of marks that often end a word
        self.chars = 0
        self.pool = np.empty(0, np.uint32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)
        self.size = 0  # pieces numbered so far
        self.new: list[str] = []
        self.new_at: list[int] = []
        self.joined: list[tuple[int, int, int]] = []  # a piece that is two pieces in a row
        self.marks = {c: self._learn(c, self.as_is, c) for c in ",."}

    def _shrink(self) -> None:
        """Forget the pieces that have not come twice, or all if that frees little."""
        keep = self.uses > 1
        keep[list(self.marks.values())] = True
        if keep.sum() > 0.7 * len(keep):
            self._forget()
            return
        number = np.cumsum(keep) - 1
        kept = np.nonzero(keep)[0]
        pool, length = self._gather(kept), self.length[kept]
        self.start, self.length, self.pool, self.size = np.cumsum(length) - length, length, pool, len(kept)
        self.uses = np.zeros(len(kept), np.int64)
        numbers, stays = number.tolist(), keep.tolist()
        self.after_space = {k: numbers[i] for k, i in self.after_space.items() if stays[i]}
        self.as_is = {k: numbers[i] for k, i in self.as_is.items() if stays[i]}
        self.marks = {c: self.as_is[c] for c in self.marks}
        self.chars = sum(map(len, self.after_space)) + sum(map(len, self.as_is))
        if self.chars > self.memo_chars // 2:
            self._forget()

    def _learn(self, piece: str, memory: dict[str, int], key: str) -> int:
        n = memory[key] = self.size
        self.size += 1
        self.chars += len(piece)
        mark = self.marks.get(piece[-1])
        if mark is not None and memory is self.after_space and len(piece) > 2 and "a" <= piece[-2] <= "z":
            # The mark is a match of its own after a letter.
            base = memory.get(key[:-1])
            if base is None:
                base = self._learn(piece[:-1], memory, key[:-1])
            self.joined.append((n, base, mark))
        else:
            self.new.append(piece)
            self.new_at.append(n)
        return n

    def _after_space(self, p: str) -> int | None:
        """The number of a new piece that follows a space, or a new line of its own; None if its ends are white space."""
        if not p or p[-1].isspace():
            return None
        if p[0] == "\n":
            return None if p[1].isspace() else self._learn(p, self.after_space, p)
        if p[0].isspace():
            return None
        return self._learn(" " + p, self.after_space, p)

    def _pieces(self, text: str) -> list[int]:
        """Numbers of the pieces that the text is cut into."""
        if not text:
            return []
        # A line break between two words is a match of its own; it goes with the word after it.
        first, *rest = text.replace("\n", " \n").split(" ")
        plain = bool(first) and not first[-1].isspace()
        if plain:
            found = list(map(self.after_space.get, rest))
            if None in found:
                for i, n in enumerate(found):
                    if n is None:
                        n = self.after_space.get(rest[i])
                        if n is None:
                            n = self._after_space(rest[i])
                            if n is None:
                                plain = False
                                break
                        found[i] = n
        if plain:
            head = self.as_is.get(first)
            return [self._learn(first, self.as_is, first) if head is None else head, *found]
        out = []
        for p in _CUT.split(text):
            n = self.as_is.get(p)
            out.append(self._learn(p, self.as_is, p) if n is None else n)
        return out

    def _encode_new(self) -> None:
        if self.size == len(self.start):
            return
        grown = np.zeros(self.size - len(self.start), np.int64)
        self.start, self.length = np.concatenate([self.start, grown]), np.concatenate([self.length, grown])
        if self.new:
            self._store(np.array(self.new_at), *self._library(self.new))
        if self.joined:
            n, *parts = np.array(self.joined).T
            at = np.stack(parts, axis=1).reshape(-1)
            self._store(n, self._gather(at), self.length[at].reshape(-1, 2).sum(axis=1))
        self.new, self.new_at, self.joined = [], [], []

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and the number of ids of each."""
        e = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(pieces))

    def _store(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start[at] = np.cumsum(counts) - counts + len(self.pool)
        self.length[at] = counts
        self.pool = np.concatenate([self.pool, ids])

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of pieces, one after the other."""
        length = self.length[at]
        ends = np.cumsum(length)
        return self.pool[np.repeat(self.start[at] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if len(self.start) > self.memo or self.chars > self.memo_chars:
            self._shrink()
        pieces = [self._pieces(t) for t in texts]
        self._encode_new()
        at = np.array(list(chain.from_iterable(pieces)), np.int64)
        self.uses = np.concatenate([self.uses, np.zeros(self.size - len(self.uses), np.int64)])
        self.uses += np.bincount(at, minlength=self.size)
        ids, ends = self._gather(at), np.cumsum(self.length[at])
        upto = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        tokens = np.diff(np.r_[0, np.r_[0, ends][upto]])
        return ids, tokens


@lru_cache(2)
def encoder(spec: str, memo: int = 600_000) -> Encoder:
    return Encoder(spec, memo, 20 * memo)


# Decoding.


@lru_cache(2)
def token_bytes(spec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after the other, and the start and length of each id's, by the reversed byte table."""
    j = json.loads(spec)
    vocab = j["model"]["vocab"]
    special = {a["id"]: a["content"].encode() for a in j["added_tokens"]}
    raw = [b""] * (max([*vocab.values(), *special]) + 1)
    for token, i in vocab.items():
        raw[i] = raw_of(token)
    for i, said in special.items():
        raw[i] = said
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length


def decode(spec: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for, and where the bytes of each id end."""
    pool, start, length = token_bytes(spec)
    n = length[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start[ids] - (ends - n), n) + np.arange(total)], ends


def char_offsets(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id: the first character it has bytes of, one past the last, and whether it ends inside a character."""
    first = (raw & 0xC0) != 0x80
    before = np.r_[0, np.cumsum(first)]  # characters begun before each byte
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    inside = np.r_[~first, False]
    return before[starts] - inside[starts], before[ends], inside[ends]


class TextDecoder:
    """Text of ids that come bit by bit; a character whose bytes are split over ids comes with the last of them."""

    def __init__(self, spec: str):
        self.spec, self.held = spec, b""

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        raw = self.held + decode(self.spec, np.asarray(ids, np.int64))[0].tobytes()
        cut = len(raw)
        if not last:
            for k in range(1, min(4, len(raw) + 1)):
                b = raw[-k]
                if b & 0xC0 == 0x80:
                    continue
                if b >= 0xC0 and (0xC0 <= b < 0xE0) * 2 + (0xE0 <= b < 0xF0) * 3 + (b >= 0xF0) * 4 > k:
                    cut = len(raw) - k
                break
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")


# Over tables.


def text_blocks(batches, most: int = BLOCK_BYTES):
    """``(id array, texts)`` of rows ``(id, text)`` whose texts add up to about ``most`` bytes."""
    for batch in batches:
        for part in parts(batch, 1, most):
            yield part.column(0), [x or "" for x in part.column(1).to_pylist()]


def _encoded(batches, spec: str, encoder_of):
    """For each block of texts: ``(doc ids, ids, raw bytes, where each id's bytes end, ids before each text, bytes before each text)``."""
    enc = encoder_of(spec)
    for doc_id, texts in text_blocks(batches):
        ids, tokens = enc.encode(texts)
        raw, ends = decode(spec, ids)
        upto = np.r_[0, np.cumsum(tokens)]
        yield doc_id, ids, raw, ends, upto, np.r_[0, ends][upto]


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary, byte_ends binary, char_spans binary, split_tokens long"


def encode_decode(docs: DataFrame, spec: str, offsets: bool = False, encoder_of=encoder) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: its ids and, decoded from them, its bytes.

    ``ids`` are little-endian unsigned 32-bit integers. With ``offsets`` (else null), ``byte_ends`` holds where each
    id's bytes end in the text, ``char_spans`` the first character that each id has bytes of and one past its last, as
    little-endian 64-bit integers; ``split_tokens`` counts ids that end inside a character. No shuffle.
    """
    sent = _sent(docs, spec)

    def go(batches):
        for doc_id, ids, raw, ends, upto, at in _encoded(batches, sent.value, encoder_of):
            first, last, split = char_offsets(raw, ends)
            out = [[], [], [], []]
            for a, b, p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[0].append(ids[a:b].astype("<u4").tobytes())
                out[1].append(raw[p:q].tobytes())
                out[2].append((ends[a:b] - p).astype("<i8").tobytes() if offsets else None)
                out[3].append(_spans(first, last, a, b).tobytes() if offsets else None)
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(upto)), *(pa.array(x, pa.binary()) for x in out), pa.array(_in_each(split, upto))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(go, SCHEMA)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, char_spans_sha256 string, split_tokens long"


def digests(docs: DataFrame, spec: str, encoder_of=encoder) -> DataFrame:
    """What :func:`encode_decode` gives, as SHA-256 of ids, decoded bytes and character spans; worked out where the ids are."""
    sent = _sent(docs, spec)

    def go(batches):
        for doc_id, ids, raw, ends, upto, at in _encoded(batches, sent.value, encoder_of):
            first, last, split = char_offsets(raw, ends)
            ids, out = ids.astype("<u4"), [[], [], []]
            for a, b, p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for to, what in zip(out, (ids[a:b], raw[p:q], _spans(first, last, a, b)), strict=True):
                    to.append(hashlib.sha256(what).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(upto)), *(pa.array(x, pa.string()) for x in out), pa.array(_in_each(split, upto))], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(go, DIGESTS)


def _sent(docs: DataFrame, spec: str):
    on_workers(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary: its size is checked when it is read


def _spans(first: np.ndarray, last: np.ndarray, a: int, b: int) -> np.ndarray:
    """Character spans of the ids ``a`` to ``b`` of one text, from its own first character on."""
    return np.ascontiguousarray(np.stack([first[a:b], last[a:b]], axis=1) - (first[a] if a < b else 0)).astype("<i8")


def _in_each(flags: np.ndarray, upto: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][upto])
