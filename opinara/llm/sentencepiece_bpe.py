"""SentencePiece encoding and decoding by a merge-type prefix table.

BPE of the merge type has this property: the encoding of each prefix of a string ends in one token, and an
encoding is right exactly if each two neighbours in it are compatible, that is, encode to themselves when
joined. So one table is enough: for each end position, the last token of that prefix's encoding. An
automaton reports the vocabulary's tokens that end there; of these, longest first, the one is taken that is
compatible with the last token of the prefix before it. The ids are recovered backwards from the end.

Two tokens are compatible if no merge across their border would come before the merges that make
them: the pair is walked down the tokens' own merge trees, comparing ranks; ties go to the left.

The model's piece file is read here directly (its few fields of protocol-buffer wire format). Text gets a space in
front and spaces become U+2581. Characters without a piece become byte tokens. No piece but runs of U+2581
has that sign after another character, so no merge crosses a word's start and words are encoded one by one,
with a bounded cache. This holds for models with identity normalisation, dummy prefix and kept spaces; others
are refused.

Null counts as empty and has no ids. Repeated rows get equal results; columns beyond id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text

MARK = "▁"
#: Words cached by a worker; the cache is emptied when full, and long words are not kept.
CACHE, CACHE_CHARS = 300_000, 40
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: bytes | int = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value = raw[at : at + n]
            at += n
        yield tag >> 3, kind, value


class Model:
    """Pieces, scores and types of a model file's bytes, with encode and decode."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for field, _, value in _fields(raw):
            if field == 1:
                got = {f: v for f, _, v in _fields(value)}
                self.pieces.append(got.get(1, b"").decode())
                scores.append(float(np.frombuffer(got[2], "<f4")[0]) if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif field == 2:
                trainer = {f: v for f, _, v in _fields(value)}
            elif field == 3:
                normalizer = {f: v for f, _, v in _fields(value)}
        if trainer.get(3, 1) != 2 or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only BPE models without normalisation rules, with a dummy prefix and kept spaces are supported")
        if any(k == USER_DEFINED for k in self.kinds):
            raise ValueError("user-defined pieces are not supported")
        self.bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on into the next word")
        # rank of a piece: the order in which merges that make it are done
        order = sorted(self.ids.values(), key=lambda i: (-scores[i], i))
        self.rank = {i: r for r, i in enumerate(order)}
        tied: dict[float, int] = {}
        self.order = {i: tied.setdefault(scores[i], r) for r, i in enumerate(order)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        self._known: dict[int, bool] = {}
        self.whole: dict[str, int] = {}
        # a piece is made by its last merge; one that the merges never make whole is no token of any text
        for i in sorted(self.ids.values(), key=lambda i: (len(self.pieces[i]), i)):
            p = self.pieces[i]
            if len(p) > 1:
                whole, last = self._merge(p)
                if not whole:
                    continue
                self.parts[i] = last
            self.automaton.add_word(p, (len(p), i))
            self.whole[p] = i
        self.automaton.make_automaton()
        self.texts = [p.replace(MARK, " ") if k == NORMAL else "" for p, k in zip(self.pieces, self.kinds, strict=True)]
        # for decode's short way; None sends it the long way
        self.plain = [t if k == NORMAL else None for t, k in zip(self.texts, self.kinds, strict=True)]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.byte_of = {i: b for b, i in self.bytes_.items()}

    def _merge(self, word: str) -> tuple[bool, tuple[int, int]]:
        """Merge a piece's characters by rank, once at start: does it become whole, and from which two pieces?"""
        at = [self.ids.get(c, -1) for c in word]
        last = (-1, -1)
        while len(at) > 1:
            best = None
            for k in range(len(at) - 1):
                if at[k] >= 0 and at[k + 1] >= 0 and (j := self.ids.get(self.pieces[at[k]] + self.pieces[at[k + 1]])) is not None:
                    if best is None or self.order[j] < self.order[best[1]]:
                        best = (k, j)
            if best is None:
                return False, last
            last = (at[best[0]], at[best[0] + 1])
            at[best[0] : best[0] + 2] = [best[1]]
        return True, last

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left right`` is how their joined text is encoded."""
        if len(self._known) >= 4 * CACHE:
            self._known.clear()
        got = self._known[left << 20 | right] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        pieces, ids, order, parts = self.pieces, self.ids, self.order, self.parts
        limit = 1 << 60  # merges of this order and later have not been done in the state looked at
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and order[joined] < limit:
                return False
            if a not in parts and b not in parts:
                return True
            oa = order[a] if a in parts else -1
            ob = order[b] if b in parts else -1
            # undo the later of the two merges; of two equal ones the right one was later
            if oa > ob:
                # at equal order a merge across the border stands right of the undone one: it came after
                limit, a = oa, parts[a][1]
            else:
                # and here it stands left of the undone one: it would have come first
                limit, b = ob + 1, parts[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word: the prefix table is filled from left to right and read from right to left."""
        if (i := self.whole.get(word)) is not None:
            return [i]
        n = len(word)
        last, size = [-1] * (n + 1), [1] * (n + 1)
        known = self._known.get
        # the automaton reports the tokens that end at a place longest first: the first that fits is the last token there
        for end, (length, i) in self.automaton.iter(word):
            if last[end + 1] < 0:
                before = last[end + 1 - length]
                # -1: a character without a piece, or the start; nothing merges with it
                if before < 0 or ((fits := known(before << 20 | i)) is None and self.compatible(before, i)) or fits:
                    last[end + 1], size[end + 1] = i, length
        out: list[int] = []
        e = n
        while e:
            if last[e] >= 0:
                out.append(last[e])
            else:
                raw = word[e - 1].encode("utf-8", "surrogatepass")
                out += [self.bytes_[b] for b in reversed(raw)] if self.bytes_ else [self.unknown]
            e -= size[e]
        return out[::-1]

    #: A word: marks and what follows up to the next mark.
    WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def words(self, text: str) -> list[str]:
        return self.WORD.findall((MARK + text).replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined to characters, U+FFFD for each byte that fits none, and the front space goes."""
        try:
            out = "".join([self.plain[i] for i in ids])
            return out[1:] if out.startswith(" ") else out
        except TypeError:
            pass  # bytes or special tokens among them
        texts, byte_of = self.texts, self.byte_of
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                parts.append(_characters(bytes(run)))
                run.clear()
            parts.append(texts[i] if i != self.unknown else " ⁇ ")
        if run:
            parts.append(_characters(bytes(run)))
        out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


def _characters(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class _Coder:
    """A model with its cache of words: word -> (number of ids, ids as text, decoded text)."""

    def __init__(self, model: bytes):
        self.model = Model(model)
        self.front = self.model.ids[MARK]
        self.cache: dict[str, tuple[int, str, str]] = {}

    def word(self, w: str) -> tuple[int, str, str]:
        got = self.cache.get(w)
        if got is None:
            m = self.model
            ids = m.encode_word(w)
            # decode cuts a space in front, so the word is given one more
            got = (len(ids), ",".join([m.decimal[i] for i in ids]), m.decode([self.front, *ids]))
            if len(w) <= CACHE_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[w] = got
        return got


_coders: dict[bytes, _Coder] = {}


def _coder(model: bytes) -> _Coder:
    """The worker's coder for a model: tables and cached words serve all its tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = _Coder(model)
    return _coders[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: doc_id, ids (array<int>) and decoded; with ``digests`` instead n_tokens, ids_sha256 and decoded_sha256.

    The model's bytes travel with the task; each worker builds the tables once.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(model)
        coded, words_of = coder.word, coder.model.words
        for b in batches:
            rows = []
            for text in b:
                words = [coded(w) for w in words_of(text)]
                decoded = "".join([w[2] for w in words])
                decoded = decoded[1:] if decoded.startswith(" ") else decoded
                if digests:
                    ids = ",".join([w[1] for w in words])
                    rows.append((sum([w[0] for w in words]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
                else:
                    rows.append(([int(i) for w in words for i in w[1].split(",")], decoded))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])

    return id_and_text(docs, id_col, text_col).select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
