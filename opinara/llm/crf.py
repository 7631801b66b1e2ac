"""Secret scans with a linear-chain conditional random field.

Tokens are tagged B (a secret begins), I (goes on) or O. Emission weights are those of hashed features: the
token's shape, length, kinds of characters and entropy, the neighbouring words, and features of the whole file; with
the transition weights they are fitted by maximising the conditional likelihood (forward-backward, Adam).
Decoding is by Viterbi.

Every token may carry any tag. A weight belongs to a feature of one token seen from one place (itself, the one before, the
second before, the next), so what a token brings is looked up by its text in a bounded cache and the emissions of a batch are sums
of four rows of a table. Tokens that no tagging better than one with O there can use are found by a bound on what transitions and the
next token's tag can make up for; they cut the chain, and only the runs between them are decoded: the same tags
as by Viterbi over the whole text (:meth:`Tagger.spans_by_full_chain`, tested).

Three base patterns (assign, access, hex) always yield their spans, leftmost and without overlap for each kind; the tagger adds
spans of kind ``crf`` that overlap no base span. Positions are code points, ends exclusive.

The documents have no labels for secrets: the tagger is fitted on generated, labelled lines (templates and a seed).
They hold keys of letters only, of digits only, short passwords, hyphenated passphrases and key blocks of many lines, which
are chains of many tokens. Passphrases of several plain words are out of reach: taught to, the field took prose for them. A null or empty text has no spans. Repeated rows get equal results; no documents give no rows; columns
beyond id and text are ignored. A text costs its length.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text

#: Kind, pattern, the group whose length counts, least length. Fixed values. ASCII case folding only.
BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS = ("assign", "access", "hex", "crf")
#: A token does not end in a full stop. A run beyond ASCII is one token.
TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]*[A-Za-z0-9+/_\-]={0,2}|[^\x00-\x7F]+|[^\sA-Za-z0-9]")
#: Cached tokens are forgotten beyond this many, so a worker's memory stays bounded.
CACHE = 600_000
HAS_SIGN = re.compile("[:=]")
BITS = 18
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not HAS_SIGN.search(text):
            continue
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


#: ASCII letters and digits to the class that stands for them.
CLASS = {**{ord(c): c0 for c0, r in (("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("a", "abcdefghijklmnopqrstuvwxyz"), ("0", "0123456789")) for c in r}}
RUN = re.compile(r"(.)\1+", re.DOTALL)


def classes(token: str) -> str:
    """A for upper case, a for lower case, 0 for digits; other characters as they are."""
    if token.isascii():
        return token.translate(CLASS)
    return "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in token)


def shape(token: str) -> str:
    """Runs of upper case, lower case, digits and signs, one letter each."""
    return RUN.sub(r"\1", classes(token))[:12]


def file_features(text: str) -> tuple[str, ...]:
    n = max(1, len(text))
    signs = text.count("=") + text.count("{") + text.count(";") + text.count(":")
    return (f"file:signs:{min(4, int(200 * signs / n))}", f"file:lines:{min(4, text.count(chr(10)) * 400 // n)}")


MASK = (1 << BITS) - 1


def _bytes(x: str) -> bytes:
    return x.encode("utf-8", "surrogatepass")


def _hash(names: list[str]) -> list[int]:
    return [zlib.crc32(_bytes(x)) & MASK for x in names]


#: The checksum of what a feature's name begins with; that of the name goes on from it.
BEGUN = {x: zlib.crc32(x.encode()) for x in ("shape:", "start:", "word:", "back:", "back2:", "next:")}
SIGN = re.compile(r"[+/_.\-]")
BEYOND = re.compile(r"[^\x00-\x7F]")


@functools.lru_cache(4096)
def _rough(mix: str, turns: int, length: int, entropy: int, digits: int) -> tuple[int, ...]:
    """The features that few values are possible for."""
    return tuple(_hash(["bias", f"turns:{turns}", f"mix:{mix}", f"length:{length}", f"entropy:{entropy}", f"both:{mix}:{length}", f"digits:{digits}"]))


@functools.lru_cache(4096)
def _share(count: int, n: int) -> float:
    return count / n * math.log2(count / n)


def own_features(token: str) -> list[int]:
    """The features of a token itself: shape, number of its turns, kinds of characters, length, entropy, share of digits, how it starts, and itself."""
    bare = token.rstrip("=")
    kinds, n, low = classes(bare), len(bare), _bytes(token.lower()[:12])
    form = RUN.sub(r"\1", kinds)[:12]
    if bare.isascii():
        mix = "A" * ("A" in kinds) + "a" * ("a" in kinds) + "0" * ("0" in kinds) + "s" * bool(SIGN.search(kinds))
    else:
        mix = "x"  # a run beyond ASCII is a token of its own
    entropy = -sum([_share(bare.count(c), n) for c in dict.fromkeys(bare)]) if bare else 0.0
    return [
        zlib.crc32(_bytes(form), BEGUN["shape:"]) & MASK, zlib.crc32(_bytes(bare[:4].lower()), BEGUN["start:"]) & MASK, zlib.crc32(low, BEGUN["word:"]) & MASK,
        *_rough(mix, min(8, len(form)), min(12, n // 4), int(2 * entropy), kinds.count("0") * 5 // max(1, n)),
    ]


PLACES = ("back", "back2", "next")


@functools.lru_cache(4096)
def _seen_kind(place: str, length: int, digit: bool, letter: bool) -> int:
    return _hash([f"{place}:kind:{length}:{'0' * digit}{'a' * letter}"])[0]


def seen_features(token: str, places: tuple[str, ...]) -> list[int]:
    """The features of a token as seen from a neighbour, two for each of ``places``."""
    low, kinds = _bytes(token.lower()[:12]), classes(token)
    if token.isascii():
        digit, letter = "0" in kinds, "a" in kinds or "A" in kinds
    else:
        digit, letter = any(map(str.isdigit, token)), any(map(str.isalpha, token))
    length, out = min(6, len(token) // 4), []
    for p in places:
        out += [zlib.crc32(low, BEGUN[p + ":"]) & MASK, _seen_kind(p, length, digit, letter)]
    return out


class Tagger:
    """Weights of a fitted field: ``w`` (feature, tag), ``t`` (tag, next tag)."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t
        self._at: dict[str, int] = {}
        self._rows = np.zeros((1024, 4, 3))
        tt = t.copy()
        tt[O, I] = -np.inf
        # the most that transitions to and from a tag of a secret can gain over O and, where I follows, over B
        self.slack = max(
            tt[p, tag] + tt[tag, q] - t[p, O] - t[O, B if q == I else q]
            for p in (B, I, O) for tag in (B, I) for q in (B, I, O) if np.isfinite(tt[p, tag]) and np.isfinite(tt[tag, q])
        )

    def __getstate__(self):
        return {"w": self.w, "t": self.t}

    def __setstate__(self, state):
        self.__init__(state["w"], state["t"])

    def _ids(self, tokens: list[str]) -> np.ndarray:
        """Rows of the tokens' table: what each brings to itself and, by place, to its neighbours. Row 0 is for no token."""
        if len(self._at) > CACHE:
            self._at, self._rows = {}, np.zeros((1024, 4, 3))
        at = self._at
        if not at:
            self._rows[0, 1:] = [self.w[seen_features("", (p,))].sum(0) for p in PLACES]
            at[""] = 0
        out = list(map(at.get, tokens))
        if None in out:
            new = list(dict.fromkeys(x for x, k in zip(tokens, out, strict=True) if k is None))
            first = len(at)
            while first + len(new) > len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            for i in range(0, len(new), 4096):  # a text of many new tokens takes no more memory than these
                part = new[i : i + 4096]
                w = self.w[np.array([own_features(x) + seen_features(x, PLACES) for x in part])]
                self._rows[first + i : first + i + len(part)] = np.add.reduceat(w, [0, w.shape[1] - 6, w.shape[1] - 4, w.shape[1] - 2], axis=1)
            at.update(zip(new, range(first, first + len(new)), strict=True))
            out = list(map(at.get, tokens))
        return np.array(out, np.int64)

    def emissions(self, tokens: list[str], file: tuple[str, ...]) -> np.ndarray:
        r = self._rows_of(tokens)
        none = self._rows[0]
        e = r[:, 0] + self.w[_hash(list(file))].sum(0)
        for place, d in ((1, 1), (2, 2)):  # the one before, the second before
            e[:d] += none[place]
            e[d:] += r[:-d, place]
        e[:-1] += r[1:, 3]
        e[-1] += none[3]
        return e

    def _rows_of(self, tokens: list[str]) -> np.ndarray:
        ids = self._ids(tokens)  # before the table is read: it may grow
        return self._rows[ids]

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """The best tags of a chain that has O before and behind it."""
        best, back = self.t[O] + emit[0], []
        best[I] = -1e9  # nothing to go on with
        for e in emit[1:]:
            score = best[:, None] + self.t
            score[O, I] = -1e9
            back.append(score.argmax(0))
            best = score.max(0) + e
        tags = [int((best + self.t[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def open_tokens(self, emit: np.ndarray) -> np.ndarray:
        """Tokens that may be part of a secret. For each other one, O there (and B for an I behind it) makes any tagging better."""
        gain = np.maximum(emit[:, B], emit[:, I]) - emit[:, O]
        after = np.r_[np.maximum(emit[1:, I] - emit[1:, B], 0), 0]
        return gain + after + self.slack >= 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets of a text: runs of tokens that may be part of one are decoded."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        emit = self.emissions(tokens, file_features(text))
        at = np.flatnonzero(self.open_tokens(emit))
        if not len(at):
            return []
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        begins, ends = at[np.r_[0, cuts]], at[np.r_[cuts - 1, len(at) - 1]] + 1
        alone = ends - begins == 1
        # a run of one token is a secret or not
        e, t = emit[begins], self.t
        drop = alone & ((t[O, B] + e[:, B]) + t[B, O] < (t[O, O] + e[:, O]) + t[O, O])
        begins, ends = begins[~drop].tolist(), ends[~drop].tolist()
        if not begins:
            return []
        out, places = [], [m.span() for m in itertools.islice(TOKEN.finditer(text), ends[-1])]
        for a, b in zip(begins, ends, strict=True):
            out += [places[a]] if b - a == 1 else _joined(self.viterbi(emit[a:b]), places[a:b])
        return out

    def spans_by_full_chain(self, text: str) -> list[tuple[int, int]]:
        """The same by one Viterbi pass over all tokens; for tests."""
        found = list(TOKEN.finditer(text))
        if not found:
            return []
        return _joined(self.viterbi(self.emissions([m[0] for m in found], file_features(text))), [(m.start(), m.end()) for m in found])


def _joined(tags: list[int], places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for tag, (a, b) in zip(tags, places, strict=True):
        if tag == B:
            out.append((a, b))
        elif tag == I:
            out[-1] = (out[-1][0], b)
    return out


def training_lines(n: int = 3000, seed: int = 23) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the spans of their secrets."""
    rng = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    parts = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur la que ent ion ción eau ung sch ein".split()
    word = lambda: pick(low, rng.randint(2, 9)) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))

    def mixed(s: str, k: int) -> str:
        return rng.choice(low) + pick(s, k) + rng.choice(dig)

    b64 = low + up + dig + "+/"
    secrets = [
        lambda: mixed(low + up + dig, rng.randint(18, 40)), lambda: mixed(b64, rng.randint(20, 60)) + rng.choice(["", "=", "=="]),
        lambda: "ghp_" + mixed(low + up + dig, 34), lambda: "sk_live_" + mixed(low + up + dig, 22), lambda: "xoxb-" + pick(dig, 11) + "-" + mixed(low + up + dig, 22),
        lambda: "0a" + pick("0123456789abcdef", rng.choice([18, 22, 26])), lambda: pick(low + up, rng.randint(16, 36)) + rng.choice(["", "=="]), lambda: pick(dig, rng.randint(12, 20)),
        lambda: pick(low + up + dig, rng.randint(5, 9)) + rng.choice(dig), lambda: f"{word().capitalize()}{pick(dig, rng.randint(1, 4))}", lambda: "-".join(word() for _ in range(rng.randint(4, 6))),
    ]
    plain = [
        lambda: f"{word()}{pick(dig, 2)}@{word()}.com", lambda: f"{word()}-{pick(dig, 4)}-{word()}", lambda: f"{word()}_{word()}_v{pick(dig, 1)}.{pick(dig, 1)}", lambda: f"2024-0{pick('123456789', 1)}-1{pick(dig, 1)}T12",
        lambda: f"{word()}/{word()}/{word()}{pick(dig, 1)}.html", lambda: f"{word()}{word()}.{pick(dig, 2)}", lambda: f"src{pick(dig, 2)}.example.com", lambda: f"{pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}x",
        lambda: pick(dig, rng.randint(3, 12)), lambda: pick(dig, rng.randint(13, 19)), lambda: pick(dig, 16) + " " + pick(dig, 16), lambda: ".".join(pick(dig, rng.randint(1, 3)) for _ in range(4)), lambda: f"+1 ({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}", lambda: word() + word() + word(), lambda: pick(up, rng.randint(4, 12)),
        lambda: f"{word()}{rng.choice(['$$$', '###', '&&&', '%%%', '!!'])} {word()}{rng.choice(['###', '!!'])}", lambda: "é".join(word() for _ in range(2)),
    ]
    cues = ["key", "auth", "bearer", "credential", "secret", "token", "apikey", "private", "signature", "pwd", "password", "pass", "passcode", "Basic", "pin"]
    ends = ["", "", "", "", "", ",", ".", ".\n", "###", "$$$", "!!"]
    say = [word, word, word, lambda: word().capitalize(), lambda: word() + "é" + word(), lambda: word().upper()]
    number = lambda: pick(dig, rng.choice([2, 4, 10, 16]))
    sentence = lambda lo, hi: " ".join((number if rng.random() < 0.04 else rng.choice(say))() + rng.choice(ends) for _ in range(rng.randint(lo, hi)))
    out = []
    for _ in range(n):
        text, spans = sentence(0, 6), []
        text += " " * bool(text)
        kind = rng.random()

        def put(s: str) -> None:
            nonlocal text
            spans.append((len(text), len(text) + len(s)))  # noqa: B023
            text += s

        if kind < 0.40:
            text += rng.choice(cues) + rng.choice([" ", ": ", "=", ' = "', " is ", ":"])
            put(rng.choice(secrets)())
            if rng.random() < 0.1:
                text += " "
                put(rng.choice(secrets[:6])())
        elif kind < 0.55:
            text += f"-----BEGIN {rng.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n"
            put("\n".join(pick(b64, 64) for _ in range(rng.randint(1, 6))) + "\n" + pick(b64, rng.randint(9, 60)) + rng.choice(["", "=", "=="]))
            text += "\n-----END PRIVATE KEY-----"
        elif kind < 0.62:
            text += sentence(40, 80)
        elif kind < 0.9:
            text += rng.choice(["", "see ", "file ", "at ", "from: ", "id=", "page ", "order ", "call "]) + rng.choice(plain)()
        else:
            text += rng.choice(["a key to ", "the token of ", "my secret ", "no password for ", "the pin in "]) + sentence(1, 3)
        text += rng.choice([" ", ". ", '" ', "; ", "\n", "### ", "&&& "]) + sentence(0, 5)
        out.append((text, [s for s in spans]))
    return out


def fit_tagger(lines: list[tuple[str, list[tuple[int, int]]]] | None = None, steps: int = 360, batch: int = 256, decay: float = 1e-4) -> Tagger:
    """Fit on labelled lines; a line's tokens are a chain."""
    chains: list[tuple[list[list[int]], list[int]]] = []
    for text, spans in training_lines() if lines is None else lines:
        found = list(TOKEN.finditer(text))
        tokens, file = [m[0] for m in found], _hash(list(file_features(text)))
        if not tokens:
            continue
        at = lambda j: tokens[j] if 0 <= j < len(tokens) else ""  # noqa: E731, B023
        inside = [next((s for s in spans if s[0] <= m.start() < s[1]), None) for m in found]
        chains.append((
            [own_features(x) + [h for p, d in zip(PLACES, (-1, -2, 1), strict=True) for h in seen_features(at(k + d), (p,))] + file for k, x in enumerate(tokens)],
            [O if s is None else B if m.start() == s[0] else I for m, s in zip(found, inside, strict=True)],
        ))
    n, longest = len(chains), max(len(c[0]) for c in chains)
    width = max(len(f) for c in chains for f in c[0])
    # features seen less than three times get no weight
    every, count = np.unique(np.concatenate([f for c in chains for f in c[0]]), return_counts=True)
    known = every[count >= 3]
    place = np.full(1 << BITS, dim := len(known))
    place[known] = np.arange(dim)
    x = np.full((n, longest, width), dim)
    y, mask = np.full((n, longest), O), np.zeros((n, longest), bool)
    for i, (fs, tags) in enumerate(chains):
        for j, f in enumerate(fs):
            x[i, j, : len(f)] = place[f]
            mask[i, j] = True
        y[i, : len(tags)] = tags
    w, t = np.zeros((dim + 1, 3)), np.zeros((3, 3))
    bar = np.zeros((3, 3))
    bar[O, I] = -1e9
    moments = [np.zeros_like(p) for p in (w, w, t, t)]
    lengths = np.array([len(c[0]) for c in chains])
    by_length = np.argsort(lengths, kind="stable")
    parts = [p for p in np.array_split(by_length, max(1, n // batch)) if len(p)]
    order = np.random.default_rng(5).permutation(len(parts))
    for step in range(1, steps + 1):
        part = parts[order[step % len(parts)]]
        size = int(lengths[part].max())
        gw, gt = _gradient(x[part, :size], y[part, :size], mask[part, :size], w, t, bar)
        gw[dim] = 0
        for p, g, k in ((w, gw / len(part) + decay * w, 0), (t, gt / len(part) + decay * t, 2)):
            moments[k] += 0.1 * (g - moments[k])
            moments[k + 1] += 0.01 * (g * g - moments[k + 1])
            p -= 0.05 * (1 - step / (steps + 1)) * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-9)
    full = np.zeros((1 << BITS, 3))
    full[known] = w[:dim]
    return Tagger(full, t)


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray, t: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log likelihood of some chains, padded to one length, by forward-backward."""
    (n, longest, width), dim, tt = x.shape, len(w) - 1, t + bar
    e = w[x].sum(2)
    e[~mask] = (-1e9, -1e9, 0.0)  # behind its end a chain is O
    alpha = np.empty_like(e)
    alpha[:, 0] = e[:, 0] + tt[O]
    for j in range(1, longest):
        alpha[:, j] = e[:, j] + _lse(alpha[:, j - 1][:, :, None] + tt, 1)
    beta = np.empty_like(e)
    beta[:, -1] = tt[:, O]
    for j in range(longest - 2, -1, -1):
        beta[:, j] = _lse(tt + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1] + tt[:, O], 1)
    node = np.exp(alpha + beta - z[:, None, None])
    diff = node.copy()
    np.put_along_axis(diff, y[:, :, None], np.take_along_axis(node, y[:, :, None], 2) - 1, 2)
    diff[~mask] = 0
    gw = np.stack([np.bincount(x.ravel(), np.repeat(diff[:, :, c].ravel(), width), dim + 1) for c in range(3)], 1)
    gt = np.zeros_like(t)
    gt[O] += diff[:, 0].sum(0)
    for j in range(1, longest):
        pair = np.exp(alpha[:, j - 1][:, :, None] + tt + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None])
        gt += pair.sum(0)
        np.subtract.at(gt, (y[:, j - 1], y[:, j]), 1)
    gt[:, O] += node[:, -1].sum(0)
    np.subtract.at(gt[:, O], y[:, -1], 1)
    return gw, gt


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


SPAN = "array<struct<kind:string,start:int,end:int>>"


def scan(text: str | None, tagger: Tagger) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans of one text."""
    base = base_spans(text or "")
    added, k, reach = [], 0, -1
    for a, b in tagger.spans(text or ""):
        while k < len(base) and base[k][1] < b:  # base spans are in order of their starts
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            added.append(("crf", a, b))
    return base, added


def find_secrets(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and added (arrays of kind, start, end)."""

    @F.pandas_udf(f"base {SPAN}, added {SPAN}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for b in batches:
            got = [scan(t, tagger) for t in b]
            yield pd.DataFrame({"base": [named(x) for x, _ in got], "added": [named(x) for _, x in got]})

    return id_and_text(docs, id_col, text_col).select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
