"""BPE encoding and decoding of words: speculate and verify.

Greedy longest match proposes the tokens of each new word. A proposal is the BPE encoding exactly
when every token and every pair of neighbours encodes to itself, so all neighbouring pairs of all
proposals are looked up in one vectorised pass (pairs never met before are decided once, by exact
merging), and only words with a failing pair are merged exactly. Words are remembered, up to a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words

#: Words whose encodings one generation of a Python worker's memory holds, about.
REMEMBERED = 150_000
#: Unicode White_Space, as the vocabulary's patterns mean it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Table:
    """Open-addressing hash table of 64-bit keys, looked up for whole arrays at once; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        slots, mask = self._slot(keys).tolist(), (1 << self.bits) - 1
        for k, v, at in zip(keys.tolist(), values.tolist(), slots):
            while self.values[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        left = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (self.values[at] >= 0)
            left, at = left[more], at[more]
        return out


_NONE = 1 << 40
#: Outside these characters the standard module's classes differ from the pattern's.
_OTHER = re.compile("[^\\t-\\r -~\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]")
_FINAL = np.uint64(0xA5A5_5A5A_1234_9876)
#: Longer words are proposed and verified one by one instead of in rows.
LONGEST = 48


class WordBpe:
    """Encoder and decoder for a vocabulary file of byte-level BPE with an end-of-word suffix, lower case and NFC."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.token = [token.get(i, "") for i in range(max(token) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = [self.vocab[a] << 20 | self.vocab[b] for a, b in merges]
        becomes = [self.vocab[a + b] for a, b in merges]
        #: pair of ids -> its rank and the id it becomes, for single words and for arrays
        self.rank = {p: k << 20 | c for k, (p, c) in enumerate(zip(pairs, becomes))}
        self.rank_table, self.becomes = Table(np.array(pairs, np.uint64), np.arange(len(pairs))), np.array(becomes, np.int64)
        alphabet = byte_alphabet()
        self.inner_byte = np.array([self.vocab.get(c, -1) for c in alphabet], np.int64)
        self.final_byte = np.array([self.vocab.get(c + suffix, -1) for c in alphabet], np.int64)
        byte_of = {c: b for b, c in enumerate(alphabet)}
        #: bytes of each token of the model, and whether it ends a word
        self.spelling = {i: (bytes(byte_of[c] for c in t.removesuffix(suffix)), t.endswith(suffix)) for t, i in self.vocab.items()}
        self.reach = max(len(x) for x, _ in self.spelling.values())
        self.power = np.array([pow(words._BASE, k, 1 << 64) for k in range(LONGEST + 1)], np.uint64)
        keys = [sum((x + 1) * int(self.power[k]) for k, x in enumerate(s)) % (1 << 64) ^ (int(_FINAL) if end else 0) for s, end in self.spelling.values() if len(s) <= LONGEST]
        self.token_table = Table(np.array(keys, np.uint64), np.array([i for i, (s, _) in self.spelling.items() if len(s) <= LONGEST]))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        #: the same split for texts of ASCII and Latin letters, in the faster standard module
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\w\s])+")
        #: word -> ids as bytes, and word -> decoded text; the older generation beside the present one
        self.ids: dict[str | int, bytes] = {}
        self.texts: dict[str | int, str] = {}
        self.older: tuple[dict, dict] = ({}, {})
        self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        #: (bytes, whether they end a word) -> id, and the longest token by its first three bytes; made for the first long word
        self.by_spelling: dict[tuple[bytes, bool], int] = {}
        self.longest: dict[bytes, int] = {}
        self.merged = 0

    def symbols(self, word: bytes) -> list[int]:
        """Ids of a word's bytes, the last one's with the suffix; bytes that the vocabulary lacks are left out."""
        out = [*self.inner_byte[list(word[:-1])].tolist(), int(self.final_byte[word[-1]])]
        return [i for i in out if i >= 0]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact BPE of one word: the pair of lowest rank first, leftmost of equals, until no pair merges; a heap keeps it near linear."""
        get, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r >> 20 << 32 | k for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << 20 | b)) is not None]
        heapify(heap)
        while heap:
            rank, k = divmod(heappop(heap), 1 << 32)
            j = after[k]
            if parts[k] < 0 or j >= n or (r := get(parts[k] << 20 | parts[j], -1)) >> 20 != rank:
                continue  # one of the two has merged meanwhile
            parts[k], parts[j] = r & 0xFFFFF, -1
            after[k] = right = after[j]
            if right < n:
                before[right] = k
                if (q := get(parts[k] << 20 | parts[right])) is not None:
                    heappush(heap, q >> 20 << 32 | k)
            left = before[k]
            if left >= 0 and (q := get(parts[left] << 20 | parts[k])) is not None:
                heappush(heap, q >> 20 << 32 | left)
        return [x for x in parts if x >= 0]

    def propose(self, raw: bytes) -> list[int] | None:
        """Greedy longest match of one word; None where a byte is not matched."""
        if not self.by_spelling:
            self.by_spelling = {s: i for i, s in self.spelling.items()}
            for s, _ in self.spelling.values():
                self.longest[s[:3]] = max(self.longest.get(s[:3], 0), len(s))
        get, longest, out, at, n = self.by_spelling.get, self.longest.get, [], 0, len(raw)
        while at < n:
            for to in range(min(n, at + longest(raw[at : at + 3], 2)), at, -1):
                i = get((raw[at:to], to == n))
                if i is not None:
                    break
            else:
                return None
            out.append(i)
            at = to
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.rank_table.get((left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64))
        return np.where((left < 0) | (right < 0) | (found < 0), _NONE, found)

    def merge_all(self, parts: np.ndarray) -> np.ndarray:
        """Exact BPE of many words in step: rows of ids, padded with -1 at the end."""
        n, width = parts.shape
        out, rows = np.full((n, width), -1, np.int64), np.arange(n)
        ranks = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int64)
        while len(rows) and ranks.shape[1]:
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            best = ranks[here, at]
            on = best < _NONE
            done = ~on
            out[rows[done], : parts.shape[1]] = parts[done]
            rows, parts, ranks, at, best = rows[on], parts[on], ranks[on], at[on], best[on]
            here = np.arange(len(rows))
            parts[here, at] = self.becomes[best]
            column = np.arange(parts.shape[1] - 1)[None, :]
            parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
            column = np.arange(ranks.shape[1] - 1)[None, :]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks(parts[left, at[left] - 1], parts[left, at[left]])
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self._ranks(parts[right, at[right]], parts[right, at[right] + 1])
        out[rows, : parts.shape[1]] = parts
        return out

    def propose_all(self, buf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words: (rows of ids padded with -1, whether every byte was matched)."""
        n, width = buf.shape
        prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[:width], axis=1, out=prefix[:, 1:])
        inverse = np.array([pow(words._INVERSE, k, 1 << 64) for k in range(width + 1)], np.uint64)
        out, length = np.full((n, width), -1, np.int64), np.zeros(n, np.int64)
        at, good = np.zeros(n, np.int64), np.ones(n, bool)
        rows = np.flatnonzero(size > 0)
        while len(rows):
            # candidate ends of the rows' next token, longest first
            todo, found, stop = rows, np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
            index = np.arange(len(rows))
            far = np.minimum(size[todo], at[todo] + self.reach)
            while len(todo):
                key = (prefix[todo, far] - prefix[todo, at[todo]]) * inverse[at[todo]]
                key = np.where(far == size[todo], key ^ _FINAL, key)
                got = self.token_table.get(key)
                hit = got >= 0
                found[index[hit]], stop[index[hit]] = got[hit], far[hit]
                more = ~hit & (far - 1 > at[todo])
                todo, index, far = todo[more], index[more], far[more] - 1
            ok = found >= 0
            good[rows[~ok]] = False
            rows, found, stop = rows[ok], found[ok], stop[ok]
            out[rows, length[rows]] = found
            length[rows] += 1
            at[rows] = stop
            rows = rows[stop < size[rows]]
        return out, good

    def _decide(self, keys: np.ndarray) -> None:
        """Learn which of the new pairs (a << 32 | b) encode to themselves."""
        a, b = keys >> 32, keys & 0xFFFFFFFF
        left, right = [self.spelling[i][0] for i in a.tolist()], [self.spelling[i] for i in b.tolist()]
        width = max(len(x) + len(y[0]) for x, y in zip(left, right))
        parts = np.full((len(keys), width), -1, np.int64)
        for k, (x, (y, end)) in enumerate(zip(left, right)):
            s = self.inner_byte[list(x + y)]
            if end:
                s[-1] = self.final_byte[y[-1]]
            parts[k, : len(s)] = s
        got = self.merge_all(parts)
        good = (got[:, 0] == a) & (got[:, 1] == b)
        if width > 2:
            good &= got[:, 2] < 0
        if len(self.pair_keys) > 4 * REMEMBERED:
            self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        everything = np.concatenate((self.pair_keys, keys))
        order = np.argsort(everything)
        self.pair_keys, self.pair_good = everything[order], np.concatenate((self.pair_good, good))[order]

    def _compatible(self, ids: np.ndarray) -> np.ndarray:
        """Rows in which every pair of neighbours encodes to itself."""
        inner = ids[:, 1:] >= 0
        keys = ((ids[:, :-1] << 32) | ids[:, 1:])[inner]
        asked = np.unique(keys)
        fresh = asked[~np.isin(asked, self.pair_keys, assume_unique=True)]
        for lo in range(0, len(fresh), 20_000):
            self._decide(fresh[lo : lo + 20_000])
        good = np.ones(inner.shape, bool)
        if len(keys):
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[at] == keys  # a pair dropped meanwhile counts as failing, which only costs a merge
            good[inner] = known & self.pair_good[at]
        return good.all(axis=1)

    def learn(self, new: list[str]) -> None:
        """Encode words and remember them."""
        raw = [w.encode() for w in new]
        size = np.array([len(r) for r in raw])
        for k in np.flatnonzero(size > LONGEST).tolist():
            ids = self.propose(raw[k])
            if ids is None or not self._compatible(np.array([ids], np.int64))[0]:
                self.merged += 1
                ids = self.merge(self.symbols(raw[k]))
            self._remember(new[k], ids)
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONGEST]
        for lo in range(0, len(order), 8192):
            rows = order[lo : lo + 8192]
            n, width = size[rows], int(size[rows[-1]])
            buf = np.frombuffer(b"".join([raw[k].ljust(width, b"\0") for k in rows]), np.uint8).reshape(len(rows), width)
            ids, good = self.propose_all(buf, n)
            good &= self._compatible(ids)
            bad = np.flatnonzero(~good)
            if len(bad):
                self.merged += len(bad)
                parts = np.where(np.arange(width)[None, :] < n[bad][:, None], self.inner_byte[buf[bad]], -1)
                parts[np.arange(len(bad)), n[bad] - 1] = self.final_byte[buf[bad, n[bad] - 1]]
                if (parts < 0).sum() == width * len(bad) - n[bad].sum():
                    ids[bad] = self.merge_all(parts)
                else:  # bytes that the vocabulary lacks
                    ids[bad] = -1
                    for k in bad.tolist():
                        one = self.merge(self.symbols(raw[rows[k]]))
                        ids[k, : len(one)] = one
            count = (ids >= 0).sum(axis=1).tolist()
            packed, width = ids.astype("<u4"), 4 * width
            data, token = packed.tobytes(), self.token
            for k, (w, c) in enumerate(zip(rows.tolist(), count)):
                self.ids[new[w]] = data[k * width : k * width + 4 * c]
            for k, (w, c, row) in enumerate(zip(rows.tolist(), count, ids.tolist())):
                self.texts[new[w]] = " ".join([token[i] for i in row[:c]])

    def _remember(self, word: str | int, ids: list[int]) -> None:
        self.ids[word] = np.array(ids, "<u4").tobytes()
        self.texts[word] = " ".join([self.token[i] for i in ids])

    def normalize(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each character on its own, so no final sigma

    def words(self, text: str) -> list[str]:
        text = self.normalize(text)
        return (self.pattern if _OTHER.search(text) else self.plain).findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text; an integer is the id of a special token met in it."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self.words(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        cut = [self.pieces(t) for t in texts]
        here: set[str | int] = set().union(*cut)
        if len(self.ids) + len(here) > REMEMBERED:  # words of the last two generations stay
            self.older, self.ids, self.texts = (self.ids, self.texts), {}, {}
        new = []
        for w in here.difference(self.ids):
            if w in self.older[0]:
                self.ids[w], self.texts[w] = self.older[0][w], self.older[1][w]
            elif isinstance(w, int):
                self._remember(w, [w])
            else:
                new.append(w)
        if new:
            self.learn(new)
        ids, text = self.ids.__getitem__, self.texts.__getitem__
        return [(b"".join(map(ids, pieces)), " ".join(map(text, pieces))) for pieces in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a blank: this vocabulary names no other decoder."""
        return " ".join(self.token[int(i)] for i in ids)


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The vocabulary at ``path``, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (binary, little-endian unsigned 32-bit), decoded.

    ``path`` names the vocabulary file, which every executor must have; by default the public
    49k word vocabulary. Defined cases: null or blank text has no ids and decodes to the empty string;
    rows are independent, so repeated ids, null ids and other columns do not matter.
    """
    words.bound_batches(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            for lo, to in words.slices(b.column(1)):
                part = b.slice(lo, to - lo)
                got = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's encoding, one row per row of docs.

    Defined cases are those of ``encode``: a null or blank text has 0 tokens and the digests of nothing;
    repeated and null ids give a row each; an empty table gives an empty result; other columns do not matter.
    """
    return encode(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
