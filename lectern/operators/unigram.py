"""Unigram tokenisers: character rules, metaspace words and likeliest pieces, for whole Arrow batches.

Tries are sorted arrays of edges, walked for all positions or all words of a slice at once. The rules take the longest match at
each place, in order; which places begin a match follows from jumps that double their length. Pieces come
from a dynamic program that handles the distinct words of a slice side by side, one start at a time.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark in front of a word, how much worse than the worst piece an unknown character is, and the longest piece in characters.
METASPACE, UNKNOWN_PENALTY, LONGEST = "▁", 10.0, 32
#: Bytes of text worked through at once (or one text), and words of one dynamic program.
SLICE, WORDS = 1 << 19, 1 << 14


class Trie:
    """Strings of numbers below 2^21 with a value each; children are found in one sorted array of (node, label)."""

    def __init__(self, entries: dict[bytes | str, int]):
        edges: dict[int, int] = {}
        values = {}
        n = 1
        for text, value in entries.items():
            node = 0
            for label in text if isinstance(text, bytes) else map(ord, text):
                at = node << 21 | label
                node = edges.setdefault(at, n)
                n += node == n
            values[node] = value
        self.key = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.key.tolist()], np.int64)
        self.value = np.full(n, -1, np.int64)
        for node, value in values.items():
            self.value[node] = value
        self.depth = max(map(len, entries), default=0)

    def step(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node by its label, -1 without one."""
        if not len(self.key):
            return np.full(len(node), -1, np.int64)
        wanted = node << 21 | label
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.to[at], -1)


def decoded_rules(charsmap: bytes) -> dict[bytes, bytes]:
    """{bytes: replacement} of a precompiled character map: the length of a double array, its 32-bit units, and replacements that end with a zero byte.

    The array is unfolded level by level, all nodes and all 255 labels of a level at once.
    """
    size = int.from_bytes(charsmap[:4], "little")
    units = np.frombuffer(charsmap[4 : 4 + size], np.uint32).astype(np.int64)
    texts = charsmap[4 + size :]

    # fixed format of a unit: bits 0-7 and 31 label, bit 8 has a value, bit 9 wide offset, bits 10-30 offset; a unit of a value is that value
    def base(node: np.ndarray) -> np.ndarray:
        u = units[node]
        return node ^ np.where(u & 0x200, (u >> 10) << 8, u >> 10)

    rules: dict[bytes, bytes] = {}
    nodes, paths = np.zeros(min(1, len(units)), np.int64), [b""]
    labels = np.arange(1, 256)
    while len(nodes):
        child = base(nodes)[:, None] ^ labels
        there = child < len(units)
        there &= (units[np.where(there, child, 0)] & 0x800000FF) == labels
        at, which = np.nonzero(there)
        nodes, paths = child[at, which], [paths[a] + bytes([labels[w]]) for a, w in zip(at.tolist(), which.tolist())]
        for k in np.flatnonzero(units[nodes] & 0x100).tolist():
            start = int(units[base(nodes[k : k + 1])[0]] & 0x7FFFFFFF)
            rules[paths[k]] = texts[start : texts.index(b"\0", start)]
    return rules


@dataclass(frozen=True)
class UnigramModel:
    """Pieces with their log-probabilities, special ids and character rules. The vocabulary goes to every task: some megabytes."""

    pieces: list[str]
    scores: list[float]
    unknown: int = 0
    begin: int | None = None
    end: int | None = None
    rules: dict[bytes, bytes] = field(default_factory=dict)

    @property
    def unknown_score(self) -> float:
        return min(self.scores, default=0.0) - UNKNOWN_PENALTY


def read_model(text: str) -> UnigramModel:
    """The model of a tokenizer.json; raises ValueError for another kind of model or normaliser, or without <s> and </s>."""
    raw = json.loads(text)
    model, normalizer = raw.get("model") or {}, raw.get("normalizer") or {}
    if model.get("type") != "Unigram" or not isinstance(model.get("vocab"), list):
        raise ValueError("the file holds no unigram model")
    if normalizer.get("type") != "Precompiled" or not isinstance(normalizer.get("precompiled_charsmap"), str):
        raise ValueError("the file's normaliser is no precompiled character map")
    added = {t["content"]: t["id"] for t in raw.get("added_tokens") or []}
    if "<s>" not in added or "</s>" not in added:
        raise ValueError("the file lacks <s> or </s>")
    pieces, scores = zip(*model["vocab"]) if model["vocab"] else ((), ())
    return UnigramModel(list(pieces), list(map(float, scores)), model.get("unk_id") or 0, added["<s>"], added["</s>"], decoded_rules(base64.b64decode(normalizer["precompiled_charsmap"])))


def normalised(buf: np.ndarray, offsets: np.ndarray, trie: Trie, replacements: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of UTF-8 texts after the rules: at each place the longest match is replaced, else one character is kept."""
    n = len(buf)
    if not n or not trie.depth:
        return buf, offsets
    ends = np.repeat(offsets[1:], np.diff(offsets))
    length, rule = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    active, node = np.arange(n), np.zeros(n, np.int64)
    active = active[(buf & 0xC0) != 0x80]  # matches begin where characters do
    node = node[: len(active)]
    for k in range(trie.depth):
        inside = active + k < ends[active]
        active, node = active[inside], node[inside]
        node = trie.step(node, buf[active + k].astype(np.int64))
        active, node = active[node >= 0], node[node >= 0]
        hit = trie.value[node] >= 0
        length[active[hit]], rule[active[hit]] = k + 1, trie.value[node[hit]]
        if not len(active):
            break
    lead = buf.astype(np.int64)
    width = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, np.where(lead >= 0xC0, 2, 1)))
    jump = np.append(np.minimum(np.arange(n) + np.where(rule >= 0, length, width), ends), n)
    starts = np.zeros(n + 1, bool)
    starts[offsets[:-1]] = True
    far = jump.copy()
    for _ in range(max(1, int(np.diff(offsets).max()).bit_length())):
        starts[far[starts]] = True
        far = far[far]
    at = np.flatnonzero(starts[:n])
    size = np.array([len(r) for r in replacements] or [0], np.int64)
    flat = np.frombuffer(b"".join(replacements), np.uint8)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    ruled = rule[at] >= 0
    out_size = np.where(ruled, size[rule[at]], jump[at] - at)
    out_at = np.concatenate(([0], np.cumsum(out_size)))
    both = np.concatenate((buf, flat))
    source = np.where(ruled, n + first[rule[at]], at)
    taken = both[np.repeat(source - out_at[:-1], out_size) + np.arange(out_at[-1])]
    return taken, out_at[np.searchsorted(at, offsets)]


def best_pieces(words: list[str], trie: Trie, scores: np.ndarray, unknown: int, unknown_score: float) -> list[np.ndarray]:
    """Ids of the likeliest pieces of each word; a character without a piece is unknown. Of equally likely ways, each end keeps the piece that begins first."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for lo in range(0, len(order), WORDS):
        part = order[lo : lo + WORDS]
        cells = 1 << 22  # words of one table, so that a very long word does not widen the rows of all others
        while part:
            take = max(1, next((k for k in range(len(part), 0, -1) if k * (len(words[part[k - 1]]) + 1) <= cells), 1))
            _table([words[k] for k in part[:take]], part[:take], trie, scores, unknown, unknown_score, out)
            part = part[take:]
    return out


def _table(words: list[str], places: list[int], trie: Trie, scores: np.ndarray, unknown: int, unknown_score: float, out: list[np.ndarray]) -> None:
    size = np.array([len(w) for w in words])
    longest = int(size.max(initial=0))
    points = np.zeros((len(words), longest), np.int64)
    points[np.arange(longest) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    best = np.full((len(words), longest + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((len(words), longest + 1), np.int32), np.zeros((len(words), longest + 1), np.int64)

    def offer(row: np.ndarray, start: int, end: int, score: np.ndarray | float, ids: np.ndarray | int) -> None:
        value = best[row, start] + score
        better = value > best[row, end]
        row = row[better]
        best[row, end], back[row, end] = value[better], start
        piece[row, end] = ids[better] if isinstance(ids, np.ndarray) else ids

    for start in range(longest):
        row = np.flatnonzero(size > start)  # sorted by length: all rows from the first that is long enough on
        node = np.zeros(len(row), np.int64)
        for k in range(min(LONGEST, longest - start)):
            inside = size[row] > start + k
            row, node = row[inside], node[inside]
            node = trie.step(node, points[row, start + k])
            ids = np.where(node >= 0, trie.value[node], -1)
            hit = ids >= 0
            if hit.any():
                offer(row[hit], start, start + k + 1, scores[ids[hit]], ids[hit])
            if not k:
                offer(row[~hit], start, start + 1, unknown_score, unknown)
            row, node = row[node >= 0], node[node >= 0]
            if not len(row):
                break
    for k, place in enumerate(places):
        ids, end = [], int(size[k])
        while end:
            ids.append(piece[k, end])
            end = int(back[k, end])
        out[place] = np.array(ids[::-1], np.int64)


def _slices(text: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(np.asarray(pc.binary_length(text), np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield text[at:to]
        at = to


def encoded(text: pa.Array, model: UnigramModel, rules: Trie, pieces: Trie) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): ids of all pieces of each text."""
    replacements = list(model.rules.values())
    scores = np.array(model.scores)
    all_ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in _slices(text):
        large = part.cast(pa.large_string())
        offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
        data = np.frombuffer(large.buffers()[2], np.uint8) if large.buffers()[2] is not None else np.zeros(0, np.uint8)
        buf, offsets = normalised(data[offsets[0] : offsets[-1]], offsets - offsets[0], rules, replacements)
        clean = pa.LargeStringArray.from_buffers(len(large), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
        lists = pc.utf8_split_whitespace(clean)
        words = lists.flatten()
        row = np.repeat(np.arange(len(large)), np.asarray(pc.list_value_length(lists), np.int64))
        filled = np.asarray(pc.binary_length(words), np.int64) > 0
        coded = words.filter(pa.array(filled)).dictionary_encode()
        distinct = [w if w.startswith(METASPACE) else METASPACE + w for w in coded.dictionary.to_pylist()]
        found = best_pieces(distinct, pieces, scores, model.unknown, model.unknown_score)
        sizes = np.array([len(f) for f in found] or [0], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *found])
        first = np.cumsum(sizes) - sizes
        which, row = coded.indices.to_numpy().astype(np.int64), row[filled]
        n = sizes[which]
        ends = np.cumsum(n)
        all_ids.append(flat[np.repeat(first[which] - ends + n, n) + np.arange(n.sum())])
        counts.append(np.bincount(row, weights=n, minlength=len(large)).astype(np.int64))
    return np.concatenate(all_ids), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def encode(texts: DataFrame, model: UnigramModel, limit: int = 510) -> DataFrame:
    """(key, ids, n_tokens, n_unknown) of (key, text): <s>, at most ``limit`` pieces (one at least), </s>; n_tokens and n_unknown count all pieces.

    Texts go through the character rules and are split at white space; each word gets a metaspace in front unless it has one. A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, pieces = Trie(dict(zip(model.rules, range(len(model.rules))))), Trie(dict(zip(model.pieces, range(len(model.pieces)))))
        begin, end = ([] if x is None else [x] for x in (model.begin, model.end))
        for b in batches:
            ids, offsets = encoded(b.column(1), model, rules, pieces)
            unknown = np.concatenate(([0], np.cumsum(ids == model.unknown)))
            held = [[*begin, *ids[s : min(e, s + max(1, limit))].tolist(), *end] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.list_(pa.int32())), pa.array(np.diff(offsets)), pa.array(unknown[offsets[1:]] - unknown[offsets[:-1]])], names=["key", "ids", "n_tokens", "n_unknown"])

    rows = texts.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key string, ids array<int>, n_tokens long, n_unknown long")
