"""The unigram tokeniser held against the tokenizers library, a naive longest match and a map written here."""

import base64
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from lectern.operators import unigram


def double_array(rules):
    """A precompiled character map of {bytes: replacement}, written by first fit."""
    texts, starts = b"", {}
    for key, value in rules.items():
        starts[key] = len(texts)
        texts += value + b"\0"
    units, used = {0: 0}, {0}
    todo = [(0, b"")]
    while todo:
        node, path = todo.pop()
        labels = sorted({k[len(path)] for k in rules if len(k) > len(path) and k.startswith(path)})
        value = path in rules and path != b""
        # a node's children lie at node ^ offset ^ label, its value at node ^ offset
        offset = next(o for o in range(1, 1 << 20) if all((node ^ o ^ x) not in used for x in [*labels, *([0] if value else [])]))
        units[node] = units[node] & 0x800000FF | offset << 10 | (0x100 if value else 0)
        if value:
            used.add(node ^ offset)
            units[node ^ offset] = 0x80000000 | starts[path]
        for x in labels:
            child = node ^ offset ^ x
            used.add(child)
            units[child] = x
            todo.append((child, path + bytes([x])))
    array = np.zeros(max(units) + 1, np.uint32)
    for k, v in units.items():
        array[k] = v
    return (4 * len(array)).to_bytes(4, "little") + array.tobytes() + texts


RULES = {"A": "a", "Ä": "ae", "ﬁ": "fi", "á": "á", "ab": "X", "abc": "", "　": " ", "日本": "nihon", "～": "~"}
RULES = {k.encode(): v.encode() for k, v in RULES.items()}


def naive(text):
    out, b, i = b"", text.encode(), 0
    while i < len(b):
        hit = max((k for k in RULES if b.startswith(k, i)), key=len, default=None)
        if hit is None:
            n = len(text.encode()[i:].decode()[0].encode())
            out, i = out + b[i : i + n], i + n
        else:
            out, i = out + RULES[hit], i + len(hit)
    return out.decode()


def some_texts(n=200):
    r = random.Random(4)
    return ["".join(r.choices(["A", "a", "b", "c", "Ä", "ﬁ", "́", " ", "　", "日", "本", "～", "z", "\n", "😀", "▁"], k=r.randint(0, 40))) for _ in range(n)] + ["", "abc", "ab", "a" * 3000, "abcab" * 400]


def test_character_map_is_unfolded_and_applied_longest_first():
    assert unigram.decoded_rules(double_array(RULES)) == RULES
    texts = some_texts()
    array = pa.array(texts, pa.large_string())
    offsets, data = np.frombuffer(array.buffers()[1], np.int64), np.frombuffer(array.buffers()[2], np.uint8)
    buf, ends = unigram.normalised(data[: offsets[-1]], offsets, unigram.Trie(dict(zip(RULES, range(len(RULES))))), list(RULES.values()))
    assert [bytes(buf[s:e]).decode() for s, e in zip(ends[:-1], ends[1:])] == [naive(t) for t in texts]


def random_vocabulary(seed=1):
    r = random.Random(seed)
    pieces = {"<unk>": 0.0}
    for _ in range(300):
        pieces["".join(r.choices("▁abcXfi~z日", k=r.randint(1, 5)))] = -r.random() * 10
    return list(pieces.items())


def test_pieces_equal_the_library():
    vocabulary = random_vocabulary()
    library = Tokenizer(models.Unigram(vocabulary, 0))
    r = random.Random(9)
    words = ["▁" + "".join(r.choices("abcXfi~z日é😀", k=r.randint(1, 30))) for _ in range(400)] + ["▁" + "ab" * 500, "▁"]
    trie = unigram.Trie({p: k for k, (p, _) in enumerate(vocabulary)})
    scores = np.array([s for _, s in vocabulary])
    got = unigram.best_pieces(words, trie, scores, 0, scores.min() - 10)
    for word, ids in zip(words, got):
        expected, own = library.encode(word).ids, ids.tolist()
        merged = [i for k, i in enumerate(own) if i or not k or own[k - 1]]  # the library joins neighbouring unknown characters
        assert merged == [i for k, i in enumerate(expected) if i or not k or expected[k - 1]]


def test_whole_texts_of_a_model_file(spark):
    vocabulary = random_vocabulary(2)
    raw = {"model": {"type": "Unigram", "unk_id": 0, "vocab": vocabulary}, "normalizer": {"type": "Precompiled", "precompiled_charsmap": base64.b64encode(double_array(RULES)).decode()}, "added_tokens": [{"id": 1001, "content": "<s>"}, {"id": 1002, "content": "</s>"}]}
    model = unigram.read_model(json.dumps(raw))
    trie, scores = unigram.Trie({p: k for k, (p, _) in enumerate(vocabulary)}), np.array([s for _, s in vocabulary])
    texts = some_texts(60) + [None]
    rows = unigram.encode(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, text string"), model, 20).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = naive(texts[int(r["key"])] or "").split()
        ids = [int(i) for found in unigram.best_pieces([w if w.startswith("▁") else "▁" + w for w in words], trie, scores, 0, scores.min() - 10) for i in found]
        assert (r["ids"], r["n_tokens"], r["n_unknown"]) == ([1001, *ids[:20], 1002], len(ids), ids.count(0))
    for part, value in (("model", {"type": "BPE"}), ("normalizer", {"type": "NFC"}), ("added_tokens", [])):
        with pytest.raises(ValueError):
            unigram.read_model(json.dumps(raw | {part: value}))
