"""Token ids of whole texts under a public byte-level vocabulary.

Where the file's merges are in the order of their ids, so that tiktoken's ranks say the same, whole texts go
to tiktoken, which splits them by the vocabulary's pattern itself; else to tokenizers.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import words
from lectern.llm.bpe import SPACE, byte_alphabet

#: White space of this length is cut out of a text beforehand: tiktoken's matcher fails on runs of a million.
LONG_SPACE = 250_000

#: The vocabulary's split, with what needs no look ahead in one group, which tiktoken matches faster.
_SPLIT = rf"(?:'(?:[stmd]|re|ve|ll)| ?(?:\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+))|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class ByteTokens:
    """Encodes texts as a byte-level vocabulary does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.space = re.compile(f"[{SPACE}]+")
        self.ranks = self._ranks(path)

    def _ranks(self, path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if model["type"] != "BPE" or merged != sorted(merged) or len(merged) + 256 != len(model["vocab"]):
            return None
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items()}

    @functools.cached_property
    def whole(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("whole", pat_str=_SPLIT, mergeable_ranks=self.ranks, special_tokens={})

    @functools.cached_property
    def piece(self) -> tiktoken.Encoding:
        """Takes any string as one piece."""
        return tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})

    def _ordinary(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE:
            return self.whole.encode_ordinary(text)
        ids, at = [], 0
        for m in self.space.finditer(text):
            if m.end() - m.start() > LONG_SPACE:
                end = m.end() - (m.end() < len(text))  # the last one belongs to what follows
                ids += self.whole.encode_ordinary(text[at : m.start()]) + self.piece.encode_ordinary(text[m.start() : end])
                at = end
        return ids + self.whole.encode_ordinary(text[at:])

    def _encode(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            return self._ordinary(text)
        ids = []
        for part in self.split_special.split(text):
            ids += [self.special[part]] if part in self.special else self._ordinary(part)
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of self.dtype."""
        code = "H" if self.dtype is np.uint16 else "I"
        if self.ranks is None:
            return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [array(code, self._encode(t)).tobytes() for t in texts]


_loaded: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    if path not in _loaded:
        _loaded[path] = ByteTokens(path)
    return _loaded[path]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row's whole text; null text has none."""
    words.bound_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(path)
        for b in batches:
            for lo, to in words.slices(b.column(1)):
                part = b.slice(lo, to - lo)
                n = [len(x) // tokens.dtype().itemsize for x in tokens.encode_batch([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
