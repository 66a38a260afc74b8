"""Tokenisers for passage budgets: basic words, WordPiece and unigram pieces over a vocabulary parameter."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Container, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx

#: Characters that stand alone.
PUNCTUATION = "!-/:-@\\[-`{-~\\u3000-\\u303f\\uff01-\\uff0f\\uff1a-\\uff20\\uff3b-\\uff40\\uff5b-\\uff65\\u2010-\\u2015\\u2026\\u2027\\u2032\\u2033\\u00b7"
IDEOGRAPHS = "\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff\\u3040-\\u30ff\\uac00-\\ud7af"


def basic_words(c: Column, ideographs_alone: bool = True) -> Column:
    """Folded words, each mark and, where asked for, each ideograph by itself: one expression, no Python."""
    alone = PUNCTUATION + (IDEOGRAPHS if ideographs_alone else "")
    return F.regexp_extract_all(tx.fold(c), F.lit(f"(?U)[{alone}]|[^\\s{alone}]+"), F.lit(0))


def ascii_words(c: Column) -> Column:
    """Words without the marks of any script; ASCII marks stand alone, and words end at ASCII white space only. Ideographs do not stand alone."""
    alone = "!-/:-@\\[-`{-~"
    return F.regexp_extract_all(tx.unmarked(c), F.lit(f"[{alone}]|[^\\t\\n\\f\\r {alone}]+"), F.lit(0))


def word_pieces(word: str, vocabulary: Container[str], unknown: str = "[UNK]") -> list[str]:
    """Longest pieces from the left, inner ones marked ##; a word with a gap is unknown as a whole."""
    out, at = [], 0
    while at < len(word):
        lead = "##" if at else ""
        size = next((n for n in range(len(word) - at, 0, -1) if lead + word[at : at + n] in vocabulary), 0)
        if not size:
            return [unknown]
        out.append(lead + word[at : at + size])
        at += size
    return out


def word_piece_lengths(vocabulary: list[str]):
    """For ``pages.chunk``: the lengths of the pieces of a white-space separated word; its marks and ideographs stand alone, an unknown part is one piece."""
    known = frozenset(vocabulary)
    parts = re.compile(f"[{PUNCTUATION}{IDEOGRAPHS}]|[^{PUNCTUATION}{IDEOGRAPHS}]+")

    def lengths(word: str) -> list[int]:
        out = []
        for part in parts.findall(word):
            pieces = word_pieces(decomposed(part), known)
            out += [len(part)] if len(pieces) == 1 else [len(p.removeprefix("##")) for p in pieces]
        return out

    return lengths


def unigram_pieces(text: str, scores: dict[str, float], longest: int = 32) -> list[str]:
    """The likeliest segmentation under piece log-probabilities; a character without a piece costs 10 more than the worst."""
    penalty = min(scores.values(), default=0.0) - 10
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            score = scores.get(piece, penalty if end - start == 1 else None)
            if score is not None and best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, start)
    out, at = [], len(text)
    while at:
        out.append(text[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def encode_word_pieces(texts: DataFrame, vocabulary: list[str], limit: int = 510, words_of: Callable[[Column], Column] = basic_words) -> DataFrame:
    """(key, ids, n_tokens, n_unknown) of (key, text): [CLS], at most ``limit`` pieces, [SEP]; n_tokens and n_unknown count all pieces.

    Words are made by Spark, as ``words_of`` says; Python only looks each distinct word of a batch up once.
    """
    ids = {t: k for k, t in enumerate(vocabulary)}
    if "[CLS]" not in ids or "[SEP]" not in ids or "[UNK]" not in ids:
        raise ValueError("the vocabulary lacks [CLS], [SEP] or [UNK]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = {w: [ids[p] for p in word_pieces(w, ids)] for w in {w for words in b["words"] for w in words}}
            rows = []
            for key, words in zip(b["key"], b["words"]):
                pieces = [i for w in words for i in known[w]]
                rows.append((key, [ids["[CLS]"], *pieces[:limit], ids["[SEP]"]], len(pieces), pieces.count(ids["[UNK]"])))
            yield pd.DataFrame(rows, columns=["key", "ids", "n_tokens", "n_unknown"])

    words = texts.select(F.col("key").cast("string"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    return words.mapInPandas(run, "key string, ids array<int>, n_tokens long, n_unknown long")


def decomposed(text: str) -> str:
    """Folding of the remaining scripts, for texts that ``tx.fold`` leaves: canonical decomposition without marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F).lower()
