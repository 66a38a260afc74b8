"""Pages and passages: page boundaries from form feeds, labels, paragraphs, token-budgeted chunks with offsets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page of (key, status, lengths), with running sums of all lengths of a batch at once."""
    for b in batches:
        lengths = b.column(2)
        n = np.diff(lengths.offsets.to_numpy())
        flat = lengths.flatten().to_numpy().astype(np.int64)
        ends, first = np.cumsum(flat), np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        base = np.concatenate(([0], ends))[first]
        page = np.arange(len(flat)) - first[row]
        start, end = ends - flat - base[row], ends - base[row] - (page == n[row] - 1)
        ints = [pa.array(x.astype(np.int32)) for x in (page, start, end, n[row])]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *ints, b.column(1).take(pa.array(row))], names=["key", "page", "start", "end", "n_pages", "status"])


def page_table(texts: DataFrame, separator: str = "\f") -> DataFrame:
    """(key, page, start, end, n_pages, status): one row per page of (key, text, pages).

    status is ok, no-separators, count-mismatch (``pages`` is known and differs) or empty-page; offsets are
    code points and a page keeps its separator, as in running text. Only ok pages are exact. A null text has no pages.
    """
    parts = texts.where("text is not null").select("key", "pages", F.split("text", separator).alias("parts"))
    n = F.size("parts")
    status = (
        F.when(n == 1, "no-separators").when((F.col("pages") > 0) & (F.col("pages") != n), "count-mismatch")
        .when(F.exists("parts", lambda p: F.trim(F.regexp_replace(p, "\\s", "")) == ""), "empty-page").otherwise("ok")
    )
    lengths = parts.select("key", status.alias("status"), F.transform("parts", lambda p: F.char_length(p) + 1).alias("lengths"))
    kind = texts.schema["key"].dataType.simpleString()
    return lengths.mapInArrow(_page_rows, f"key {kind}, page int, start int, end int, n_pages int, status string")


def page_label(page: Column, labels: Column, n_pages: Column) -> Column:
    """Label of a page from 0: its entry in the table, untrimmed, or its ordinal where that is missing or blank; empty outside the pages."""
    entry = F.get(labels, page)
    known = F.when(F.trim(entry) != "", entry)
    return F.when((page < 0) | (page >= n_pages), "").otherwise(F.coalesce(known, (page + 1).cast("string")))


def page_of(boundaries: Column, position: Column) -> Column:
    """Page from 0 that holds a position: boundaries are increasing and begin with 0."""
    return F.greatest(F.lit(0), F.size(F.filter(boundaries, lambda b: b <= position)) - 1)


def estimated_page(position: Column, length: Column, pages: Column) -> Column:
    """Page from 1, in proportion; null without a page count or a text."""
    return F.when((pages > 0) & (length > 0), F.least(pages, F.floor(position / (length / pages)).cast("int") + 1))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """(key, content_hash, n_chunks): first 16 hex digits of the digest of a key's chunk hashes, in order."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content_hash"))), lambda s: s["content_hash"]), "|")
    return chunks.groupBy("key").agg(F.substring(F.sha2(ordered.cast("binary"), 256), 1, 16).alias("content_hash"), F.count(F.lit(1)).alias("n_chunks"))


#: Code points of white space, and of marks that end a sentence.
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_ENDS = np.array([ord(c) for c in ".!?;\u3002\uff01\uff1f\uff1b"], np.uint32)


def _table(points: np.ndarray) -> np.ndarray:
    """Whether each code point up to the one behind the last of ``points`` is among them."""
    return np.isin(np.arange(points.max() + 2), points)


_IS_SPACE, _IS_END = _table(_SPACES), _table(_ENDS)

Spans = tuple[np.ndarray, np.ndarray]
#: Words whose pieces a task remembers.
KNOWN_WORDS = 200_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _among(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(points, len(table) - 1)]


def whitespace_tokens(text: str) -> Spans:
    """(starts, ends) of white-space separated tokens, in code points."""
    inside = np.concatenate(([False], ~_among(code_points(text), _IS_SPACE), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def boundary_ranks(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How good it is to cut before each token and after the last: 2 after a blank line, 1 after a line or sentence, else 0."""
    points = code_points(text)
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    rank = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        between = lines[starts[1:]] - lines[ends[:-1]]
        rank[1:-1] = np.where(between > 1, 2, (between > 0) | _among(points[ends[:-1] - 1], _IS_END))
        rank[-1] = 2
    return rank


def chunk_spans(text: str, max_tokens: int, overlap: float = 0.125, tokens: Callable[[str], Spans] = whitespace_tokens) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of overlapping chunks of at most ``max_tokens``.

    The text is tokenised once. A chunk that cannot hold the rest ends at the best boundary of its later
    half (the last of equals); the next one begins ``overlap`` of its tokens before that end. Together the
    chunks hold every token. ``tokens`` gives increasing start and end offsets of the tokens of any text.
    """
    if not 0 < overlap <= 0.2:
        raise ValueError(f"overlap must lie in (0, 0.2]: {overlap}")
    if max_tokens <= 0:
        raise ValueError(f"max_tokens must be positive: {max_tokens}")
    starts, ends = tokens(text)
    n, first, out = len(starts), 0, []
    rank = boundary_ranks(text, starts, ends)
    while first < n:
        cut = n
        if n - first > max_tokens:
            least = first + max(1, max_tokens // 2)
            later = rank[least : first + max_tokens + 1]
            cut = least + len(later) - 1 - int(later[::-1].argmax())
        out.append((int(starts[first]), int(ends[cut - 1]), cut - first))
        if cut == n:
            break
        first = cut - min(math.floor((cut - first) * overlap + 0.5), cut - first - 1)
    return out


#: The tokens of a text and the pieces that a model makes of each.
Weights = Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]


def weighted_spans(text: str, max_pieces: int, weights: Weights, overlap: float = 0.125) -> list[tuple[int, int, int]]:
    """(start, end, pieces) of overlapping chunks of at most ``max_pieces`` pieces: ``chunk_spans`` for tokens of unequal weight.

    Limits are looked up in the running sums of the weights, which increase. A chunk that cannot hold the rest ends at the best boundary
    of its later half; the next one begins at the first token from which on at most ``overlap`` of its pieces are repeated. Only a single token that is too heavy by itself
    makes a chunk beyond the limit: ``weights`` should split such tokens.
    """
    if not 0 < overlap <= 0.2:
        raise ValueError(f"overlap must lie in (0, 0.2]: {overlap}")
    if max_pieces <= 0:
        raise ValueError(f"max_pieces must be positive: {max_pieces}")
    starts, ends, weight = weights(text)
    sums = np.concatenate(([0], np.cumsum(weight)))
    n, first, out = len(starts), 0, []
    rank = boundary_ranks(text, starts, ends)
    while first < n:
        most = max(first + 1, int(np.searchsorted(sums, sums[first] + max_pieces, "right")) - 1)
        cut = n
        if most < n:
            least = min(most, max(first + 1, int(np.searchsorted(sums, sums[first] + max_pieces // 2, "left"))))
            later = rank[least : most + 1]
            cut = least + len(later) - 1 - int(later[::-1].argmax())
        out.append((int(starts[first]), int(ends[cut - 1]), int(sums[cut] - sums[first])))
        if cut == n:
            break
        repeated = math.floor((sums[cut] - sums[first]) * overlap + 0.5)
        first = max(first + 1, int(np.searchsorted(sums, sums[cut] - repeated, "left")))
    return out


def piece_weights(lengths_of: Callable[[str], list[int]], most: int) -> Weights:
    """Weights of white-space separated words from the lengths, in characters, of the pieces that a model makes of a word.

    A word of more than ``most`` pieces is split at every piece. Lengths that do not sum up to the word (a tokeniser may fold letters) count
    but do not split. Words are looked up once a task.
    """
    known: dict[str, list[int]] = {}

    def weights(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = whitespace_tokens(text)
        rows: list[tuple[int, int, int]] = []
        for s, e in zip(starts.tolist(), ends.tolist()):
            word = text[s:e]
            sizes = known.get(word)
            if sizes is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                sizes = known[word] = lengths_of(word)
            if len(sizes) <= most or sum(sizes) != e - s:
                rows.append((s, e, max(1, len(sizes))))
            else:
                at = s + np.concatenate(([0], np.cumsum(sizes)))
                rows += [(int(x), int(y), 1) for x, y in zip(at[:-1], at[1:])]
        columns = np.array(rows, np.int64).reshape(-1, 3)
        return columns[:, 0], columns[:, 1], columns[:, 2]

    return weights


def chunk(texts: DataFrame, max_tokens: int = 128, overlap: float = 0.125, lengths_of: Callable[[str], list[int]] | None = None) -> DataFrame:
    """(key, idx, text, char_start, char_end, content_hash, tokens) of (key, text); text[char_start:char_end] is the chunk's text.

    Tokens are white-space separated words or, with ``lengths_of`` (lengths of the pieces of a word), the pieces of a model. A null, empty or
    blank text has no chunks; rows that repeat a key are chunked each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = piece_weights(lengths_of, max_tokens) if lengths_of is not None else None
        for b in batches:
            keys, index, start, end, size, parts = [], [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = chunk_spans(text or "", max_tokens, overlap) if weights is None else weighted_spans(text or "", max_tokens, weights, overlap)
                keys += [key] * len(spans)
                index += range(len(spans))
                start += [x[0] for x in spans]
                end += [x[1] for x in spans]
                size += [x[2] for x in spans]
                parts += [text[x[0] : x[1]] for x in spans]
            ints = lambda v: pa.array(v, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), ints(index), pa.array(parts, pa.string()), ints(start), ints(end), ints(size)], names=["key", "idx", "text", "char_start", "char_end", "tokens"])

    rows = texts.select(F.col("key").cast("string"), F.col("text").cast("string")).mapInArrow(run, "key string, idx int, text string, char_start int, char_end int, tokens int")
    return rows.select("key", "idx", "text", "char_start", "char_end", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("content_hash"), "tokens")


def labelled_chunks(chunks: DataFrame, texts: DataFrame, separator: str = "\f") -> DataFrame:
    """chunks plus page_label and estimated, by the page that a chunk begins on. texts: key, text, pages and, optionally, labels (array, one a page).

    Where the separators agree with the page count (``page_table`` says ok), the page is exact and its
    label comes from the table. Otherwise it is estimated in proportion to the position, and without a page
    count there is no label. Pages and chunks of a text are put in one order, in which a chunk takes the last page begun.
    """
    t = texts.withColumn("key", F.col("key").cast("string"))
    labels = F.col("labels") if "labels" in texts.columns else F.lit(None).cast("array<string>")
    t = t.select("key", "text", F.col("pages").cast("int").alias("pages"), labels.alias("labels"))
    begun = page_table(t, separator).where("status = 'ok'").select("key", F.col("start").alias("at"), F.lit(None).cast("int").alias("idx"), "page", "n_pages")
    asked = chunks.select("key", F.col("char_start").alias("at"), "idx", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("n_pages"))
    so_far = Window.partitionBy("key").orderBy("at", F.col("idx").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    exact = begun.unionByName(asked).select("key", "idx", last("page"), last("n_pages")).where("idx is not null and page is not null").distinct()
    facts = t.select("key", "pages", "labels", F.char_length("text").alias("length"))
    rows = chunks.join(facts, "key", "left").join(exact, ["key", "idx"], "left")
    guess = estimated_page(F.col("char_start"), F.col("length"), F.col("pages"))
    at = F.coalesce("page", guess - 1)
    label = F.when(at.isNotNull(), page_label(at, F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("n_pages", "pages")))
    return rows.select(*[chunks[c] for c in chunks.columns], label.alias("page_label"), (F.col("page").isNull() & at.isNotNull()).alias("estimated"))


def paragraphs(c: Column) -> Column:
    """Array of a text's paragraphs: runs of lines that are not blank, without the white space around them."""
    parts = F.transform(F.split(c, "\n\\s*\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))
    return F.filter(parts, lambda p: p != "")
