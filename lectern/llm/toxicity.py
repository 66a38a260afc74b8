"""Toxicity by compression distance: windows are compressed with a dictionary trained on toxic text and one trained on ordinary text.

Text is first written as one 8-byte code a word (its hash), so that what a dictionary matches is a
word or a phrase and all else is incompressible. Most of a toxic document is ordinary text, so the toxic
dictionary keeps those stretches of toxic documents that compress better with dictionaries trained on the
windows of other toxic documents than with ones trained on ordinary windows, in repeated fits that have not
seen the stretch's document. Both dictionaries end with the one trained on ordinary windows, so that ordinary
text costs the same with either. The bytes a window saves with the toxic one are the evidence; windows count
from a calibrated threshold on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.labelled import fold, labelled
from lectern.llm.ngram_join import minhashes
from lectern.llm.quality import isotonic

#: Words a window, compression level, labelled documents of each label that the fit samples (about), and the
#: bytes of their texts it takes at most, half of them for each label.
WINDOW, LEVEL, FIT_DOCS, FIT_BYTES = 16, 6, 4000, 96_000_000
#: Windows that the fit takes of one document at most, and the bytes that such a document counts as at most.
DOC_WINDOWS, DOC_BYTES = 1024, 1 << 17
#: Bytes of a dictionary trained on ordinary and of one trained on toxic windows, and the windows of a label that one
#: dictionary is trained on at most (chosen at random; zstandard's training takes some ten times their bytes).
ORDINARY_BYTES, TOXIC_BYTES, TRAIN_WINDOWS = 1 << 19, 1 << 16, 40_000
#: Rounds of fits on all parts of the documents but one, the parts, the rounds that a stretch must win, the bytes it
#: must save to win, and the documents that must hold it.
ROUNDS, PARTS, WINS, SAVES, LEAST = 3, 4, 3, 3, 3
#: Window thresholds to choose from, and parts of the documents that are scored in turn to calibrate.
THRESHOLDS, CALIBRATION = range(3, 9), 3


def word_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of each word."""
    codes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, to in words.slices(text):
        buf, offsets = words.raw_bytes(pc.utf8_lower(pc.fill_null(text.slice(lo, to - lo), "")))
        start, end, doc = words.spans(buf, offsets)
        if len(start):
            codes.append(words.span_hashes(buf, start, end)), docs.append(doc + lo)
    return np.concatenate(codes), np.concatenate(docs)


def windows(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of the windows of each document: one after the other, the last one reaches back to be full."""
    count = np.bincount(doc, minlength=n)
    first, k = np.cumsum(count) - count, -(-count // WINDOW)
    owner = np.repeat(np.arange(n), k)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
    return owner, first[owner] + np.clip(count[owner] - WINDOW, 0, j * WINDOW)


def filled(codes: np.ndarray, doc: np.ndarray, n: int, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word codes with documents of fewer words than a window filled up by frequent words."""
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < WINDOW))
    if not len(short):
        return codes, doc
    more = WINDOW - count[short]
    at = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    codes, doc = np.concatenate((codes, fill[at])), np.concatenate((doc, np.repeat(short, more)))
    order = np.argsort(doc, kind="stable")
    return codes[order], doc[order]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)


def _lengths(codes: np.ndarray, start: np.ndarray, content: bytes) -> np.ndarray:
    """Compressed length of each window with a dictionary."""
    out, compressor = np.zeros(len(start), np.int64), _compressor(content)
    for lo in range(0, len(start), 1 << 14):
        a = start[lo : lo + (1 << 14)]
        segments = np.stack([(a - a[0]) * 8, np.full(len(a), WINDOW * 8)], axis=1).astype(np.uint64).tobytes()
        part = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(codes[a[0] : a[-1] + WINDOW].tobytes(), segments))
        out[lo : lo + len(a)] = np.fromiter((len(x) for x in part), np.int64, len(a))
    return out


@dataclass
class ToxicityModel:
    """Contents of the two dictionaries, frequent words that fill up short documents, the window threshold in bytes and the calibration curve."""

    toxic: bytes
    ordinary: bytes
    fill: np.ndarray
    threshold: int = 4
    curve_x: tuple[float, ...] = (0.0,)
    curve_y: tuple[float, ...] = (0.0,)

    def savings(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, bytes the toxic dictionary saves) of each window."""
        return self.saved(*word_codes(text), len(text))

    def saved(self, codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``savings`` of n documents by their word codes."""
        codes, doc = filled(codes, doc, n, self.fill)
        owner, start = windows(doc, n)
        return owner, _lengths(codes, start, self.ordinary) - _lengths(codes, start, self.toxic)

    def evidence(self, owner: np.ndarray, saved: np.ndarray, n: int) -> np.ndarray:
        """Windows from the threshold on, over the root of the number of windows."""
        return np.bincount(owner, saved >= self.threshold, n) / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))

    def scores(self, text: pa.Array) -> np.ndarray:
        x = self.evidence(*self.savings(text), len(text))
        return np.clip(0.995 * np.interp(x, self.curve_x, self.curve_y) + 0.005 * x / (1 + x), 0, 1)


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(8 MinHash values of each document, whether it has words)."""
    s, offsets = words.shingles(text)
    return minhashes(s, offsets)[:, :8], offsets[:-1] < offsets[1:]


def distinct_documents(signature: np.ndarray) -> np.ndarray:
    """Rows that share none of 8 MinHash values with an earlier one: copies must not pass for independent evidence."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for k, m in enumerate(signature):
        key = set(enumerate(m.tolist()))
        if not key & seen:
            keep.append(k)
        seen |= key
    return np.array(keep, np.int64)


def excerpt(codes: np.ndarray) -> tuple[np.ndarray, float]:
    """(word codes, windows of the document by windows taken): all of a document, or DOC_WINDOWS windows of a longer one, chosen by hash."""
    n = -(-len(codes) // WINDOW)
    if n <= DOC_WINDOWS:
        return codes, 1.0
    full = codes[: len(codes) // WINDOW * WINDOW].reshape(-1, WINDOW)
    order = np.argsort(words.mix(full.sum(axis=1, dtype=np.uint64) + np.arange(len(full), dtype=np.uint64)), kind="stable")
    return full[np.sort(order[:DOC_WINDOWS])].reshape(-1), n / DOC_WINDOWS


def _trained(codes: np.ndarray, start: np.ndarray, size: int, k: int, rng: np.random.Generator) -> bytes:
    """A dictionary trained on windows, from segments of k bytes; the windows' own bytes where they are too few to train on."""
    some = rng.permutation(start)[:TRAIN_WINDOWS]
    samples = [codes[i : i + WINDOW].tobytes() for i in some.tolist()]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _pair(codes: np.ndarray, start: np.ndarray, toxic: np.ndarray, rng: np.random.Generator) -> tuple[bytes, bytes]:
    """Dictionaries trained on the windows of toxic and on those of ordinary documents; each ends with the ordinary one."""
    ordinary = _trained(codes, start[~toxic], ORDINARY_BYTES, 16, rng)
    return _trained(codes, start[toxic], TOXIC_BYTES, 8, rng) + ordinary, ordinary


def _word_savings(words_: np.ndarray, fill: np.ndarray, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each word amid frequent ones."""
    half = WINDOW // 2
    rows = np.tile(np.concatenate((fill[:half], fill[:1], fill[half : WINDOW - 1])), (len(words_), 1))
    rows[:, half] = words_
    start = np.arange(len(words_)) * WINDOW
    return _lengths(rows.reshape(-1), start, ordinary) - _lengths(rows.reshape(-1), start, toxic)


def train(codes: np.ndarray, doc: np.ndarray, label: np.ndarray) -> ToxicityModel:
    """Dictionaries from word codes of distinct documents, in document order."""
    rng = np.random.default_rng(5)
    ordinary_words, times = np.unique(codes[label[doc] == 0], return_counts=True)
    fill = np.resize(ordinary_words[np.argsort(-times, kind="stable")[:WINDOW]], WINDOW) if len(times) else np.arange(WINDOW, dtype=np.uint64)
    del ordinary_words, times
    codes, doc = filled(codes, doc, len(label), fill)
    owner, start = windows(doc, len(label))
    whole = np.append(start[1:] - start[:-1] >= WINDOW, True)[: len(start)]  # not met again in a window that reaches back
    owner, start = owner[whole], start[whole]
    toxic = label[owner] == 1
    inside = np.flatnonzero(label[doc] == 1)
    seen, word = np.unique(codes[inside], return_inverse=True)
    wins = np.zeros(len(inside), np.int8)
    for r in range(ROUNDS):
        part = rng.permutation(len(label)) % PARTS
        for p in range(PARTS):
            own = np.flatnonzero((part[doc[inside]] == p) & (wins >= r + WINS - ROUNDS))
            rest = part[owner] != p
            if not len(own) or toxic[rest].all() or not toxic[rest].any():
                continue
            pair = _pair(codes, start[rest], toxic[rest], rng)
            asked, inverse = np.unique(word[own], return_inverse=True)
            wins[own] += (_word_savings(seen[asked], fill, *pair) >= SAVES)[inverse]
    # runs of winning words, and each of the words, are the stretches; the one most documents hold comes last
    at = np.flatnonzero(wins >= WINS)
    new = np.append(True, (np.diff(inside[at]) != 1) | (np.diff(doc[inside[at]]) != 0))[: len(at)]
    held: dict[bytes, set[int]] = {}
    for run in [*np.split(at, np.flatnonzero(new)[1:]), *at[:, None]]:
        if len(run):
            held.setdefault(codes[inside[run]].tobytes(), set()).add(int(doc[inside[run[0]]]))
    stretches = sorted((x for x, d in held.items() if len(d) >= LEAST), key=lambda x: (len(held[x]), x))
    ordinary = _trained(codes, start[~toxic], ORDINARY_BYTES, 16, rng) or b"\0" * 8
    return ToxicityModel(b"".join(stretches) + ordinary, ordinary, fill)


def fit(codes: np.ndarray, doc: np.ndarray, label: np.ndarray, grown: np.ndarray) -> ToxicityModel | None:
    """Train on all documents; threshold and curve come from documents scored with dictionaries that have not seen them."""
    if not len(label) or label.min() == label.max():
        return None
    label = label.astype(float)
    model = train(codes, doc, label)
    owner, saved = [], []
    part = np.random.default_rng(6).permutation(len(label)) % CALIBRATION
    for p in range(CALIBRATION):
        rest = part != p
        if not rest.any() or label[rest].min() == label[rest].max():
            rest = np.ones(len(part), bool)
        inside = rest[doc]
        most = train(codes[inside], (np.cumsum(rest) - 1)[doc[inside]], label[rest])
        rows, inside = np.flatnonzero(part == p), (part == p)[doc]
        o, s = most.saved(codes[inside], (np.cumsum(part == p) - 1)[doc[inside]], len(rows))
        owner.append(rows[o]), saved.append(s)
    owner, saved = np.concatenate(owner), np.concatenate(saved)

    def gap(t: int) -> float:
        model.threshold = t
        hit = model.evidence(owner, saved, len(label)) > 0
        return hit[label == 1].mean() - hit[label == 0].mean()

    model.threshold = max(THRESHOLDS, key=gap)
    # windows of an excerpt stand for all windows of their document
    x = np.round(model.evidence(owner, saved, len(label)) * np.sqrt(grown), 2)
    level, inverse = np.unique(x, return_inverse=True)
    cx, cy = isotonic(level, np.bincount(inverse, label), np.bincount(inverse).astype(float))
    model.curve_x, model.curve_y = tuple(cx), tuple(cy)
    return model


def _within_budget(label: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of each label that its half of FIT_BYTES holds, in the order of their hashes; the first one always."""
    take = []
    for k in (0, 1):
        rows = np.flatnonzero(label == k)
        rows = rows[np.argsort(order[rows], kind="stable")]
        n = int(np.searchsorted(np.cumsum(size[rows]), FIT_BYTES // 2, "right"))
        take.append(rows[: max(1, n)])
    return np.sort(np.concatenate(take))


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """Fit on a hash sample of about FIT_DOCS labelled documents of each label, held to FIT_BYTES.

    The sizes of the sampled documents decide which are taken, by hash order within each label; a long
    one counts with its excerpt only, so that none can use up the budget or fall out of it. Texts become
    word codes in the tasks and do not reach the driver.
    """
    words.bound_batches(docs.sparkSession)
    known = labelled(labels, label_col)
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    share = F.create_map(*[F.lit(v) for k in (0, 1) for v in (k, int(min(1.0, FIT_DOCS / max(1, counts.get(k, 1))) * (1 << 30)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("label")])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("text", F.lit(1)))
    sizes = rows.select("doc_id", "h", "label", F.least(F.octet_length("text"), F.lit(DOC_BYTES)).alias("size"), F.xxhash64("doc_id", "h", F.lit(2)).alias("o")).distinct().toArrow()
    if not len(sizes):
        return None
    sizes = sizes.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    kept = _within_budget(*(sizes.column(c).to_numpy() for c in ("label", "size", "o")))
    ids, hashes = (sizes.column(c).to_numpy()[kept] for c in ("doc_id", "h"))
    chosen = docs.sparkSession.createDataFrame(pa.table({"doc_id": np.unique(ids)}))
    wanted = set(zip(ids.tolist(), hashes.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            b = b.filter(pa.array([p in wanted for p in pairs], pa.bool_()))
            for lo, to in words.slices(b.column(3)):
                part = b.slice(lo, to - lo)
                signature, full = signatures(part.column(3))
                codes, doc = word_codes(part.column(3))
                at = np.searchsorted(doc, np.arange(to - lo + 1))
                taken = [excerpt(codes[at[k] : at[k + 1]]) for k in np.flatnonzero(full)]
                columns = [pa.array([c.tobytes() for c, _ in taken], pa.binary()), pa.array([g for _, g in taken], pa.float64()), pa.array([m.tobytes() for m in signature[full]], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.filter(pa.array(full)).columns[:3], *columns], names=["doc_id", "h", "label", "codes", "grown", "signature"])

    coded = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "h", "label", "text")
    table = coded.mapInArrow(run, "doc_id long, h long, label int, codes binary, grown double, signature binary").toArrow()
    order = np.lexsort((table.column("h").to_numpy(), table.column("doc_id").to_numpy()))
    signature = np.array([np.frombuffer(table.column("signature")[k].as_py(), np.uint32) for k in order.tolist()])
    order = order[distinct_documents(signature)]
    parts = [np.frombuffer(table.column("codes")[k].as_buffer(), np.uint64) for k in order.tolist()]
    codes = np.concatenate([np.zeros(0, np.uint64), *parts])
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    label, grown = (table.column(c).to_numpy()[order] for c in ("label", "grown"))
    del table, parts
    return fit(codes, doc, label, grown)


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that ``toxicity_scores`` predicts as 0, with all their columns; rows are judged one by one, without a shuffle of texts.

    Defined cases are those of ``toxicity_scores``: null, empty and wordless texts stay, rows that repeat
    an id or have none are judged each by its text, and without labels of both kinds all rows stay.
    """
    model = fit_on(docs, labels, label_col, id_col, text_col)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for lo, to in words.slices(b.column(at)):
                part = b.slice(lo, to - lo)
                yield part.filter(pa.array(model.scores(part.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted; score estimates the probability of label 1.

    Every window of the whole text is compressed; the text is the only input of a score. Labels are
    learnt from rows whose crc32(doc_id as text) mod 3 is not 1: a hash sample of about FIT_DOCS
    documents of each label within its half of FIT_BYTES, copies left out.

    Defined cases: null text counts as empty; a text without words has no evidence and gets the lowest
    score; a row without an id is scored, is not held out and teaches nothing; rows that repeat an id
    are scored each; without labels of both kinds every score is 0; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    model = fit_on(docs, labels, label_col, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, to in words.slices(b.column(1)):
                part = b.slice(lo, to - lo)
                s = np.zeros(to - lo) if model is None else model.scores(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
