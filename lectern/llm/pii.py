"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
#: What follows an IBAN's first four characters, at its greatest length; and at the length that its country fixes.
_IBAN_REST = re.compile(r"(?:[\x20-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AO25 AT20 AZ28 BA20 BE16 BF28 BG22 BH22 BI27 BJ28 BR29 BY28 CF27 CG27 CH21 CI28 CM27 CR22 CV25 CY28 CZ24 DE22 DJ27 DK18 DO28 DZ26 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
    "GA27 GB22 GE22 GI23 GL18 GQ27 GR27 GT28 GW25 HN28 HR21 HU28 IE22 IL23 IQ23 IR26 IS26 IT27 JO30 KM27 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MA28 MC27 MD24 ME22 MG27 MK19 ML28 "
    "MN20 MR27 MT31 MU30 MZ25 NE28 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SN28 SO23 ST25 SV28 TD27 TG28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
_IBAN_FIXED = {x[:2]: re.compile(rf"(?:[\x20-]?[A-Z0-9]){{{int(x[2:]) - 4}}}(?![A-Za-z0-9])") for x in _IBAN_LENGTHS.split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
#: Score of a proposed span by kind, before its words nearby; a span of the base kinds is kept at any score.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "split card": 0.5, "local phone": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.IGNORECASE) for k, v in CONTEXT.items()}
NEAR, GAIN, THRESHOLD = 40, 0.3, 0.5

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 of an IBAN without separators."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that pass mod 97, at their country's length or, failing that, at the greatest one; a failed start hides nothing after its country code."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 2
        for rest in (_IBAN_FIXED.get(m[0][:2]), _IBAN_REST):
            r = rest.match(text, m.end()) if rest else None
            if r and mod97(text[m.start() : r.end()].replace(" ", "").replace("-", "")):
                yield m.start(), r.end()
                at = r.end()
                break


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.name, from each @ outwards: linear for any text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def _scored(text: str, start: int, end: int, kind: str, prior: str | None = None) -> Span:
    near = _CONTEXT[kind].search(text[max(0, start - NEAR) : start]) or _CONTEXT[kind].search(text[end : end + NEAR])
    return start, end, kind, min(1.0, PRIOR[prior or kind] + (GAIN if near else 0))


def _split_cards(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Card numbers inside a digit run that is none as a whole: runs of its groups with 13 to 19 digits that pass Luhn, longest first."""
    groups = [(m.start(), m.end()) for m in re.compile(r"[0-9]+").finditer(text, start, end)]
    k = 0
    while k < len(groups):
        digits, best = "", None
        for j in range(k, len(groups)):
            digits += text[groups[j][0] : groups[j][1]]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and digits[0] in "23456" and luhn(digits):
                best = j
        if best is None:
            k += 1
        else:
            yield groups[k][0], groups[best][1]
            k = best + 1


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each (start, end, kind, score) in code points, end exclusive.

    Base: the four base kinds as their patterns and checks define them. Added, where no base span is:
    IBANs that pass mod 97, card numbers inside longer digit runs, and numbers in the form of a
    national telephone or social security number with a word nearby that says so.
    """
    base: list[Span] = []
    added: list[Span] = []
    if "@" in text:
        base += [_scored(text, a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                base.append(_scored(text, *m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                base.append(_scored(text, *m.span(), "card"))
            elif len(digits) > 13:
                added += [_scored(text, a, b, "card", "split card") for a, b in _split_cards(text, *m.span())]
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    base.append(_scored(text, *m.span(), "phone"))
        added += [_scored(text, a, b, "iban") for a, b in ibans(text)]
        added += [_scored(text, *m.span(), "ssn") for m in _SSN.finditer(text)]
        added += [_scored(text, *m.span(), "phone", "local phone") for m in _LOCAL_PHONE.finditer(text)]
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda s: (s[0], order[s[2]])
    base.sort(key=key)
    covered = _disjoint(base)
    kept: list[Span] = []
    for s in sorted(added, key=lambda s: (-s[3], s[0])):
        if s[3] >= THRESHOLD:
            at = bisect_left(covered, (s[1],))  # intervals that begin before the span ends
            if at == 0 or covered[at - 1][1] <= s[0]:
                kept.append(s)
                covered.insert(at, s[:2])
    return base, sorted(kept, key=key)


def _disjoint(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that spans sorted by start cover."""
    out: list[tuple[int, int]] = []
    for a, b, *_ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k, _ in spans])


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by the kind of its first one in brackets."""
    kind = {}
    for a, _, k, _ in spans:
        kind.setdefault(a, k)
    out, at = [], 0
    for a, b in _disjoint(spans):
        out += [text[at:a], f"[{kind[a].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base (text), spans (text), items (array of kind, start, end, score), masked (text).

    Whole texts are searched. Defined cases: null text counts as empty and has no spans; rows are
    independent, so repeated ids, null ids and other columns do not matter; an empty table gives an
    empty result.
    """
    words.bound_batches(docs.sparkSession)
    schema = "doc_id long, base string, spans string, items array<struct<kind:string,start:int,end:int,score:double>>, masked string"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for b in batches:
            for lo, to in words.slices(b.column(1)):
                part = b.slice(lo, to - lo)
                rows: list[tuple] = []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    base, added = find(text)
                    both = sorted(base + added, key=lambda s: (s[0], order[s[2]]))
                    rows.append((joined(base), joined(both), [{"kind": k, "start": a, "end": e, "score": s} for a, e, k, s in both], mask(text, both) if both else text))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), item, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "base", "spans", "items", "masked"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, the digest of the base spans, and all spans; one row per row of docs.

    Defined cases are those of ``find_spans``: null text has no spans, counts of 0 and the digest of the
    empty string; repeated and null ids give a row each; an empty table gives an empty result.
    """
    found = find_spans(docs)
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def mask_spans(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the spans in ``text_col`` masked and ``chars_col``, where present, counted anew.

    Defined cases: null text stays null with its count; a text without spans stays as it is; rows are
    independent, so repeated and null ids do not matter; an empty table gives an empty result; all columns stay.
    """
    words.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for lo, to in words.slices(b.column(at)):
                part = b.slice(lo, to - lo)
                masked = []
                for text in part.column(at).to_pylist():
                    if text is not None:
                        base, added = find(text)
                        text = mask(text, sorted(base + added, key=lambda s: (s[0], order[s[2]]))) if base or added else text
                    masked.append(text)
                yield part.set_column(at, part.schema.field(at), pa.array(masked, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.char_length(text_col)).cast(docs.schema[chars_col].dataType))
    return out
