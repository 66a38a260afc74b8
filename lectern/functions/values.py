"""Small value functions: canonical JSON, redaction, plan ids, poll windows, defaults of annotations, readings of compiler logs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The colour of an annotation without one, and the request format that stands for each export format.
ANNOTATION_COLOUR = "#ffd400"
EXPORT_FORMATS = {"bib": "bibtex", "bibtex": "bibtex", "ris": "ris", "csljson": "csljson", "citation": "bib", "bibliography": "bib"}
REDACTED = "***"
#: What compilers print when their environment fails, as (reason, program that must be named, messages as the words of a line), in order of precedence.
ENVIRONMENT_MESSAGES = (
    ("updates", "", [["not checked for miktex updates"]]),
    ("download", "", [["api2.miktex.org"], ["going to download"]]),
    ("repository", "", [["cannot contact", "repository"]]),
    ("network", "miktex", [["fatal"], ["could not resolve host"], ["failed to connect"], ["connection timed out"], ["ssl connect error"], ["could not be contacted"]]),
)


def _normal(value):
    if isinstance(value, dict):
        return {k: _normal(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_normal(v) for v in value]
    return (value.strip() if value else None) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON texts that are equal for equal values: keys in order, no blanks, strings trimmed, empty ones null; null for what is no JSON."""

    def one(text):
        try:
            return json.dumps(_normal(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def redacted(c: Column, token: str | None) -> Column:
    """A text, JSON text included, with every occurrence of a secret replaced."""
    return F.replace(c, F.lit(token), F.lit(REDACTED)) if token else c


def plan_id(created: Column, n_changes: Column, suffix: Column) -> Column:
    """plan-, the time to the second in digits, the number of changes, and a suffix that the caller draws."""
    return F.concat_ws("-", F.lit("plan"), F.substring(F.regexp_replace(created, "[^0-9]", ""), 1, 14), n_changes.cast("string"), suffix)


def within_window(last: Column, now: Column, milliseconds: int) -> Column:
    """Whether the last synchronisation is at most so long ago, and not in the future; False without one."""
    gap = (F.unix_millis(now) - F.unix_millis(last)).cast("long")
    return F.coalesce((gap >= 0) & (gap < milliseconds), F.lit(False))


def with_annotation_defaults(text: Column, comment: Column, colour: Column) -> Column:
    """struct(text, comment, colour) with empty texts and the default colour for missing ones."""
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(comment, F.lit("")).alias("comment"), F.coalesce(colour, F.lit(ANNOTATION_COLOUR)).alias("colour"))


def undefined_lines(log: Column) -> Column:
    """The trimmed lines of a log that speak of something undefined."""
    return F.transform(F.filter(F.split(log, "\\r?\\n"), lambda x: x.rlike("(?i)undefined")), lambda x: F.trim(x))


def environment_issue(log: Column) -> Column:
    """Why a compiler's run failed for reasons of its environment: the first row of ENVIRONMENT_MESSAGES that the log shows; null for errors of the text itself.

    A row shows when one line holds all words of one of its messages and its program is named anywhere. A missing package alone is no
    such reason.
    """
    words = lambda message: F.array(*map(F.lit, message))
    rows = F.array(*[F.struct(F.lit(reason).alias("reason"), F.lit(program).alias("program"), F.array(*map(words, messages)).alias("messages")) for reason, program, messages in ENVIRONMENT_MESSAGES])
    low = F.lower(log)
    lines = F.split(low, "\n")
    says = lambda message: F.exists(lines, lambda line: F.forall(message, lambda w: F.contains(line, w)))
    shown = F.filter(rows, lambda r: F.contains(low, r["program"]) & F.exists(r["messages"], says))
    return F.get(shown, F.lit(0))["reason"]


def export_format(wanted: Column) -> Column:
    """The request format of an export format; null for one that is not requested."""
    return F.create_map(*[F.lit(x) for pair in EXPORT_FORMATS.items() for x in pair])[wanted]
