"""The search ladder: passages by meaning, else full text, else titles, with the reasons for each step down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import stats
from lectern.storage import materialize


def ladder(items: DataFrame, trashed: DataFrame, query: str, semantic: Callable[[str], DataFrame] | None = None, limit: int = 25, **filters) -> DataFrame:
    """The hits of the first level that has any, with columns level and degraded (why the levels above were left).

    ``semantic`` gives rows with a key, best first by ``score``, or raises ValueError where there is no fitting
    index; its hits are held against the same filters as the others. Then the full text (column text) is
    searched, then titles, authors and dates, as far as items have them. Items in the trash never appear.
    """
    reasons: list[str] = []
    alive = stats.in_trash(items, trashed).where("not deleted")
    if semantic is not None:
        try:
            allowed = alive.where(stats.matching("", [], **filters)).select("key")
            hits = materialize(semantic(query).join(allowed, "key", "left_semi").orderBy(F.desc("score"), "key").limit(max(1, limit)), "hits")
            if not hits.isEmpty():
                return hits.withColumn("level", F.lit("semantic")).withColumn("degraded", F.array().cast("array<string>"))
            reasons.append("semantic: no hits")
        except ValueError as e:
            reasons.append(f"semantic: {e}")
    hits, level = alive.limit(0), "none"
    titles = [c for c in ("title", "author", "date") if c in items.columns]
    for level, columns in (("fulltext", ["text"] if "text" in items.columns else []), ("keyword", titles)):
        if not columns:
            reasons.append(f"{level}: nothing to search")
            continue
        hits = materialize(stats.search(alive, query, columns, limit=limit, **filters), "hits")
        if level == "keyword" or not hits.isEmpty():
            break
        reasons.append(f"{level}: no hits")
    return hits.withColumn("level", F.lit(level)).withColumn("degraded", F.array(*map(F.lit, reasons)).cast("array<string>"))
