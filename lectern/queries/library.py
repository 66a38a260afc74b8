"""Imports every module of library queries, which registers them."""

from lectern.queries import catalogue, changes, embedded, enrich, exported, imported, index, journalled, planned, recorded, small, streamed, texts, tokenised  # noqa: F401
