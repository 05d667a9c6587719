"""Queries over the tables, by theme; importing this package registers them all."""

from scriptorium.plans import chunking, coverage, curation, layout, retrieval, structure, workspace  # noqa: F401
