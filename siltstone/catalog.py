"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from siltstone.plans import ORACLE_SQL, QUERIES, chats, corpus, documents, evaluation, indexes, passages, search, tokens, vectors

__all__ = ["ORACLE_SQL", "QUERIES", "chats", "corpus", "documents", "evaluation", "indexes", "passages", "search", "tokens", "vectors"]
