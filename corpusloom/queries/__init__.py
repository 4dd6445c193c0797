"""Named queries over the given tables, each with the SQL that says the same where SQL can."""

from corpusloom.queries import activity, references, searches, texts

MODULES = [activity, references, searches, texts]


def all_queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
