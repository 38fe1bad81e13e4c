"""The registered queries with their SQL, and the reports."""

from foldline.plans import more, queries, whole  # noqa: F401  each adds to queries.QUERIES
