"""The registered queries: each operator over the given tables, with equivalent SQL to check it."""

from . import candidates, columns, feedback, ranking, sources, streams, summaries, tables  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
