"""What the entry file adds where this subpackage is there."""

from skeinflow.llm.queries import QUERIES
from skeinflow.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
