"""Small tables that a join sends to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a graph whose state is sent to all tasks, so that no link is shuffled to it.
HELD_NODES = 4_000_000


def held(state: DataFrame) -> DataFrame:
    """``state``, a small row a node, to be sent to all tasks by a join if it has few enough rows. It should be stored, as it is counted."""
    return F.broadcast(state) if state.count() <= HELD_NODES else state
