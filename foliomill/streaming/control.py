"""Starting, pausing and ending streams from outside."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery


def run_until(query: StreamingQuery, stop: Callable[[], bool], poll: float = 0.2) -> bool:
    """Wait for a stream, but end it between two micro-batches once stop() says so; True if it was stopped.

    The checkpoint holds all that was committed, so the same query started again goes on from there. A stream that fails raises
    its error here.
    """
    while query.isActive:
        if stop():
            while query.isActive and query.status["isTriggerActive"]:
                time.sleep(poll / 10)
            query.stop()
            return True
        query.awaitTermination(poll)
    if error := query.exception():
        raise error
    return False
