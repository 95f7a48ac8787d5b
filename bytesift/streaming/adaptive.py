"""A pace for publishing that follows how long publishing takes."""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame

from bytesift.sources.store import Store
from bytesift.streaming.ingest import ingest_stream


class Pace:
    """The pause before the next batch: short while batches are quick, longer when they are not, doubled while they are slow.

    Quick and slow are told by the 95th percentile (nearest rank) of the last `window` durations, so a single long batch
    among many is passed over.
    """

    def __init__(self, quick_s: float = 1.0, slow_s: float = 5.0, short_s: float = 0.5, middle_s: float = 2.0, longest_s: float = 60.0, window: int = 16):
        if not 0 < quick_s <= slow_s or not 0 <= short_s <= middle_s <= longest_s or window < 1:
            raise ValueError("a pace needs quick <= slow and short <= middle <= longest")
        self.quick_s, self.slow_s, self.short_s, self.middle_s, self.longest_s = quick_s, slow_s, short_s, middle_s, longest_s
        self.samples: deque[float] = deque(maxlen=window)
        self.pause_s = short_s

    def p95(self) -> float:
        own = sorted(self.samples)
        return own[math.ceil(0.95 * len(own)) - 1] if own else 0.0

    def after(self, took_s: float) -> float:
        """The pause after a batch that took so long."""
        self.samples.append(took_s)
        p = self.p95()
        if p <= self.quick_s:
            self.pause_s = self.short_s
        elif p <= self.slow_s:
            self.pause_s = self.middle_s
        else:
            self.pause_s = min(self.longest_s, max(self.middle_s, 2 * self.pause_s))
        return self.pause_s


def ingest_paced(stream: Callable[[], DataFrame], store: Store, checkpoint: str, pace: Pace, go_on: Callable[[], bool], sleep: Callable[[float], None] = time.sleep) -> int:
    """Ingests whatever has come, pauses as the pace says, and so on while go_on(). Returns the number of rounds.

    Each round is a query that ends with what is there; the checkpoint carries the place from round to round.
    """
    rounds = 0
    while go_on():
        began = time.monotonic()
        ingest_stream(stream(), store, checkpoint).awaitTermination()
        rounds += 1
        sleep(pace.after(time.monotonic() - began))
    return rounds
