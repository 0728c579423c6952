"""What a Python worker keeps between batches and tasks: values by key, bounded
in bytes. Only speed depends on it; a fresh worker starts empty."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable

ENTRY = 300  # bytes of a dictionary entry and its objects


class Remembered:
    """Key -> value in two generations. ``learn`` returns a dictionary that has
    all keys of a batch; what the last generations did not use is forgotten
    once a generation holds ``limit`` bytes (after the batch, so at most
    ``2 * limit`` and the values of two batches are held)."""

    def __init__(self, compute: Callable[[list], Iterable], limit: int, weigh: Callable[[object], int] = len):
        self.compute, self.weigh, self.limit = compute, weigh, limit
        self.now: dict = {}
        self.old: dict = {}
        self.held = 0

    def learn(self, keys: set) -> dict:
        if self.held > self.limit:
            self.old, self.now, self.held = self.now, {}, 0
        missing = keys.difference(self.now)
        if missing:
            again = [k for k in missing if k in self.old]
            new = list(missing.difference(again))
            for found, values in ((again, [self.old[k] for k in again]), (new, list(self.compute(new)))):
                self.now.update(zip(found, values, strict=True))
                self.held += ENTRY * len(found) + sum(map(len, found)) + sum(map(self.weigh, values))
        return self.now


def in_worker(key: tuple, make: Callable[[], object]) -> object:
    """One object per key and Python process. Task functions are pickled by
    value, so their own globals do not outlive a task."""
    kept = sys.modules.setdefault("paramforge_worker_state", types.ModuleType("paramforge_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
