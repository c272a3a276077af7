"""Compiled plans, kept for the next DataFrame of the same schema."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from threading import Lock
from typing import TypeVar

Made = TypeVar("Made")


class PlanCache:
    """The most recently used results of compilation; a failed one is not kept."""

    def __init__(self, size: int = 64):
        self.size = size
        self.hits = self.misses = 0
        self._kept: OrderedDict[Hashable, object] = OrderedDict()
        self._lock = Lock()

    def get(self, key: Hashable, make: Callable[[], Made]) -> Made:
        with self._lock:
            if key in self._kept:
                self.hits += 1
                self._kept.move_to_end(key)
                return self._kept[key]
        made = make()
        with self._lock:
            self.misses += 1
            self._kept[key] = made
            while len(self._kept) > self.size:
                self._kept.popitem(last=False)
        return made
