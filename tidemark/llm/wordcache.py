"""Values of repeating pieces of text, made once per worker while they are remembered."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain


class Remembered:
    """``known``: piece -> value of ``make``. When it would hold more than ``limit`` pieces it forgets them all, which costs
    time only."""

    def __init__(self, make: Callable[[list], list], limit: int = 300_000):
        self.known: dict = {}
        self.make, self.limit = make, limit

    def learn(self, lists: Iterable[Iterable]) -> None:
        """Add all pieces of ``lists`` that are missing, in one call."""
        seen = set(chain.from_iterable(lists))
        new = seen.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = seen
        if new:
            new = list(new)
            self.known.update(zip(new, self.make(new)))
