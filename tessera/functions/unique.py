"""Unique names for things the driver knows: columns, tables, headers."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Names:
    """Hands out names that differ from all it has handed out before.

    ``same`` maps a name to what must differ (case folding, say); ``limit``
    bounds the length, in which case the name is cut so that its ending fits.
    """

    def __init__(self, same: Callable[[str], str] = lambda n: n, limit: int | None = None, taken: Iterable[str] = ()):
        self.same, self.limit = same, limit
        self.gone = {same(n) for n in taken}
        self.next: dict[str, int] = {}  # of names that have been numbered: lower numbers are gone for good

    def _ended(self, name: str, ending: str) -> str:
        return name + ending if self.limit is None else name[: max(0, self.limit - len(ending))] + ending

    def is_free(self, name: str) -> bool:
        return self.same(name) not in self.gone

    def take(self, name: str, endings: Callable[[int], str] | None = None, first: int = 2) -> str:
        """``name`` if it is free, else with the first of ``endings(first)``, ``endings(first + 1)`` ... that is."""
        chosen = self._ended(name, "")
        if not self.is_free(chosen):
            number = first if endings else max(first, self.next.get(self.same(name), first))
            while not self.is_free(chosen):
                chosen = self._ended(name, endings(number) if endings else f"_{number}")
                number += 1
            if not endings:
                self.next[self.same(name)] = number
        self.gone.add(self.same(chosen))
        return chosen
