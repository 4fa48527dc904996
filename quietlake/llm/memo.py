"""A bounded memo for values that a text repeats: two generations, the older one is dropped when the newer is full."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """key -> value; what is missing comes from the older generation or from fill(missing keys)."""

    def __init__(self, fill: Callable[[list], list], capacity: int = 250_000):
        super().__init__()
        self.fill, self.capacity, self.older = fill, capacity, {}

    def prepare(self, keys: set) -> None:
        """Have a value for each of the keys; afterwards plain look-ups find them."""
        if len(self) > self.capacity:
            self.older = dict(self)
            self.clear()
        older, missing = self.older, []
        for k in keys - self.keys():
            if k in older:
                self[k] = older[k]
            else:
                missing.append(k)
        if missing:
            self.update(zip(missing, self.fill(missing)))
