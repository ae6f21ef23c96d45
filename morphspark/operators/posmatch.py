"""Sets of parts of speech: from partial tuples or a test, with the algebra of sets, as predicates on pos_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from morphspark.sources.config import ConfigError


class PosMatcher:
    """A set of part-of-speech ids within a list of tuples."""

    def __init__(self, pos: list[tuple[str, ...]], ids: set[int]):
        self.pos, self.ids = pos, frozenset(ids)

    @classmethod
    def of(cls, pos: list[tuple[str, ...]], what: Callable[[tuple[str, ...]], bool] | list[tuple]) -> PosMatcher:
        """From a test of a tuple, or partial tuples in which None stands for anything; one that matches nothing is an error."""
        if callable(what):
            return cls(pos, {k for k, p in enumerate(pos) if what(p)})
        ids: set[int] = set()
        for part in what:
            if len(part) > 6:
                raise ConfigError(f"more than six classes: {part}")
            found = {k for k, p in enumerate(pos) if all(w is None or w == x for w, x in zip(part, p))}
            if not found:
                raise ConfigError(f"no part of speech is like {part}")
            ids |= found
        return cls(pos, ids)

    def matches(self, pos_id: Column | str = "pos_id") -> Column:
        """The predicate on a column of ids."""
        c = pos_id if isinstance(pos_id, Column) else F.col(pos_id)
        return c.isin(*sorted(self.ids)) if self.ids else F.lit(False)

    def __contains__(self, pos_id: int) -> bool:
        return pos_id in self.ids

    def __or__(self, other: PosMatcher) -> PosMatcher:
        return PosMatcher(self.pos, self.ids | other.ids)

    def __and__(self, other: PosMatcher) -> PosMatcher:
        return PosMatcher(self.pos, self.ids & other.ids)

    def __sub__(self, other: PosMatcher) -> PosMatcher:
        return PosMatcher(self.pos, self.ids - other.ids)

    def __invert__(self) -> PosMatcher:
        return PosMatcher(self.pos, set(range(len(self.pos))) - self.ids)

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        return (self.pos[k] for k in sorted(self.ids))

    def __len__(self) -> int:
        return len(self.ids)
