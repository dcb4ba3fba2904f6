"""Extension points: chunkers, projectors, note handlers, constraint checks and named tools."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from corvane.functions import tables


class Registry:
    """Hooks run in the order of registration; those of packs come before built-in ones."""

    def __init__(self) -> None:
        self.chunkers: list[tuple[str, Callable]] = []
        self.projectors: list[Callable[[DataFrame], DataFrame]] = []
        self.handlers: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}
        self.constraints: list[Callable[[DataFrame], DataFrame]] = []
        self.tools: dict[str, Callable] = {}

    @staticmethod
    def _callable(f: Callable) -> Callable:
        if not callable(f):
            raise TypeError(f"not callable: {f!r}")
        return f

    def chunker(self, language: str, f: Callable) -> None:
        if (language, f) not in self.chunkers:
            self.chunkers.append((language, self._callable(f)))

    def projector(self, f: Callable[[DataFrame], DataFrame]) -> None:
        self.projectors.append(self._callable(f))

    def handler(self, note_type: str, f: Callable[[DataFrame], DataFrame]) -> None:
        """A handler of one note type, or of all types with `*`."""
        self.handlers.setdefault(note_type, []).append(self._callable(f))

    def constraint(self, f: Callable[[DataFrame], DataFrame]) -> None:
        self.constraints.append(self._callable(f))

    def tool(self, name: str, f: Callable) -> None:
        if name in self.tools:
            raise ValueError(f"tool exists: {name}")
        self.tools[name] = self._callable(f)

    def by_language(self) -> dict[str, Callable]:
        """The first chunker of each language."""
        return {name: f for name, f in reversed(self.chunkers)}

    def register_tables(self, spark: SparkSession) -> None:
        """Makes the table functions of SQL know these chunkers."""
        tables.register(spark, self.by_language())

    def project(self, files: DataFrame) -> DataFrame | None:
        return self._union([f(files) for f in self.projectors])

    def handle(self, notes: DataFrame) -> DataFrame | None:
        """Records of all handlers: those of a note's own type, then those of all types."""
        own = [f(notes.filter(notes["type"] == t)) for t, fs in self.handlers.items() if t != "*" for f in fs]
        return self._union(own + [f(notes) for f in self.handlers.get("*", [])])

    def violations(self, nodes: DataFrame) -> DataFrame | None:
        return self._union([f(nodes) for f in self.constraints])

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame | None:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def load_plugins(registry: Registry, group: str) -> list[str]:
    """Runs the entry points of a group on the registry; the names of those that failed come back."""
    from importlib.metadata import entry_points

    failed = []
    for point in entry_points(group=group):
        try:
            point.load()(registry)
        except Exception:  # a broken pack must not stop the others
            failed.append(point.name)
    return failed
