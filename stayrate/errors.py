"""Errors the library raises."""

from __future__ import annotations


class DataQualityError(ValueError):
    """A gate found violations; ``counters`` holds the failing counts by name."""

    def __init__(self, subject: str, counters: dict[str, int]):
        self.subject = subject
        self.counters = dict(counters)
        detail = ", ".join(f"{name}={count}" for name, count in sorted(self.counters.items()))
        super().__init__(f"{subject}: {detail}")


class MissingInputError(FileNotFoundError):
    """One or more required inputs do not exist."""

    def __init__(self, paths: list[str]):
        self.paths = list(paths)
        super().__init__("missing inputs: " + ", ".join(self.paths))
