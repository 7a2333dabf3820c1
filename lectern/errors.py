"""The errors that the library raises on purpose; all of them are ValueErrors too."""

from __future__ import annotations


class LecternError(ValueError):
    """Any of them."""


class UnsupportedFormat(LecternError):
    """No parser knows the extension."""


class MissingDependency(LecternError):
    """A parser needs something that isn't installed; ``remedy`` says what would help."""

    def __init__(self, message: str, remedy: str = "") -> None:
        super().__init__(message)
        self.remedy = remedy


class ParseFailure(LecternError):
    """A parser knows the format and can't read the file."""
