"""Errors of the engine and their wire form."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    """Base of all errors; ``details`` are merged into the wire form."""

    kind = "EngineError"

    def __init__(self, message: str, details: dict[str, Any] | None = None):
        super().__init__(message)
        self.message, self.details = message, dict(details or {})

    def to_dict(self) -> dict[str, Any]:
        return {"error": True, "error_type": self.kind, "message": self.message, "details": self.details}


class ValidationError(EngineError):
    kind = "ValidationError"


class IndexingError(EngineError):
    kind = "IndexingError"


class SearchError(EngineError):
    kind = "SearchError"


class RepositoryError(EngineError):
    kind = "GitError"


class StorageError(EngineError):
    kind = "DatabaseError"


def wire(error: Exception) -> dict[str, Any]:
    """Any exception in wire form; foreign ones keep the name of their class."""
    if isinstance(error, EngineError):
        return error.to_dict()
    return {"error": True, "error_type": type(error).__name__, "message": str(error), "details": {}}
