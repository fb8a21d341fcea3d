"""Errors with stable codes: callers branch on the code, never on the message (PLT-8)."""

from __future__ import annotations

#: Codes and the status that a web layer would answer with.
STATUS = {
    "internal_error": 500,
    "configuration_error": 500,
    "registry_error": 500,
    "duplicate_registration": 500,
    "unknown_plugin": 400,
    "ingestion_error": 400,
    "unsupported_source": 400,
    "archive_error": 400,
    "corrupt_archive": 400,
    "archive_too_large": 413,
    "unsafe_archive_member": 400,
    "repository_error": 400,
    "invalid_repository_url": 400,
    "repository_fetch_failed": 502,
    "repository_fetch_timeout": 504,
    "empty_project": 400,
    "workspace_error": 500,
    "path_escape": 500,
    "dataset_error": 400,
    "ml_error": 400,
    "not_found": 404,
    "conflict": 409,
}


class QuarryError(ValueError):
    """An error with a code of STATUS and details by name."""

    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(message)
        self.code, self.status, self.message, self.details = code, STATUS[code], message, details

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details}


def require(condition: object, code: str, message: str, **details: object) -> None:
    """Raises unless the condition holds."""
    if not condition:
        raise QuarryError(code, message, **details)
