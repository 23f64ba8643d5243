"""Errors and their contract: a code, a status, details."""

from __future__ import annotations

from typing import Any

#: Fixed codes by status.
CODES = {400: "BAD_REQUEST", 401: "UNAUTHORIZED", 403: "FORBIDDEN", 404: "NOT_FOUND", 409: "CONFLICT", 422: "VALIDATION_ERROR", 429: "RATE_LIMITED", 500: "INTERNAL_ERROR", 503: "UNAVAILABLE"}

#: Fixed codes on the wire by status; any other status is an internal error.
WIRE = {
    400: "validation_error", 401: "unauthorized", 403: "forbidden", 404: "not_found", 409: "conflict", 412: "precondition_failed",
    422: "validation_error", 429: "rate_limited", 500: "internal_error", 503: "service_unavailable", 504: "timeout",
}


class RepositoryError(Exception):
    status = 500

    def __init__(self, message: str, details: Any = None, status: int | None = None):
        super().__init__(message)
        self.details, self.status = details, status or self.status

    def contract(self) -> dict[str, Any]:
        out = {"code": CODES.get(self.status, CODES[500]), "message": str(self), "status": self.status}
        return out | ({"details": self.details} if self.details is not None else {})


class NotFound(RepositoryError):
    status = 404


class Invalid(RepositoryError, ValueError):
    status = 422


class Conflict(RepositoryError):
    """Another write was published first."""

    status = 409


class VersionConflict(Conflict):
    """The row's version is not the expected one."""


class DuplicateKey(Conflict):
    """A unique key is taken."""


class IllegalTransition(RepositoryError):
    status = 409


class PreconditionFailed(RepositoryError):
    status = 412


class TimedOut(RepositoryError):
    status = 504


class ReadOnly(RepositoryError):
    status = 403


class Unsupported(RepositoryError):
    status = 400


def to_contract(e: BaseException) -> dict[str, Any]:
    return e.contract() if isinstance(e, RepositoryError) else {"code": CODES[400 if isinstance(e, ValueError) else 500], "message": str(e), "status": 400 if isinstance(e, ValueError) else 500}


def to_wire(e: BaseException) -> dict[str, Any]:
    """The contract with the codes that clients switch on; an error's own ``code`` goes first."""
    out = to_contract(e)
    return out | {"code": getattr(e, "code", None) or WIRE.get(out["status"], WIRE[500])}
