"""Errors of the engine, printed as ``Code: message`` (which is also their form on the wire)."""

from __future__ import annotations


class StatusError(Exception):
    code = "Error"

    def __init__(self, message: str = ""):
        super().__init__(message)
        self.message = message

    def __str__(self) -> str:
        return f"{self.code}: {self.message}" if self.message else self.code


class NotFound(StatusError):
    code = "NotFound"


class Corruption(StatusError):
    code = "Corruption"


class NotSupported(StatusError):
    code = "NotSupported"


class InvalidArgument(StatusError):
    code = "InvalidArgument"


class IOErr(StatusError):
    code = "IOError"


class Conflict(StatusError):
    code = "Conflict"
