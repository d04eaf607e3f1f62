"""Errors and the exit codes they stand for."""


class SnapweaveError(Exception):
    exit_code = 3


class ValidationFailure(SnapweaveError):
    """A gate or a check failed; whatever output was asked for is already written."""

    exit_code = 1


class SourceError(SnapweaveError):
    """A file is missing or can't be read as what it should be."""

    exit_code = 2


class InvariantError(SnapweaveError):
    exit_code = 3


class LayoutError(InvariantError):
    """No layout has the header's width and first columns."""


class MissingFieldError(InvariantError):
    """The layout of a release has no such field."""


class CollisionError(InvariantError):
    """One id of a release leads to several of the next."""


class UsageError(SnapweaveError):
    exit_code = 4
