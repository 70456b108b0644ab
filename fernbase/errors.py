"""Errors that the engine raises before a plan is built."""


class QueryError(ValueError):
    """A filter, update, projection or option that cannot be understood."""


class ConflictError(RuntimeError):
    """A table changed between reading and committing."""


class UniqueError(ValueError):
    """A write would break a unique index."""
