"""Errors of the library."""


class GeoloomError(Exception):
    """Base of the library's own errors."""


class NotFittedError(GeoloomError):
    """A model is used before it is fitted or loaded."""


class EmptyDataError(GeoloomError):
    """A source gave no rows where some are needed."""
