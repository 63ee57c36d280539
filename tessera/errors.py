"""Errors of requests, by the status that a service would answer with."""


class RequestError(ValueError):
    """400: the request cannot be run as it is."""

    status = 400


class DimensionMismatch(RequestError):
    """A vector's length differs from the collection's."""


class InvalidTags(RequestError):
    """A tag breaks the rules of :func:`tessera.functions.tags.invalid_tags`."""


class Conflict(RequestError):
    """409: an id or key is taken."""

    status = 409


class SparseIds(Conflict):
    """Ids of a segment have gaps or repeat."""


class Overloaded(RuntimeError):
    """429: the store is over a hard limit."""

    status = 429
