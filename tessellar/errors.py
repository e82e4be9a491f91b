"""What a query can fail with; the HTTP layer turns them into status codes."""


class QueryError(Exception):
    status, kind = 422, "execution"


class Invalid(QueryError):
    """The query or a parameter is malformed."""

    status, kind = 400, "bad_data"


class Unsupported(QueryError):
    """The query is well-formed PromQL that this engine does not run."""


class LimitExceeded(QueryError):
    """A query limit was passed."""


class NotReady(QueryError):
    """No live view can be read yet."""

    status, kind = 503, "unavailable"
