"""Errors of query construction and planning, raised before Spark sees a plan."""


class QueryError(ValueError):
    """A query that has no meaning."""


class SourceError(QueryError):
    """A FROM, JOIN or UNION without exactly the sources that it needs, or with an alias twice."""


class JoinError(QueryError):
    """A join whose condition isn't one equality between its two sides, or of an unsupported kind."""


class WhereError(QueryError):
    """A filter that isn't an expression, such as a Python boolean."""


class GroupError(QueryError):
    """A selected or filtered expression that grouping doesn't define."""


class OrderError(QueryError):
    """A limit, offset or window without an order."""


class DistinctError(QueryError):
    """DISTINCT without a select."""


class FunctionError(QueryError):
    """An unknown function, wrong arguments, or operands of kinds that don't compare."""


class UnknownNameError(QueryError):
    """A reference to an alias or field that the sources don't have."""


class IncludeError(QueryError):
    """A nested query without a correlation to its parent."""


class OpaqueError(QueryError):
    """A query with Python functions inside, which have no stable identity."""
