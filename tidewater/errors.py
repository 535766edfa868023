"""Errors of the query language."""


class QueryError(Exception):
    """The statement cannot be run."""


class SyntaxProblem(QueryError):
    """It is not in the grammar."""


class BindProblem(QueryError):
    """A name or a type in it does not fit the catalogue."""


class AccessProblem(QueryError):
    """It needs rights that the caller does not have."""


class LimitProblem(QueryError):
    """It is estimated to touch more rows than the caller may."""


class ConstraintProblem(QueryError):
    """It would give two rows the same unique key."""
