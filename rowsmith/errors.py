"""Errors that a query can end with, by the category shown to users."""


class QueryError(Exception):
    category = "unexpected"


class ParsingError(QueryError):
    category = "query parsing"


class SyntaxProblem(QueryError):
    category = "syntax error"


class ExecutionError(QueryError):
    category = "query execution"


class HandlingError(QueryError):
    category = "IO handling"


def describe(error: BaseException) -> tuple[str, str]:
    """Category and message of any error, with Spark's wrapping removed."""
    if isinstance(error, QueryError):
        return error.category, str(error)
    text = str(error)
    if "[USER_RAISED_EXCEPTION]" in text:
        return "query execution", text.split("[USER_RAISED_EXCEPTION]")[1].split("SQLSTATE")[0].strip()
    return "unexpected", text.splitlines()[0] if text else type(error).__name__
