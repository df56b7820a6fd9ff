"""The four kinds of SQL error."""


class SqlError(ValueError):
    """Any error of the SQL dialect."""


class SqlSyntaxError(SqlError):
    """The text is not a statement of the dialect."""


class SqlUnsupportedError(SqlError):
    """A construct that SQL v1 leaves out."""

    def __init__(self, what: str):
        super().__init__(f"not supported in SQL v1: {what}")


class SqlSemanticError(SqlError):
    """Names, types or shapes that do not fit together."""


class SqlTableKindError(SqlError):
    """A table used against its kind."""

    def __init__(self, what: str):
        super().__init__(f"table-kind constraint violation: {what}")
