"""Errors of the compiler. Data errors surface from Spark when the plan runs."""


class QueryError(ValueError):
    """A specification that cannot be compiled."""


class UnsupportedOperator(QueryError):
    """An operator, stage or option that the language does not have."""

    def __init__(self, kind: str, name: str):
        super().__init__(f"Unsupported {kind}: {name}")
        self.name = name
