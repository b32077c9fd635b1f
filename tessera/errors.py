"""Errors of the engine, by the phase that raises them."""


class SqlError(Exception):
    """Any failure of a statement."""


class ParseError(SqlError):
    """The text is no statement of the grammar."""


class UnsupportedError(SqlError):
    """The grammar has it, the engine doesn't do it."""


class AnalysisError(SqlError):
    """Names, types or arity don't fit; raised before anything runs."""


class TableNotFound(AnalysisError):
    def __init__(self, name: str):
        super().__init__(f'table "{name}" not found')


class TableExists(AnalysisError):
    def __init__(self, name: str):
        super().__init__(f'table "{name}" already exists')


class ColumnNotFound(AnalysisError):
    def __init__(self, name: str):
        super().__init__(f'column "{name}" does not exist')


class DuplicateName(AnalysisError):
    pass


class IndexExists(AnalysisError):
    def __init__(self, name: str):
        super().__init__(f'index "{name}" already exists')


class MultiplePrimaryKeys(AnalysisError):
    def __init__(self):
        super().__init__("a table has at most one primary key")


class ColumnCountMismatch(AnalysisError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} values or columns, got {got}")


class TypeMismatch(AnalysisError):
    pass


class ReservedName(AnalysisError):
    def __init__(self):
        super().__init__('column name "row_id" is reserved')


class CatalogReadOnly(AnalysisError):
    def __init__(self):
        super().__init__("the system catalog can't be modified")


class ExecutionError(SqlError):
    """A statement failed while it ran; an open transaction is rolled back."""


class NotNullViolation(ExecutionError):
    def __init__(self, column: str):
        super().__init__(f'column "{column}" takes no NULL')


class DuplicateKey(ExecutionError):
    def __init__(self, column: str, value: object = None):
        super().__init__(f'duplicate key in column "{column}"' + (f": {value}" if value is not None else ""))


class TransactionError(SqlError):
    pass
