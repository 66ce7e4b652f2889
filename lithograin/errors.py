"""Errors of the engine, by cause."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(EngineError):
    pass


class StorageError(EngineError):
    pass


class IndexError_(EngineError):
    """A missing or duplicate index."""


class QueryError(EngineError):
    pass


class ParserError(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class ColumnNotFound(QueryError):
    pass


class TypeMismatch(QueryError):
    pass


class InvalidOperation(EngineError):
    pass


class RowNotFound(EngineError):
    pass
