"""Exceptions of the engine."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class QueryError(EngineError):
    """The request can't be answered as asked."""


class JoinError(QueryError):
    """No join path connects the views of a request."""

    def __init__(self, message: str, location: str = "join_graph"):
        super().__init__(message)
        self.location = location


class AccessDeniedOrDoesNotExistException(EngineError):
    def __init__(self, message: str, object_name: str = "", object_type: str = ""):
        super().__init__(message)
        self.object_name, self.object_type = object_name, object_type


class ConfigError(EngineError):
    """The project's definition is wrong."""


class ParseError(EngineError):
    """Text can't be parsed."""


class ArgumentError(EngineError):
    """A call's arguments don't fit together."""
