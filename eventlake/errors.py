"""Errors of the engine, each with the HTTP status that a gateway would answer."""

from __future__ import annotations


class EngineError(Exception):
    status = 500


class ParseError(EngineError):
    status = 400


class InvalidQuery(EngineError):
    status = 400


class UnsupportedOperation(EngineError):
    status = 400


class TopicNotFound(EngineError):
    status = 404


class ViewNotFound(EngineError):
    status = 404


class ViewAlreadyExists(EngineError):
    status = 409


class OffsetNotFound(EngineError):
    status = 404


class QueryTimeout(EngineError):
    status = 408


class MissingConnector(EngineError):
    """A data source or format whose jar isn't on the classpath."""


class IncompatibleSchema(EngineError):
    status = 409


class SharedFolderUnset(EngineError):
    """A cluster's session that names no folder which driver and executors share."""


class DeliveryFailed(EngineError):
    """A sink's records that were not taken; their batch does not count as delivered."""

    status = 502


class CheckpointNotFound(EngineError):
    status = 404
