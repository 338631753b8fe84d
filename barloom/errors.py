"""Errors raised by the library."""


class BarloomError(Exception):
    """Base of all library errors."""


class ConfigurationError(BarloomError):
    """A required setting is missing or wrong."""


class DataValidationError(BarloomError, ValueError):
    """Arguments or input columns do not have the expected form."""


class DataNotFound(BarloomError):
    """A query, path or manifest selects nothing although rows are required."""


class PartitionNotFound(DataNotFound):
    """A requested store partition does not exist."""


class ConflictError(BarloomError):
    """Another writer published a version of the same table first."""


class QueryError(BarloomError):
    """A generated query text could not be run."""
