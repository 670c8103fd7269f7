"""Errors that the engine raises; all are EngineError."""


class EngineError(Exception):
    """Any failure of an operator."""


class InvalidParametersError(EngineError, ValueError):
    """A parameter out of its range, or parameters that don't fit together."""


class InvalidDataError(EngineError, ValueError):
    """Data that an operator can't work with: nulls, non-finite values, too few rows."""


class InvalidStateError(EngineError, RuntimeError):
    """Data that doesn't fit what the operator holds, such as another number of columns."""


class UntrainedModelError(EngineError, RuntimeError):
    """A prediction was asked of an estimator that hasn't been fitted."""

    def __init__(self, message: str = "the model has not been trained"):
        super().__init__(message)


class LinearAlgebraError(EngineError, ArithmeticError):
    """A matrix that can't be factorised, inverted or solved."""
