"""Errors of the field engine. Row-level problems come as the struct column :data:`ERROR` instead."""

from __future__ import annotations

ERROR = "struct<kind:string,required:bigint,capacity:bigint>"


class FieldEngineError(ValueError):
    """Base of all errors that the engine raises on the driver."""


class InvalidDims(FieldEngineError):
    """A dimension is zero before a used one, or none is used."""


class DimensionTooLarge(FieldEngineError):
    """A dimension does not fit the 52-bit metadata."""


class ShapeTooLarge(FieldEngineError):
    """The number of elements or blocks does not fit 63 bits."""


class InsufficientData(FieldEngineError):
    def __init__(self, required: int, actual: int):
        super().__init__(f"the layout spans {required} bytes, the data has {actual}")
        self.required, self.actual = required, actual


class BlockLength(FieldEngineError):
    """A block has fewer than ``4 ** rank`` values."""


class InvalidParameters(FieldEngineError):
    """Expert parameters out of range."""


class InvalidRate(FieldEngineError):
    """A rate that no block size can hold."""


class UnrepresentableMode(FieldEngineError):
    """Parameters that a mode word cannot carry."""


class BufferTooSmall(FieldEngineError):
    def __init__(self, required: int, capacity: int):
        super().__init__(f"{required} bytes needed, {capacity} given")
        self.required, self.capacity = required, capacity


class Truncated(BufferTooSmall):
    """The stream ends before its blocks do."""


class InvalidMagic(FieldEngineError):
    pass


class InvalidMetadata(FieldEngineError):
    pass


class InvalidMode(FieldEngineError):
    pass


class InvalidRank(FieldEngineError):
    """A rank other than 1 to 4."""
