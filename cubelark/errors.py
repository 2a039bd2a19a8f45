"""What can go wrong with a query; all are CubeError."""


class CubeError(Exception):
    """Base of all errors of this library."""


class AlignmentError(CubeError):
    """The second operand has a dimension that the first lacks."""


class EmptyDataError(CubeError):
    """A layer has no data within the extent."""


class InvalidValueTypeError(CubeError):
    """A function does not take operands of these value types."""


class InvalidIntervalError(CubeError):
    """The upper bound of an interval is below the lower one."""


class InvalidBuildingBlockError(CubeError):
    """A part of a recipe is malformed or of an unknown kind."""


class UnknownConceptError(CubeError):
    """The mapping has no such concept or property."""


class UnknownLayerError(CubeError):
    """The layout has no such layer."""


class UnknownResultError(CubeError):
    """The recipe has no such result."""


class UnknownVerbError(CubeError):
    """No verb of this name is built in or registered."""


class UnknownReducerError(CubeError):
    """No reducer of this name is built in or registered."""


class UnknownOperatorError(CubeError):
    """No operator of this name is built in or registered."""


class UnknownDimensionError(CubeError):
    """The array has no such dimension."""


class UnknownComponentError(CubeError):
    """The dimension has no such component."""


class UnknownLabelError(CubeError):
    """The active array has no value with this label."""


class TooManyDimensionsError(CubeError):
    """The operation is not defined for so many dimensions."""


class MissingDimensionError(CubeError):
    """The operation needs a dimension that is not there."""


class MixedDimensionsError(CubeError):
    """Groupers given together have different dimensions."""


class ReservedDimensionError(CubeError):
    """A new dimension has a name that is reserved."""


class UnknownTimeZoneError(CubeError):
    """No time zone is known for a source of times."""


class MixedTimeZonesError(CubeError):
    """The bounds of a temporal extent are in different zones."""


class RecursiveResultError(CubeError):
    """A result refers, directly or not, to itself."""
