"""Errors of the engine; every check that fails raises one of these instead of guessing."""


class WattloomError(Exception):
    """Base of all engine errors."""


class ConstraintError(WattloomError, ValueError):
    """Rows break a declared rule."""


class CapacityError(WattloomError):
    """A job or schedule needs more nodes or power than there is."""


class PlacementError(WattloomError):
    """A placement run can't go on, or ended with work left."""


class SignalError(WattloomError):
    """The carbon signal is invalid."""


class MissingBucketError(SignalError):
    """A needed bucket of the carbon signal is absent."""


class ForecastError(SignalError):
    """No forecast exists for the asked issue time."""


class CoverageError(SignalError):
    """A schedule leaves the signal's coverage."""


class GridSourceError(SignalError):
    """A grid-data service gave an unusable answer."""
