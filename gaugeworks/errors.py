"""Errors of wrong arguments, raised on the driver before any data is touched."""


class CleaningArgumentError(ValueError):
    """Bounds, percentiles, levels or jumps that make no sense."""


class RegularizeArgumentError(ValueError):
    """Steps, tolerances, spans, bands or aggregators that make no sense."""


class InterpolationArgumentError(ValueError):
    """An unknown method or a negative limit."""


class AlarmArgumentError(ValueError):
    """A silence that isn't longer than zero."""
