"""The library's one error type."""


class FrameError(ValueError):
    """A request that makes no sense for the data: wrong parameters, shapes that differ, files that are not there."""
