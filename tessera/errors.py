"""Errors that callers can tell apart; faults of single rows are columns instead."""


class SlideError(Exception):
    """Any error of this package."""


class NotASlide(SlideError, ValueError):
    """The file isn't one that this source reads."""


class FrameTableError(SlideError, ValueError):
    """Where the frames are contradicts the file or its header."""


class Unsupported(SlideError, ValueError):
    """A transfer syntax, type or format that can't be read or written."""


class AnnotationError(SlideError, ValueError):
    """Annotations whose points, kinds or measurements don't fit together."""
