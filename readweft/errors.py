"""Errors that callers can tell apart."""


class ReadweftError(ValueError):
    """Any error of this library."""


class UnknownFormat(ReadweftError):
    """A file's format can't be told from its name or first bytes."""


class MalformedRecord(ReadweftError):
    """A record that breaks its format; it ends the run."""


class UnsupportedCompression(ReadweftError):
    """A compression that is recognized but not read or written."""


class BadArgument(ReadweftError):
    """Arguments that contradict each other or are out of range."""
