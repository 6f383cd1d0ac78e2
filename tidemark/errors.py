"""What can go wrong with a log, by kind."""


class LogError(Exception):
    """Base of all errors of a log."""

    def is_retryable(self) -> bool:
        """Conflicts, and backend errors that say so in their text."""
        text = str(self).lower()
        return isinstance(self, Conflict) or isinstance(self, Backend) and ("would block" in text or "temporarily unavailable" in text)


class Validation(LogError):
    pass


class NotFound(LogError):
    pass


class Conflict(LogError):
    pass


class Backend(LogError):
    pass


class Internal(LogError):
    pass


class Unsupported(LogError):
    pass
