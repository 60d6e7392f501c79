"""Errors of the keyed store."""


class StoreError(Exception):
    """Base of all errors of this package."""


class KeyNotFound(StoreError, KeyError):
    """The key has no live value."""


class KeyExists(StoreError):
    """put_if_absent met a live value."""


class ConditionFailed(StoreError):
    """A condition or requirement did not hold; nothing was written."""


class InvalidCondition(StoreError, ValueError):
    """A condition is missing."""


class TransactionDone(StoreError):
    """The transaction has been committed, rolled back or has failed a condition."""


class CommitUncertain(StoreError):
    """Publishing failed in a way that does not tell whether the version is visible."""


class VersionConflict(StoreError):
    """Another writer has published the version first."""


class VersionNotFound(StoreError):
    """The version has not been published, or what it needs has been deleted."""


class Corrupt(StoreError):
    """Stored data break a rule of the log or do not match their checksums."""


class DirectoryLocked(StoreError):
    """Another process has the store open for writing."""


class Closed(StoreError):
    """The store has been closed."""
