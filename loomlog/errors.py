"""Errors of the log, raised by eager validation on the driver."""


class LogError(Exception):
    """Base of all errors of the log."""


class EmptyBatch(LogError): ...


class EmptyKey(LogError): ...


class KeyTooLong(LogError): ...


class KeyNotFound(LogError): ...


class InvalidShardId(LogError): ...


class InvalidCursorShard(LogError): ...


class InvalidCursor(LogError):
    """A cursor that is not on a record boundary, or of another generation."""


class CursorBeyondVisibleFrontier(LogError): ...


class InvalidGlobalMergeCursor(LogError): ...


class UnsupportedCheckpointVersion(LogError): ...


class CheckpointShardCountMismatch(LogError): ...


class InvalidCheckpointFile(LogError): ...


class CheckpointChecksumMismatch(LogError): ...


class InvalidSnapshotFile(LogError): ...


class SnapshotChecksumMismatch(LogError): ...


class PendingOperationsExist(LogError): ...


class SyncTimeout(LogError): ...


class CommitConflict(LogError):
    """Another writer published this commit number; nothing of this commit is visible."""


class ChecksumMismatch(LogError):
    """A record whose bytes don't have the checksum that was written with it."""


class LogReplaced(LogError):
    """A restore replaced the log under a running consumer."""
