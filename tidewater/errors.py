"""What statements and transactions raise."""


class EngineError(Exception):
    """Any error of a statement."""


class ParseError(EngineError):
    """The text is no statement of the dialect."""


class BindError(EngineError):
    """A name or type doesn't fit the tables."""


class ConflictError(EngineError):
    """Another transaction committed a conflicting change first; this one is rolled back."""


class DeadlockAbort(EngineError):
    """A lock request that would close a cycle of waits; its transaction is the victim."""
