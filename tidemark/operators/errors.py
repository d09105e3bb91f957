class DataContractError(RuntimeError):
    """Input or output data break a stated contract."""


class ConcurrentWriteError(RuntimeError):
    """Another writer published to the same table first; nothing of this write is visible."""
