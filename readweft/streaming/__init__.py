from .reads import appended_reads, streamed

__all__ = ["appended_reads", "streamed"]
