"""Errors with their place in a sequence stream."""

from __future__ import annotations

import re


class SequenceFormatError(ValueError):
    """A parse error; offset, record and line are those of the decompressed stream, counted from 0."""

    def __init__(self, message: str, byte_offset: int | None = None, record_index: int | None = None, line_index: int | None = None) -> None:
        self.detail, self.byte_offset, self.record_index, self.line_index = message, byte_offset, record_index, line_index
        where = "" if byte_offset is None else f" at byte {byte_offset}, record {record_index}, line {line_index}"
        super().__init__(f"parse error{where}: {message}")


class BgzfError(ValueError):
    """A block-gzip stream that can't be read."""

    def __init__(self, message: str) -> None:
        self.detail = message
        super().__init__(f"BGZF error: {message}")


_PLACED = re.compile(r"parse error(?: at byte (\d+), record (\d+), line (\d+))?: ([^\n]*)")


def from_spark(e: Exception) -> SequenceFormatError | None:
    """The parse error that a Spark job has raised, as it was meant; None if e is something else."""
    m = _PLACED.search(str(e))
    if not m:
        return None
    place = [int(x) if x is not None else None for x in m.groups()[:3]]
    return SequenceFormatError(re.split(r" SQLSTATE: | *$", m[4])[0], *place)
