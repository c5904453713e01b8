"""Small text helpers used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

SPACES = b" \t\n\x0b\x0c\r"


def pieces(body: bytes, size: int) -> Iterator[bytes]:
    """The text cut at white space into pieces of about ``size`` bytes (one at least)."""
    start = 0
    while len(body) - start > size:
        stop = start + size
        while stop < len(body) and body[stop] not in SPACES:
            stop += 1
        yield body[start:stop]
        start = stop
    if start < len(body) or not start:
        yield body[start:]
