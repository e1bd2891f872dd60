"""Where the members of a ZIP archive lie, read from its directories alone.

Nothing is extracted: a few ranged reads at the end of the archive find the central
directory, by way of the ZIP64 records where they are needed, and one more finds the first
byte of each member.  The data of a stored member can then be read in place.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

ReadAt = Callable[[int, int], bytes]

# Fixed values of the format: signatures, and the sizes of the records without their tails.
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ENTRY, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
LONGEST_COMMENT = 0xFFFF
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF  # a field that stands in its ZIP64 place
ZIP64_EXTRA = 1
STORED = 0


class BadArchive(ValueError):
    """The archive is cut off or not a ZIP archive."""


@dataclass(frozen=True)
class Member:
    """``start`` and ``size`` say where the (possibly compressed) data lie."""

    name: str
    method: int
    encrypted: bool
    start: int
    size: int

    def in_place(self) -> Member:
        """The member itself, if its data can be read as they lie."""
        if self.method != STORED or self.encrypted:
            raise BadArchive(f"{self.name} is not stored as it is")
        return self


def _unpack(layout: str, raw: bytes, at: int, what: str) -> tuple:
    if at < 0 or at + struct.calcsize(layout) > len(raw):
        raise BadArchive(f"{what} is cut off")
    return struct.unpack_from(layout, raw, at)


def _directory_place(read_at: ReadAt, size: int) -> tuple[int, int, int, int]:
    """``count, start, length`` of the central directory, and what stands before the archive."""
    tail_size = min(size, END_SIZE + LONGEST_COMMENT + LOCATOR64_SIZE)
    tail = read_at(size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0:
        if at + END_SIZE <= len(tail):
            comment = struct.unpack_from("<H", tail, at + 20)[0]
            if at + END_SIZE + comment == len(tail):
                break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadArchive("no end of a central directory")
    count, length, start = _unpack("<HII", tail, at + 10, "end of the central directory")
    end = size - tail_size + at
    if tail[max(at - LOCATOR64_SIZE, 0) : at].startswith(LOCATOR64):
        where = _unpack("<Q", tail, at - LOCATOR64_SIZE + 8, "ZIP64 locator")[0]
        # it stands right before its locator, also when the whole archive has been moved
        end = size - tail_size + at - LOCATOR64_SIZE - END64_SIZE
        for place in (end, where):
            raw = read_at(place, END64_SIZE) if 0 <= place <= size - END64_SIZE else b""
            if raw.startswith(END64):
                end = place
                break
        else:
            raise BadArchive("no ZIP64 end of the central directory")
        count, length, start = struct.unpack_from("<QQQ", raw, 32)
    elif FULL32 in (length, start) or count == FULL16:
        raise BadArchive("no ZIP64 locator")
    before = end - length - start
    if before < 0:
        raise BadArchive("the central directory is cut off")
    return count, start + before, length, before


def _wide(extra: bytes, size: int, plain_size: int, at: int) -> tuple[int, int]:
    """Size and place of an entry, from its ZIP64 field where the plain ones are full."""
    if FULL32 not in (size, plain_size, at):
        return size, at
    place = 0
    while place + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, place)
        if kind == ZIP64_EXTRA:
            field, k = extra[place + 4 : place + 4 + length], 0
            if plain_size == FULL32:  # comes first, though nothing here needs it
                k += 8
            if size == FULL32:
                size, k = _unpack("<Q", field, k, "ZIP64 field")[0], k + 8
            if at == FULL32:
                at = _unpack("<Q", field, k, "ZIP64 field")[0]
            return size, at
        place += 4 + length
    return size, at  # exactly full, with nothing wider


def members(read_at: ReadAt, size: int) -> list[Member]:
    """All members of an archive of ``size`` bytes that ``read_at(offset, length)`` reads."""
    count, start, length, before = _directory_place(read_at, size)
    raw = read_at(start, length)
    if len(raw) != length:
        raise BadArchive("the central directory is cut off")
    found, at = [], 0
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise BadArchive("the central directory has fewer entries than it says")
        flags, method = _unpack("<HH", raw, at + 8, "entry")
        packed, plain, name_len, extra_len, note_len = _unpack("<IIHHH", raw, at + 20, "entry")
        local = _unpack("<I", raw, at + 42, "entry")[0]
        name = raw[at + ENTRY_SIZE : at + ENTRY_SIZE + name_len]
        extra = raw[at + ENTRY_SIZE + name_len : at + ENTRY_SIZE + name_len + extra_len]
        packed, local = _wide(extra, packed, plain, local)
        found.append(
            Member(
                name.decode("utf-8" if flags & 0x800 else "cp437"),
                method,
                bool(flags & 1),
                _data_start(read_at, before + local),
                packed,
            )
        )
        if found[-1].start + packed > start:
            raise BadArchive(f"{found[-1].name} is cut off")
        at += ENTRY_SIZE + name_len + extra_len + note_len
    return found


def _data_start(read_at: ReadAt, local: int) -> int:
    """The local header may carry other extra fields than the directory's entry."""
    head = read_at(local, LOCAL_SIZE)
    if not head.startswith(LOCAL):
        raise BadArchive("an entry points to no local header")
    name_len, extra_len = _unpack("<HH", head, 26, "local header")
    return local + LOCAL_SIZE + name_len + extra_len
