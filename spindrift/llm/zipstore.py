"""Reading ZIP packages by ranges: end records, ZIP64 records, central directory, stored members."""

from __future__ import annotations

import struct
from dataclasses import dataclass

EOCD = struct.Struct("<4s4H2IH")
EOCD64_AT = struct.Struct("<4sIQI")
EOCD64 = struct.Struct("<4sQ2H2I4Q")
CENTRAL = struct.Struct("<4s6H3I5H2I")
LOCAL = struct.Struct("<4s5H3I2H")
NO16, NO32 = 0xFFFF, 0xFFFFFFFF
LONGEST_COMMENT = 0xFFFF


class ZipError(ValueError):
    """The bytes aren't a ZIP package this reader can use."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header_at: int


class ZipRanges:
    """A package behind `read(at, size)`; nothing is read but directories and asked ranges."""

    def __init__(self, read, size: int):
        self._read, self._size = read, size
        at, length, count = self._directory()
        self.members = self._entries(read(at, length), count)
        self._data_at: dict[str, int] = {}

    def _directory(self) -> tuple[int, int, int]:
        tail_at = max(0, self._size - EOCD.size - LONGEST_COMMENT)
        tail = self._read(tail_at, self._size - tail_at)
        at = len(tail) - EOCD.size
        while True:
            at = tail.rfind(b"PK\x05\x06", 0, at + 4)
            if at < 0:
                raise ZipError("no end of central directory")
            _, _, _, _, count, length, where, comment = EOCD.unpack_from(tail, at)
            if at + EOCD.size + comment == len(tail):
                break
        if NO16 in (count,) or NO32 in (length, where):
            locator_at = tail_at + at - EOCD64_AT.size
            sign, _, end_at, _ = EOCD64_AT.unpack(self._read(locator_at, EOCD64_AT.size))
            if sign != b"PK\x06\x07":
                raise ZipError("no ZIP64 locator")
            sign, *_, count, length, where = EOCD64.unpack(self._read(end_at, EOCD64.size))
            if sign != b"PK\x06\x06":
                raise ZipError("no ZIP64 end record")
        return where, length, count

    @staticmethod
    def _entries(data: bytes, count: int) -> dict[str, Member]:
        out, at = {}, 0
        for _ in range(count):
            f = CENTRAL.unpack_from(data, at)
            if f[0] != b"PK\x01\x02":
                raise ZipError("bad central directory entry")
            method, stored, size, n_name, n_extra, n_comment, header = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
            name_at = at + CENTRAL.size
            raw, extra = data[name_at : name_at + n_name], data[name_at + n_name : name_at + n_name + n_extra]
            big = {}
            while len(extra) >= 4:
                tag, n = struct.unpack_from("<2H", extra)
                big[tag] = extra[4 : 4 + n]
                extra = extra[4 + n :]
            wide = big.get(1, b"")
            values = []
            for v in (size, stored, header):  # only fields that overflowed are there, in this order
                if v == NO32:
                    (v,), wide = struct.unpack_from("<Q", wide), wide[8:]
                values.append(v)
            name = raw.decode("utf-8" if f[3] & 0x800 else "cp437")
            out[name] = Member(name, method, values[0], values[1], values[2])
            at = name_at + n_name + n_extra + n_comment
        return out

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        """Bytes [at, at + size) of a stored member."""
        m = self.members[name]
        if m.method:
            raise ZipError(f"{name} is compressed; ranges need a stored member")
        if name not in self._data_at:
            head = LOCAL.unpack(self._read(m.header_at, LOCAL.size))
            if head[0] != b"PK\x03\x04":
                raise ZipError("bad local header")
            self._data_at[name] = m.header_at + LOCAL.size + head[9] + head[10]
        size = m.size - at if size is None else size
        if at < 0 or at + size > m.size:
            raise ZipError("range outside the member")
        return self._read(self._data_at[name] + at, size)
