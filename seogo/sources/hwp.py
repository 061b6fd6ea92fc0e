"""HWP 5.0: sections of records in a compound file, for which a small reader is included."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from .model import Block, Part, ParseError, clean

PARAGRAPH_TEXT, MOST_STREAM = 67, 128 * 1024 * 1024
# Control codes of one unit and what they stand for; other codes below 32 take eight units.
_SINGLE = {0: "", 10: "\n", 13: "", 24: "-", 25: "", 26: "", 27: "", 28: "", 29: "", 30: " ", 31: " "}
_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE


class CompoundFile:
    """Reading streams of an OLE compound file by path."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1") or len(data) < 512:
            raise ParseError("not a compound file")
        self.data = data
        self.sector = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, _, first_more, more = struct.unpack_from("<5I", data, 56)
        tables = list(struct.unpack_from("<109I", data, 76))
        seen = 0
        while first_more < _END and seen <= more:
            block = self._sector(first_more)
            entries = struct.unpack(f"<{len(block) // 4}I", block)
            tables += entries[:-1]
            first_more, seen = entries[-1], seen + 1
        fat = b"".join(self._sector(t) for t in tables if t < _END)
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat)
        mini = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self._read_directory(self._chain(first_dir))

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.sector
        return self.data[at : at + self.sector].ljust(self.sector, b"\0")

    def _chain(self, number: int) -> bytes:
        out, steps = [], 0
        while number < _END and number < len(self.fat) and steps <= len(self.fat):
            out.append(self._sector(number))
            number, steps = self.fat[number], steps + 1
        return b"".join(out)

    def _read_directory(self, raw: bytes) -> None:
        entries = []
        for at in range(0, len(raw) - 127, 128):
            size, kind = struct.unpack_from("<HB", raw, at + 64)
            name = raw[at : at + max(0, size - 2)].decode("utf-16-le", "replace")
            left, right, below = struct.unpack_from("<3I", raw, at + 68)
            start, length = struct.unpack_from("<IQ", raw, at + 116)
            entries.append((name, kind, left, right, below, start, length))
        self.streams: dict[tuple[str, ...], tuple[int, int]] = {}
        if not entries:
            return
        self.small = self._chain(entries[0][5])
        todo, seen = [(entries[0][4], ())], set()
        while todo:
            number, path = todo.pop()
            if number >= len(entries) or number in seen:
                continue
            seen.add(number)
            name, kind, left, right, below, start, length = entries[number]
            todo += [(left, path), (right, path)]
            if kind == 1:
                todo.append((below, (*path, name)))
            elif kind == 2:
                self.streams[(*path, name)] = (start, length)

    def read(self, *path: str) -> bytes | None:
        if path not in self.streams:
            return None
        start, length = self.streams[path]
        if length >= self.cutoff:
            return self._chain(start)[:length]
        out, steps = [], 0
        while start < _END and start < len(self.mini_fat) and steps <= len(self.mini_fat):
            out.append(self.small[start * self.mini : (start + 1) * self.mini])
            start, steps = self.mini_fat[start], steps + 1
        return b"".join(out)[:length]


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload): tag and level take 10 bits, size 12; a full size field means 32 more bits."""
    at = 0
    while at + 4 <= len(data):
        head, = struct.unpack_from("<I", data, at)
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size, = struct.unpack_from("<I", data, at)
            at += 4
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def paragraph(payload: bytes) -> str:
    """Text of a paragraph record without its controls."""
    units = memoryview(payload[: len(payload) // 2 * 2]).cast("H")
    out, at = [], 0
    while at < len(units):
        stop = at
        while stop < len(units) and units[stop] >= 32:
            stop += 1
        if stop > at:
            out.append(payload[at * 2 : stop * 2].decode("utf-16-le", "replace"))
            at = stop
            continue
        code = units[at]
        out.append(_SINGLE.get(code, "\t" if code == 9 else ""))
        at += 1 if code in _SINGLE else 8
    return "".join(out)


def _summary(raw: bytes | None) -> dict[str, str]:
    """Title (2) and author (4) of a property set; nothing where it cannot be read."""
    out: dict[str, str] = {}
    try:
        base, = struct.unpack_from("<I", raw, 44)
        count, = struct.unpack_from("<I", raw, base + 4)
        for k in range(count):
            number, at = struct.unpack_from("<2I", raw, base + 8 + 8 * k)
            key = {2: "title", 4: "author"}.get(number)
            kind, size = struct.unpack_from("<2I", raw, base + at)
            if key and kind in (30, 31):
                text = raw[base + at + 8 : base + at + 8 + size * (2 if kind == 31 else 1)].decode("utf-16-le" if kind == 31 else "cp949", "ignore")
                if value := clean(text.rstrip("\0")):
                    out[key] = value
    except (struct.error, TypeError):
        pass
    return out


def parse_hwp(name: str, data: bytes) -> Part:
    try:
        ole = CompoundFile(data)
    except (ParseError, struct.error) as e:
        raise ParseError("not an HWP file (rename HWPX documents to .hwpx)") from e
    header = ole.read("FileHeader")
    if header is None or not header.startswith(b"HWP Document File"):
        raise ParseError("not an HWP 5.0 document")
    flags = struct.unpack_from("<I", header, 36)[0] if len(header) >= 40 else 0
    if flags & 2:
        raise ParseError("the HWP document is protected by a password")
    part = Part(name, "hwp", metadata=_summary(ole.read("\x05HwpSummaryInformation")))
    number = lambda p: int("".join(re.findall(r"\d", p[1])) or 0)
    for path in sorted((p for p in ole.streams if len(p) == 2 and p[0] == "BodyText"), key=number):
        raw = (ole.read(*path) or b"")[:MOST_STREAM]
        if flags & 1:
            try:
                raw = zlib.decompress(raw, -15)
            except zlib.error:
                part.warnings.append(f"stream not inflatable: {'/'.join(path)}")
                continue
        texts = (clean(paragraph(payload)) for tag, _, payload in records(raw) if tag == PARAGRAPH_TEXT)
        part.blocks += [Block(t) for t in texts if t]
    preview = clean((ole.read("PrvText") or b"").decode("utf-16-le", "replace")) if not part.blocks else ""
    if preview:
        why = "the body is encrypted" if flags & 4 else "the body could not be read"
        part.warnings.append(f"{why}: only the stored preview was read")
        part.blocks = [Block(p) for p in preview.split("\n") if p.strip()]
    return part
