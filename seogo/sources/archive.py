"""Zip archives: their supported files become attachments."""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath

from .model import Block, Part, ParseError

MOST_ENTRIES, MOST_ENTRY, MOST_TOTAL, MOST_LISTED = 500, 30 * 1024 * 1024, 200 * 1024 * 1024, 200
# Folders that hold no material.
SKIPPED = frozenset("__MACOSX .git node_modules .idea .vscode build dist target __pycache__ .venv venv".split())


def entry_name(info: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 flag are CP949 more often than CP437."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.filename.encode("cp437").decode("cp949")
    except UnicodeError:
        return info.filename


def parse_zip(name: str, data: bytes, depth: int = 0) -> Part:
    from .registry import PARSERS, parse

    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParseError("the zip archive is damaged") from e
    part = Part(name, "zip")
    files = [i for i in archive.infolist() if not i.is_dir()]
    if len(files) > MOST_ENTRIES:
        part.warnings.append(f"entries beyond {MOST_ENTRIES} left out")
    total = 0
    for info in files[:MOST_ENTRIES]:
        path = PurePosixPath(entry_name(info))
        inside, suffix = str(path), path.suffix.lower()
        if suffix == ".zip" or suffix not in PARSERS or any(p in SKIPPED or p.startswith(".") for p in path.parts):
            continue
        if info.file_size > MOST_ENTRY:
            part.warnings.append(f"entry left out, too large: {inside}")
            continue
        total += info.file_size
        if total > MOST_TOTAL:
            part.warnings.append("entries left out: the archive unpacks to more than 200 MB")
            break
        try:
            with archive.open(info) as f:
                child = parse(inside, f.read(MOST_ENTRY + 1), depth=depth + 1)
        except (ParseError, zipfile.BadZipFile, RuntimeError) as e:
            part.warnings.append(f"entry not readable: {inside} ({e})")
            continue
        child.metadata.setdefault("parent_name", name)
        child.metadata.setdefault("path_in_archive", inside)
        part.children.append(child)
    part.metadata["file_count"] = len(part.children)
    if part.children:
        listing = "\n".join(f"- {c.name}" for c in part.children[:MOST_LISTED])
        part.blocks.append(Block(f"압축파일 '{name}' 구성:\n{listing}", "meta"))
    return part
