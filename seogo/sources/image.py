"""Images, through a text reader that the user registers."""

from __future__ import annotations

from collections.abc import Callable

from .model import Part, ParseError
from .plain import suffix_of, text_blocks

MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}
MOST_BYTES = 5 * 1024 * 1024
ImageReader = Callable[[bytes, str], str]
_reader: ImageReader | None = None


def set_image_reader(reader: ImageReader | None) -> None:
    """Register ``reader(bytes, media_type) -> text`` in this process; null removes it. Spark readers take
    the function as an argument and register it in their workers, so it must be picklable."""
    global _reader
    _reader = reader


def parse_image(name: str, data: bytes) -> Part:
    if _reader is None:
        raise ParseError("no image reader is registered")
    if len(data) > MOST_BYTES:
        raise ParseError(f"the image is larger than {MOST_BYTES // 1024 // 1024} MB")
    try:
        text = _reader(data, MEDIA_TYPES.get(suffix_of(name), "image/png"))
    except ParseError:
        raise
    except Exception as e:
        raise ParseError(f"the image could not be read: {e}") from e
    blocks = text_blocks(text.strip())
    return Part(name, "image", blocks, warnings=[] if blocks else ["이미지에서 글자를 찾지 못했어요."])
