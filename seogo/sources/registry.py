"""Parsers by file extension."""

from __future__ import annotations

from collections.abc import Callable

from .archive import parse_zip
from .hwp import parse_hwp
from .hwpx import parse_hwpx
from .image import MEDIA_TYPES, parse_image
from .mail import parse_eml, parse_msg
from .markup import parse_html
from .model import Part, ParseError
from .office import parse_docx, parse_pptx, parse_xlsx
from .pdf import parse_pdf
from .plain import LANGUAGES, TABLES, TEXTS, parse_code, parse_delimited, parse_text, suffix_of

Parser = Callable[..., Part]
DEEPEST = 2
#: Extension -> parser(name, data); add entries to support more formats.
PARSERS: dict[str, Parser] = {
    ".pdf": parse_pdf, ".hwpx": parse_hwpx, ".hwp": parse_hwp, ".docx": parse_docx, ".pptx": parse_pptx, ".xlsx": parse_xlsx, ".xlsm": parse_xlsx,
    ".eml": parse_eml, ".msg": parse_msg, ".html": parse_html, ".htm": parse_html, ".zip": parse_zip,
    **dict.fromkeys(MEDIA_TYPES, parse_image), **dict.fromkeys(TEXTS, parse_text), **dict.fromkeys(TABLES, parse_delimited), **dict.fromkeys(LANGUAGES, parse_code),
}
_NESTING = {parse_zip, parse_eml, parse_msg}
# Names of formats for users.
LABELS = {
    "pdf": "PDF", "hwpx": "한글(HWPX)", "hwp": "한글(HWP)", "docx": "Word", "pptx": "PowerPoint", "xlsx": "Excel", "eml": "메일", "msg": "메일", "html": "HTML",
    "zip": "압축파일", "image": "이미지", "text": "텍스트", "markdown": "마크다운", "csv": "CSV", "code": "소스코드",
}


def supported_extensions() -> set[str]:
    return set(PARSERS)


def parse(name: str, data: bytes, depth: int = 0) -> Part:
    """One file as a tree of parts; files nested too deep, or of unknown type, are errors."""
    suffix = suffix_of(name)
    parser = PARSERS.get(suffix)
    if parser is None:
        raise ParseError(f"unsupported file type: {suffix or '(no extension)'}")
    if depth > DEEPEST:
        raise ParseError("archives or attachments are nested too deep")
    return parser(name, data, depth) if parser in _NESTING else parser(name, data)
