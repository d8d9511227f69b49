"""Splits texts into units that a word-level tokenizer treats independently."""

from __future__ import annotations

import re

_BEYOND_LATIN = re.compile(f"[^{chr(0)}-{chr(0x12F)}]")
_LETTERS, _SPACE = "".join(chr(i) for i in range(0x130) if chr(i).isalpha()), r"\x20\x09-\x0D"
#: Of a Latin text: words of letters, the comma or full stop at their end apart from them,
#: and words of another form.
LATIN_UNITS = re.compile(rf"[{_LETTERS}]+(?=[,.]?(?:[{_SPACE}]|\Z))|[,.](?=[{_SPACE}]|\Z)|[^{_SPACE}]+")


def is_latin(text: str) -> bool:
    """Whether lower-casing and normalisation work on each character alone: no
    combining marks, no letters whose lower case depends on their neighbours."""
    return _BEYOND_LATIN.search(text) is None


def halves(word: str) -> tuple[str, str] | None:
    """A Latin word as (letters in lower case, one trailing comma or full stop or
    ""); None if the word isn't of that form."""
    body, tail = (word[:-1], word[-1]) if word[-1] in ",." else (word, "")
    return (body.lower(), tail) if body.isalpha() and (body.isascii() or is_latin(body)) else None
