"""Words of ASCII letters, digits and other scripts, read from UTF-8 bytes inside tasks."""

from __future__ import annotations

import string

_WORD = set((string.digits + string.ascii_letters).encode()) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte outside words into a space.
_FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and b in _WORD else b if b in _WORD else 0x20 for b in range(256))

#: The same words as a regular expression over text in which A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: DuckDB: a text with A-Z lower-cased, other letters unchanged.
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def terms(text: bytes | None) -> list[bytes]:
    """The words of a text, with A-Z lower-cased; a null text has none."""
    return text.translate(_FOLD).split() if text else []
