"""Code-point classes, as sets for Python and as regular-expression classes that Java and RE2 both read."""

from __future__ import annotations

# Code points that count as white space.
WHITESPACE = (
    0x0009, 0x000A, 0x000D, 0x0020, 0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000,
)
# Code points that count as control characters besides the ranges below.
CONTROL = (
    0x007F, 0x00AD, 0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x061C, 0x06DD, 0x070F, 0x08E2, 0x180E, 0x200B,
    0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064,
    0x2066, 0x2067, 0x2068, 0x2069, 0x206A, 0x206B, 0x206C, 0x206D, 0x206E, 0x206F, 0xFEFF, 0xFFF9, 0xFFFA, 0xFFFB,
    0x110BD, 0x110CD, 0x13430, 0x13431, 0x13432, 0x13433, 0x13434, 0x13435, 0x13436, 0x13437, 0x13438, 0x1BCA0,
    0x1BCA1, 0x1BCA2, 0x1BCA3, 0x1D173, 0x1D174, 0x1D175, 0x1D176, 0x1D177, 0x1D178, 0x1D179, 0x1D17A, 0xE0001,
)
# Ranges of control characters (tab, line feed and carriage return are none).
CONTROL_RANGES = ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x80, 0x9F), (0xE000, 0xF8FF), (0xE0020, 0xE007F), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
#: C0 and C1 controls only.
CONTROL_LAX_RANGES = ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F))
#: What Unicode calls White_Space: trimmed at the end of text before a special token, and blank texts.
BLANK_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
REPLACEMENT = 0xFFFD
MARKER = "▁"


def regex_class(points=(), ranges=()) -> str:
    """A bracket expression of code points and ranges."""
    return "[" + "".join(rf"\x{{{p:X}}}" for p in points) + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


WHITESPACE_CLASS = regex_class(WHITESPACE)
CONTROL_CLASS = regex_class(CONTROL, CONTROL_RANGES)
CONTROL_LAX_CLASS = regex_class((), CONTROL_LAX_RANGES)
DROPPED_CLASS = regex_class((*CONTROL, REPLACEMENT), CONTROL_RANGES)
#: Printable characters up to U+02FF but spaces and the soft hyphen: none is white space or a control.
PLAIN_CLASS = regex_class((), ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0x2FF)))
BLANK_CLASS = regex_class((), BLANK_RANGES)

WHITESPACE_SET = frozenset(map(chr, WHITESPACE))
_SINGLE = frozenset((*CONTROL, REPLACEMENT))


def is_dropped(c: str) -> bool:
    """Whether cleaning deletes the character."""
    p = ord(c)
    return p in _SINGLE or any(a <= p <= b for a, b in CONTROL_RANGES)
