"""What the operators on texts share: markup and the remains of wrong decoding."""

from __future__ import annotations

import re

#: Tags, comments and declarations; a "less than" sign in prose begins none of these.
TAG = re.compile(r"<(?:!--.*?--|[/!?]?[A-Za-z][^<>]*)>", re.S)
LEADS, FOLLOWS = "[Â-ô]", "[\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
#: A character of two to four bytes whose bytes were read one by one.
MOJIBAKE = re.compile(LEADS + FOLLOWS + "{1,3}")


def _read_again(match: re.Match) -> str:
    raw = bytearray()
    for c in match.group():
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            raw.append(ord(c) & 0xFF)
    for end in range(len(raw), 1, -1):
        try:
            return raw[:end].decode("utf-8") + match.group()[end:]
        except UnicodeDecodeError:
            continue
    return match.group()


def decoded(text: str) -> str:
    """The text with its bytes put together again where they were read one by one."""
    return MOJIBAKE.sub(_read_again, text)
