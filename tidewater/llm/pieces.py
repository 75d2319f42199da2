"""Texts as space-led pieces.

Byte-level BPE splits a text into pre-tokens by a fixed pattern. A space that a non-space follows
always begins a pre-token, so a text may be cut there and every piece be encoded by itself.
"""

from __future__ import annotations

import re

#: Pieces longer than this are worked out anew each time.
LONGEST_KEPT = 64

_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """The pieces of any text; all but the first have lost their leading space."""
    return _CUT.split(text)
