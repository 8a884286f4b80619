"""Character classes of the byte-level chunk pattern: letters, numbers, white space, others."""
from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

END, LETTER, NUMBER, SPACE, BLANK, OTHER = range(6)
#: Unicode white space other than the space (fixed values: the White_Space property)
BLANKS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: no letters or numbers are assigned in the planes above
PLANES_END = 0x40000


@cache
def classes() -> np.ndarray:
    """Class of every code point.  Python's tables decide; code points that they do not know are
    asked of the tokenizers library, whose tables may be newer."""
    kinds = {"L": LETTER, "N": NUMBER}
    names = [unicodedata.category(chr(c)) for c in range(PLANES_END)]
    out = np.full(0x110000, OTHER, np.uint8)
    out[:PLANES_END] = [kinds.get(n[0], OTHER) for n in names]
    out[BLANKS] = BLANK
    out[32] = SPACE
    unknown = [c for c, n in enumerate(names) if n == "Cn"]
    from tokenizers.pre_tokenizers import ByteLevel
    probe = "".join(f"a{chr(c)}.1{chr(c)}." for c in unknown)
    found = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(probe)
    border = np.zeros(len(probe) + 1, bool)
    border[[span[0] for _, span in found]] = True
    at = 6 * np.arange(len(unknown))
    out[np.array(unknown)[~border[at + 1]]] = LETTER
    out[np.array(unknown)[~border[at + 4]]] = NUMBER
    return out


def ranges(*wanted: int) -> str:
    """The code points of some classes as the inside of a regular expression's character class."""
    inside = np.isin(classes(), wanted)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())
