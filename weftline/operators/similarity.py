"""Term similarity of two texts outside of a plan (for folds whose next step depends on the last)."""

from __future__ import annotations

import math
import re
from collections import Counter

_TERM = re.compile(r"\w{2,}")
_IDF = 1.0 + math.log(1.5)


def cosine(a: str, b: str) -> float:
    """The same measure as markdown.pair_cosine."""
    x, y = Counter(_TERM.findall(a.lower())), Counter(_TERM.findall(b.lower()))
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    dot = sum(n * y[w] for w, n in x.items() if w in y)
    size = lambda c, o: math.sqrt(sum((n * (1.0 if w in o else _IDF)) ** 2 for w, n in c.items()))
    return dot / (size(x, y) * size(y, x))
