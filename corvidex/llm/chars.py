"""Texts as arrays of code points."""

from __future__ import annotations

import numpy as np


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
