"""Sizes such as 5M or 1.5g."""

from __future__ import annotations

import re

from ..errors import BadArgument

_FACTORS = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9}


def parse_size(text: str) -> int:
    """A number, perhaps with an exponent, and an optional K, M or G (powers of 1000, any case), rounded to a whole one."""
    m = re.fullmatch(r"(\+?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d{1,3})?)\s*([kmg]?)", text.strip(), re.IGNORECASE)
    if not m or float(m[1]) * _FACTORS[m[2].upper()] >= 2**64:
        raise BadArgument(f"not a size: {text!r}")
    return int(float(m[1]) * _FACTORS[m[2].upper()] + 0.5)
