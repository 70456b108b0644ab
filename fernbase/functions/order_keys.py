"""Fractional order keys: texts whose byte order is the order of siblings, with room between any two.

A key is a fraction in base 62, written without the point; it never ends in the smallest digit, so there
is always a key between two different ones.
"""

from __future__ import annotations

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_VALUE = {c: i for i, c in enumerate(DIGITS)}
_BASE = len(DIGITS)


def _check(key: str) -> str:
    if key and (any(c not in _VALUE for c in key) or key.endswith(DIGITS[0])):
        raise ValueError(f"{key!r} is no order key")
    return key


def between(low: str | None, high: str | None) -> str:
    """A short key above ``low`` (None: the start) and below ``high`` (None: the end)."""
    a, b = _check(low or ""), _check(high or "")
    if b and a >= b:
        raise ValueError(f"no key lies between {a!r} and {b!r}")
    out, bounded, i = "", bool(b), 0
    while True:
        x = _VALUE[a[i]] if i < len(a) else 0
        y = _VALUE[b[i]] if bounded and i < len(b) else _BASE
        if y - x > 1:
            return out + DIGITS[(x + y) // 2]
        out += DIGITS[x]
        if y > x:  # one digit below the bound: everything after is free
            bounded = False
        i += 1


def spread(low: str | None, high: str | None, count: int) -> list[str]:
    """``count`` ascending keys between two, by halving, so that they stay short."""
    if count <= 0:
        return []
    middle = between(low, high)
    left = (count - 1) // 2
    return [*spread(low, middle, left), middle, *spread(middle, high, count - 1 - left)]


def after(low: str | None, count: int) -> list[str]:
    """Ascending keys after one, growing slowly: the last digit is raised before a new one is added."""
    out, key = [], _check(low or "")
    for _ in range(count):
        key = _next(key)
        out.append(key)
    return out


def _next(key: str) -> str:
    for i, c in enumerate(key):
        if c != DIGITS[-1]:
            return key[:i] + DIGITS[_VALUE[c] + 1]
    return key + DIGITS[1]


def before(high: str | None, count: int) -> list[str]:
    """Ascending keys before one."""
    return spread(None, high or None, count)
