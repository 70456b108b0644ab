"""File names that are unique among siblings."""

from __future__ import annotations

import re
from collections.abc import Iterable

_NUMBERED = re.compile(r"(.*?)\s*\((\d+)\)", re.S)


def numbered(name: str) -> str:
    """``a.txt`` gives ``a (1).txt``, and that gives ``a (2).txt``. A leading dot begins no extension."""
    dot = name.rfind(".")
    stem, extension = (name[:dot], name[dot:]) if dot > 0 else (name, "")
    found = _NUMBERED.fullmatch(stem)
    return f"{found[1]} ({int(found[2]) + 1}){extension}" if found else f"{stem} (1){extension}"


#: A numbered name as :func:`numbered` writes it: stem, number, extension.
NUMBERED = r"^(.*) \(([1-9][0-9]{0,17})\)(\.[^.]*)?$"
#: The extension of a name; a leading dot begins none.
EXTENSION = r"(?<=.)(\.[^.]*)$"


def joined(stem: str, extension: str, number: int) -> str:
    return f"{stem} ({number}){extension}"


def split(name: str) -> tuple[str, str, int]:
    """Stem, extension and number of a numbered name."""
    dot = name.rfind(".")
    base, extension = (name[:dot], name[dot:]) if dot > 0 else (name, "")
    found = _NUMBERED.fullmatch(base)
    return found[1], extension, int(found[2])


def unique_names(wanted: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """The names, numbered up until none is taken by a sibling or an earlier one."""
    used, out = set(taken), []
    for name in wanted:
        while name in used:
            name = numbered(name)
        used.add(name)
        out.append(name)
    return out
