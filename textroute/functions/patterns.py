"""Patterns written with the usual shorthands, read as Unicode-aware."""
from __future__ import annotations

from .text import EDGE

# What each shorthand stands for inside a bracketed class.
_MEMBERS = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\s\x0B\x1C-\x1F\x85\p{Z}"}


def unicode_pattern(pattern: str) -> str:
    """Spell out `\\w`, `\\d`, `\\s` and `\\b`, so that they do not depend on the engine's defaults."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            name = pattern[i + 1]
            if name in _MEMBERS:
                out.append(_MEMBERS[name] if in_class else f"[{_MEMBERS[name]}]")
            elif name == "b" and not in_class:
                out.append(EDGE)
            else:
                out.append(ch + name)
            i += 2
            continue
        in_class = (ch == "[") if not in_class else (ch != "]")
        out.append(ch)
        i += 1
    return "".join(out)
