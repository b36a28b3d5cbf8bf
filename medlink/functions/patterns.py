"""Word boundaries written out, so results do not depend on the Java version.

Java has changed what ``\\b`` means for non-Latin letters; the texts here mix CJK and
Latin without spaces, where that decides matches.
"""

from __future__ import annotations

import re


def _alternatives(inside: str) -> list[str]:
    """Branches of a group's inside; none for insides with nested groups, classes or an escaped parenthesis."""
    return [] if re.search(r"[()\[\]]|\\$", inside) else inside.split("|")


def _begins_with_word(rest: str) -> bool:
    """Whether a match of ``rest`` surely starts with an ASCII letter or digit (False if in doubt)."""
    group = re.match(r"\((?:\?:)?([^()]*)\)(?![?*{])", rest)
    if group:
        branches = _alternatives(group[1])
        return bool(branches) and all(_begins_with_word(b) for b in branches)
    return re.match(r"(?:[A-Za-z0-9]|\\d|\[(?:0-9|[A-Za-z0-9](?!-))+\])(?:\{[1-9]|(?![?*{]))", rest) is not None


def _expand(pattern: str, word: str) -> str:
    begin = f"(?<!{word})(?={word})"
    end = f"(?<={word})(?!{word})"
    # A boundary before a word character can only be a beginning; it is tried at every place of a text, so it is kept short.
    parts = pattern.split(r"\b")
    pattern = parts[0] + "".join((f"(?<!{word})" if _begins_with_word(p) else r"\b") + p for p in parts[1:])
    return pattern.replace(r"\b", f"(?:{begin}|{end})").replace(r"\m", begin).replace(r"\M", end)


def ascii_bounds(pattern: str) -> str:
    """Words are runs of A-Z, a-z, 0-9 and the underscore."""
    return _expand(pattern, "[A-Za-z0-9_]")


def unicode_bounds(pattern: str) -> str:
    """Words are runs of any letters, digits and the underscore."""
    return _expand(pattern, r"[\p{L}\p{N}_]")
