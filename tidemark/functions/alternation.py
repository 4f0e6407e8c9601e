"""Merge an ordered list of patterns into one expression with shared beginnings.

Alternatives that begin with different letters can never match at the same place, so
grouping them by letter keeps "first in list wins" while most positions of a text are
rejected by one character test.
"""

from __future__ import annotations

from collections.abc import Sequence

QUANTIFIERS = tuple("?*+{")
DEPTH = 2


def merged(patterns: Sequence[str], depth: int = DEPTH) -> str:
    """One expression for all patterns, to be matched without regard to case."""
    alternatives = [a for p in patterns for a in (opened(p) if is_single(p) else [f"(?:{p})"])]
    heads = {literal_head(a) for a in alternatives}
    guard = "" if "" in heads else "(?=[" + "".join(sorted(heads)) + "])"
    return guard + "(?:" + grouped(alternatives, depth) + ")"


def is_single(pattern: str) -> bool:
    """No alternative outside groups; where classes or escapes make that unclear, the answer is no."""
    if "[" in pattern or "\\" in pattern:
        return "|" not in pattern
    depth = 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return False
    return True


def opened(pattern: str) -> list[str]:
    """`(?:a|b)c` as `ac`, `bc` when the leading group is flat and not repeated; else the pattern itself."""
    if not pattern.startswith("(?:"):
        return [pattern]
    inner, _, rest = pattern[3:].partition(")")
    if "(" in inner or rest.startswith(QUANTIFIERS):
        return [pattern]
    return [choice + rest for choice in inner.split("|")]


def literal_head(pattern: str) -> str:
    """The first character when it is a plain, unrepeated one, else nothing."""
    plain = pattern[:1].isalnum() or pattern[:1] in (" ", "'")
    return pattern[:1].lower() if plain and pattern[:1] and not pattern[1:].startswith(QUANTIFIERS) else ""


def grouped(alternatives: Sequence[str], depth: int) -> str:
    """Runs between alternatives without a plain first character are grouped by that character."""
    runs: list[dict[str, list[str]]] = [{}]
    for a in alternatives:
        head = literal_head(a)
        if not head:
            runs += [{"": [a]}, {}]
        else:
            runs[-1].setdefault(head, []).append(a)
    parts = []
    for run in runs:
        for head, members in run.items():
            if head and len(members) > 1 and depth:
                parts.append(f"{head}(?:{grouped([m[1:] for m in members], depth - 1)})")
            else:
                parts += members
    return "|".join(parts)
