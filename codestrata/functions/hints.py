"""Cheap pre-tests for rule patterns.

A pattern can only match a text that holds one of its required words, and a plain substring
test is many times faster than a case-blind regular expression. The words are read off the
pattern, so a rule row needs nothing extra; a pattern without a usable word has no pre-test.
"""

from __future__ import annotations

from functools import lru_cache

try:
    from re import _parser as _sre
except ImportError:  # older Python
    import sre_parse as _sre

MIN_WORD = 2


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    usable = [o for o in options if o and all(len(w) >= MIN_WORD for w in o)]
    return max(usable, key=lambda o: (min(len(w) for w in o), -len(o)), default=None)


def _words(items) -> frozenset[str] | None:
    """One of the returned words occurs in every match of the sequence."""
    options: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            options.append(frozenset([run]))
        run = ""

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        close()
        inner = None
        if name == "SUBPATTERN":
            inner = _words(arg[3])
        elif name == "BRANCH":
            parts = [_words(b) for b in arg[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            inner = _words(arg[2])
        if inner:
            options.append(inner)
    close()
    return _best(options)


@lru_cache(maxsize=None)
def required_words(pattern: str) -> tuple[str, ...]:
    """Lower-case words, one of which every match holds; empty if there is no such list."""
    try:
        found = _words(_sre.parse(pattern))
    except Exception:  # a form this parser does not know: no pre-test, the pattern decides
        return ()
    if not found or not all(w.isascii() for w in found):
        return ()
    return tuple(sorted(found))
