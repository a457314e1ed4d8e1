"""Small text expressions.

The functions of this package return SQL text.  Detection, parsing and scoring
are long expressions over short word lists; as text each of them is built by one
call of ``F.expr``, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterable


def q(text: str) -> str:
    """SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def strip(col: str) -> str:
    """Remove leading and trailing white space, Unicode blanks included."""
    return f"regexp_replace({col}, {q(r'(?U)^\s+|\s+$')}, '')"


def present(col: str) -> str:
    """True when the field exists and is not empty."""
    return f"coalesce({col}, '') <> ''"


# The text of an event: the raw message if there is one, else the message.
EVENT_TEXT = "coalesce(nullif(raw_message, ''), message, '')"

# Raw message and message run together, as phases and failure counts see it.
JOINED_TEXT = "concat(coalesce(raw_message, ''), coalesce(message, ''))"


def has_any(col: str, words: Iterable[str]) -> str:
    """Substring test against a short word list.

    A chain of ``contains`` stays in generated code and beats a regex alternation,
    which retries every word at every position.
    """
    return "(" + " or ".join(f"contains({col}, {q(word)})" for word in words) + ")"


def first_group(col: str, pattern: str, group: int = 1) -> str:
    """First regex hit, NULL when there is none."""
    return f"nullif(regexp_extract({col}, {q(pattern)}, {group}), '')"


def lookup(mapping: dict[str, str], key: str) -> str:
    """Value of a small fixed mapping, NULL for other keys."""
    entries = ", ".join(f"{q(k)}, {q(v)}" for k, v in mapping.items())
    return f"try_element_at(map({entries}), {key})"


def first_case(arms: Iterable[tuple[str, str]], default: str = "null") -> str:
    """``case`` over (condition, result) pairs, first hit wins."""
    return "case " + " ".join(f"when {test} then {value}" for test, value in arms) + f" else {default} end"


def is_plain(pattern: str) -> bool:
    """True when a regex pattern contains no special character."""
    return not set(pattern) & set("\\.^$*+?{}[]|()")
