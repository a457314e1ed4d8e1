"""Many rules at once: lines meet rules by a piece of text which a match cannot do without.

Of each pattern, the parts every match contains word for word are known from the pattern's structure.  One
short piece of them (the one fewest rules use) is the pattern's key.  A line gives the pieces of the same length
it contains; both sides meet by an equality join with the rules, which are configuration and broadcast, and only
the pairs which meet are tried.  So a line costs its own length, not the number of rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pin import pin

try:  # the module's name since Python 3.11
    from re import _constants as codes, _parser as parser
except ImportError:
    import sre_constants as codes
    import sre_parse as parser

#: Lengths of pieces; a pattern takes the longest it has.
LENGTHS = (4, 3, 2)


def _strings(tokens) -> list[list[str]]:
    """Texts which every match contains, as lists of alternatives: of each list one text is there."""
    found: list[list[str]] = []
    run: list[str] = []

    def close():
        if run:
            found.append(["".join(run)])
            run.clear()

    for op, value in tokens:
        if op is codes.LITERAL and chr(value).isascii():
            run.append(chr(value).lower())
            continue
        if op is codes.SUBPATTERN and not value[1] and not value[2]:  # flags as outside
            inner = list(value[3])
            if all(o is codes.LITERAL and chr(v).isascii() for o, v in inner):
                run += [chr(v).lower() for _, v in inner]
                continue
        close()
        if op is codes.SUBPATTERN:
            found += _strings(value[3])
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _strings(value[2])
        elif op is codes.ATOMIC_GROUP:
            found += _strings(value)
        elif op is codes.BRANCH:
            arms = [_strings(arm) for arm in value[1]]
            if all(arms):
                best = [max(arm, key=lambda texts: min(map(len, texts))) for arm in arms]
                found.append([text for texts in best for text in texts])
    close()
    return found


def required(pattern: str) -> list[list[str]]:
    """``_strings`` of a pattern; one that is broken stands for its own text."""
    try:
        tree = parser.parse(pattern, re.IGNORECASE)
    except re.error:
        return [[piece.lower() for piece in [max(re.split("[^\x00-\x7f]+", pattern), key=len)] if piece]]
    return _strings(tree) if not tree.state.flags & re.VERBOSE else []


def _pieces(text: str, length: int) -> set[str]:
    return {text[i:i + length] for i in range(len(text) - length + 1)}


def keys(patterns: Iterable[str]) -> list[list[str] | None]:
    """Keys of each pattern, one of which any match contains; None where there are none."""
    needed = [required(p) for p in patterns]
    use = Counter(piece for lists in needed for texts in lists for text in texts for n in LENGTHS for piece in _pieces(text, n))
    out: list[list[str] | None] = []
    for lists in needed:
        best = None
        for texts in lists:
            for n in LENGTHS:
                if texts and all(len(t) >= n for t in texts):
                    chosen = sorted({min(_pieces(t, n), key=lambda piece: (use[piece], piece)) for t in texts})
                    rank = (-n, len(chosen), sum(use[c] for c in chosen))
                    if best is None or rank < best[0]:
                        best = (rank, chosen)
                    break
        out.append(best[1] if best else None)
    return out


# Lower-casing leaves two letters which patterns take for ASCII ones.
_FOLDED = "translate(concat(_low, '\\n', _type), 'ſı', 'si')"


def _matches(pattern: str, plain: str) -> str:
    return f"if({plain}, contains(_low, {pattern}) or contains(_type, {pattern}), rlike(_low, {pattern}) or rlike(_type, {pattern}))"


def indexed_hits(text: DataFrame, entries: list[tuple[int, list[tuple[str, bool, list[str]]]]], keep: tuple[str, ...]) -> DataFrame:
    """(position, seq, keep) of the rules ``entries``: position and (pattern, plain, keys) of each pattern.

    ``text`` has ``_low`` and ``_type``.  A line counts once for a rule: at the first of its patterns which matches, and
    of that at the first key which the line contains.
    """
    rows = []
    for position, patterns in entries:
        for i, (pattern, plain, found) in enumerate(patterns):
            earlier = [{"pattern": p, "plain": f} for p, f, _ in patterns[:i]]
            rows += [(key, position, pattern, plain, earlier, found[:j]) for j, key in enumerate(found)]
    table = text.sparkSession.createDataFrame(
        rows, "_key string, position int, _pattern string, _plain boolean, _earlier array<struct<pattern: string, plain: boolean>>, _before array<string>")
    lengths = sorted({len(r[0]) for r in rows})
    grams = [
        f"if(length(_all) >= {n}, transform(sequence(1, length(_all) - {n - 1}), i -> substring(_all, i, {n})), cast(array() as array<string>))"
        for n in lengths]
    # Pieces are made once a line.  Neither the explode nor the join has a function of arrays, so generated code runs
    # both and copies no line for a piece; what is tried on the pairs which meet stays behind the join.
    lines = pin(text.selectExpr("*", f"{_FOLDED} as _all"), _pieces=f"array_distinct({grams[0] if len(grams) == 1 else f'concat({', '.join(grams)})'})")
    met = lines.selectExpr("*", "explode(_pieces) as _key").drop("_pieces").join(F.broadcast(table), "_key")  # rules are driver-side configuration
    first = "not exists(_before, k -> contains(_all, k))"
    unmatched = f"not exists(_earlier, e -> {_matches('e.pattern', 'e.plain')})"
    return pin(met, _hit=f"{_matches('_pattern', '_plain')} and {first} and {unmatched}").where("_hit").select("position", "seq", *keep)
