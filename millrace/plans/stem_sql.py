"""The published word stems (Porter 1980) as SQL over distinct tokens, to check ``stem_tokens`` with.

Each step is one relation of (token, w): the token and what is left of it so far. Beside it stands
the shape of w, a ``v`` or ``c`` per letter, whose prefix is the shape of a stem.
"""

from __future__ import annotations

from millrace.functions.stemming import STEP_2, STEP_3, STEP_4


def _shaped(relation: str) -> str:
    letters = "list_concat([''], string_split(w, ''))"
    vowel = "x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(sh, 1) = 'c')"
    shape = f"list_reduce({letters}, lambda sh, x: sh || CASE WHEN {vowel} THEN 'v' ELSE 'c' END)"
    return f"(SELECT *, length(w) n, {shape} AS shape FROM {relation})"


def _measure(cut: int | str) -> str:
    return f"len(regexp_extract_all(left(shape, CAST(n - {cut} AS BIGINT)), 'v+c+'))"


def _closed(cut: int) -> str:
    """Consonant, vowel, consonant other than w, x, y at the end of what the cut leaves."""
    return f"(right(left(shape, n - {cut}), 3) = 'cvc' AND right(left(w, n - {cut}), 1) NOT IN ('w', 'x', 'y'))"


def _exchange(table: dict[str, str], more_than: int = 0) -> str:
    """The longest suffix that fits decides; it is replaced if enough of a stem is left."""
    arms = []
    for s in sorted(table, key=len, reverse=True):
        enough = f"{_measure(len(s))} > {more_than}"
        if s == "ion":
            enough += f" AND substr(w, n - {len(s)}, 1) IN ('s', 't')"
        arms.append(f"WHEN suffix(w, '{s}') THEN CASE WHEN {enough} THEN left(w, n - {len(s)}) || '{table[s]}' ELSE w END")
    return f"CASE {' '.join(arms)} ELSE w END"


def stems(tokens: str) -> str:
    """Relations up to ``stems(token, stem)`` for the column ``token`` of a relation."""
    ending = "CASE WHEN suffix(w, 'ed') THEN 2 WHEN suffix(w, 'ing') THEN 3 END"
    steps = [
        f"SELECT DISTINCT token, token w FROM {tokens} WHERE length(token) > 2",
        """SELECT token, CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN left(w, length(w) - 2)
           WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, length(w) - 1) ELSE w END w FROM stem0""",
        f"""SELECT token, cut IS NOT NULL bare, CASE WHEN suffix(w, 'eed') AND {_measure(3)} > 0 THEN left(w, n - 1)
            WHEN cut IS NOT NULL THEN left(w, n - cut) ELSE w END w
            FROM (SELECT *, CASE WHEN NOT suffix(w, 'eed') AND contains(left(shape, n - {ending}), 'v') THEN {ending} END cut
                  FROM {_shaped("stem1")})""",
        f"""SELECT token, CASE WHEN NOT bare THEN w WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN w || 'e'
            WHEN n > 1 AND right(w, 1) = substr(w, n - 1, 1) AND right(shape, 1) = 'c' AND right(w, 1) NOT IN ('l', 's', 'z')
            THEN left(w, n - 1) WHEN {_measure(0)} = 1 AND {_closed(0)} THEN w || 'e' ELSE w END w FROM {_shaped("stem2")}""",
        f"""SELECT token, CASE WHEN suffix(w, 'y') AND contains(left(shape, n - 1), 'v') THEN left(w, n - 1) || 'i' ELSE w END w
            FROM {_shaped("stem3")}""",
        f"SELECT token, {_exchange(STEP_2)} w FROM {_shaped('stem4')}",
        f"SELECT token, {_exchange(STEP_3)} w FROM {_shaped('stem5')}",
        f"SELECT token, {_exchange(dict.fromkeys(STEP_4, ''), 1)} w FROM {_shaped('stem6')}",
        f"""SELECT token, CASE WHEN suffix(w, 'e') AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {_closed(1)}))
            THEN left(w, n - 1) ELSE w END w FROM {_shaped("stem7")}""",
        f"SELECT token, CASE WHEN suffix(w, 'll') AND {_measure(0)} > 1 THEN left(w, n - 1) ELSE w END w FROM {_shaped('stem8')}",
    ]
    relations = [f"stem{i} AS MATERIALIZED ({sql})" for i, sql in enumerate(steps)]
    all_tokens = f"SELECT DISTINCT token, token stem FROM {tokens} WHERE length(token) <= 2 UNION ALL SELECT token, w FROM stem9"
    return ",\n".join([*relations, f"stems AS MATERIALIZED ({all_tokens})"])
