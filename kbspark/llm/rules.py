"""Secret-scan rules, and the Boolean trigram query that each of their patterns implies."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from re import _constants as C
from re import _parser as P


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java, RE2 and Python share; matches shorter than `least` in `group` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which they are listed. The runs of `access` and `hex` end only
#: where their class ends, so asking for the least length in the pattern drops just the short ones.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public formats of credentials.
MORE = (
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    # the key's body goes with its heading: up to the END line, or as far as it looks like a body
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\x20\t\r\n\\:,._-]*?-----END [A-Z ]*PRIVATE KEY-----|[\x20\t\r\n\\]*[A-Za-z0-9+/=\r\n\\]{40,}|)"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]+:([^\x20\x09-\x0D@/]+)@", 1, 8),
)
RULES = BASE + MORE

#: A class with more letters than this stands for any letter; so does a set of more strings.
_MOST_LETTERS, _MOST_STRINGS = 8, 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams: a text that matches holds all of at least one.

    An empty list says that nothing is mandatory, so the rule must scan every text.
    """
    flags = re.IGNORECASE if pattern.startswith("(?i)") else 0
    pieces = _strings(P.parse(pattern.removeprefix("(?i)"), flags))
    alternatives = {frozenset()}
    for strings in pieces:  # each piece is a set of strings of which one must occur
        needs = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in needs:
            grown = {a | n for a, n in product(alternatives, needs)}
            alternatives = grown if len(grown) <= _MOST_STRINGS else alternatives
    if frozenset() in alternatives:
        return []
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _strings(nodes) -> list[set[str]]:
    """Cuts a pattern into pieces, each the set of all strings that it can be; unknown stretches part them."""
    pieces: list[set[str]] = [{""}]
    for node in nodes:
        exact = _exact(node)
        if exact is not None:
            grown = {a + b for a, b in product(pieces[-1], exact)}
            pieces[-1:] = [grown] if len(grown) <= _MOST_STRINGS else [pieces[-1], exact]
            continue
        kind, value = node
        if kind is C.SUBPATTERN:
            pieces += [*_strings(value[3]), {""}]
        elif kind is C.MAX_REPEAT and value[0] > 0:
            first = [_exact(x) for x in value[2]]
            if len(first) == 1 and first[0] is not None and value[0] <= 4:
                pieces[-1] = {a + b for a, b in product(pieces[-1], {"".join(x) for x in product(first[0], repeat=value[0])})}
            pieces += [*_strings(value[2]), {""}]
        else:
            pieces.append({""})
    return pieces


def _exact(node) -> set[str] | None:
    """All strings that a node can match, in lower case, or None if they are too many."""
    kind, value = node
    if kind is C.LITERAL:
        return {chr(value).lower()}
    if kind is C.IN:
        letters: set[str] = set()
        for k, v in value:
            if k is C.LITERAL:
                letters.add(chr(v).lower())
            elif k is C.RANGE and v[1] - v[0] < _MOST_LETTERS:
                letters |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return letters if len(letters) <= _MOST_LETTERS else None
    if kind is C.SUBPATTERN:
        return _product(value[3])
    if kind is C.BRANCH:
        branches = [_product(b) for b in value[1]]
        return None if None in branches else set().union(*branches)
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] <= 1:
        inner = _product(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _product(nodes) -> set[str] | None:
    strings = {""}
    for node in nodes:
        exact = _exact(node)
        if exact is None or len(strings) * len(exact) > _MOST_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, exact)}
    return strings
