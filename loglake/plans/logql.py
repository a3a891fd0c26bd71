"""Label selectors with one line filter: ``{a="x", b="y"} |= "text"``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from loglake.functions.core import BadRequest


@dataclass(frozen=True)
class ParsedQuery:
    labels: tuple[tuple[str, str], ...]
    contains: str | None = None


_TERM = re.compile(r'\s*([^=!~"{},\s]+)\s*=\s*"([^"]*)"\s*')


def parse_labels(text: str) -> dict[str, str]:
    """Labels between the first braces; the last of equal names holds. Values can't hold a comma or a closing brace."""
    found = re.search(r"\{([^}]*)\}", text)
    if not found:
        raise BadRequest("a selector in braces is missing")
    out: dict[str, str] = {}
    for term in found[1].split(","):
        if term.strip():
            m = _TERM.fullmatch(term)
            if not m:
                raise BadRequest(f"not a label equality: {term.strip()}")
            out[m[1]] = m[2]
    return out


def parse(query: str) -> ParsedQuery:
    """Chained filters and every operator but equality and ``|=`` are refused."""
    query = query.strip()
    if not query.startswith("{") or "}" not in query:
        raise BadRequest("a query starts with a selector in braces")
    labels, rest = parse_labels(query), query[query.index("}") + 1 :].strip()
    if not rest:
        return ParsedQuery(tuple(labels.items()))
    m = re.fullmatch(r'\|=\s*"([^"]*)"', rest)
    if not m:
        raise BadRequest(f"not a line filter: {rest}")
    return ParsedQuery(tuple(labels.items()), m[1])
