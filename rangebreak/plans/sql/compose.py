"""Named SQL steps and their assembly into one standalone statement.

A step name ends in ``_$`` where ``$`` stands for the grid letter. A statement pulls in exactly the
steps whose names it mentions, directly or through another step.
"""

from __future__ import annotations

import re

STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def _mentions(text: str, grid: str) -> list[str]:
    words = set(re.findall(r"[a-z][a-z0-9_]*", text))
    return [name for name in STEPS if name.replace("$", grid) in words]


def half_up(sql: str) -> str:
    """Spell ``round(x, d)`` as floor arithmetic, which both engines evaluate to the same double."""
    while (found := re.search(r"\bround\(", sql)) is not None:
        depth, at, comma = 1, found.end(), -1
        while depth:
            char = sql[at]
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 1:
                comma = at
            at += 1
        inner, digits = sql[found.end() : comma], sql[comma + 1 : at - 1].strip()
        sql = f"{sql[: found.start()]}(floor(({inner}) * 1e{digits} + 0.5) / 1e{digits}){sql[at:]}"
    return sql


def statement(sql: str, grid: str = "m") -> str:
    body = half_up(sql.replace("$", grid))
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _mentions(text, grid):
            if name not in ordered:
                inner = STEPS[name].replace("$", grid)
                visit(inner)
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    parts = [
        f"{name.replace('$', grid)} AS MATERIALIZED ({STEPS[name].replace('$', grid)})" for name in ordered
    ]
    return "WITH " + ",\n".join(parts) + "\n" + body
