"""Sequential models of the operators, as short as can be, for comparison on random lines."""

from __future__ import annotations

import re


def skip(lines: list[tuple[int | None, bool]]) -> list[bool]:
    """Which of (level, boilerplate) lines are hidden."""
    out, hidden = [], None
    for level, boilerplate in lines:
        if level is not None and hidden is not None and level <= hidden:
            hidden = None
        if level is not None and hidden is None and boilerplate:
            hidden = level
        out.append(hidden is not None)
    return out


def merge(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(test_id, text) rows in order, runs of one id joined."""
    out: list[list] = []
    for i, text in rows:
        if out and i and out[-1][0] == i:
            out[-1][1].append(text)
        else:
            out.append([i, [text]])
    return [(i, t[0] if len(t) == 1 else "\n".join(x for x in t if x.strip())) for i, t in out]


PRE, STEPS = {"preconditions", "precondition"}, {"steps", "procedure"}


def section(lines: list[str], words: str = "step|result") -> tuple[str, str, str]:
    """Description, preconditions and steps of a section."""
    told, needs, tables, state, open_ = [], [], [], "d", False
    for line in (x.strip() for x in lines):
        label = line.lower().rstrip(":")
        if not line:
            open_ = False
        elif label in PRE | STEPS:
            state, open_ = ("p" if label in PRE else "b"), False
        elif "|" in line and len(line) > 2:
            if not open_:
                tables.append((state, []))
            tables[-1][1].append(line)
            state, open_ = "b", True
        else:
            open_ = False
            {"d": told, "p": needs}.get(state, []).append(line)
    kept = ["\n".join(r) for s, r in tables if s == "b" or any(re.search(words, c.lower()) for c in r[0].split("|"))]
    return "\n".join(told), "\n".join(needs), "\n\n".join(kept)


def pages(blocks: list[tuple]) -> str:
    """The text of a document's blocks (page, top, left, number, text or rows of cells)."""
    out: dict[int, list[str]] = {}
    for page, _, _, _, what in sorted(blocks, key=lambda b: (b[0], round(b[1], 2), round(b[2], 2), b[3])):
        if isinstance(what, list):
            text = "\n".join(" | ".join((c or "").replace("\n", " ").strip() for c in row) for row in what) + "\n"
        else:
            text = what.strip()
        if text.strip():
            out.setdefault(page, []).append(text)
    return "\n\n".join("\n".join(out[p]) for p in sorted(out)).strip()


def page_of_words(words: list[tuple], tables: list[tuple], size: tuple[float, float] | None) -> str:
    """The text of a page of words (x0, top, x1, bottom, text) and tables (x0, top, x1, bottom, rows of cells)."""

    def said(found: list[tuple]) -> str:
        lines, last = [], None
        for top, x0, nth, text in sorted(found):
            if last is None or top > last + 3:
                lines.append([])
            lines[-1].append((x0, nth, text))
            last = top
        return "\n".join(" ".join(t for *_, t in sorted(line)) for line in lines)

    named = [(n, *w[:4], w[4].strip()) for n, w in enumerate(words) if w[4] and w[4].strip()]
    if not tables:
        return said([(top, x0, n, t) for n, x0, top, _, _, t in named])
    width, height = size or (float("inf"), float("inf"))
    parts, cursor = [], 0.0
    ordered = sorted(enumerate(tables), key=lambda t: (round(t[1][1], 2), round(t[1][0], 2), t[0]))
    for _, (_, top, _, bottom, rows) in [*ordered, (0, (0, height, 0, height, None))]:
        top, bottom = max(0.0, min(top, height)), max(0.0, min(bottom, height))
        if top > cursor + 1:
            parts.append(said([(max(t, cursor), x0, n, text) for n, x0, t, x1, b, text in named if b >= cursor and t <= top and x0 <= width and x1 >= 0]))
        if rows is not None:
            pipes = "\n".join(" | ".join((c or "").replace("\n", " ").strip() for c in row) for row in rows)
            parts.append(pipes + "\n" if pipes else "")
        cursor = max(cursor, bottom)
    return "\n".join(p for p in parts if p)
