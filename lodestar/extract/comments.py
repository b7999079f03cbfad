"""Which lines of a source text are code and which stand in comments or doc blocks.

A style is a table of delimiters. Each line is cut into its delimiters, and a stack of the closers still waited for is
carried from line to line. Strings are not told apart from code.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Style(NamedTuple):
    #: What makes a whole line a comment, and whether that comes before any block opener in it.
    line: str
    line_first: bool
    #: Openers with their closers, and all of them as one pattern.
    closers: dict[str, str]
    delimiters: re.Pattern
    #: Whether blocks nest, whether a line is looked at further behind a closer, whether a block closed on its own line is code.
    nests: bool = False
    further: bool = False
    inline: bool = False


_C = Style("//", True, {"/*": "*/"}, re.compile(r"/\*|\*/"), further=True)
STYLES = dict.fromkeys(("typescript", "javascript", "java", "csharp"), _C) | dict.fromkeys(("rust", "swift"), _C._replace(nests=True)) | {
    "python": Style("#", True, {'"""': '"""', "'''": "'''"}, re.compile("\"\"\"|'''"), inline=True),
    "lua": Style("--", False, {"--[[": "]]"}, re.compile(r"--\[\[|\]\]")),
}


def _carry(marks: list[str], waiting: list[str], style: Style) -> None:
    """Takes a line's delimiters off and on the stack of closers waited for."""
    for mark in marks:
        if waiting and mark == waiting[-1]:
            waiting.pop()
            if not style.further:
                return
        elif mark in style.closers and (style.nests or not waiting):
            waiting.append(style.closers[mark])


def code_lines(text: str, language: str) -> list[bool]:
    """One flag per line. A line with code before a comment opener is code; delimiters inside strings count as such."""
    lines, style = text.split("\n"), STYLES.get(language)
    if style is None:
        return [True] * len(lines)
    waiting: list[str] = []
    flags = []
    for line in map(str.strip, lines):
        found = [(m.start(), m[0]) for m in style.delimiters.finditer(line)]
        opener = next((at for at, mark in found if mark in style.closers), None)
        inside = bool(waiting)
        if not inside and line.startswith(style.line) and (style.line_first or opener is None):
            flags.append(False)
            continue
        _carry([mark for _, mark in found], waiting, style)
        flags.append(not inside and (opener != 0 or style.inline and not waiting))
    return flags
