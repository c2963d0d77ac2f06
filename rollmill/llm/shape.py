"""Structural completeness of a text: a stack automaton over its structural marks, and the way it ends."""

from __future__ import annotations

import re

#: States of a text.
FINISHED, UNENDED, CUT, BLANK = 0, 1, 2, 3

#: Marks that the automaton reads; everything between them leaves the stack as it is.
_MARK = re.compile(r"```|\\[()\[\]{}$]|\$\$?|[{}]|</?[A-Za-z][\w-]*(?:\s[^<>]*)?>|[“”„«»]")
#: Characters one of which a text must hold for the automaton to have anything to do.
_HAS_MARK = re.compile(r"[`$<{“„«\\]")
#: Elements that are never closed; fixed values.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"\\)": "\\(", "\\]": "\\[", "”": "“", "»": "«"}

#: How a finished text may end: an end mark, perhaps with closing quotes or brackets, a code fence, a closed tag.
_END_MARK = re.compile(r"(?:[.!?。！？∎■□][\"'”»“’)\]}*_~]*|```|</[A-Za-z][\w-]*>)\Z")
_LAST_LINE_RESULT = re.compile(
    r"(?:^|[\s>*_])(?:####\s*\S.*|\W*(?:final\s+)?(?:answer|result|antwort|ergebnis|réponse|résultat|respuesta|resultado|答案|结果)\W*\s*[:：=]\s*\S.*|.*\\(?:boxed|fbox)\{.*\}[\s$\\\])]*)\Z",
    re.IGNORECASE,
)
#: Endings that show a cut whatever the rest: an ellipsis, a lost byte sequence, an escape or entity without its rest.
_CUT_END = re.compile(r"(?:…|\.\.\.|�|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#?\w{0,8})|%[0-9A-Fa-f])\Z")


#: Plain brackets and straight quotes; an apostrophe or a measure in inches is no quote.
_PLAIN = re.compile(r"[()\[\]（）【】「」]|(?<![\d\\])\"")
_FENCED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]*\$|\\\(.*?\\\)|\\\[.*?\\\]", re.DOTALL)
_OPENERS = "([（【「"


def open_plain(text: str) -> bool:
    """Whether a plain bracket or straight quote outside of code and formulas is open at the end. Either kind of bracket closes
    the last one (half-open intervals); a closing bracket without an opening one is a list number."""
    depth, quoted = 0, False
    for found in _PLAIN.finditer(_FENCED.sub(" ", text)):
        mark = found.group()
        if mark == '"':
            quoted = not quoted
        elif mark in _OPENERS:
            depth += 1
        elif depth:
            depth -= 1
    return quoted or depth > 0


def open_marks(text: str) -> list[str]:
    """What is still open at the end: fences, formulas, braces within formulas, tags and directed quotes."""
    stack: list[str] = []
    if not _HAS_MARK.search(text):
        return stack
    for found in _MARK.finditer(text):
        mark = found.group()
        top = stack[-1] if stack else ""
        if top == "```":
            if mark == "```":
                stack.pop()
        elif mark == "```":
            stack.append(mark)
        elif mark[0] == "$":
            if mark in stack:
                del stack[stack.index(mark) :]  # braces left open within a closed formula don't matter
            elif mark == "$$" and "$" in stack:
                del stack[stack.index("$") :]
                stack.append("$")
            else:
                stack.append(mark)
        elif mark == "{":
            if top in ("$", "$$", "\\(", "\\[", "{"):
                stack.append(mark)
        elif mark == "}":
            if top == "{":
                stack.pop()
        elif mark in ("\\(", "\\[", "“", "«"):
            stack.append(mark)
        elif mark in _CLOSES:
            if _CLOSES[mark] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(_CLOSES[mark]) :]
        elif mark == "„":
            stack.append("“")
        elif mark[0] == "<" and top not in ("$", "$$"):
            name = re.match(r"</?([\w-]+)", mark)[1].lower()
            if mark[1] == "/":
                if f"<{name}>" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
            elif name not in _VOID and not mark.endswith("/>"):
                stack.append(f"<{name}>")
    return stack


def state_of(text: str | None) -> int:
    """BLANK without any visible character; CUT if code, a formula or a tag is left open, the end is broken, or a text without
    end mark or result has an open bracket or quote; UNENDED if only the end mark or result is missing (what that means
    depends on the source); else FINISHED."""
    if text is None or not (body := text.rstrip(" \t\r\n\f\v ​  ﻿")):
        return BLANK
    tail = body[-300:]
    if body[-1] not in "`>)]$" and _CUT_END.search(tail):
        return CUT
    still_open = open_marks(body)
    if any(mark not in ("“", "«") for mark in still_open):
        return CUT
    if _END_MARK.search(tail):
        return FINISHED
    line = body.rsplit("\n", 1)[-1].strip()
    if _LAST_LINE_RESULT.search(line):
        return FINISHED
    return CUT if still_open or open_plain(body) else UNENDED
