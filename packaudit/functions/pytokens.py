"""Calls and string constants of one Python text, in one walk that is linear in its length.

A small helper of the task that reads Python files: strings and comments are tokens, so text
inside them is no call; brackets nest to any depth; neighbouring constants are joined and
brackets around a lone constant are dropped, as the language has it.
"""

from __future__ import annotations

import re
from bisect import bisect_left

_TRIPLE = r'''"""(?:[^"\\]++|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]++|\\.|'(?!''))*+\'\'\''''
_SINGLE = r'''"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+\''''
STRING = f"(?:{_TRIPLE}|{_SINGLE})"
_TOKEN = re.compile(
    rf"(?P<comment>#[^\n]*+)|(?P<string>(?:(?<!\w)[rRbBuUfF]{{1,2}})?{STRING})|(?P<name>[A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)*+)"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<space>\s++)|(?P<other>[^\s#\"'A-Za-z_()\[\]{}]++|.)", re.S | re.A)
_KEYWORD = re.compile(
    r"eval|exec|compile|__import__|subprocess|system|popen|spawn|requests\.|urllib|httpx\.|urlopen|http\.client|socket\.|connect|dup|open"
    r"|read_text|read_bytes|write_text|write_bytes|getattr|os\.path\.join|Path\b|getenv|os\.environ", re.A)
_CALLED = re.compile(r"\s*+([(\[])", re.A)
_PARTS = re.compile(r"""(?s)^([rRbBuUfF]{0,2})(\"{3}|'{3}|"|')(.*)\2$""")


def constant(literal: str) -> tuple[str, str]:
    """Prefix and contents of a quoted constant; common escapes are resolved unless it is raw."""
    prefix, _, body = _PARTS.match(literal).groups()
    if "r" not in prefix.lower() and "\\" in body:
        body = re.sub(r"\\(\n|n|[\\'\"])", lambda m: {"\n": "", "n": "\n"}.get(m[1], m[1]), body)
    return prefix.lower(), body


class Constant(list):
    """Neighbouring literals that make one constant; never grows once its bracket is closed."""

    def takes(self, literal: str) -> bool:
        """Whether a further literal joins: format strings do not, and bytes only join bytes."""
        p, q = (x[:min(x.find("'") % 1000, x.find('"') % 1000)].lower() for x in (self[0], literal))
        return "f" not in p + q and ("b" in p) == ("b" in q)

    def __str__(self) -> str:
        if len(self) == 1:
            return self[0]
        parts = [constant(x) for x in self]
        body = "".join(x for _, x in parts).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        self[:] = [("b" if "b" in parts[0][0] else "") + f'"{body}"']
        return self[0]


class _Frame:
    """An open bracket: its text with nested brackets shown to depth 0, 1 and 2."""

    __slots__ = ("bracket", "call", "shown", "lone", "before", "last")

    def __init__(self, bracket: str, call: int | None, before: str):
        self.bracket, self.call, self.before = bracket, call, before
        self.shown: list[list] = [[], [], []]
        self.lone: bool | None = None  # None: empty so far; True: one constant and nothing else
        self.last: Constant | None = None  # the constant that ends the text, if one does

    def add(self, text: str) -> None:
        for s in self.shown:
            s.append(text)

    def constant(self, group: Constant) -> None:
        """Take a constant, joined to one just before it."""
        if self.last is not None and self.last.takes(group[0]):
            self.last.extend(group)
            return
        self.lone = self.lone is None
        self.last = group
        self.add(group)


#: Words before a bracket that make no call.
_NO_CALL = {"if", "elif", "while", "for", "in", "and", "or", "not", "return", "yield", "lambda", "assert", "del", "with", "except", "import", "from", "raise", "is", "else", "await", "as"}


def tokens(text: str, tree: list[list] | None = None) -> list[tuple[str, int]]:
    """(token, line) of calls of interest and string constants in text order.

    A call is its name, bracket and arguments without the closing bracket; brackets nested
    deeper than two inside the arguments show as an ellipsis, so that the tokens of a text
    stay linear in its length however calls are nested.

    ``tree`` takes every call, of interest or not, as [name, line, place of the name, place of
    its closing bracket, number of calls around it, number of the innermost of these or -1]: a
    call stands in the arguments of another, at any depth, if its places lie within.
    """
    breaks = [m.start() for m in re.finditer("\n", text)]
    out: list[list] = []
    stack: list[_Frame] = []
    nodes: list[int | None] = []  # per open bracket, the call of the tree it belongs to
    around: list[int] = []  # calls that are open
    end_at = len(text)
    flat = None  # place in ``out`` of a constant outside brackets that the next one may join

    def close() -> None:
        nonlocal flat
        frame = stack.pop()
        node = nodes.pop()
        if node is not None:
            tree[node][3] = end_at
            around.pop()
        if frame.call is not None:
            out[frame.call][0] += "".join(map(str, frame.shown[2]))
        if not stack:
            return
        parent = stack[-1]
        if frame.bracket == "(" and frame.lone and frame.call is None and frame.before != "value":
            parent.constant(frame.last or next(x for x in frame.shown[0] if isinstance(x, Constant)))
            return
        end = {"(": ")", "[": "]", "{": "}"}[frame.bracket]
        inner = ["…" if frame.shown[0] else "", "".join(map(str, frame.shown[0])), "".join(map(str, frame.shown[1]))]
        for s, x in zip(parent.shown, inner):
            s.append(frame.bracket + x + end)
        parent.lone, parent.last = False, None

    previous, call, node = "mark", None, None
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m[0]
        top = stack[-1] if stack else None
        if kind == "space" or kind == "comment":
            if top and kind == "space":
                top.add(s)
            if "\n" in s or kind == "comment":
                flat = None if not (kind == "space" and text[m.start() - 1] == "\\") else flat
            continue
        if kind == "string":
            line = bisect_left(breaks, m.start()) + 1
            joinable = top.last is not None if top else flat is not None
            if joinable and out and isinstance(out[-1][0], Constant) and out[-1][0].takes(s):
                out[-1][0].append(s)
            else:
                out.append([Constant([s]), line])
            flat = len(out) - 1
            if top:
                top.constant(Constant([s]))
            previous = "value"
            continue
        if not (kind == "other" and s == "\\"):
            flat = None
        if kind == "open":
            stack.append(_Frame(s, call, previous))
            nodes.append(node)
            if node is not None:
                around.append(node)
            call, node, previous = None, None, "mark"
            continue
        if kind == "close":
            if stack:
                end_at = m.start()
                close()
            previous = "value"
            continue
        if top:
            top.add(s)
            if kind == "name" or not s.isspace():
                top.lone, top.last = False, None
        previous = "value" if kind == "name" or s[-1:].isdigit() else "mark"
        if kind == "name":
            here = m.start()
            opened = _CALLED.match(text, m.end())
            if tree is not None and opened and opened[1] == "(" and s not in _NO_CALL and text[max(0, here - 4):here] != "def " and text[max(0, here - 6):here] != "class ":
                node = len(tree)
                tree.append([s, bisect_left(breaks, here) + 1, here, len(text), len(around), around[-1] if around else -1])
            if opened and _KEYWORD.search(s):
                before = text[here - 1:here]
                free = not (before and (before in "." or before.isalnum() or before == "_")) and text[max(0, here - 4):here] != "def " and text[max(0, here - 6):here] != "class "
                chained = before == "." and "." not in s and opened[1] == "(" and text[max(0, here - 2):here - 1] in (")", "]", "'", '"')
                if free or chained:
                    call = len(out)
                    out.append([s + opened[0], bisect_left(breaks, here) + 1])
            if s in ("return", "in", "and", "or", "not", "if", "else", "yield", "lambda", "is", "print", "await"):
                previous = "mark" if s != "print" else previous
    end_at = len(text)
    while stack:
        close()
    return [(str(t), line) for t, line in out]


_DIVIDED = re.compile(rf"#[^\n]*+|((?:(?<![\w.])[\w.]*(?:home|expanduser)[\w.]*\s*\([^()]*+\)|[\w)\]])?\s*(?:/\s*{STRING}\s*)++)|{STRING}", re.S | re.A)


def divisions(text: str) -> list[tuple[str, int]]:
    """(expression, line) of paths built with ``/`` from constants."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [(m[1], bisect_left(breaks, m.start()) + 1) for m in _DIVIDED.finditer(text) if m[1]]
