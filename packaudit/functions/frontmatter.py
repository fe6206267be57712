"""Front matter of one instruction file as (path of keys, value) rows, to any depth.

A stack of open keys is folded over the lines by their indentation.  What is read are block
maps and lists, lists of maps, inline lists and maps on one line, quoted scalars, comments and
block scalars; what cannot be read as one of these is left out.
"""

from __future__ import annotations

import re

_KEY = re.compile(r"""((?:"[^"]*"|'[^']*'|[^\s'"\[\]{},&*!|>%@`#][^:#]*?))\s*:(?:\s+(.*))?$""")
_BLOCK = re.compile(r"[|>][+-]?\d?$")


def scalar(text: str) -> str:
    """A scalar without quotes, trailing comment or surrounding blanks; booleans in one spelling."""
    text = text.strip()
    if text[:1] in ("'", '"'):
        end = text.find(text[0], 1)
        if end > 0 and not text[end + 1:].split("#", 1)[0].strip():
            return text[1:end]
    text = "" if text.startswith("#") else re.split(r"\s#", text, maxsplit=1)[0].strip()
    return {"true": "True", "false": "False"}.get(text.lower(), text)


def _scan(text: str):
    """(place, character) of what stands in no quotes; quotes open only where a value may start."""
    quote, before = "", "["
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"" and before in "[{,:":
            quote = ch
        else:
            yield i, ch
        before = before if ch == " " else ch


def _uncommented(text: str) -> str:
    """The text up to a comment, which starts with a number sign after a blank."""
    end = next((i for i, ch in _scan(text) if ch == "#" and (i == 0 or text[i - 1] in " \t")), len(text))
    return text[:end].strip()


def _parts(text: str) -> list[str]:
    """The text cut at commas that stand in no brackets and no quotes."""
    out, depth, start = [], 0, 0
    for i, ch in _scan(text):
        depth += (ch in "[{") - (ch in "]}")
        if ch == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p for p in (*out, text[start:]) if p.strip()]


def _inline(keys: tuple[str, ...], text: str) -> list[tuple[tuple[str, ...], str]]:
    """Rows of a value that stands behind its key."""
    text = text.strip()
    bare = _uncommented(text)
    if bare[:1] == "[" and bare[-1:] == "]":
        return [row for part in _parts(bare[1:-1]) for row in _inline(keys, part)]
    if bare[:1] == "{" and bare[-1:] == "}":
        rows = []
        for part in _parts(bare[1:-1]):
            name, _, value = part.partition(":")
            rows += _inline((*keys, scalar(name)), value)
        return rows
    return [(keys, scalar(text))] if scalar(text) else []


def paths(front: str) -> list[tuple[int, list[str], str]]:
    """(line, keys, value) for every scalar of the front matter, in order; lines count from 0.

    Members of a list share the keys of the list.  A block scalar is one value, its lines
    joined by blanks.
    """
    out: list[tuple[int, list[str], str]] = []
    stack: list[tuple[int, str]] = []  # indentation and key of the maps that are open
    text_at, text_keys, text_rows = -1, (), []  # a block scalar that is open
    start = 0
    for number, raw in enumerate(front.split("\n")):
        line = raw.expandtabs(2)
        indent = len(line) - len(line.lstrip(" "))
        if text_at >= 0:
            if not line.strip() or indent > text_at:
                text_rows.append(line.strip())
                continue
            out.append((start, list(text_keys), " ".join(filter(None, text_rows))))
            text_at = -1
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        while body == "-" or body.startswith("- "):  # a member of a list stands deeper than its dash
            while stack and stack[-1][0] >= indent + (0 if stack[-1][0] != indent else 1):
                stack.pop()
            rest = body[1:]
            indent += 1 + len(rest) - len(rest.lstrip(" "))
            body = rest.strip()
        if not body:
            continue
        hit = _KEY.match(body)
        if hit is None:
            keys = tuple(k for i, k in stack if i < indent)
            out += [(number, list(k), v) for k, v in _inline(keys, body)] if keys else []
            continue
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, scalar(hit[1])))
        keys, value = tuple(k for _, k in stack), (hit[2] or "").strip()
        if _BLOCK.match(value):
            text_at, text_keys, text_rows, start = indent, keys, [], number
        else:
            out += [(number, list(k), v) for k, v in _inline(keys, value)]
    if text_at >= 0:
        out.append((start, list(text_keys), " ".join(filter(None, text_rows))))
    return [row for row in out if row[2]]
