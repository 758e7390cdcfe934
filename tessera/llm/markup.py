"""A pushdown parser of what an answer may leave open: fences, markup elements, brackets, quotations, code and emphasis.

Blocks (fences and elements) stay open until they are closed. What stands inside a line of text lives no longer than its
paragraph or list item: a mark that is not closed there was meant as it stands, and so was one that the sentences after
it have left behind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Elements that must be closed; others, such as those of list items, may end by themselves (fixed values).
CLOSED_ELEMENTS = frozenset("a article b blockquote body code dd div dl em fieldset figure form h1 h2 h3 h4 h5 h6 head html i main ol p pre q s section select small span strong sub sup svg table tbody textarea thead u ul".split()) - {"p", "dd"}
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
_CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“„", "»": "«"}
_TOKEN = re.compile(
    r"(?P<fence>^[ \t]*(?:`{3,}|~{3,})[^\n`]*$)|(?P<block>\n[ \t]*(?=\n)|^[ \t]*(?:[-*•+]|\d{1,3}[.)])[ \t]+)|(?P<code>`+)|<(?P<tag>/?[A-Za-z][\w:-]*)(?:\s[^<>]*)?(?P<alone>/?)>|(?P<emphasis>\*\*|__)|(?P<mark>[()\[\]{}“”„«»\"])",
    re.M,
)
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*\s+(?=\S)")
_ANY = re.compile(r"[`~<(\[{“„«\"]|\*\*|__")


@dataclass(frozen=True)
class Frame:
    """Something opened at a place: kind is `fence`, `element`, `code`, `emphasis`, `bracket` or `quotation`."""

    kind: str
    name: str
    at: int


INLINE = frozenset(("code", "emphasis", "bracket", "quotation"))


def _within_word(text: str, i: int) -> bool:
    """Whether a mark stands between letters or digits, or is the frown of a smiley."""
    return 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum() or i > 0 and text[i - 1] in ":;=-" and text[i] in "([{"


def _opens(text: str, end: int) -> bool:
    """Whether something follows a mark at once; before a blank or the end it opens nothing."""
    return bool(text[end : end + 1].strip())


def _drop(stack: list[Frame], kind: str, names: str | tuple[str, ...]) -> bool:
    """Closes the last frame of a kind with one of the names, and what was opened within it."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].kind == kind and stack[k].name in names:
            del stack[k:]
            return True
        if stack[k].kind == "element" and kind in INLINE:
            return False
    return False


def unclosed(text: str) -> list[Frame]:
    """The frames a text leaves open at its end. Closers that close nothing are passed over."""
    if not _ANY.search(text):
        return []
    stack: list[Frame] = []
    document = text.lstrip()[:1] == "<"
    for m in _TOKEN.finditer(text):
        at, kind = m.start(), m.lastgroup
        if stack and stack[-1].kind == "fence":
            found = m["fence"]
            if found and found.strip().rstrip("`~") == "" and found.strip().startswith(stack[-1].name):
                stack.pop()
            continue
        if m["fence"]:
            stack = [f for f in stack if f.kind not in INLINE]
            stack.append(Frame("fence", re.match(r"`+|~+", m["fence"].strip())[0], at))
        elif m["block"] is not None:
            stack = [f for f in stack if f.kind not in INLINE]
        elif m["code"]:
            if not _drop(stack, "code", (m["code"],)) and _opens(text, m.end()):
                stack.append(Frame("code", m["code"], at))
        elif stack and stack[-1].kind == "code":
            continue
        elif m["tag"]:
            name = m["tag"].lower()
            if name.startswith("/"):
                _drop(stack, "element", (name[1:],))
            elif not m["alone"] and (document or name in CLOSED_ELEMENTS or f"</{m['tag']}>" in text):
                stack.append(Frame("element", name, at))
        elif kind == "emphasis":
            if not _drop(stack, "emphasis", (m["emphasis"],)) and _opens(text, m.end()):
                stack.append(Frame("emphasis", m["emphasis"], at))
        elif m["mark"] == '"':
            if not _drop(stack, "quotation", '"') and _opens(text, m.end()) and not text[at - 1 : at].isalnum():
                stack.append(Frame("quotation", '"', at))
        else:
            c = m["mark"]
            if c == "“" and _drop(stack, "quotation", "„"):
                continue
            if c in _CLOSERS:
                _drop(stack, "quotation" if c in "”»" else "bracket", _CLOSERS[c])
            elif not _within_word(text, at):
                stack.append(Frame("quotation" if c in "“„«" else "bracket", c, at))
    return stack


def stops_within(text: str) -> tuple[bool, bool]:
    """(in a block, in a line): whether a text stops inside of a fence or element, and whether inside of something
    that its last sentence has opened. A mark at the very beginning is a frame around the whole text and tells nothing."""
    frames = unclosed(text)
    if not frames:
        return False, False
    if any(f.kind not in INLINE for f in frames):
        return True, False
    begin = 0
    for m in _SENTENCE_END.finditer(text):
        begin = m.end()
    first = len(text) - len(text.lstrip("“„«\"*_ \n"))
    return False, any(f.at >= max(begin, first) for f in frames)
