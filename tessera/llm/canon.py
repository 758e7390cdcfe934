"""Canonical form of prompts: what is left when formatting is taken away."""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: Format characters, variation selectors and blank fillers: they show nothing and part nothing.
_UNSEEN = [chr(c) for c in [*range(0xFE00, 0xFE10), 0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0xE0200)] if c in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= c < 0xFE10 or unicodedata.category(chr(c)) == "Cf"]
INVISIBLE = frozenset(_UNSEEN)
_WITHOUT = dict.fromkeys(map(ord, _UNSEEN))
#: What parts the words of an ASCII text.
_BLANKED = {i: " " for i in range(128) if not chr(i).isalnum()}
SENTENCE_END = re.compile(r"[.!?。！？]+(?=\s|$|[*_\"'”»)])")
FIELD = re.compile(r"^\W*([^\W\d_]+)[\s\"'*_`]*[:=]\s*(.*)$", re.S)


def plain(text: str) -> str:
    """Compatibility form without invisible characters, case folded."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    if not INVISIBLE.isdisjoint(text):
        text = text.translate(_WITHOUT)
    return unicodedata.normalize("NFKC", text.casefold())


def words(text: str) -> list[str]:
    """Runs of letters and digits of a text that is already plain."""
    return text.translate(_BLANKED).split() if text.isascii() else WORD.findall(text)


def _leaves(name: str, value: object) -> list[tuple[str, str]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _leaves(f"{name} {k}".strip(), v)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(name, v)]
    return [(name, "" if value is None else str(value))]


def _pairs(items: list[tuple[str, object]]) -> dict:
    """Members of a JSON object; a name that comes twice keeps both values."""
    seen: dict = {}
    for k, v in items:
        seen.setdefault(k, []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in seen.items()}


def fields(text: str) -> list[tuple[str, list[str]]] | None:
    """The (name, words) fields of a plain text in field notation, sorted; None for other texts.
    Notations: a JSON object; `name: value` parted by bars or semicolons, each part with a name; or by line ends, most
    lines and the first with a name (a line without one goes on with the value before it). One field alone has no
    order to lose: it is read as a sentence, in every notation."""
    body = text.strip()
    if body[:1] == "{":
        try:
            whole = json.loads(body, object_pairs_hook=_pairs)
        except ValueError:
            whole = None
        if isinstance(whole, dict) and whole:
            leaves = sorted((" ".join(words(k)), words(v)) for k, v in _leaves("", whole))
            return leaves if len(leaves) > 1 else None
    for mark in "|;":
        if mark in body:
            parts = [FIELD.match(p) for p in body.split(mark) if WORD.search(p)]
            if len(parts) > 1 and all(parts):
                return sorted((m[1], words(m[2])) for m in parts)
    lines = [p for p in re.split(r"[\r\n]+", body) if WORD.search(p)]
    named = [FIELD.match(p) for p in lines]
    if sum(map(bool, named)) > 1 and named[0] and 2 * sum(map(bool, named)) > len(lines):
        found: list[tuple[str, list[str]]] = []
        for line, m in zip(lines, named):
            if m:
                found.append((m[1], words(m[2])))
            else:
                found[-1][1].extend(words(line))
        return sorted(found)
    return None


def forms(text: str | None) -> tuple[str | None, list[list[str]]]:
    """The canonical string of a text and its segments.

    The string is one for all outward forms: fields sorted by name, each value bound to its name; or the words in their
    order; null for null, blank and wordless texts. The segments are word lists, one for each field (its name first) or
    sentence."""
    if not text:
        return None, []
    low = plain(text)
    named = fields(low)
    if named is not None:
        return "\x1e" + "\x1e".join(f"{name}\x1f{' '.join(value)}" for name, value in named), [[*words(name), *value] for name, value in named]
    found = [w for s in SENTENCE_END.split(low) if (w := words(s))]
    return " ".join(chain.from_iterable(found)) or None, found


def canonical(text: str | None) -> str | None:
    """The canonical string of a text."""
    return forms(text)[0]


def segments(text: str | None) -> list[list[str]]:
    """The segments of a text."""
    return forms(text)[1]


@F.pandas_udf(T.StructType([T.StructField("canon", T.StringType()), T.StructField("segs", T.StringType())]))
def _canon(texts: pd.Series) -> pd.DataFrame:
    """The canonical string, and the segments: a line each, words parted by a space."""
    out = []
    for text in texts:
        canon, parts = forms(text)
        out.append((canon, None if canon is None else "\n".join(map(" ".join, parts))))
    return pd.DataFrame(out, columns=["canon", "segs"])


def canon_column(text: Column) -> Column:
    """struct(canon, segs) of a text column."""
    return _canon(text)
