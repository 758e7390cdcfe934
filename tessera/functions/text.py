"""Text functions of the curation steps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeeze(column: Column) -> Column:
    """Trimmed, with each run of white space (Unicode's) as one space."""
    return F.regexp_replace(F.regexp_replace(column, r"(?U)\s+", " "), r"^ | $", "")


def normal(column: Column) -> Column:
    """The form in which prompts are held to be equal: compatibility normalisation, white space, full case folding. ASCII
    texts stay in generated code; only the others go to Python. Null stays null."""
    plain = F.octet_length(column) == F.char_length(column)
    native = F.lower(F.regexp_replace(F.regexp_replace(column, r"[\s\x0b\x1c-\x1f]+", " "), r"^ | $", ""))
    return F.when(plain, native).otherwise(_folded(F.when(~plain, column)))


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold)


def fold(text: str | None) -> str | None:
    """normal() of one text."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def folding_table() -> list[tuple[str, str]]:
    """(character, what it becomes) of all characters that normal() changes otherwise than by plain lower case, or that
    count as white space (then a space); by the Unicode rules of this Python. For SQL engines without such a function:
    characters are replaced one by one, and the text composed afterwards."""
    out = []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) in ("Cn", "Co"):
            continue
        made = " " if c.isspace() else unicodedata.normalize("NFKC", c).casefold()
        if made != c.lower() or len(made) != 1:
            out.append((c, made))
    return out


def prompt_group(column: Column) -> Column:
    """The digest that equal prompts share."""
    return F.sha2(normal(column), 256)


def ordering(seed: int | str, key: Column) -> Column:
    """A reproducible random order: the hex digest of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
