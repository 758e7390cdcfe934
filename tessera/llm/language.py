"""The language of short sentences, by script and function words."""

from __future__ import annotations

import re
from collections import Counter

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was be it its that this with for on at by from as so which who one first then since none all each near between nothing not no if yet where while there here i you we has have left stays sits outside",
    "de": "der die das den dem des ein eine einem einen einer und oder ist sind war mit für auf am im vom zum zur bei beim vor nach von nicht kein keine keiner wird wurde weil dass damit sich so wie es er sie ich wir habe hat zuerst danach dort liegt steht bleibt bleiben genau",
    "fr": "le la les un une des du de et ou est sont était avec pour sur au aux en dans par ne pas n'est mais qui que ce cette il elle je nous j'ai puis comme près à où aucun plus enfin sans se il reste trouve",
    "es": "el la los las un una unos y o es son era con para por sobre al del en de no pero que quien se lo su este esta como más muy ya he ha después primero ni nunca tal está queda quedan ninguno sin",
    "it": "il lo la gli le un una e o è sono con per su al del della di in da non ma che chi si come più ho ha poi nessuna mai viene prima dopo dell nell resta",
    "pl": "i oraz jest są w we na z ze do od po przy za że się nie ale który która jak o to ten ta bo dla pod nad ani żaden nigdy tak czeka kto najpierw potem przed między oraz przez było był co więc też w punkcie",
    "pt": "o os as um uma e ou é são com para por em no na do da de não mas que se como mais muito já depois primeiro nem está",
    "nl": "de het een en of is zijn was met voor op aan in van bij niet geen maar dat die dit er zich zoals wordt naar uit dan eerst",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_BY_WORD: dict[str, tuple[str, ...]] = {}
for _k, _v in _SETS.items():
    for _w in _v:
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _k)
#: Scripts that settle the language by themselves (fixed values).
SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")), ("ko", re.compile("[가-힯]")), ("ru", re.compile("[Ѐ-ӿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ar", re.compile("[؀-ۿ]")), ("he", re.compile("[֐-׿]")), ("hi", re.compile("[ऀ-ॿ]")))
_ANY_SCRIPT = re.compile("[" + "".join(p.pattern[1:-1] for _, p in SCRIPTS) + "]")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|‘[^’]*’")


def language(text: str) -> str | None:
    """The language of a stretch of text, None if nothing tells."""
    if not text.isascii() and _ANY_SCRIPT.search(text):
        letters = len(_WORDS.findall(text))
        for name, script in SCRIPTS:
            n = len(script.findall(text))
            if n and (n >= 4 or n >= letters):
                return name
    votes: Counter = Counter()
    for w in _WORDS.findall(text.lower()):
        names = _BY_WORD.get(w)
        if names:
            for name in names:
                votes[name] += 1.0 / len(names)
    if not votes:
        return None
    (name, most), *rest = votes.most_common(2)
    return name if not rest or most > rest[0][1] else None


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text."""
    return [s for s in _SENTENCE.split(text) if s.strip()]


def clear_language(text: str) -> str | None:
    """The language of a text in Latin script if nine in ten of its telling words are of it; a quick answer for the many
    texts in one language."""
    if not text.isascii() and _ANY_SCRIPT.search(text):
        return None
    votes: Counter = Counter()
    for w in _WORDS.findall(text.lower()):
        names = _BY_WORD.get(w)
        if names and len(names) == 1:
            votes[names[0]] += 1
    if not votes:
        return None
    name, most = votes.most_common(1)[0]
    return name if most >= 5 and 10 * most >= 9 * sum(votes.values()) else None


def main_language(text: str, opening: int = 0, quotes: bool = False) -> str | None:
    """The language most of a text's letters are written in, quoted phrases aside unless `quotes` is set or there is
    nothing else. With `opening`, sentences of at most so many words at the beginning are passed over if others follow."""
    found = [] if quotes else sentences(QUOTED.sub(" ", text))
    found = found if any(map(_WORDS.search, found)) else sentences(text)
    skip = 0
    while skip < len(found) - 1 and len(_WORDS.findall(found[skip])) <= opening:
        skip += 1
    votes: Counter = Counter()
    for s in found[skip:]:
        name = language(s)
        if name:
            votes[name] += len(s)
    return votes.most_common(1)[0][0] if votes else None
