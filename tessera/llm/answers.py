"""How an answer ends and what it is: the parsing shared by problems 2 and 4.

An answer is read by a pushdown parser over objects, fences, elements, quotations, brackets and emphasis; what is not
markup is read as a list or as prose. The verdict on the ending is one of `whole`, `cut` and `open`; `open` means prose that stops without a mark
of its end and may still be a complete repetition of a question that has none either.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

from tessera.llm.canon import plain, segments, words
from tessera.llm.language import QUOTED, clear_language, main_language, sentences
from tessera.llm.markup import stops_within
from tessera.llm.tiling import tiles

#: Marks that storage or transfer puts after a cut (fixed values).
CUT_MARK = re.compile(r"(?:\s*(?:…|\.\.\.+|[\[(<](?:cut|cut off|truncated|snip|more|…|\.\.\.)[\])>]))+\s*$", re.I)
FENCE_END = re.compile(r"\s*\n```[ \t]*\s*$")
FENCE_BEGIN = re.compile(r"```[^\n`]*\n?")
LONGEST_MARK = 64
PLACEHOLDERS = frozenset(["null", "none", "nil", "n/a", "na", "nan", "undefined", "-", "--", "—", "...", "…", "empty", "(empty)", "(no output)", "no output", "(none)", "[no output]", "<empty>", "tbd", "todo"])
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]"]', re.S)
TOKEN_SINGLE = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[{}\[\]'\"]", re.S)
BULLET = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])\s+")
TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*(?:\s*[^\w\s.,;:…\-(\[{<\"'“‘«„/\\]+)?\s*$")
#: Closing lines: a label with its value, a parenthesis, a sign-off, a sign alone.
CLOSING = re.compile(r"^\W*(?:[^\W\d_][\w ]{0,24}: *[^\s.!?][^.!?\n]{0,40}|\([^()\n]{1,60}\)|(?:the )?end(?: of [\w ]{1,20})?|done|finished|fin|ende|fertig|listo|terminé)\W*$", re.I)
SIGN = re.compile(r"^[^\w\s]+$")


def strip_marks(text: str) -> tuple[str, bool]:
    """The text without marks and fences added at its end, and whether a mark of a cut was there."""
    marked = False
    while True:
        # Marks are short: only the last characters are searched, however long the text is.
        head, tail = text[:-LONGEST_MARK], text[-LONGEST_MARK:]
        bare = CUT_MARK.sub("", tail)
        if bare != tail and (head + bare).strip():
            marked, text = True, head + bare
            continue
        bare = FENCE_END.sub("", tail)
        if bare == tail:
            return text, marked
        text = head + bare


def brackets_open(body: str) -> tuple[bool | None, int]:
    """Pushdown reading of an object or list in JSON or a like notation: True if it stops before its end, False if all
    is closed, None if nothing was opened; and the place behind the last bracket read. Closers that don't fit are passed over: malformed is not unfinished."""
    single = bool(re.match(r"[\[{\s]*'", body))
    stack: list[str] = []
    opened = False
    for m in (TOKEN_SINGLE if single else TOKEN).finditer(body):
        c = m[0]
        if c in "{[":
            stack.append(c)
            opened = True
        elif c in "}]":
            if stack and stack[-1] == ("{" if c == "}" else "["):
                stack.pop()
            elif stack and ("{" if c == "}" else "[") in stack:
                while stack.pop() != ("{" if c == "}" else "["):
                    pass
            if opened and not stack:
                return False, m.end()
        elif len(c) == 1:
            return True, m.end()  # a quotation that never ends
    return (bool(stack) if opened else None), len(body)


def list_open(lines: list[str]) -> bool:
    """Whether the last of a list's items stops early: it has another shape than the items before it."""
    shape = lambda s: re.sub(r"[^\W\d_]+(?: [^\W\d_]+)*", "w", re.sub(r"\d+", "9", BULLET.sub("", s).strip()))
    shapes = [shape(s) for s in lines]
    if len(shapes) == 1:
        return not re.search(r"[)\].!?。]$", lines[0].strip())
    usual, n = Counter(shapes[:-1]).most_common(1)[0]
    if 2 * n >= len(shapes) - 1:
        return shapes[-1] != usual
    return not re.search(r"[)\].!?。\w]$", lines[-1].strip())


def _ends(text: str) -> bool:
    """A sentence ends here; what may follow its mark is short."""
    return bool(TERMINAL.search(text[-LONGEST_MARK:]))


def _is_short(items: list[str]) -> bool:
    """Items of a few words, as in a list of placements, and not of whole sentences."""
    return sum(len(words(s)) for s in items) <= 8 * len(items)


def ending(text: str) -> tuple[str, str]:
    """(kind, verdict) of a non-empty answer: kind is `world`, `object`, `list` or `prose`; verdict `whole`, `cut` or
    `open`. `world` is markup with a list of objects, `object` any other."""
    body, marked = strip_marks(text.strip())
    inner = FENCE_BEGIN.sub("", body.lstrip(), count=1) if body.lstrip().startswith("```") else body.lstrip()
    start = re.search(r"[{\[]", inner)
    fence = FENCE_BEGIN.search(body)
    if start and (start.start() == 0 or fence and fence.end() <= body.find(inner[start.start()]) + 1 or re.match(r"[{\[]\s*[\"'{\[\]}]", inner[start.start() : start.start() + 40])):
        markup = inner[start.start() :].rstrip()
        kind = "world" if re.search(r"[\"']objects[\"']\s*:\s*\[\s*\{|[\"'](?:schema_version|relation_type|object_type)[\"']", markup) else "object"
        if decoded(markup) is not None:
            return kind, "whole"
        state, stop = brackets_open(markup)
        if state:
            return kind, "cut"
        if state is False:
            # Sentences may follow a finished object; then their end decides.
            rest = FENCE_END.sub("", markup[stop:]).strip("` \n\r\t")
            return ending(rest) if kind == "object" and len(words(rest)) > 5 else (kind, "whole")
    if "\ufffd" in body[-2:]:
        return "prose", "cut"
    # A fence behind a cut may have been added with the mark; the one that was there before counts.
    in_block, in_line = stops_within(body if marked else text.strip())
    if in_block or in_line:
        bulleted = [bool(BULLET.match(s)) for s in body.splitlines() if s.strip()]
        if any(bulleted) and 2 * sum(bulleted) >= len(bulleted) - 1:
            return "list", "cut"
        return "prose", "cut" if in_block else "open"
    lines = [s for s in body.splitlines() if s.strip()]
    if not lines:
        return "prose", "cut" if marked else "whole"
    if marked and not _ends(body):
        bulleted = sum(bool(BULLET.match(s)) for s in lines)
        return "list" if bulleted and 2 * bulleted >= len(lines) - 1 else "prose", "cut"
    last = lines[-1]
    if BULLET.match(last):
        items = [s for s in lines if BULLET.match(s)]
        if _ends(last):
            return ("list" if _is_short(items) else "prose"), "whole"
        if not _is_short(items):
            return "prose", "open"
        return "list", "cut" if list_open(items) else "whole"
    bulleted = [s for s in lines[:-1] if BULLET.match(s)]
    kind = "list" if 2 * len(bulleted) >= len(lines) - 1 and bulleted else "prose"
    if _ends(last):
        return kind, "whole"
    if kind == "prose" and len(lines) == 1 and last.rstrip().endswith(":") or len(lines) == 1 and kind == "list":
        return kind, "cut"
    before = lines[-2] if len(lines) > 1 else ""
    ended = bool(_ends(before)) or bool(BULLET.match(before)) and not list_open(bulleted)
    if ended and (CLOSING.match(last) or SIGN.match(last.strip())):
        return kind, "whole"
    if kind == "list":
        return kind, "cut"
    return kind, "open"


@lru_cache(maxsize=8)
def decoded(text: str) -> tuple[object] | None:
    """The JSON value that a text is, or that follows its blanks, in a tuple; None if it is none. Kept for the few texts
    in hand, which several questions are asked about."""
    try:
        return (json.loads(text),)
    except (ValueError, RecursionError):
        return None


#: A number or a truth value: whatever holds one isn't hollow.
_VALUE = re.compile(r"[:,\[]\s*(?:-?\d|true|false)")


def is_empty(text: str | None) -> bool:
    """Null, blank, or nothing but an empty container, a fence or a placeholder, however long."""
    if text is None:
        return True
    body = re.sub(r"```[\w-]*", "", text) if "```" in text else text
    body = body.strip().strip("\u200b\ufeff").strip()
    if not body or body.lower() in PLACEHOLDERS or not re.search(r"\w", body):
        return len(body) <= 12 or not body.strip("`'\"{}[]()<>.,:;-–—_*#~… \n\t")
    if body[0] in "{[\"" and not _VALUE.search(body):
        value = decoded(body)
        return value is not None and _hollow(value[0])
    return False


def _hollow(value: object) -> bool:
    if isinstance(value, dict):
        return all(_hollow(v) for v in value.values())
    if isinstance(value, list):
        return all(_hollow(v) for v in value)
    return value is None or isinstance(value, str) and (not value.strip() or value.strip().lower() in PLACEHOLDERS)


#: Phrases by which a model or a provider says that it won't do it (a small grammar by language, fixed values).
_CAN_NOT = r"(?:can(?:'|’)?t|cannot|can not|could not|won(?:'|’)?t|will not|am unable to|(?:'|’)m unable to|am not (?:able|allowed|permitted) to|(?:'|’)m not (?:able|allowed|permitted) to|must (?:decline|refuse)|have to (?:decline|refuse|say no)|(?:would|(?:'|’)d) rather not|decline|refuse)"
REFUSAL = re.compile(
    "|".join(
        [
            rf"\b(?:I|we)\s?{_CAN_NOT}\b",
            r"\bunable to (?:help|assist|comply|fulfil|create|generate|do)\b",
            r"\b(?:is|are)(?:n(?:'|’)t| not) (?:a |some)?(?:request|wish|thing|something)\b.{0,20}\b(?:I|we) (?:can|may|will)\b",
            r"\boutside (?:of )?what (?:I|we) (?:am|are|may|can)\b",
            r"\bcannot (?:comply|assist|fulfil)\b",
            r"\bI (?:do not|don(?:'|’)t) (?:want|wish) to (?:create|generate|make|draw)\b",
            r"\bich (?:kann|darf|möchte|werde|will)\b[^.!?]{0,60}\b(?:nicht|nicht helfen|keine)\b|\b(?:kann|darf|möchte|werde|will|muss) ich\b[^.!?]{0,60}\b(?:nicht|keine|ablehnen|verweigern)\b|\bich (?:lehne|verweigere|muss)\b[^.!?]{0,60}\b(?:ab|ablehnen|verweigern)\b",
            r"\bje ne (?:peux|veux|souhaite|vais)\b[^.!?]{0,12}\bpas\b|\bje (?:dois|préfère|me vois)\b[^.!?]{0,20}\b(?:refuser|décliner|ne pas)\b|\bje refuse\b",
            r"\bno (?:puedo|debo|voy a|me es posible)\b[^.!?]{0,30}\b(?:crear|generar|ayudar|hacer|dibujar|cumplir|realizar|con)\b|\b(?:debo|tengo que|prefiero) (?:rechazar|negarme|declinar|no)\b|\bme niego\b|\bme veo obligad[oa] a rechazar\b",
            r"\bnon posso (?:creare|generare|aiutar|fare)|\bdevo rifiutare\b|\bnie mogę\b|\bmuszę odmówić\b|\bя не могу\b|\bвынужден[а]? отказать|我不能|我无法|无法(?:满足|完成|创建|提供)|抱歉，",
        ]
    ),
    re.I,
)
#: What every sentence of the grammar has in it; a text without any of these needs no parsing (fixed values).
REFUSAL_HINTS = (" thing", "something", "je me vois", "me veo", "n't", "n’t", "cannot", "not able", "not allowed", "not permitted", "can not", "could not", "will not", "do not", "unable", "decline", "refuse", "rather not", "have to say", "request", "wish", "outside of what", "outside what", " ich ", "ich lehne", "ich kann", "ich darf", "ich werde", "ich muss", "ich möchte", "je ne", "je dois", "je refuse", "je préfère", "no puedo", "no debo", "no voy", "no me es", "rechazar", "negarme", "declinar", "prefiero", "niego", "non posso", "rifiutare", "nie mogę", "odmówić", "не могу", "отказать", "不能", "无法", "抱歉")
REFUSED_ERROR = re.compile(r"declin|refus|reject\w* by policy|policy|safety|content filter|blocked by|moderat|not permitted|forbidden content", re.I)
REFUSED_VALUE = re.compile(r"cannot|can't|can’t|unable|refus|declin|policy|not allowed|denied|reject", re.I)
#: Members that say what became of a wish.
OUTCOMES = ("error", "status", "reason", "message", "refusal", "detail")
REFUSED_FIELD = re.compile(rf"[\"'](?:{'|'.join(OUTCOMES)})[\"']\s*:\s*[\"'][^\"']*(?:{REFUSED_VALUE.pattern})", re.I)
_OBJECT = re.compile(r"\{\s*[\"'}]|\[\s*[\[{\"'\]]")
_WORLD = re.compile(r"[\"']objects[\"']\s*:\s*\[\s*\{")


def _refused(value: object) -> bool:
    """Whether an object has an outcome that is a refusal, at any depth."""
    if isinstance(value, dict):
        return any(k in OUTCOMES and isinstance(v, str) and REFUSED_VALUE.search(v) or _refused(v) for k, v in value.items())
    return isinstance(value, list) and any(map(_refused, value))


def outside_objects(text: str) -> tuple[str, list[str]]:
    """The text without its objects and lists in JSON or a like notation, and those."""
    whole = text.strip()
    if whole[:1] in "{[" and decoded(whole):
        return "", [whole]
    rest, found, at = [], [], 0
    for m in _OBJECT.finditer(text):
        if m.start() < at:
            continue
        try:
            end = json.JSONDecoder().raw_decode(text, m.start())[1]
        except (ValueError, RecursionError):
            state, stop = brackets_open(text[m.start() :])
            end = len(text) if state else m.start() + stop
        rest.append(text[at : m.start()])
        found.append(text[m.start() : end])
        at = end
    return " ".join([*rest, text[at:]]), found


def is_refusal(text: str | None, error: str | None) -> bool:
    """Whether the answer, outside of objects and quotations, or an outcome in an object that is no world, or the error
    says that the wish won't be met."""
    if error and REFUSED_ERROR.search(error):
        return True
    if not text or not text.strip():
        return False
    if "{" in text or "[" in text:
        text, objects = outside_objects(text)
        for part in objects:
            if not _WORLD.search(part) and REFUSED_VALUE.search(part):
                value = decoded(part)
                if _refused(value[0]) if value else REFUSED_FIELD.search(part):
                    return True
    low = text.lower()
    if not any(hint in low for hint in REFUSAL_HINTS):
        return False
    return bool(REFUSAL.search(text)) and bool(REFUSAL.search(QUOTED.sub(" ", text)))


@lru_cache(maxsize=4096)
def _question(text: str) -> tuple[list[str], frozenset[str], str | None, frozenset[str]]:
    """What is needed of a question: its words, the set of them, its language and the languages it asks for."""
    low = plain(text)
    found = words(low)
    return found, frozenset(found), main_language(low, quotes=True), wanted_languages(low)


def repeats(answer: str, question: str) -> tuple[float, float]:
    """(share of the question's words in tiles with the answer, share of the answer's words outside of them)."""
    a, (q, distinct, _, _) = words(plain(answer)), _question(question)
    if not a or not q or 2 * len(distinct.intersection(a)) < len(distinct):
        return 0.0, 1.0
    shared = sum((Counter(a) & Counter(q)).values())
    if shared < 0.5 * len(q):
        return shared / len(q), 1.0
    covered = sum(n for _, _, n in tiles(q, a, 3))
    # What is given back a second time isn't the answer's own either.
    known = {tuple(q[i : i + 3]) for i in range(len(q) - 2)}
    given = bytearray(len(a))
    for i in range(len(a) - 2):
        if (a[i], a[i + 1], a[i + 2]) in known:
            given[i : i + 3] = b"\x01\x01\x01"
    return covered / len(q), 1 - sum(given) / len(a)


#: Least share of the question that is given back, and most of the answer that may be something else.
LEAST_REPEATED, MOST_OWN, OWN_WORDS = 0.6, 0.2, 8


def is_copied(answer: str, question: str) -> bool:
    """All or most of the question is given back and nothing else is said but a short opening."""
    share, own = repeats(answer, question)
    return share >= LEAST_REPEATED and (own <= MOST_OWN or own * len(words(plain(answer))) <= OWN_WORDS)


def ends_with_question(answer: str, question: str) -> bool:
    """Whether an answer without an end mark is a whole repetition of the question: no more than a word in twenty of
    the question is missing, and the answer's last word ends a field or sentence of the question."""
    a, q = words(plain(strip_marks(answer.strip())[0])), _question(question)[0]
    if not a or not q or sum((Counter(q) - Counter(a)).values()) > len(q) / 20:
        return False
    return any(a[-1] == p[-1] and a[-2:-1] == p[-2:-1] for p in segments(question) if len(p) > 1) or a[-1] == q[-1]


def repeats_last_words(answer: str, question: str) -> bool:
    """Whether an answer ends with the last two words of the question."""
    a, q = words(plain(strip_marks(answer.strip())[0])), _question(question)[0]
    return a[-2:] == q[-2:]


#: Names of languages in requests such as `answer in German` (fixed values).
LANGUAGE_NAMES = {
    "en": "english englisch englischer anglais inglés inglese angielsku", "de": "german deutsch deutscher allemand alemán tedesco niemiecku", "fr": "french französisch französischer français francés francese francusku",
    "es": "spanish spanisch spanischer espagnol español castellano spagnolo hiszpańsku", "it": "italian italienisch italien italiano włosku", "pl": "polish polnisch polonais polaco polacco polsku", "ru": "russian russisch russe ruso russo rosyjsku", "zh": "chinese chinesisch chinois chino cinese mandarin chińsku",
}
_NAMED = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}


_REQUEST = re.compile(r"\b(?:in|into|auf|en|em|po|w)\s+(?:the |der |die |das |la |el )?(" + "|".join(_NAMED) + r")\b")


def wanted_languages(low: str) -> frozenset[str]:
    """The languages a question in lower case wants the answer in."""
    return frozenset(_NAMED[w] for w in _REQUEST.findall(low))


#: Sentences of at most so many words at the beginning are an opening.
OPENING_WORDS = 6


def in_other_language(answer: str, question: str) -> bool:
    """Whether the answer's sentences, a short opening and quotations aside, are in another language than the question's
    and in none that it asks for."""
    _, _, theirs, wanted = _question(question)
    if theirs is None or clear_language(answer) == theirs:
        return False
    mine = main_language(answer, OPENING_WORDS)
    return mine is not None and mine != theirs and mine not in wanted


__all__ = ["ending", "ends_with_question", "in_other_language", "is_copied", "is_empty", "is_refusal", "sentences"]
