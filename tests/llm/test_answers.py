"""Endings, emptiness, refusals, repetitions and languages of answers."""

from __future__ import annotations

import pytest

from tessera.llm import answers
from tessera.llm.language import language, main_language
from tessera.llm.tiling import tiles

WORLD = '{"schema_version":"1.0","objects":[{"id":"a","position":[1,2]}],"relations":[]}'
LIST = "Places:\n- house at 4, 28 (4x6)\n- mill at 1, 2 (3x3)"


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        (WORLD, "whole"),
        (f"Here it is:\n```json\n{WORLD}\n```", "whole"),
        (WORLD[:-3], "cut"),
        (f"```json\n{WORLD[:40]}\n```", "cut"),
        (WORLD[:50] + " (cut)", "cut"),
        (WORLD[:50] + "…", "cut"),
        (WORLD.replace("]}]", "],}]"), "whole"),
        (WORLD.replace('"', "'"), "whole"),
        (WORLD + "\n// the end", "whole"),
        (LIST, "whole"),
        (LIST + "\nTotal objects: 2", "whole"),
        (LIST + "\n(all in bounds)", "whole"),
        (LIST + "\nDone ✅", "whole"),
        (LIST[:-1], "cut"),
        (LIST[:-6], "cut"),
        (LIST + "\n- tre", "cut"),
        ("The house stands at 3. The mill is near the pond.", "whole"),
        ("The house stands at 3. The mill is ne", "open"),
        ("The house stands at 3. The mill is ne [truncated]", "cut"),
        ("The house stands at 3.\n\nScene: Millpond", "whole"),
        ("The house stands at 3.\n\nEnd of plan", "whole"),
        ("The house stands there. 🏰", "whole"),
        ("She says “come in, the mi", "open"),
        ("我把房子放在这里。", "whole"),
        ("The mill is nea�", "cut"),
        ("x" * 100_000, "open"),
    ],
)
def test_ending(text, verdict):
    assert answers.ending(text)[1] == verdict


@pytest.mark.parametrize("text", [None, "", " \n", "\xa0", "{}", "[]", '""', "null", "N/A", "...", "-", "```json\n```", '{"objects": []}', "(no output)"])
def test_empty(text):
    assert answers.is_empty(text)


@pytest.mark.parametrize("text", ["A", "ok.", WORLD, "[1]", '{"objects": [], "x": 1}', "0"])
def test_not_empty(text):
    assert not answers.is_empty(text)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("I'm sorry, but I can't draw this.", None),
        ("Leider kann ich dabei nicht helfen.", None),
        ("Je ne peux pas créer cela.", None),
        ("No puedo crear esta escena.", None),
        ('{"status": "refused", "reason": "policy"}', None),
        (None, "content filter: request rejected by policy"),
    ],
)
def test_refusal(text, error):
    assert answers.is_refusal(text, error)


@pytest.mark.parametrize(("text", "error"), [("The keeper says “I can't help you”, and leaves.", None), ("Carts cannot cross it, sorry for the detour!", None), (None, "read timed out"), (WORLD, None), ("", None)])
def test_no_refusal(text, error):
    assert not answers.is_refusal(text, error)


QUESTION = "Build the mill of Tarn on 24 by 20 tiles. Put three trees near the pond, and let the road end at the gate."


def test_copies():
    assert answers.is_copied(QUESTION.upper(), QUESTION) and answers.is_copied(f"Sure! The task was: {QUESTION}\n{QUESTION}", QUESTION)
    assert not answers.is_copied(QUESTION[:40] + " The trees stand at 3 and 4, the road leads past them to the wall.", QUESTION)
    assert not answers.is_copied("", QUESTION) and not answers.is_copied("x", "")
    assert answers.ends_with_question("site: Tarn; map: 24 by 20; mood: quiet", "mood: quiet; site: Tarn; map: 24 by 20")
    assert not answers.ends_with_question("site: Tarn; map: 24 b", "site: Tarn; map: 24 by 20; mood: quiet")


def test_languages():
    german = "Das Haus steht bei der Mühle und der Weg ist frei. Niemand wird aufgehalten."
    assert answers.in_other_language("Sure! " + german, QUESTION)
    assert not answers.in_other_language(german, QUESTION + " Please answer in German.")
    assert not answers.in_other_language("The gate carries the words “wer zu spät kommt, der schläft draußen” in blue.", QUESTION)
    assert answers.in_other_language("房子在这里，路很宽。", QUESTION)
    assert language("") is None and main_language("12, 13") is None


def brute_tiles(a, b, least):
    """The definition: again and again the longest unmarked match, ties by place."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return sum(n for _, _, n in out)
        i, j, n = best
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append(best)


def test_tiles_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(25))] for _ in range(2))
        got = tiles(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
        marks = [k for i, _, n in got for k in range(i, i + n)], [k for _, j, n in got for k in range(j, j + n)]
        assert all(len(m) == len(set(m)) for m in marks)
        assert max([n for *_, n in got], default=0) == max((n for n in [longest(a, b)] if n >= 3), default=0)
        assert abs(sum(n for *_, n in got) - brute_tiles(a, b, 3)) <= 4  # ties may be broken another way


def longest(a, b):
    return max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)
