"""Repairs in mixed fields: what is clean stays clean."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm.garbled import WEAK, cost, encode, examine

CLEAN = "Größe café déjà für Straße élève señor Müller año".split()


def garble(word: str, wrong: str, meant: str) -> str | None:
    """``word`` as it looks if text of the encoding ``meant`` is read as ``wrong``."""
    try:
        shown = word.encode(meant).decode(wrong)
        return shown if encode(shown, wrong) == word.encode(meant) else None
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


@pytest.mark.parametrize(("wrong", "meant"), WEAK)
def test_one_bad_word_leaves_the_others(wrong, meant):
    """Words that keep a garbling cost of 0 may stay unseen, but clean ones never change, and at least one garbled word is put right."""
    right = 0
    for word in (*CLEAN, "naïve", "ARRÊTÉ", "다라마", "Привет", "наука"):
        bad = garble(word, wrong, meant)
        if bad is None or bad == word or cost(bad) == 0:
            continue
        found, restored, _ = examine(" ".join([*CLEAN[:4], bad, *CLEAN[4:]]))
        assert found
        if restored is not None:
            words = restored.split(" ")
            assert words[:4] + words[5:] == CLEAN
            right += words[4] == word
    assert right


@pytest.mark.parametrize("text", ["Größe café déjà naÔve", "das Maß ist naÔve", "Die Größe, cafÚ"])
def test_clean_words_beside_a_bad_one(text):
    found, restored, _ = examine(text)
    assert found
    kept = [w for w in text.split() if cost(w) == 0]
    assert kept == [w for w in restored.split() if w in kept]


def test_the_usual_letter_counts_among_equal_repairs():
    assert examine("cafÚ")[1] == "café"


def test_the_rest_of_the_field_decides_between_repairs():
    field = " ".join(w.encode("cp1252").decode("mac_roman") for w in ("Größe", "für", "perché", "però", "così"))
    assert examine(field)[1] == "Größe für perché però così"


@pytest.mark.parametrize(("bad", "good"), [("Ãœbersicht", "Übersicht"), ("â€“", "–"), ("MÃœLLROSE", "MÜLLROSE"), ("‚Äì", "–"), ("IÒigo", "Iñigo"), ("AÃƒâ€¡ÃƒÆ’O", "AÇÃO")])
def test_disguised_words(bad, good):
    assert examine(f"a {bad} b")[:2] == (True, f"a {good} b")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CLEAN, "plain", "5 €", "„ja“", "l’été", "한국어", "Привет", "naÔve", "cafÚ", "f¸r", "MÃ¼ller", "Ã©tÃ©", "¿Qué?"]), min_size=1, max_size=8))
def test_words_without_cost_survive(words):
    text = " ".join(words)
    _, restored, _ = examine(text)
    if restored is not None:
        old, new = re.split(" ", text), re.split(" ", restored)
        assert len(old) == len(new)
        assert all(a == b for a, b in zip(old, new, strict=True) if cost(a) == 0)
