"""The units of texts that op2 reads together are those of each text alone."""

import random

import helpers
import numpy as np

import quarrylens.llm.passages as passages
from quarrylens.llm.passages import ANCHOR, Words, _all_units, _groups, _second_halves, _windows

PIECES = ["a", "B", "c ", "..", "! ", "?", "\n", "\n\n", " \t\n", "\r", "\x0b", " ", "　", " ", "é", "ﬁ", "½", "\x1c", "İ", "Σ", " x", " .", ".y"]


def units(words, text, window, stops, number):
    """The units of one of the texts read: rows and both halves of digests, and the windows of every second anchor."""
    rows, hashes = _all_units(words, text, window, stops)
    plain = rows[:, 0] != ANCHOR
    second = _second_halves(words, text, rows[plain])
    anchors = rows[~plain]
    anchors = anchors[anchors[:, 1] % 2 == 0]
    places, seconds = [], []
    if len(anchors):
        bounds, heads, at, seconds = _windows(words, anchors[:, 1] + words.firsts[anchors[:, 6]], window)
        own = words.text[at]
        places = list(zip((at - words.firsts[own]).tolist(), np.repeat(heads, np.diff(bounds)).tolist(), seconds.tolist(), own.tolist(), strict=True))
    found = []
    for i in range(number):
        mine = rows[:, 6] == i
        own = rows[mine, :6].tolist(), hashes[mine].tolist(), second[rows[plain, 6] == i].tolist()
        found.append((*own, [x[:3] for x in places if x[3] == i]))
    return found


def test_texts_read_together_have_the_units_of_each(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(600)]
    texts += [None, "", "\n", "plain words only. Of one text", helpers.prose(rng, 30), "of one text. And the next"] * 3
    rng.shuffle(texts)
    words = Words()
    alone = [units(words, x or "", 3, None, 1)[0] for x in texts]
    for codes in (1, 300, 1 << 17):
        monkeypatch.setattr(passages, "GROUP_CODES", codes)
        together = []
        for begin, stop, text, stops in _groups(texts):
            together += units(words, text, 3, stops, stop - begin)
        assert together == alone


def test_short_texts_are_read_together_and_long_ones_bound_a_group():
    texts = ["Some words. " * 5] * 1000 + ["x " * 200_000] + [None] * 10 + ["y " * 200_000] * 2
    found = list(_groups(texts))
    assert [(begin, stop) for begin, stop, _, _ in found] == [(0, 1001), (1001, 1012), (1012, 1013)]
    assert [x for _, _, text, stops in found for x in (text[i:j] for i, j in zip([0, *(stops[:-1] + 1)], stops, strict=True))] == [x or "" for x in texts]
    assert list(_groups([])) == []
