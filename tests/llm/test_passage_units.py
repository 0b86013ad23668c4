"""The units that op2 counts in a text are those of its patterns, and only the digests asked for are made."""

import random

import numpy as np

from quarrylens.llm.passages import ANCHOR, RUN, UNITS, WHOLE, Words, _all_units, _second_halves

PIECES = ["a", "B", "c ", "..", "! ", "?", "\n", "\n\n", " \t\n", "\r", "\x0b", " ", "　", " ", "é", "ﬁ", "½", "\x1c", "İ", " x", " .", ".y"]


def test_units_are_those_of_the_patterns():
    rng = random.Random(5)
    words = Words()
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(25)))
        rows, _ = _all_units(words, text, 3)
        if not text.strip():
            assert not len(rows)
            continue
        sentences = rows[rows[:, 0] == RUN]
        assert sentences[:, 3:5].tolist() == [list(m.span()) for m in UNITS["sentence"].finditer(text)]
        assert sentences[:, 1].tolist() == list(range(len(sentences)))
        wholes, seen = [[words.starts[0], words.ends[-1]]], []
        wholes += [list(m.span()) for u in ("line", "paragraph") for m in UNITS[u].finditer(text)]
        first = []
        for begin, end in wholes:
            held = tuple(np.flatnonzero((words.starts >= begin) & (words.starts < end)))
            if held not in seen:
                seen.append(held)
                first.append([begin, end, len(held)])
        assert rows[rows[:, 0] == WHOLE, 3:6].tolist() == first


def test_the_first_reading_makes_one_half_of_the_digests():
    words = Words()
    text = " ".join(f"word{i % 90}." for i in range(400))
    rows, hashes = _all_units(words, text, 50)
    assert hashes.shape == (len(rows),)
    assert words._halves[0] is not None and words._halves[1] is None
    plain = rows[rows[:, 0] != ANCHOR]
    second = _second_halves(words, text, plain)
    both = np.column_stack([hashes[rows[:, 0] != ANCHOR], second])
    spelt = [(k, text[s:e]) for k, s, e in plain[:, [0, 3, 4]].tolist()]
    assert len(np.unique(both, axis=0)) == len(set(spelt))
