"""SentencePiece encoding and decoding."""

import random

import helpers
import pytest
from pyspark.sql import functions as F

from quarrylens.llm.common import TOKENIZERS, read_bytes
from quarrylens.llm.pieces import BLANK, MODEL, PieceCoder, decode_tokens, encode_texts, round_trip

CONTENT = read_bytes(f"{TOKENIZERS}/{MODEL}")
ODD = ["", " ", "  two  blanks ", "line\nfeed\n\n", "tab\tand\x00nul", "日本語と emoji 🙂", "é" * 50, f"own {BLANK} sign", "a\xa0b", "x" * 300, "Ünïcode ßäß"]


@pytest.fixture(scope="module")
def own():
    return PieceCoder(CONTENT)


@pytest.fixture(scope="module")
def library():
    """The library's Viterbi on the same pieces.

    It adds scores in single precision, so the one huge penalty among them is made smaller: the
    pieces of several blanks stay worse than single ones.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(CONTENT)
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for piece in model.pieces:
        piece.score = max(piece.score, -70_000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def lines():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñ'.,!?-0123456789ABC"
    return ["".join(rng.choice(letters) if rng.random() < 0.85 else " " for _ in range(rng.randint(1, 80))).strip() or "a" for _ in range(400)]


def test_equals_the_library(own, library):
    for text in lines():
        if "  " not in text:
            assert own.encode(text).tolist() == library.encode(text), text


def test_equals_a_plain_viterbi(own):
    """All segmentations by dynamic programming, without the automaton."""
    scores = {own.raw[i].decode(): (s, i) for text, (_, s, i) in own.automaton.items() for _ in [0]}

    def best(text):
        score = [0.0] + [None] * len(text)
        for end in range(1, len(text) + 1):
            options = [score[b] + scores[text[b:end]][0] for b in range(max(0, end - 20), end) if text[b:end] in scores]
            if text[end - 1] not in own.single:
                options.append(score[end - 1] + own.unknown)
            score[end] = max(options)
        return score[-1]

    for text in lines()[:80] + ["日本語 🙂x", "a\nb c"]:
        total, ids, at = 0.0, own.encode(text).tolist(), 0
        by_id = {i: s for s, i in scores.values()}
        while at < len(ids):
            if ids[at] in by_id:
                total += by_id[ids[at]]
                at += 1
            else:
                lead = own.raw[ids[at]][0]
                total += own.unknown
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        assert total == pytest.approx(best(" " + text))


def test_round_trip(own):
    rng = random.Random(1)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x3040, 0x30FF), 0x20, 0x0A])) for _ in range(200)) for _ in range(60)]
    for text in texts:
        assert own.decode(own.encode(text).tolist()) == text
    assert own.decode([own.byte_ids[0xFF]]) == "�"


def test_frames(spark, own):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (0, ODD[0]), (101, "long word " * 40_000)]
    frame = helpers.docs(spark, rows).withColumn("TOKEN_IDS", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    found = round_trip(frame).collect()
    assert len(found) == len(rows) and all(r["same"] for r in found)
    assert all((r["token_ids"] is None) == (r["text"] is None) for r in found)
    assert all(r["n_tokens"] == len(r["token_ids"]) and r["token_ids"] == own.encode(r["text"]).tolist() for r in found if r["text"] is not None)
    decoded = decode_tokens(encode_texts(frame)).collect()
    assert len(decoded) == len(rows) and all(r["decoded"] == r["text"] for r in decoded)
    assert decode_tokens(encode_texts(frame.limit(0))).count() == round_trip(frame.limit(0)).count() == 0
