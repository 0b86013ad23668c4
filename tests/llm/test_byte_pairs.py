"""Byte-level BPE against the public library."""

import hashlib
import random

import helpers
import numpy as np
import pytest
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from quarrylens.llm import byte_pairs
from quarrylens.llm.byte_pairs import PairCoder, ascii_pattern, coder_parts, decode_bytes, encode_and_decode, encode_bytes, hash_shifts, read_ranks
from quarrylens.llm.common import TOKENIZERS, read_bytes

ODD = ["", " ", "  a  b ", "\n\n x\t", "it's 'tis we'll I'd", "日本語 🙂", "<|endoftext|>", "\x00\x1c\x85 ", "a" * 3000, " " * 500 + "x", "Ünïcode", "1234567890 12"]


@pytest.fixture(scope="module")
def own():
    return PairCoder(*coder_parts())


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = read_ranks(read_bytes(f"{TOKENIZERS}/{byte_pairs.RANKS}"))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def random_texts(seed, count):
    rng = random.Random(seed)
    kinds = ["etaoin shrdlu", " \n\t\xa0　", "'sdtm", "0123٣", "äßéñ漢字кирил", "!?#$—🙂", "".join(map(chr, range(1, 40)))]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 120))) for _ in range(count)]


def test_hash_is_minimal_and_perfect(own):
    ranks = read_ranks(read_bytes(f"{TOKENIZERS}/{byte_pairs.RANKS}"))
    words = own.vocabulary
    assert len({words._place(k) for k in ranks}) == len(ranks) == words.size
    assert all(words.rank(k) == r for k, r in ranks.items())
    assert words.rank(b"no such token at all") == -1
    for n in (1, 2, 5, 300):
        seed, shifts = hash_shifts([b"%d" % i for i in range(n)])
        assert len(shifts) == max(1, -(-n // byte_pairs.BUCKET_KEYS))


def test_equals_the_library(own, library):
    for text in ODD + random_texts(3, 1500):
        assert ids(own.encode(text)) == library.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_equals_the_library_on_every_pre_token_without_the_first_tier(own, library):
    for text in random_texts(5, 300):
        for piece in (p for part in own.pieces(text) for p in part):
            raw = piece.encode()
            if own.vocabulary.rank(raw) < 0:
                assert own.merge(raw) == library.encode_ordinary(piece)


def test_ascii_texts_are_cut_alike(own):
    rng = random.Random(2)
    for n in range(4000):
        text = "".join(chr(rng.choice([rng.randrange(128), 32, 39, 10, 115, 49])) for _ in range(rng.randint(1, 30)))
        assert own.find_ascii(text) == own.find(text), repr(text)
    assert "p{" not in ascii_pattern(PATTERN)


@pytest.mark.parametrize("size", [3, 7, 50])
def test_slices_do_not_change_the_ids(own, library, monkeypatch, size):
    monkeypatch.setattr(byte_pairs, "SLICE_CHARS", size)
    for text in ODD + random_texts(8, 200):
        assert ids(own.encode(text)) == library.encode_ordinary(text), repr(text)


def test_frames(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (0, ODD[0]), (101, "long word " * 40_000), (None, "no id")]
    frame = helpers.docs(spark, rows).withColumn("TOKEN_IDS", F.lit("x")).withColumn("Decoded", F.lit("y"))
    encoded = encode_bytes(frame)
    found = encoded.collect()
    assert len(found) == len(rows)
    for r in found:
        want = None if r["text"] is None else library.encode_ordinary(r["text"])
        assert r["token_ids"] == want and r["n_tokens"] == (None if want is None else len(want))
    assert all(r["decoded"] is None if r["text"] is None else bytes(r["decoded"]) == r["text"].encode() for r in decode_bytes(encoded).collect())
    both = encode_and_decode(frame).select("text", "packed_ids", "decoded", F.sha2("packed_ids", 256).alias("digest")).collect()
    for r in both:
        if r["text"] is not None:
            packed = np.array(library.encode_ordinary(r["text"]), dtype="<u4").tobytes()
            assert bytes(r["packed_ids"]) == packed and r["digest"] == hashlib.sha256(packed).hexdigest()
            assert bytes(r["decoded"]) == r["text"].encode()
    assert encode_bytes(frame.limit(0)).count() == encode_and_decode(frame.limit(0)).count() == decode_bytes(encoded.limit(0)).count() == 0


def test_other_vocabulary(spark):
    rows = helpers.docs(spark, [(1, "many languages, многие языки")])
    coded = encode_bytes(rows, ranks="byte_bpe_multi_50k.tiktoken")
    assert bytes(decode_bytes(coded, ranks="byte_bpe_multi_50k.tiktoken").first()["decoded"]).decode() == "many languages, многие языки"
