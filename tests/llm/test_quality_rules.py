"""Quality rules by tokeniser fertility."""

import base64
import math
import random
import re

import helpers
from pyspark.sql import functions as F

from quarrylens.llm.common import TOKENIZERS, read_bytes
from quarrylens.llm import quality_rules as rules
from quarrylens.llm.quality_rules import BANDS, accepts, base_counts, entropy, foreign_share, load_vocabulary, main_script, quality_rules
from quarrylens.llm.queries import QUERIES

ODD = ["", " \n\t ", "one", "a\xa0b \x1c c", "x\n\nx\n x\nx", "a b c d e a b c d e", "a b c d e f a b c d e", "aaaa " * 30, "#1 *2 $% & | < >", "日本語 " * 5]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(repeated),
    )


def test_base_counts():
    rng = random.Random(3)
    for text in ODD + [helpers.prose(rng, rng.randint(1, 150), vocabulary=rng.choice([2, 5, 400])) for _ in range(60)]:
        assert base_counts(text.encode())[1] == plain(text)


def plain_verdict(text, lang):
    """The measures and the verdict of the bands, token by token."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    joined, points = " ".join(words), sum(map(len, words))
    kept, measures = True, []
    for name, bands in BANDS.items():
        ids = load_vocabulary(name, read_bytes(f"{TOKENIZERS}/{name}")).encoding.encode_ordinary(joined)
        ranks = dict(line.split() for line in read_bytes(f"{TOKENIZERS}/{name}").splitlines())
        lone = {int(ranks[k]) for k in ranks if len(base64.b64decode(k)) == 1 and base64.b64decode(k)[0] > 127}
        shares = [ids.count(i) / len(ids) for i in set(ids)]
        bits = -sum(x * math.log2(x) for x in shares)
        band = bands.get(lang) or bands.get(main_script(joined)) or bands["other"]
        part = min(1, max(0, 32 / len(ids) - 32 / 256))
        low = band.chars[0] - part * max(0, band.chars[0] - 1)
        chars, lones = points / len(ids), sum(i in lone for i in ids) / len(ids)
        measures.append((len(ids), chars, lones, bits))
        kept &= low <= chars <= band.chars[1] * (1 + part) and lones <= band.byte_share + 0.2 * part
        kept &= bits >= (band.spread - 0.3 * part) * math.log2(min(len(ids), 256))
    return kept, measures


def test_bands_against_plain_measures(spark):
    rng = random.Random(12)
    junk = ["".join(chr(rng.randrange(0x1000, 0x109F)) for _ in range(5)) for _ in range(80)]
    rows = [(i, helpers.prose(rng, 12 + 4 * i, vocabulary=rng.choice([8, 400])), rng.choice(["en", "de", None])) for i in range(25)]
    rows += [(30 + i, " ".join(rng.sample(junk, 12 + i)), rng.choice(["en", "xx"])) for i in range(6)]
    rows += [(40 + i, " ".join(f"{rng.getrandbits(64):x}#%" for _ in range(11 + 3 * i)), "en") for i in range(6)]
    for r in quality_rules(helpers.docs(spark, rows)).collect():
        kept, measures = plain_verdict(r["text"], r["lang"])
        for got, want in zip(r["fertility"], measures, strict=True):
            assert got["n_tokens"] == want[0]
            found = (got["chars_per_token"], got["byte_share"], got["token_entropy"])
            assert all(abs(a - b) < 1e-9 for a, b in zip(found, want[1:], strict=True))
        assert r["kept"] == (kept and not r["base_failed"])


def test_short_texts_have_a_verdict():
    band = BANDS["byte_bpe_multi_50k.tiktoken"]["en"]
    for n in (10, 20, 40, 63, 64, 100, 255, 256, 1000):
        assert accepts(band, n, 4.0, 0.0, 0.95 * math.log2(min(n, 256)))
        assert not accepts(band, n, 0.6, 0.0, 0.95 * math.log2(min(n, 256)))
        assert not accepts(band, n, 4.0, 0.9, 0.95 * math.log2(min(n, 256)))
        assert not accepts(band, n, 4.0, 0.0, 0.1)
    assert foreign_share(256) == 0 and foreign_share(57) < foreign_share(40) <= 1


def test_verdicts(spark):
    rng = random.Random(6)
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(50, None, "en"), (50, None, "en")]
    english = "The council met on Tuesday to discuss the new plan for the old harbour, and most of those who spoke were in favour of it. "
    english += "A small group asked for more time, since the cost of the work had not been checked by anyone outside the town. "
    english += "After a long debate the members agreed to hold a second meeting before the end of the month and to invite the builders."
    rows += [(60, english, "en"), (61, english, None), (62, english, "xx"), (63, " ".join(w + "###" for w in english.split()), "en")]
    rows += [(64, "".join(chr(rng.randrange(0x1000, 0x10FF)) + " " for _ in range(200)), "en")]
    frame = helpers.docs(spark, rows).withColumn("KEPT", F.lit("x")).withColumn("fertility", F.lit(1))
    found = quality_rules(frame)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows) and "KEPT" not in found.columns
    for i, text, _ in rows:
        n_words, _, _, _, repeated = plain(text)
        failed = n_words < 10 or 100 * repeated > 20 * n_words
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (n_words, repeated)
    assert got[60]["kept"] and got[61]["kept"] and got[62]["kept"]
    assert [got[i]["fertility"][0]["band"] for i in (60, 61, 62)] == ["en", "LATIN", "LATIN"]
    assert not got[63]["kept"] and not got[64]["kept"] and not got[50]["kept"]
    assert quality_rules(frame.limit(0)).count() == 0


def test_measures():
    name = next(iter(BANDS))
    model = load_vocabulary(name, read_bytes(f"{TOKENIZERS}/{name}"))
    ids = model.encode("This is plain text.")
    assert not model.is_byte[ids].any()
    assert model.is_byte[model.encode("ခ")].any()
    assert entropy(ids[:1]) == 0.0 and abs(entropy(ids[[0, 0, 1, 1]]) - 1) < 1e-12
    pieces = load_vocabulary("piece_bpe_32k.model", read_bytes(f"{TOKENIZERS}/piece_bpe_32k.model"))
    assert pieces.is_byte[pieces.encode("ခ")].sum() == 3
    assert main_script("Привет мир") == "CYRILLIC" and main_script("12 !") == "other"


def test_query_over_documents_without_words(spark, tmp_path):
    texts = ["one two three " * 9, "", " \n\t ", None, "a" + "\u3000" * 1_100_000 + "b"]
    helpers.docs(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op7_tokeniser_fertility"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0]["n_tokens"] > 0 and got[4]["n_tokens"] > 0
    for i in (1, 2, 3):
        assert got[i]["n_words"] == 0 and got[i]["base_failed"] and not got[i]["kept"]
        assert all(got[i][x] is None for x in ("n_tokens", "chars_per_token", "byte_share", "token_entropy", "band"))


def test_text_that_is_not_unicode():
    words, counts = base_counts(b"ab \xff\xc3 c\xc3\xa9")
    assert words == [b"ab", b"\xff\xc3", b"c\xc3\xa9"] and counts[:2] == (3, 6)


def test_long_runs_of_white_space(monkeypatch):
    """The ids are those of the whole text, wherever runs are cut out of it."""
    rng = random.Random(8)
    model = load_vocabulary(next(iter(BANDS)), read_bytes(f"{TOKENIZERS}/{next(iter(BANDS))}"))
    monkeypatch.setattr(rules, "WHITE_RUN", 3)
    monkeypatch.setattr(rules, "_WHITE_RUNS", re.compile(rules._WHITE_RUNS.pattern.replace(str(1 << 16), "3")))
    for _ in range(300):
        text = "".join(rng.choice(["a", "word", "7", "#", "\x1c", "é", " ", " ", "\u3000\u3000", "\xa0", "\u2003", "\u200b"]) for _ in range(rng.randint(0, 25)))
        assert model.encode(text).tolist() == model.encoding.encode_ordinary(text)
