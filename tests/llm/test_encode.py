import random

import pytest

from strandline.llm import encode as E


@pytest.fixture(scope="module")
def v():
    return E.vocabulary(E.default_vocabulary())


TEXTS = [
    "", " ", "\n\n", "it's we'll they'd I'm you've 're ' s", "<|endoftext|> is text", "a" * 5000, "ab" * 3000 + " x", " " * 3000, "x" + " " * 3000 + "y", "é" * 2000, "渡船補助に関する報告書は" * 300,
    "=" * 4000 + "a", "don't " * 900, "👏🏽" * 700, "word  two   three\t\tfour \n five " * 200, "1234567890" * 500, "l'''re" * 700, "a b " * 500, "mixed" * 900 + "'ll" + "9" * 900 + " tail",
]


@pytest.mark.parametrize("block", [16, 64, 1000, 65_536])
def test_stream_equals_whole(v, block):
    for t in TEXTS:
        assert E.encode(v, t, block) == v.core.encode_ordinary(t), (block, t[:30])


def test_typical_texts_go_through_the_encoder(v, monkeypatch):
    text = "Of words, numbers like 1234 and marks: it's an ordinary text, as they come. " * 20
    want, most, plain = v.core.encode_ordinary(text), [], v.core.encode_ordinary
    monkeypatch.setattr(v.core, "encode_ordinary", lambda t: most.append(len(t)) or plain(t))
    assert E.encode(v, text) == want
    assert max(most) < len(text) / 2


@pytest.mark.parametrize("text", [" " * 400_000, "\n" * 100_000 + "x", "x" + " \t" * 60_000 + " y", "a" * 100_000, "=" * 100_000, "9" * 50_000, "word " * 40_000, "夜" * 50_000, "don't" * 20_000])
def test_memory_is_constant(v, text):
    e, ids, most = E.Encoder(v), [], 0
    for at in range(0, len(text), 1000):
        ids += e.feed(text[at : at + 1000])
        most = max(most, len(e.held) + (len(e.stream.tail) if e.stream else 0))
    assert most <= 2 * E.BLOCK + 8 * v.lookahead
    assert ids + e.finish() == v.core.encode_ordinary(text)


def test_lookahead_comes_from_the_merge_list(v):
    assert v.lookahead == max(len(t) for t in v.ranks) and not hasattr(E.PieceStream, "_whole")


def test_random_feeds(v):
    rnd = random.Random(5)
    alphabet = ["a", "the", "'", "'s", " ", "  ", "\n", "9", "é", "日", "—", "''", "ing", "_", "\t", "zzzz", "\r\n"]
    for _ in range(150):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400)))
        e, ids, at = E.Encoder(v, rnd.choice([8, 20, 100])), [], 0
        while at < len(t):
            n = rnd.randrange(1, 60)
            ids += e.feed(t[at : at + n])
            at += n
        assert ids + e.finish() == v.core.encode_ordinary(t), t


def test_piece_stream(v):
    rnd = random.Random(9)
    for s in ["a" * 3000, "".join(rnd.choice("abcdeionrst") for _ in range(6000)), "=-" * 2000, "antidisestablishmentarianism" * 90, "ééàü" * 500]:
        p = E.PieceStream(v)
        b, ids, early = s.encode(), [], 0
        for at in range(0, len(b), 97):
            ids += p.feed(b[at : at + 97])
            assert len(p.tail) < 12 * v.longest
        early = len(ids)
        assert ids + p.finish() == v.core._encode_single_piece(b) and early > 0


def test_decode_parts(v):
    for t in TEXTS:
        assert "".join(E.decode(v, v.core.encode_ordinary(t))) == t
    half = v.ranks[bytes([0xC3])]
    assert "".join(E.decode(v, [half])) == "�"


def test_operator(spark, v):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*TEXTS, None, "twin", "twin"])], "doc_id bigint, text string, key string")
    got = {r.doc_id: r.ids for r in E.encoded(df, "doc_id", "text", block=500).collect()}
    assert got == {i: v.core.encode_ordinary(t or "") for i, t in enumerate([*TEXTS, None, "twin", "twin"])}
    assert all(r.same for r in E.encoded(df, "doc_id", "text", mode="check", block=500).collect())
    assert E.encoded(df.where("false"), "doc_id", "text").collect() == []
