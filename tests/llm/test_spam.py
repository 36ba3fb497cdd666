import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import spam as S
from strandline.llm import stretches as T

rnd = random.Random(11)
EN_A = ["the committee", "this council", "our inspector", "the minister for roads", "a former teacher", "the member opposite", "my neighbour", "the report"]
EN_B = ["has said that", "was told by us that", "will not admit that", "wrote to the press so that", "had hoped that", "could not see why"]
EN_C = ["the school in the valley is too small for all of the children", "a bridge that was built in haste has to be closed", "the price of bread is not what it was", "we owe an answer to the people who wait at the station", "no one has read the letter that came with it", "it is not for us to say who is right"]
DE_A = ["Der Ausschuss", "Die Abgeordnete", "Mein Nachbar", "Der Bericht", "Die Ministerin"]
DE_B = ["hat gesagt, dass", "will nicht sehen, dass", "war der Ansicht, dass", "weiß seit langem, dass"]
DE_C = ["die Schule im Tal für alle Kinder zu klein ist", "eine Brücke nicht in Eile gebaut werden darf", "der Preis für Brot nicht mehr zu zahlen ist", "wir den Leuten am Bahnhof eine Antwort geben müssen"]


def prose(a, b, c, n):
    return " ".join(f"{(x := rnd.choice(a))[0].upper()}{x[1:]} {rnd.choice(b)} {rnd.choice(c)}." for _ in range(n))


def names(n, tail):
    return "\n".join(f"Mr {rnd.choice(['Alan', 'Bert', 'Carl', 'Dora', 'Emma'])} {rnd.choice('ABCDEFGHKLM')}{rnd.choice(['ill', 'otter', 'arlow', 'enson'])}{tail}" for _ in range(n))


SPAM = {
    "german links": ("de", "\n".join(f"Angebot {i} schnaeppchen{i}.de" for i in range(60))),
    "german tags": ("de", "\n".join(f"Artikelnr. {1000 + 37 * i} | Farbe: {rnd.choice(['rot', 'blau', 'grau'])} | Preis: {i},99 EUR" for i in range(40))),
    "dutch links": (None, "\n".join(f"goedkope aanbieding https://www.winkel{i}.nl/koop/{i}" for i in range(40))),
    "french keywords": (None, "pas cher montre homme, montre homme luxe, montre femme pas cher, acheter montre homme, montre homme promo, " * 8),
    "hash tags": ("en", " ".join("#" + rnd.choice(["rabatt", "mode", "schuhe", "sale", "neu", "trend"]) for _ in range(80))),
    "keywords, a line each": ("en", "\n".join(rnd.choice(["garden hose", "hose reel", "cheap hose", "garden hose deal", "sprinkler"]) for _ in range(60))),
    "keyword sentences": ("en", "Best garden hose, garden hose deal garden hose cheap. Garden hose online garden hose sale garden hose shop. " * 6),
    "bare links": ("en", " ".join(f"http://shop{i}.com/item?id={i * 7}" for i in range(50))),
    "no word twice": ("en", "copper pans, night creams, velvet lamps, corridor boots, salt lamps, mossy tea, quill pens, wool socks, ember stoves, oat serum, garnet rings, felt slippers, loft beds, brass kettles, canvas bags, dusk perfume, pocket drones, cheap watches, used phones, running shoes, baby strollers, dog food, cat litter"),
}
PROCEEDINGS = {
    "attendance": ("en", names(40, " present")),
    "votes": ("en", "Ayes\n" + names(60, "")),
    "votes in a line": ("en", "Ayes: " + names(60, "").replace("\n", "; ")),
    "chant": ("en", "Resign now! " * 40),
    "calm chant": ("en", "We want justice. " * 30),
    "table": ("en", "District\tPosts\tCrowns\n" + "\n".join(f"Town{i}\t{i * 7}\t{i * 31}.50" for i in range(40))),
    "german table": ("de", "Tabelle 1: Ausgaben je Kreis\nKreis | 2019 | 2020\n" + "\n".join(f"Kreis {x} | {rnd.randint(100, 999)} | {rnd.randint(100, 999)}" for x in ["Altdorf", "Bergen", "Celle", "Dahme", "Emden", "Fulda", "Gera", "Hof", "Jena", "Lahr"])),
    "orders of the day": ("en", "Orders of the day\n" + "\n".join(f"{i}. {x} Bill: second reading, Mr Speaker to propose" for i, x in enumerate(["Harbour Dues", "Night Trains", "Peat", "Bridges", "Quarries", "Schools", "Rural Post"]))),
    "romanian": ("ro", "Domnule președinte, vreau să vă întreb de ce guvernul nu a publicat raportul despre bugetul pentru școli. Nu este corect ca părinții să aștepte un an întreg. Cred că ministrul trebuie să vină aici și să răspundă la întrebări, iar comisia să primească toate documentele care au fost cerute în luna martie."),
    "one romanian sentence": (None, "Domnule președinte, vreau să vă întreb de ce guvernul nu a publicat raportul despre bugetul pentru școli."),
    "two links in prose": ("en", "The paper is at https://parliament.example/papers/12 and has an annex. The minister replied that the report is at www.gov.example/reports and that it will be laid before us next week, which is late but not too late for the committee to read it, and it is not for me to say why it took so long."),
    "rule": ("en", prose(EN_A, EN_B, EN_C, 2) + "\n" + "=" * 200),
    "few words": ("en", "Hear, hear!"),
    "a heading": ("en", "Harbour dues"),
}


def corpus(n):
    out = []
    for i in range(n):
        german = i % 4 == 0
        tag = rnd.choice(["de", "DE", "de-x"]) if german else rnd.choice(["en", "en", "EN-gb", "en_US"])
        out.append(("en" if i % 31 == 0 else tag, prose(*((DE_A, DE_B, DE_C) if german else (EN_A, EN_B, EN_C)), rnd.randrange(2, 12))))
    return out


def test_wording_that_is_in_no_test_data(spark):
    texts = corpus(600)
    data = [(i, t, x, "k") for i, (x, t) in enumerate(texts)]
    data += [(1000 + i, t, x, "k") for i, (x, t) in enumerate(SPAM.values())]
    data += [(2000 + i, t, x, "k") for i, (x, t) in enumerate(PROCEEDINGS.values())]
    data += [(3000, None, "en", "k"), (3001, "", None, "k"), (3002, " \n ", "en", "k"), (3003, "-", None, "k"), (3004, prose(EN_A, EN_B, EN_C, 3) * 400, "en", "k"), (1000, data[600][1], "de", "k")]
    # half spam: a case only if more than half of the characters are spam
    some, much = prose(EN_A, EN_B, EN_C, 40), SPAM["french keywords"][1] * 9
    data += [(3005, some + "\n" + much[: len(some) // 3], "en", "k"), (3006, some + "\n" + much[: 2 * len(some)], "en", "k")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, key string").repartition(4)
    got = Counter(r.doc_id for r in S.spam_pages(df, "doc_id", "text", "lang").collect())
    want = Counter([1000, 3006, *(1000 + i for i in range(len(SPAM)))])
    of = lambda c: [list(SPAM)[k - 1000] if 1000 <= k < 2000 else list(PROCEEDINGS)[k - 2000] if 2000 <= k < 3000 else k for k in c]
    assert got == want, (of(want - got), of(got - want))


def test_edges(spark):
    schema = "doc_id bigint, text string, lang string"
    assert S.spam_pages(spark.createDataFrame([], schema), "doc_id", "text", "lang").collect() == []
    assert S.spam_pages(spark.createDataFrame([(1, None, None), (2, "", "en")], schema), "doc_id", "text", "lang").collect() == []
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(corpus(50))], schema)
    assert S.spam_pages(df, "doc_id", "text").collect() == []  # no tags: all texts are one language


def test_statistics_ignore_a_minority(spark):
    r = np.random.default_rng(4)
    n, bad = 4000, 300
    rates = np.abs(r.normal(0.3, 0.06, (n, len(S.FEATURES))))
    rates[:bad] = 1.0
    words = np.full(n, 60.0)
    counts = rates * S._sizes(words, np.full(n, 300.0))
    rows = [(i, [0], [60.0], [300.0], *([float(x)] for x in c)) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, f"key bigint, language array<int>, n_words array<float>, n_chars array<float>, {S._RATES}")
    centre, scale, inverse = S.robust_models(df, 1)[0]
    assert abs(centre - 0.3).max() < 0.02 and (scale < 0.13).all()
    _, d = S.offsets(words, np.full(n, 300.0), counts, (centre, scale, inverse))
    assert d[:bad].min() > 5 > np.quantile(d[bad:], 0.99)


@pytest.mark.parametrize("tag,want", [("en", "en"), ("EN-gb", "en"), ("en_US", "en"), (None, "und"), ("", "und"), ("english", "und"), ("und", "und"), (" fr ", "fr")])
def test_tags(tag, want):
    assert S.primary(tag) == want


PLAIN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+(?:['’][^\W\d_]+)*")


def test_words_equal_a_plain_search():
    texts = ["It's we'll 'quoted' don''t", "a_b c-d 12.5 x2", "夜行列車 is 24h カナです。", "É café ÎLE Straße", "'", "", "x", "ab'c'd e'", "👏 ok", "a" * 3000, None, "tab\tnew\nline"]
    seen = {}
    for block in T.blocks(pa.array(texts)):
        w = T.words(*block)
        for p, (s, e) in zip(w.part, zip(w.start, w.stop)):
            seen.setdefault(w.rows[p], []).append((s - w.begin[p], e - w.begin[p]))
    for i, t in enumerate(texts):
        got = [t[s:e] for s, e in seen.get(i, [])]
        assert got == PLAIN.findall(t or ""), t


def test_hashes_tell_words_apart_and_ignore_case():
    t = ["The cat the CAT The dog", "dog cat"]
    (block,) = T.blocks(pa.array(t))
    w = T.words(*block)
    words = " ".join(t).lower().split()
    for a, x in zip(w.hash, words):
        for b, y in zip(w.hash, words):
            assert (a == b) == (x == y)


def test_counts_equal_plain_counts():
    text = "Best hose, best HOSE; see http://a.b/c now! Mr Alan Hill, Ms Dora Bell, x | y"
    (block,) = T.blocks(pa.array([text]))
    w = T.words(*block)
    s = T.counted(w, np.zeros(len(w.start), bool))
    words = PLAIN.findall(text)
    c = dict(zip(S.FEATURES, s.counts[0]))
    assert s.n_words[0] == len(words) and s.n_chars[0] == len(text)
    assert c["plain"] == len(words) - sum(len(x) < 3 and x.islower() for x in words)
    assert c["unstopped"] == len(words) - 1 and c["marks"] == 2 and c["links"] == len("http://a.b/c")
    assert c["unnamed"] == len(words) - 8 and c["repetition"] == 2


def test_long_texts_are_taken_in_parts(monkeypatch):
    text = prose(EN_A, EN_B, EN_C, 60)
    whole = S._counter(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["tag", "text"])]))
    want = {r["word"]: r["n"] for b in whole for r in b.to_pylist()}
    monkeypatch.setattr(T, "BLOCK", 1000)
    parts = list(T.blocks(pa.array([text, "short"])))
    assert len(parts) > 3 and sum((e - b).sum() for _, _, b, e in parts) == len(text) + 5
    got = {r["word"]: r["n"] for b in S._counter(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["tag", "text"])])) for r in b.to_pylist()}
    assert set(got.values()) == {1} and len(set(want) - set(got)) == 0 and len(got) <= len(want) + 2 * len(parts)
