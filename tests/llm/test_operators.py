import hashlib
import random
from array import array
from collections import Counter

import pytest
import sentencepiece

from millrace.llm import licenses, mixing, pieces, prints, urls

HARD = [None, "", " ", "  a  b\t\nc  ", "the <0x41> é😀 世界><s>", "x" * 30_000, "a b " * 5_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src" if i % 2 else None, "clash", "clash") for i, t in enumerate(HARD)]
    rows += [(None, "the same text", "src", "", ""), (3, "twice", "src", "", ""), (3, "twice", "src", "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, rule string")


def test_pieces_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = pieces.decoded(pieces.encode(docs)).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r["token_ids"] == sp.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")


def test_pieces_random():
    model, sp = pieces.Model.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    random.seed(7)
    for _ in range(500):
        text = "".join(random.choice(" ▁  ab\n\tthé😀世>< s") for _ in range(random.randint(0, 40)))
        words = model.split(text)
        known = dict(model.encode_words(set(words)))
        assert array("i", b"".join(known[w] for w in words)).tolist() == sp.encode(text)


def test_pieces_runs_of_marks():
    """Pieces of marks alone tie in priority."""
    model, sp = pieces.Model.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    random.seed(11)
    spaces = [0, 1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 33, 40]
    texts = [" " * i for i in range(1, 80)]
    texts += ["".join(" " * random.choice(spaces) + random.choice(["the", "a", "x1", "é", "世", "\n"]) for _ in range(5)) + " " * random.choice(spaces) for _ in range(500)]
    assert [array("i", x).tolist() for x in pieces.encode_texts(model, texts)] == sp.encode(texts)


def test_pieces_bounds_change_no_ids(monkeypatch):
    model, sp = pieces.Model.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    monkeypatch.setattr(pieces, "LONG", 8)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 3)
    random.seed(8)
    texts = [x or "" for x in HARD] + [" ".join("".join(random.choices("aeinst", k=4)) for _ in range(30)) for _ in range(20)]
    assert [array("i", x).tolist() for x in pieces.encode_texts(model, texts)] == sp.encode(texts)


def test_unigram_viterbi_is_the_best_path():
    chars = "abc"
    names = [None] * 256 + [pieces.MARK, *chars, "ab", "bc", "abc", pieces.MARK + "a", "ca"]
    scores = [0.0] * 256 + [-2.0, -3.0, -3.1, -3.2, -4.0, -4.5, -7.0, -3.5, -5.5]
    model = pieces.Model(names, scores, list(range(256)), pieces.UNIGRAM)

    def best(w):
        return max([(scores[model.ids[w[:k]]] + best(w[k:])[0], [model.ids[w[:k]], *best(w[k:])[1]]) for k in range(1, len(w) + 1) if w[:k] in model.ids], default=(0.0, []))

    random.seed(5)
    for _ in range(100):
        w = pieces.MARK + "".join(random.choice(chars) for _ in range(random.randint(0, 7)))
        got = array("i", dict(model.encode_words({w, w[:-1] or w}))[w])
        assert sum(scores[i] for i in got) == pytest.approx(best(w)[0])


def test_licenses(spark, docs):
    text = "Foo.\nLicensed under the Apache License, Version 2.0.\nbar\nReleased under the MIT License."
    rows = docs.select("doc_id", "text", "rule").unionByName(spark.createDataFrame([(99, text, "")], "doc_id long, text string, rule string"))
    found = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert found[99]["sentence_ids"] == ["apache2-notice", "mit-notice"] and found[99]["licenses"] == ["Apache-2.0", "MIT"]
    assert found[0]["licenses"] == found[3]["licenses"] == [] and licenses.scan(rows).count() == rows.count()
    assert licenses.scan(rows.limit(0)).count() == 0


def test_urls(spark):
    rows = [None, "", "no scheme", "http://A.ORG", "http://a.org/x", "http://b.example.org/en/10?q", "http://x.com/de/1", "http://x.com/fr/#a", "https://www.bad.net:80//p//q/", "https://sub.bad.net/p", "http://good.net/p/q", "http://notorg/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.net/p/",), (None,), ("http://bad.net/p",), ("http://www.sub.bad.net/",)], "url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, listed).collect()}
    assert [found[i] for i in range(12)] == [
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("example.org/en/1", "block"),
        ("com/de/", "block"), ("com/fr/", "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"),
    ]
    assert urls.judge(pages.limit(0), listed).count() == 0
    assert urls.judge(pages, listed.limit(0)).where("listed").count() == 0


def test_url_filter_passes_every_listed_url(spark):
    keys = spark.range(2_000).selectExpr("concat('http://h', id, '.net/') AS url")
    asked = spark.range(4_000).selectExpr("concat('h', id, '.net/') AS url")
    assert {r[0] for r in urls.listed_urls(asked, keys).collect()} == {f"h{i}.net/" for i in range(2_000)}
    assert urls.listed_urls(asked, keys, max_broadcast=0).count() == 2_000


def test_fingerprints_estimate_the_similarity(spark, docs):
    random.seed(2)
    sampler = prints.Sampler(512)
    for _ in range(10):
        a, b = ([random.choice("abcdefghijklmnop") for _ in range(60)] for _ in range(2))
        x, y = Counter(a), Counter(b)
        assert prints.alike(sampler(" ".join(a)), sampler(" ".join(b))) == pytest.approx(sum((x & y).values()) / sum((x | y).values()), abs=0.12)
    found = prints.fingerprints(docs).collect()
    assert len(found) == docs.count() and {len(r["fingerprint"]) for r in found} == {16 * prints.SAMPLES}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_successors(spark, parts):
    rows = spark.createDataFrame([(i * 3 % 101, hashlib.md5(str(i).encode()).hexdigest()) for i in range(101)], "doc_id long, text string")
    seen = prints.with_successor(rows, parts=parts).rdd.glom().collect()
    pairs = {a["doc_id"]: b["doc_id"] for part in seen for a, b in zip(part, part[1:], strict=False) if not a["last"]}
    assert pairs == {i: (i + 1) % 101 for i in range(101)}


def test_mix_comes_near_its_targets(spark, docs):
    random.seed(4)
    rows = spark.createDataFrame([(i, "w " * random.choice([1, 5, 20, 200]), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.mix(rows, block=30).collect())) for _ in range(2))
    assert a == b
    for s in {r[2] for r in a}:
        target, got = next(r[5] for r in a if r[2] == s), sum(r[3] * r[6] for r in a if r[2] == s)
        assert abs(got - target) <= 0.02 * target
    assert mixing.dealt(mixing.mix(docs)).count() == docs.count() and mixing.mix(docs.limit(0)).count() == 0
