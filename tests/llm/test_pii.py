"""Disclosing terms of personal data."""

import math
import random
import re
from collections import Counter

import regex

from millrace.llm import pii


def test_terms_are_marked_in_the_whole_text_of_their_entity(spark):
    common = [(i, "the common words stand in all these texts and say little " * 4) for i in range(40)]
    far = "the common words say little " * 10
    rows = [
        *common,
        (100, f"Écrit Quillon a@x.com the common words. {far} QUILLON again."),
        (101, f"Quillon Écrit b {far} A@X.com 12"),
        (102, f"a@x.com. {far} quillonéquillon@x.com"),
        (103, "Quillon without the entity"),
        (104, "Ott's mark Quillon a@x.com"),
    ]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.scan(rows, min_support=2).collect()}
    words = lambda i: [found[i]["text"][s["start"] : s["end"]] for s in found[i]["terms"]]
    assert words(100).count("Quillon") == words(100).count("QUILLON") == 1
    assert "Quillon" in words(101) and words(103) == words(0) == []
    for r in found.values():
        assert not any(t["start"] < b["end"] and b["start"] < t["end"] for t in r["terms"] for b in r["base"])
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitised(pii.scan(rows, min_support=2)).collect()}
    assert "quillon" not in clean[100].lower() and "a@x.com" not in clean[101].lower() and clean[103] == "Quillon without the entity"


def test_a_rare_name_beside_a_one_off_email_is_a_term(spark):
    rows = [(i, "the common words stand in all these texts and say little " * 4) for i in range(40)]
    rows.append((100, "the common words of Quillon one@x.com say little"))
    found = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[100]["text"][s["start"] : s["end"]] for s in found[100]["terms"]] == ["Quillon"]
    assert all(not found[i]["terms"] for i in range(40))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_base(text: str) -> list[tuple]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end(), m.group()))
    return out


def brute_terms(texts: list[str], width: int = 64, threshold: float = 0.5, window_terms: int = 16) -> list[list[tuple]]:
    """Each text's disclosing terms: (start, end)."""
    term = lambda s: [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}{3,}+", s)]
    windows, holds = {}, []
    for t in texts:
        spans = sorted((s, e, k, v) for k, s, e, v in brute_base(t))
        holds.append(set())
        for i, (s, e, k, v) in enumerate(spans):
            entity = (k, re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower())
            lo = max(spans[i - 1][1] if i else 0, s - width)
            hi = min(spans[i + 1][0] if i + 1 < len(spans) else len(t), e + width)
            left, right = t[lo:s] if s > lo else "", t[e:hi] if hi > e else ""
            words = {w for a, b, w in term(left) if lo != s - width or a > 0} | {w for a, b, w in term(right) if hi != e + width or b < len(right)}
            holds[-1].add(entity)
            if words:
                # one window for each text: here no test text holds an entity twice
                windows.setdefault(entity, {}).setdefault(t, set()).update(words)
    counts = Counter(w for t in texts for _, _, w in term(t))
    total = sum(counts.values()) / window_terms
    strong = {}
    for entity, found in windows.items():
        f_c = len(found)
        for w in set().union(*found.values()):
            f_ct = sum(w in x for x in found.values())
            if f_c < total and math.log2(f_ct * total / (f_c * counts[w])) / math.log2(total / f_c) >= threshold:
                strong.setdefault(entity, set()).add(w)
    out = []
    for t, entities in zip(texts, holds):
        plain = t
        for _, s, e, _ in brute_base(t):
            plain = plain[:s] + " " * (e - s) + plain[e:]
        words = set().union(*(strong.get(x, set()) for x in entities)) if entities else set()
        out.append([(a, b) for a, b, w in term(plain) if w in words])
    return out


def test_spans_equal_brute_force(spark):
    random.seed(6)
    names = ["".join(random.choices("bcdfgé", k=5)) for _ in range(300)]
    private = ["a.b@x.org", "A.B@x.org", "10.0.0.1", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (0)20 7946-0958", "+1", "x@y", "a@b.c@d.e.", "+49 30 1234567 4111111111111111"]
    texts = []
    for _ in range(150):
        words = [random.choice(["the", "common", "words", "and", "say", random.choice(names)]) for _ in range(random.randint(0, 120))]
        if random.random() < 0.6:
            words.insert(random.randint(0, len(words)), random.choice(private))
        texts.append(random.choice([" ", "\n", ", "]).join(words))
    texts += private + ["".join(random.choices("0123456789 -.+@a()", k=60)) for _ in range(200)]
    texts = list(dict.fromkeys(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.scan(rows).collect()}
    for i, text in enumerate(texts):
        assert [tuple(s) for s in found[i]["base"]] == brute_base(text), text
    one_each = [t for t in texts if len({(k, v.lower()) for k, _, _, v in brute_base(t)}) == len(brute_base(t))]
    rows = spark.createDataFrame(list(enumerate(one_each)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in pii.scan(rows).collect()}
    want = brute_terms(one_each)
    assert sum(map(len, want)) > 50
    assert all(found[i] == w for i, w in enumerate(want))
    # counted the other way, as where too many terms are wanted to send them to all tasks
    again = {r["doc_id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in pii.scan(rows, max_broadcast=0).collect()}
    assert again == found


def test_a_taxonomy_generalises(spark):
    rows = [(i, "the common words stand in all these texts and say little " * 4, 0) for i in range(40)]
    rows.append((100, "the common words of Quillon one@x.com say little", 0))
    broader = spark.createDataFrame([("QUILLON", "a person"), ("quillon", "someone")], "term string, general string")
    clean = pii.sanitised(pii.scan(spark.createDataFrame(rows, "doc_id long, text string, words int"), taxonomy=broader))
    assert clean.where("doc_id = 100").first()["clean_text"] == "the common words of a person [EMAIL] say little"


def test_edge_rows(spark):
    rows = [(None, None, ""), (None, "", ""), (1, "a@b.cd", "x"), (1, "a@b.cd", "x"), (2, "1" * 1_000_000, ""), (3, "a" * 1_000_000, ""), (4, "+1 " * 300_000, ""), (5, "1." * 50_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    found = sorted((r["doc_id"] or 0, len(r["base"]), r["clean_text"]) for r in pii.sanitised(pii.scan(df)).collect())
    assert [x[:2] for x in found[:4]] == [(0, 0), (0, 0), (1, 1), (1, 1)] and found[3][2] == "[EMAIL]" and len(found) == len(rows)
    assert pii.scan(df.limit(0)).count() == 0
