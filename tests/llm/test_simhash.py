"""SimHash classes against brute force over all pairs."""

import random
import re

import pytest
import xxhash

from millrace.llm import simhash


def brute_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints: list[int], ids: list[int]) -> list[int]:
    label = list(ids)
    while True:
        new = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3) for p in prints]
        if new == label:
            return label
        label = new


def test_classes_equal_brute_force(spark):
    random.seed(6)
    words = [f"w{i}É" for i in range(60)]
    texts: list[str | None] = [None, "", " \t\n", "One", "one", "a\xa0b c", "two words"]
    for _ in range(12):
        base = random.choices(words, k=random.choice([5, 80, 300]))
        texts += [" ".join(base), " ".join(base).upper().replace("É", "é"), " ".join(base), " ".join([*base[:-1], "last"]), "\n".join(["first", *base])]
    ids = random.sample(range(10_000), len(texts))
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp long, component long")
    found = {r["_id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.classes(rows).collect()}
    prints = [brute_print(t) for t in texts]
    assert found == dict(zip(ids, zip(prints, brute_classes(prints, ids), strict=True), strict=True))
    assert simhash.classes(rows.limit(0)).count() == 0


def test_hot_nodes_lose_no_link(spark):
    random.seed(7)
    roots = [random.getrandbits(64) for _ in range(30)]
    prints = list({r ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for r in roots for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    of = {p: p for p in signed}
    top = lambda x: x if of[x] == x else top(of[x])
    for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), len(signed), group=4, crowd=1).collect():
        of[top(r["a"])] = top(r["b"])
    want = brute_classes(prints, list(range(len(prints))))
    pairs = {(want[i], top(p)) for i, p in enumerate(signed)}
    assert len(pairs) == len(set(want)) == len({b for _, b in pairs})


def shingle_sets(text: str) -> set:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_dedup_finds_planted_edits(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows, near, far = [], set(), set()
    for i in range(240):
        base = rng.choices(words, k=rng.choice([60, 150, 400]))
        edited = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.choice([0.005, 0.01, 0.02, 0.04, 0.1])))):
            edited[at] = rng.choice(words) + "x"
        a, b = shingle_sets(" ".join(base)), shingle_sets(" ".join(edited))
        (near if len(a & b) / len(a | b) >= 0.8 else far).add(1000 + i)
        rows += [(i, " ".join(base)), (1000 + i, " ".join(edited))]
    left = {r[0] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(240)) | far <= left
    assert len(near) > 80 and len(far) > 60
    assert len(near & left) <= len(near) * 0.01


@pytest.mark.parametrize("paired", [64, 0])
def test_dedup_compares_members_of_a_bucket(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    # a chain: each text is near its neighbours only, and all of it is one class
    base = [f"v{i}" for i in range(400)]
    rows = [(k, " ".join(["y%d" % i if i < 14 * k else w for i, w in enumerate(base)])) for k in range(12)]
    left = [r[0] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert left == [0]


def test_dedup_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (None, "alone twice"), (None, "alone twice"), (4, "alone twice not"), (4, "alone twice not")]
    left = [tuple(r) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(left) == 4 and set(left) == {(1, a), (1, b), (None, "alone twice"), (4, "alone twice not")}


def edited(rng: random.Random, base: list, at: list, own: str) -> list:
    return [f"{own}{i}" if i in set(at) else w for i, w in enumerate(base)]


def test_copies_just_under_the_threshold_are_not_paired(spark, monkeypatch):
    # copies of one text, each with two or four words of its own: near the text or not, and hardly ever near each other
    rng = random.Random(3)
    base = [f"b{i}" for i in range(130)]
    rows = [(i, " ".join(edited(rng, base, rng.sample(range(130), rng.choice([2, 2, 4])), f"own{i}x"))) for i in range(300)]
    rows.append((300, " ".join(base)))
    monkeypatch.setattr(simhash, "PAIRED", 0)
    asked, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest: asked.append(pairs.count()) or alike(pairs, *rest))
    left = {r[0] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingle_sets(t) for _, t in rows]
    joined = brute_labels(sets, 0.8)
    assert left == set(joined)
    assert asked[1] <= 4 * len(rows), asked


def brute_labels(sets: list, similarity: float) -> list:
    label = list(range(len(sets)))
    near = [[j for j, q in enumerate(sets) if len(p & q) >= similarity * len(p | q) - 1e-9] for p in sets]
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    return label


@pytest.mark.parametrize(("similarity", "seen", "cores"), [(0.8, 64, 3), (0.8, 2, 2), (0.6, 8, 1), (0.5, 64, 3)])
def test_framed_pairs_link_what_brute_force_links(spark, monkeypatch, similarity, seen, cores):
    monkeypatch.setattr(simhash, "SEEN", seen)
    monkeypatch.setattr(simhash, "CORES", cores)
    rng = random.Random(seen)
    texts = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(rng.choice([40, 90]))]
        for kind in "ab":  # copies of copies, edits that several share, shorter and longer copies
            second = edited(rng, base, rng.sample(range(len(base)), 6), f"{kind}{f}") if kind == "b" else base
            for n in range(25):
                at = rng.sample(range(len(base)), rng.choice([0, 1, 1, 2, 3, 5, 9]))
                words = edited(rng, second, at, rng.choice([f"own{f}{kind}{n}_", "common"]))
                texts.append(" ".join(words[: rng.choice([len(words), len(words), len(words) - 9])]))
    texts = sorted(set(texts))
    rows = simhash._sets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t", 5)
    nodes = {r["node"]: r["i"] for r in rows.select("i", "node").collect()}
    named = rows.selectExpr("node", "node AS label", "CAST(0 AS LONG) AS family")
    pairs = simhash._framed_pairs(named, rows, "t", 5, similarity, 1000)
    sets = [shingle_sets(t) for t in texts]
    of = list(range(len(texts)))
    top = lambda x: x if of[x] == x else top(of[x])
    for r in pairs.collect():
        a, b = nodes[r["a"]], nodes[r["b"]]
        assert (r["wa"], r["wb"]) == (len(sets[a]), len(sets[b]))
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            a, b = top(a), top(b)
            of[max(a, b)] = min(a, b)
    want = brute_labels(sets, similarity)
    assert [top(i) for i in range(len(texts))] == want
    assert 3 < len(set(want)) < len(texts)
