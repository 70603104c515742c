"""Line-first rules against a plain version, and edge rows."""

import random
import re
from collections import Counter

from millrace.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    lost = sum(len(x) for x in lines if quality.line_fails(x, len(re.findall(WORD, x))))
    kept = not failed and 100 * lost <= quality.MOST_LOST * sum(map(len, lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed, kept, lost


def test_figures_equal_brute_force(spark):
    random.seed(2)
    vocabulary = ["alpha", "beta", "gamma.", "délta", "#", "|", "*<>", "Cookies", "the", " x", "\x1c", "end!", "\x0b", "sign in"] + [f"w{i}" for i in range(60)]
    texts = [random.choice([" ", "\n", "\t", "\r\n"]).join(random.choices(vocabulary, k=random.randint(0, 150))) for _ in range(300)]
    texts = ["\n".join([t, *random.choices(texts, k=random.randint(0, 2))]) for t in texts]
    texts += [None, "", " ", "a " * 200_000, "x" * 1_000_000, "\n" * 100_000, "|" * 200_000, "One line, twice.\n" * 60]
    df = spark.createDataFrame([(i % 7 or None, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n long")
    found = {r["n"]: tuple(r)[1:] for r in quality.judge(df, carry=("n",), cleaned=False).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}
    assert quality.judge(df).count() == len(texts) and quality.judge(df.limit(0)).count() == 0


def test_failing_lines_go_and_good_ones_stay(spark):
    good = "A plain sentence of some words ends here, as prose does. " * 12
    text = f"Home | About | Contact | Help\n{good}\nWe use cookies.\nno mark at the end\n{good.strip()}"
    row = quality.judge(spark.createDataFrame([(1, text.replace("A plain", "Another"))], "doc_id long, text string")).first()
    assert row["clean_text"].split("\n") == [good.replace("A plain", "Another"), good.strip().replace("A plain", "Another")]
