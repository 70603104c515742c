"""Line-first quality rules.

Each line is judged by three rules: punctuation (prose has a sentence mark before white space or its end),
navigation (many separators or symbols for its words) and boilerplate (a stock phrase in a short line). Lines that
fail are removed; a document goes if it loses more than MOST_LOST percent of its characters, or fails the base
figures on words and repeated passages. Everything is computed on the whole text of one document at a time, so rows
never move; memory is bounded by an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS, SEPARATORS = "#*$%&|<>", "|»›•·"
SENTENCE = r"""[.!?…:;。！？؟]["')\]»”’]*([\x20\x09\x0B-\x0D]|$)"""
PHRASES = r"\b(cookies?|javascript|lorem ipsum|terms of (use|service)|privacy policy|all rights reserved|click here|sign (in|up)|log ?in|subscribe|read more|share this)\b"
#: A line of more words isn't boilerplate for one phrase in it.
PHRASE_WORDS = 20
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 50

_sentence, _phrases = re.compile(SENTENCE), re.compile(PHRASES, re.I | re.A)
_SPACES = " \t\n\v\f\r"


def line_fails(line: str, words: int) -> str | None:
    """The first rule that a line with words fails."""
    if not _sentence.search(line):
        return "punctuation"
    if 4 * sum(map(line.count, SEPARATORS)) >= max(words, 8) or 5 * sum(map(line.count, SYMBOLS)) > max(words, 5):
        return "navigation"
    if words <= PHRASE_WORDS and _phrases.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def judged(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, clean_text)"""
    words = text.encode().split()  # bytes are split at exactly U+0009 to U+000D and the space
    lines, seen, dup, lost, total = [], set(), 0, 0, 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            dup += line in seen
            seen.add(line)
            total += len(line)
            if line_fails(line, n):
                lost += len(line)
                continue
        lines.append(line)
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    kept = not failed and 100 * lost <= MOST_LOST * total
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated, failed, kept, lost, "\n".join(lines)


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("clean_text", pa.string())]
SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint, clean_text string"


def judge(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), *, cleaned: bool = True) -> DataFrame:
    """The columns `carry` of each row, its figures and verdict, and with cleaned=True its text without failing lines.

    A null text counts as empty: it has no words, so it fails. Rows are judged one by one: ids may be null or repeat.
    An empty table gives an empty result, and columns of df that aren't carried are ignored.
    """
    wanted = _FIELDS if cleaned else _FIELDS[:-1]
    rows = df.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = ", ".join(f"_c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(judged(x.as_py()) for x in b.column("_text")), strict=True)) or [()] * len(_FIELDS)
            columns = [pa.array(v, type=kind) for v, (_, kind) in zip(found, wanted, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *columns], names=[*b.schema.names[: len(carry)], *(n for n, _ in wanted)])

    out = rows.mapInArrow(run, ", ".join([kinds, *SCHEMA.split(", ")[: len(wanted)]]))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), *(n for n, _ in wanted))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), cleaned=False)


def _count(c: str, of: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '[{of}]', '', 'g')))"


_WORD = r"[^\x20\x09-\x0D]+"
_QUOTED = SENTENCE.replace("'", "''")
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
l AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '{_WORD}')) AS n FROM (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d)) WHERE regexp_matches(line, '{_WORD}')),
j AS (SELECT doc_id, length(line) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
  NOT regexp_matches(line, '{_QUOTED}') OR 4 * {_count('line', SEPARATORS)} >= greatest(n, 8) OR 5 * {_count('line', SYMBOLS)} > greatest(n, 5)
  OR (n <= {PHRASE_WORDS} AND regexp_matches(line, '(?i){PHRASES}')) AS bad FROM l),
jl AS (SELECT doc_id, sum(dup::BIGINT) AS dups, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, sum(chars) AS total FROM j GROUP BY doc_id),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(3) AS x(k) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST({_count('t', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(total, 0) AS total FROM d LEFT JOIN jl USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * total AS kept, lost_chars FROM f
"""

QUERIES = {"op4_quality": op4_quality}
ORACLES = {"op4_quality": ORACLE}
