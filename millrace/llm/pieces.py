"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text's spaces are marks (U+2581 in the vocabulary) and one more is put before it. It is cut into marked words where no piece can
cross. A slice's distinct words are sorted, which lays their trie out depth-first: a word starts from the forward
states of the prefix that it shares with the word before, and only adds states for the rest. An Aho-Corasick
automaton of all pieces names the pieces that end at each new character.

A forward state of a prefix holds its best score and the last piece on the best path. For a unigram model the score
is the sum of the pieces' scores. For a merge (BPE) model a path scores 0 if each two neighbours are what merging
their joined text gives, else minus infinity: exactly one path to each prefix is left, and it is the encoding that
the merges give. Prefixes of marks alone, whose pieces tie in priority, take their last piece from merging that run.
Characters that no piece holds become their bytes.

Scale: rows never move. The model (a vocabulary file, at most MAX_PIECES pieces) is read once on the driver and sent
with the task. Texts are worked off in slices of SLICE bytes, and a longer text in runs of its words. Of a slice its
distinct words and their ids are held, and of a task at most MAX_PAIRS pairs of pieces; both go with it, and what is
forgotten is found anew. So the memory of a task doesn't grow with its rows, and with a text's length only by its ids.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What a vocabulary writes for a space. Inside, texts and pieces keep the space, which takes half the memory.
WRITTEN, MARK = "▁", " "
MAX_PIECES, MAX_PAIRS = 1_000_000, 250_000
#: Bytes of texts that are worked off at a time; characters of a text that is worked off alone, run by run
SLICE, LONG = 12_000_000, 1_000_000
#: Rows that go back to Spark at a time
ROWS_OUT = 256
MERGE, UNIGRAM = "merge", "unigram"
#: In place of a piece: the start of a word, and a character that no piece holds
ROOT, UNKNOWN = -2, -1


class Model:
    """A vocabulary: `pieces` in the order of their ids, with None for control pieces."""

    def __init__(self, pieces: list[str | None], scores: list[float], byte_ids: list[int], kind: str = MERGE):
        assert len(pieces) <= MAX_PIECES and len(byte_ids) == 256
        pieces = [p if p is None else p.replace(WRITTEN, MARK) for p in pieces]
        self.kind, self.byte_ids, self.scores = kind, byte_ids, scores
        self.ids = {p: i for i, p in enumerate(pieces) if p is not None}
        of_byte = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.raw = [of_byte.get(i, b"") if p is None else p.encode() for i, p in enumerate(pieces)]
        self.longest = max(map(len, self.ids), default=1)
        #: below every path of pieces, as the reference library places unknown characters
        self.unknown = min((scores[i] for i in self.ids.values()), default=0.0) - 10.0
        alone = [c for c in "\n\t" if not any(c in p for p in self.ids)]
        inside = "".join(map(re.escape, alone))
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.words = re.compile("(?s).+" if crossing else f"{MARK}+[^{MARK}{inside}]*|[^{MARK}{inside}]+" + (f"|[{inside}]" if alone else ""))
        self.names = pieces
        self._start()

    def say(self, ids: np.ndarray) -> str:
        """The ids, comma-joined."""
        return ",".join(map(self._said.__getitem__, ids.tolist()))

    def _start(self) -> None:
        """What isn't sent with a task: the automaton, and what is remembered of pairs and of runs of marks."""
        self._pairs: dict[int | tuple[str, int], bool] = {}
        self._marks: dict[int, int] = {}
        self._said = list(map(str, range(len(self.names))))
        self._ends = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self._ends.add_word(p, (i, len(p)))
        if self.ids:
            self._ends.make_automaton()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_pairs", "_marks", "_said", "_ends")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        """From a SentencePiece file whose normaliser is the identity with a mark put before the text."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            stored = proto.ModelProto.FromString(f.read())
        norm, train = stored.normalizer_spec, stored.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback:
            raise ValueError("only models with the identity normaliser, a mark before the text and byte fallback are read")
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(p.get_piece_size())
        pieces = [None if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) else p.id_to_piece(i) for i in n]
        kind = {1: UNIGRAM, 2: MERGE}[train.model_type]
        return cls(pieces, [p.get_score(i) for i in n], [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], kind)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored pair first, of equal ones the leftmost."""
        part: list[str] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        rank = lambda i, j: (-self.scores[k], i, j, part[i] + part[j]) if j < len(part) and (k := self.ids.get(part[i] + part[j])) is not None else None
        heap = [x for i in range(len(part) - 1) if (x := rank(i, i + 1))]
        heapify(heap)
        while heap:
            _, i, j, both = heappop(heap)
            if not part[i] or j >= len(part) or after[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, "", after[j]
            if after[i] < len(part):
                before[after[i]] = i
                if x := rank(i, after[i]):
                    heappush(heap, x)
            if before[i] >= 0 and (x := rank(before[i], i)):
                heappush(heap, x)
        return [p for p in part if p]

    def _fits(self, before: str, piece: str) -> bool:
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def _last_of_marks(self, n: int) -> int:
        """Where the last piece starts that merging gives for n marks."""
        if n not in self._marks:
            self._marks[n] = n - len(self.merged(MARK * n)[-1])
        return self._marks[n]

    def encode_words(self, words: Iterator[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word and its ids as int32 bytes, by one depth-first pass over the trie of all of them."""
        best = self._best_scores if self.kind == UNIGRAM else self._best_merges
        last, start, piece, score = "", [0], [ROOT], [0.0]
        for w in sorted(words):
            n, shared = min(len(last), len(w)), 0
            while shared < n and last[shared] == w[shared]:
                shared += 1
            del start[shared + 1 :], piece[shared + 1 :], score[shared + 1 :]
            start.extend(range(shared, len(w)))
            piece.extend([UNKNOWN] * (len(w) - shared))
            best(w, shared, start, piece, score)
            parts, end = [], len(w)
            while end:
                k = piece[end]
                if k >= 0:
                    parts.append(k)
                else:
                    parts.extend(self.byte_ids[b] for b in reversed(w[start[end] : end].replace(MARK, WRITTEN).encode()))
                end = start[end]
            parts.reverse()
            last = w
            yield w, array("i", parts).tobytes()

    def _ending(self, w: str, shared: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """(last index, (id, length)) of all pieces in w that end after the shared prefix, among some before."""
        return self._ends.iter(w, max(0, shared + 1 - self.longest)) if self.ids else iter(())

    def _best_merges(self, w: str, shared: int, start: list[int], piece: list[int], score: list[float]) -> None:
        """The forward states of w past the shared prefix: of the pieces that end there, the one that fits its left neighbour."""
        pairs, names, done = self._pairs, self.names, shared - 1
        marks = len(w) - len(w.lstrip(MARK)) if w.startswith(MARK * 2) else 0
        for end in range(shared + 1, marks + 1):
            j = self._last_of_marks(end)
            start[end], piece[end], done = j, self.ids.get(w[j:end], UNKNOWN), end - 1
        for e, (k, n) in self._ending(w, shared):
            if e <= done:
                continue
            j = e + 1 - n
            left = piece[j]
            key = left << 20 | k if left != UNKNOWN else (w[j - 1], k)
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) >= MAX_PAIRS:
                    pairs.clear()
                fits = pairs[key] = self._fits(w[start[j] : j], names[k])
            if fits:
                start[e + 1], piece[e + 1], done = j, k, e

    def _best_scores(self, w: str, shared: int, start: list[int], piece: list[int], score: list[float]) -> None:
        """The forward states of w past the shared prefix: of the paths that end there, the one with the best sum of scores; of equal ones the longest last piece."""
        scores, end = self.scores, shared
        found = (x for x in self._ending(w, shared) if x[0] >= shared)
        x = next(found, None)
        for end in range(shared, len(w)):
            top, at, last = float("-inf"), end, UNKNOWN
            alone = False
            while x is not None and x[0] == end:
                k, n = x[1]
                alone |= n == 1
                if (s := score[end + 1 - n] + scores[k]) > top:
                    top, at, last = s, end + 1 - n, k
                x = next(found, None)
            if not alone and (s := score[end] + self.unknown) > top:
                top, at, last = s, end, UNKNOWN
            score.append(top)
            start[end + 1], piece[end + 1] = at, last

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(WRITTEN, MARK)) if text else []

    def decode(self, numbers: list[int] | np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, without the space put before."""
        raw = b"".join(map(self.raw.__getitem__, numbers.tolist() if isinstance(numbers, np.ndarray) else numbers))
        return raw[1 if raw[:1] == b" " else 0 :].decode(errors="replace")


def encode_texts(model: Model, texts: list[str]) -> Iterator[bytes]:
    """The ids of each text as int32 bytes, by one pass over the trie of all their distinct words."""
    place: defaultdict[str, int] = defaultdict()  # word: its number, in the order of first sight
    place.default_factory = place.__len__
    cut = [array("i", map(place.__getitem__, model.split(t))) if len(t) <= LONG else None for t in texts]
    known: list[bytes] = [b""] * len(place)
    for w, x in model.encode_words(place):
        known[place[w]] = x
    for t, numbers in zip(texts, cut, strict=True):
        yield b"".join(map(known.__getitem__, numbers)) if numbers is not None else _long(model, t)


def _long(model: Model, text: str) -> bytes:
    """The ids of a long text, a run of its words at a time."""
    words, out = (m.group() for m in model.words.finditer(MARK + text.replace(WRITTEN, MARK))), []
    while run := list(islice(words, LONG // 8)):
        known = dict(model.encode_words(set(run)))
        out.append(b"".join(map(known.__getitem__, run)))
    return b"".join(out)


def _sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most `size` bytes of text, or one row."""
    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b.column("_text")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield b.slice(at, end - at)
            at = end


def encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", *, model_path: str = MODEL, carry: tuple[str, ...] | None = None, derive: dict[str, tuple[str, Callable[[Model, str, np.ndarray], object]]] | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """The columns `carry` of df (all, if None) and out_col: array<int> with the ids of the whole text.

    derive: instead of out_col, columns of what is made in the same task from (model, text, ids as an int32 array):
    {name: (type, function)}. slice_bytes: of texts worked off at a time; fewer take less memory and more time.
    Null and empty texts have no ids. Rows are encoded one by one, so null and repeated ids or rows keep their rows.
    A column of df named like an output is replaced. An empty table gives an empty result.
    """
    model = Model.load(model_path)
    made = list((derive or {out_col: ("array<int>", None)}).items())
    columns = [c for c in (df.columns if carry is None else carry) if c not in dict(made)]
    rows = df.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    kinds = [f"_c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(columns))] + [f"_o{i} {kind}" for i, (_, (kind, _)) in enumerate(made)]
    arrow = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, slice_bytes):
            texts = b.column("_text").to_pylist()
            found = encode_texts(model, texts)
            for at in range(0, len(texts), ROWS_OUT):  # few at a time, as ids take several times the space of texts
                part = b.slice(at, ROWS_OUT)
                lists = [np.frombuffer(next(found), dtype=np.int32) for _ in range(part.num_rows)]
                out = [pa.array([f(model, t, ids) if f else ids for t, ids in zip(texts[at : at + ROWS_OUT], lists, strict=True)], arrow[kind]) for _, (kind, f) in made]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *out], names=[*b.schema.names[: len(columns)], *(f"_o{i}" for i in range(len(made)))])

    out = rows.mapInArrow(run, ", ".join(kinds))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)), *(F.col(f"_o{i}").alias(n) for i, (n, _) in enumerate(made)))


def decoded(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", *, model_path: str = MODEL) -> DataFrame:
    """df with the text of its ids. Null ids give a null text; a column named like out_col is replaced."""
    model = Model.load(model_path)

    @F.pandas_udf("string")
    def texts(numbers):  # noqa: ANN001, ANN202
        return numbers.map(lambda x: None if x is None else model.decode(x))

    return df.withColumn(out_col, texts(F.col(ids_col)))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, comma-joined) and text_sha256, of the text decoded from the ids."""
    derive = {
        "n_tokens": ("bigint", lambda model, text, ids: len(ids)),
        "ids_sha256": ("string", lambda model, text, ids: _sha(model.say(ids))),
        "text_sha256": ("string", lambda model, text, ids: _sha(model.decode(ids))),
    }
    return encode(table(spark, folder, "documents"), carry=("doc_id",), derive=derive)


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
