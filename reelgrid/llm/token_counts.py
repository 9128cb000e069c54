"""Exact token counts at every prefix, by dynamic programming.

A piece of the vocabulary never holds a space mark after another character, so no
merge crosses the place between a character and the space run that follows it. A
text is then a chain of segments (a space run with the word behind it), each of
which is encoded on its own, and

    count(prefix up to segment i) = count(prefix up to segment i - 1) + tokens(segment i)

is exact at every segment's end. Inside a segment the count at every character comes
from a second recurrence: a prefix ends with one piece only, and that is the one piece
t for which the piece u that ends the prefix before it and t stay apart when u + t is
merged on its own; so count(prefix) = count(prefix without t) + 1. Both tables are kept,
bounded, for each worker: a cut or a budget is answered by look-ups, and no text is
encoded again.

Defined results: null and empty texts have 0 tokens; control strings inside a text
are ordinary text, as the library's default has it; bytes that are no UTF-8 are U+FFFD
each; nothing is truncated, however long a text is; repeated rows are counted each,
and other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Segments whose counts a worker keeps, pairs of pieces whose merging it knows, and characters of segments whose inner counts it keeps; beyond that each table starts anew.
CACHE = 300_000
PAIRS = 1_000_000
INNER = 4_000_000
SPACE = "▁"
_loaded: dict[str, PrefixCounter] = {}


class PrefixCounter:
    """Token counts of one sentencepiece model that merges characters as they are."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        # what merging can make, and how early it makes it
        kept = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in kept}
        self.longest = max(map(len, self.scores))
        if any(SPACE in x.lstrip(SPACE) for x in self.scores) or m.encode("a  b", out_type=str)[1][:1] != SPACE or m.normalize("ﬁ①é\t") != SPACE + "ﬁ①é\t":
            raise ValueError(f"{path}: its pieces cross the segments' boundaries, or characters change")
        self.counts: dict[str, int] = {}
        self.inner: dict[str, np.ndarray] = {}
        self.inner_held = 0
        self.apart: dict[tuple[str, str], bool] = {}
        # what the model's dummy prefix adds to a text's first segment is a leading space
        self.segment = re.compile(r"[ ▁]*[^ ▁]+|[ ▁]+\Z")

    def segments(self, text: str) -> list[str]:
        """Of the text with the dummy prefix, each with its leading space run."""
        return self.segment.findall(f" {text}") if text else []

    def _learn(self, segments: list[str]) -> None:
        # the dummy prefix stands for the first space of a segment
        for s, ids in zip(segments, self.model.encode([s[1:] for s in segments], num_threads=1), strict=True):
            self.counts[s] = len(ids) if len(s) > 1 else 1  # a lone space is one piece

    def table(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the exact token count at each segment's end."""
        cut = [self.segments(t) for t in texts]
        missing = {s for x in cut for s in x}.difference(self.counts)
        if len(self.counts) + len(missing) > CACHE:
            self.counts.clear()
            missing = {s for x in cut for s in x}
        if missing:
            self._learn(list(missing))
        get = self.counts.__getitem__
        return [np.cumsum(np.fromiter(map(get, x), np.int64, len(x))) for x in cut]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the pair that makes the best piece is joined, the leftmost of equals, until none makes any."""
        parts = list(text)
        while True:
            made = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not made:
                return parts
            i = min(made)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stay_apart(self, u: str, t: str) -> bool:
        found = self.apart.get((u, t))
        if found is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            found = self.apart[u, t] = self.merged(u + t) == [u, t]
        return found

    def within(self, segment: str) -> np.ndarray:
        """The token count at each of the segment's prefixes, 0 for the empty one first."""
        if (found := self.inner.get(segment)) is not None:
            return found
        x = segment.replace(" ", SPACE)
        n = np.zeros(len(x) + 1, np.int64)
        last = [""] * (len(x) + 1)
        for i in range(1, len(x) + 1):
            for k in range(min(i, self.longest), 0, -1):
                t = x[i - k : i]
                if (k == 1 or t in self.scores) and (self.stay_apart(last[i - k], t) if i > k else self.merged(t) == [t]):
                    # a character that the vocabulary lacks is spelt in bytes
                    n[i], last[i] = n[i - k] + (1 if t in self.scores else len(t.encode("utf-8", "surrogatepass"))), t
                    break
        if self.inner_held + len(n) > INNER:
            self.inner.clear()
            self.inner_held = 0
        self.inner[segment] = n
        self.inner_held += len(n)
        return n

    def count(self, texts: list[str]) -> list[int]:
        return [int(x[-1]) if len(x) else 0 for x in self.table(texts)]

    def prefixes(self, text: str) -> np.ndarray:
        """The token count at each of the text's prefixes: of its first 0, 1, ... characters."""
        cut = self.segments(text)
        if not cut:
            return np.zeros(1, np.int64)
        before = np.r_[0, self.table([text])[0]]
        inner = [self.within(s) for s in cut]
        whole = np.concatenate([inner[0][:1], *(x[1:] + b for x, b in zip(inner, before, strict=False))])
        return np.r_[0, whole[2:]]  # without the dummy prefix

    def at(self, text: str, n_chars: int) -> int:
        """Tokens of the text's first n_chars characters: the sum before the segment that is cut, and that segment's own table."""
        if n_chars <= 0 or not text:
            return 0
        cut = self.segments(text)
        ends = np.cumsum([len(s) for s in cut])
        place = min(n_chars + 1, int(ends[-1]))
        k = int(np.searchsorted(ends, place))
        before = int(self.table([text])[0][k - 1]) if k else 0
        return before + int(self.within(cut[k])[place - (int(ends[k - 1]) if k else 0)])

    def fitting(self, text: str, budget: int, ends: np.ndarray) -> int:
        """Characters of the longest prefix with at most budget tokens; ends is the text's own table."""
        if not len(ends) or ends[-1] <= budget:
            return len(text)
        # the last segment that has a token of its own within the budget is cut
        k = int(np.searchsorted(ends, budget, side="left"))
        cut = self.segments(text)
        if k < len(ends) and ends[k] == budget:
            k += 1  # counts never fall from one segment's end to the next, and what follows has a token at least
        k = min(k, len(cut) - 1)
        before = int(ends[k - 1]) if k else 0
        fits = np.flatnonzero(self.within(cut[k]) + before <= budget)
        return max(0, sum(map(len, cut[:k])) + int(fits[-1] if len(fits) else 0) - 1)

    def truncated(self, text: str, budget: int) -> str:
        """The longest prefix with at most budget tokens."""
        return text[: self.fitting(text, budget, self.table([text])[0])]


def counter(path: str) -> PrefixCounter:
    if path not in _loaded:
        common.single_thread()
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_fit (characters of the longest prefix within limit) of each row."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            raw = b.column("text").to_pylist()
            texts = [x.decode(errors="replace") for x in raw]
            ends = own.table(texts)
            n = [int(e[-1]) if len(e) else 0 for e in ends]
            fit = [own.fitting(x, limit, e) for x, e in zip(texts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_fit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", common.utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_fit long")
