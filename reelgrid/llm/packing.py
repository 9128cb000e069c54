"""Packing token sequences into windows by non-negative least squares.

Each task packs its own documents, a shard of some two million tokens at a time, so
nothing is shuffled and memory is bounded by the shard. A document longer than a
window gives whole windows; what is left of it, and each shorter document, has a
length in units of a fraction of the window. All combinations of at most DEPTH unit
lengths that fill a window are the columns of a non-negative least-squares problem
whose right side is the shard's histogram; its solution, rounded and limited to what
the histogram has, says how often each combination is used. What remains is packed
greedily: the largest piece that fits a window's gap first, then a cut piece if the
gap is worth one, then windows that are filled in order, with cuts. The last window
of a shard goes on into the next one, so that a task pads one window at its end; many
small splits are read by one task, so that a task has PART bytes of text at least on
average.

Defined results: a null or empty text is the end id alone; bytes that are no UTF-8 are
U+FFFD each; repeated rows are packed each on its own, without a row there is no
sequence; a text of any length is cut over as many windows as it fills; other columns
are not read, whatever their names. Sequence ids are the task's number and a count in
it: the same whenever the same split is read again, as after a lost executor.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
#: Unit lengths in a window, and pieces in a combination.
UNITS = 32
DEPTH = 6
#: Tokens that a task plans at once, bytes of text that it encodes at once, and the smallest gap for which a document is cut.
SHARD = 1 << 21
CHUNK = 1 << 20
GAP = 16
#: Bytes of text that a task packs on average, at least.
PART = 8 << 20
#: Stems whose ids a worker keeps twice over: a full table is put behind a new one, to which stems move as they are met again.
CACHE = 100_000
#: Words in whose form normalisation changes nothing but case: a stem of letters, with signs behind it or none; and how many are encoded as one text.
PLAIN = r"^(?P<stem>[a-zß-öø-ÿ]+)(?P<signs>[.,;:!?*#$%&]*)$"
JOINED = 500
SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_loaded: dict[str, WordEncoder] = {}


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def strings(raw: pa.Array) -> pa.Array:
    """Bytes as text; where they are no UTF-8, with U+FFFD in their place."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())


class WordEncoder:
    """Ids of a tokenizers file that never joins characters across ASCII white space, end taken as the id behind each text."""

    def __init__(self, path: str) -> None:
        common.single_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        ids = self.tokenizer.encode_batch(["x y\tz", "x", "y", "z"], add_special_tokens=False)
        if ids[0].ids != [i for x in ids[1:] for i in x.ids]:
            raise ValueError(f"{path}: its ids depend on white space")
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # stems need no normaliser and no search for word boundaries, only the bytes' signs; a check says whether that is so here
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.stems = None
        if suffix and self.folds:
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            bare = Tokenizer.from_file(path)
            bare.normalizer = None
            bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            tried = ["the", "zebra", "größe", "ça", "naïvement", "þórr"]
            if all(self.ids_of(bare, t + s) == self.ids_of(self.tokenizer, t + s) for t in tried for s in ("", " ", " y")) and all(
                self.ids_of(self.tokenizer, t + s) == self.ids_of(bare, t) + self.ids_of(self.tokenizer, s) for t in tried for s in (".", ",;", "!?", "*#$%&:")
            ):
                self.stems = bare
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def ids_of(tokenizer, text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def alone(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, by the tokenizer as it is."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stem_ids(self, stems: list[str]) -> list[bytes]:
        """Ids of distinct stems, many of them in a text, whose ends the vocabulary marks."""
        if len(self.known) + len(stems) > CACHE:
            self.older, self.known = self.known, {}
        out = [self.known.get(s) or self.older.get(s) for s in stems]
        new = [i for i, x in enumerate(out) if x is None]
        groups = [new[at : at + JOINED] for at in range(0, len(new), JOINED)]
        for group, e in zip(groups, self.stems.encode_batch_fast([" ".join([stems[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(group) or at[-1] != len(ids):
                own = self.alone([stems[i] for i in group])
            else:
                raw, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
                own = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for i, x in zip(group, own, strict=True):
                out[i] = x
        self.known.update(zip(stems, out, strict=True))
        return out

    def encode(self, raw: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, end behind each, and where each text's ids stop.

        A text's words are told apart and looked up in Arrow; Python sees distinct stems only.
        """
        text = strings(raw)
        if self.folds:  # lower case, unless a control string is spelt by that or the text has one
            low = pc.ascii_lower(text)
            held = [pc.match_substring(low, s, ignore_case=True) for s in self.special]
            for h in held:
                low = pc.if_else(h, text, low)
            text = low
        cut = pc.ascii_split_whitespace(text)
        found = cut.flatten().dictionary_encode()
        words, of = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
        if self.stems is None:
            first = np.arange(len(words))
            pool, second = self.alone(words.to_pylist()), None
        else:
            parts = pc.extract_regex(words, PLAIN)
            plain = parts.is_valid().to_numpy(zero_copy_only=False)
            stems, signs = (parts.field(k).filter(parts.is_valid()).dictionary_encode() for k in (0, 1))
            pool = self.stem_ids(stems.dictionary.to_pylist())
            tails = [b"" if not s else x for s, x in zip(signs.dictionary.to_pylist(), self.alone(signs.dictionary.to_pylist()), strict=True)]
            others = words.filter(pa.array(~plain)).to_pylist()
            first, second = np.zeros(len(words), np.int64), np.full(len(words), len(pool) + len(tails))
            first[plain] = stems.indices.to_numpy(zero_copy_only=False)
            second[plain] = len(pool) + signs.indices.to_numpy(zero_copy_only=False)
            first[~plain] = len(pool) + len(tails) + 1 + np.arange(len(others))
            pool = [*pool, *tails, b"", *self.alone(others)]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(pool), "<u4")
        if second is not None:  # the ids of a stem and of the signs behind it
            both = np.stack([first, second], 1).ravel()
            flat = gathered(flat, starts[both], sizes[both])
            sizes = sizes[first] + sizes[second]
            starts = np.cumsum(sizes) - sizes
            first = np.arange(len(words))
        n = sizes[first][of] if len(words) else np.zeros(0, np.int64)
        ids = gathered(flat, starts[first][of], n) if len(words) else np.zeros(0, "<u4")
        stop = np.concatenate([[0], np.cumsum(n)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()][1:]
        return np.insert(ids, stop, end), stop + np.arange(1, len(stop) + 1)


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


@cache
def combinations(units: int, depth: int) -> np.ndarray:
    """All multisets of at most depth unit lengths with the sum units, one a row, descending, zero where shorter."""

    def parts(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield (0,) * left
        elif left * most >= rest:
            for first in range(min(rest, most), 0, -1):
                for more in parts(rest - first, first, left - 1):
                    yield (first, *more)

    return np.array(list(parts(units, units, depth)))


@cache
def matrix(units: int, depth: int) -> tuple[np.ndarray, float]:
    """How often each length (row) is in each combination (column), and the largest eigenvalue of its square."""
    rows = combinations(units, depth)
    a = np.zeros((units + 1, len(rows)))
    for c in range(depth):
        np.add.at(a, (rows[:, c], np.arange(len(rows))), 1)
    a = a[1:]
    return a, float(np.linalg.norm(a, 2) ** 2)


def repeat_counts(histogram: np.ndarray, units: int = UNITS, depth: int = DEPTH, steps: int = 300) -> np.ndarray:
    """Non-negative x that brings matrix @ x close to the histogram, by accelerated projected gradients."""
    a, most = matrix(units, depth)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - a.T @ (a @ y - histogram) / most)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


Item = tuple[int, int, int]


def combined(bins: dict[int, list[Item]]) -> list[list[Item]]:
    """Windows by the solution's combinations, most used first; their items leave the bins."""
    x = repeat_counts(np.array([len(bins.get(b, ())) for b in range(1, UNITS + 1)], float))
    rows = combinations(UNITS, DEPTH)
    windows: list[list[Item]] = []
    for p in np.argsort(-x, kind="stable"):
        if (n := int(x[p] + 0.5)) < 1:
            break
        need: dict[int, int] = defaultdict(int)
        for b in rows[p][rows[p] > 0].tolist():
            need[b] += 1
        n = min(n, *(len(bins.get(b, ())) // k for b, k in need.items()))
        windows += [[bins[b].pop() for b, k in need.items() for _ in range(k)] for _ in range(n)]
    return windows


def plan(items: list[Item], window: int, last: bool) -> tuple[list[list[Item]], list[Item]]:
    """Windows of (document, start, length) for items shorter than a window, and the items left for the next shard (none if last)."""
    unit = window // UNITS
    bins: dict[int, list[Item]] = defaultdict(list)
    for x in items:
        bins[-(-x[2] // unit)].append(x)
    windows = combined(bins)
    left = {b: v for b, v in bins.items() if v}

    def largest(room: int) -> Item | None:
        """The first piece of the largest unit length that surely fits, or of the next one if it does."""
        for b in range(min(UNITS, room // unit + 1), 0, -1):
            if (have := left.get(b)) and have[-1][2] <= room:
                found = have.pop()
                if not have:
                    del left[b]
                return found
        return None

    for w in windows:
        room = window - sum(x[2] for x in w)
        while room and (x := largest(room)):
            w.append(x)
            room -= x[2]
        if room >= GAP and left:
            b = max(left)
            doc, start, n = left[b].pop()
            if not left[b]:
                del left[b]
            w.append((doc, start, room))
            left.setdefault(-(-(n - room) // unit), []).append((doc, start + room, n - room))
    current: list[Item] = []
    room = window
    for b in sorted(left, reverse=True):
        for doc, start, n in left[b]:
            while n >= room:
                windows.append([*current, (doc, start, room)])
                doc, start, n, current, room = doc, start + room, n - room, [], window
            if n:
                current.append((doc, start, n))
                room -= n
    if last and current:
        windows.append(current)
        current = []
    return windows, current


def pieces(windows: list[list[Item]], first: int, ids: dict[int, np.ndarray], names: dict[int, object], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The windows, numbered from first, a row for each piece."""
    for at in range(0, len(windows), 512):
        flat = [(d, s, n, first + at + k, o) for k, w in enumerate(windows[at : at + 512]) for (d, s, n), o in zip(w, np.cumsum([0] + [x[2] for x in w]).tolist(), strict=False)]
        docs, starts, sizes, sequence, offset = zip(*flat, strict=True)
        data = np.concatenate([ids[d][s : s + n] for d, s, n, *_ in flat]).astype("<u4", copy=False)
        stops = np.concatenate([[0], 4 * np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[d] for d in docs], kind), *(pa.array(x, pa.int64()) for x in (starts, sizes, [len(ids[d]) for d in docs], sequence, offset)),
                pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(stops), pa.py_buffer(data)]),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(docs: DataFrame, path: str, end: int, window: int = WINDOW, shard: int = SHARD, part: int = PART) -> DataFrame:
    """doc_id and, for each piece of a document, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", common.utf8(F.col("text")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()  # what the worker's last task has left
        own, context = encoder(path), TaskContext.get()
        made = (context.partitionId() if context else 0) << 32
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        items: list[Item] = []
        whole: list[list[Item]] = []
        held = count = 0
        kind = pa.int64()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal items, whole, ids, names, held, made
            windows, items = plan(items, window, last)
            windows = whole + windows
            yield from pieces(windows, made, ids, names, kind)
            made += len(windows)
            ids = {d: ids[d].copy() for d, *_ in items}
            names = {d: names[d] for d in ids}
            whole, held = [], sum(x[2] for x in items)
            common.give_back()

        for t in common.tables(batches, CHUNK):
            kind = t.schema.field("doc_id").type
            found, stops = own.encode(t.column("text").combine_chunks(), end)
            begin = 0
            for name, stop in zip(t.column("doc_id").to_pylist(), stops.tolist(), strict=True):
                ids[count], names[count], n = found[begin:stop], name, stop - begin
                begin = stop
                whole += [[(count, at, window)] for at in range(0, n - window + 1, window)]
                if n % window:
                    items.append((count, n - n % window, n % window))
                held += n
                count += 1
                if held >= shard:
                    yield from flush(False)
        if count:
            yield from flush(True)

    return common.gathered_splits(rows, part).mapInArrow(run, schema)


def report(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    found = pack(docs, path, end)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
