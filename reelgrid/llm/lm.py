"""Text scores by a log-bilinear neural language model of two levels.

Words are lower-cased (A-Z) runs of other than ASCII white space; a text ends with
an end token. The first level predicts one of K classes from the two before it: the
end, the most frequent words, and RARE groups of all other words by their last two
bytes.

    score(class | c1, c2) = (R[c1] A1 + R[c2] A2) . Q[class] + b[class]

The second level predicts the word inside a group from the class before it, over the
group's words among the DICTIONARY most frequent ones:

    p(w | group, c1) = (n[w] + 0.1) exp(R2[c1] . Q2[w]) / Z[c1, group]

so that the words with a vector of their own grow with the corpus until DICTIONARY,
and a word beyond it has the group's remaining mass by its count (0 if training never
saw it). Both are trained by noise-contrastive estimation in numpy, the second with
noise from the same group: each task runs over all words of its own training texts from
the same start, and parameters are averaged by how often each was met. Small splits are
read by one task, so that a task has PART bytes of text at least on average. Since
scores add up over contexts, one product of two K x K matrices gives the first level's
normaliser of every pair of contexts, and one product for each group the second's, so
probabilities are exact and scoring a token takes a few look-ups.

Word counts are over all training texts. The DICTIONARY most frequent words go to the
tasks with their counts (a fixed bound); the few words of a text beyond those are
joined with the counts by a shuffle, so that no frequent word is a join key.

Defined results: a null text is empty, which is the end token alone; without training
texts every word is unseen, the base score is log10(0.1 / 0.1) = 0 for each token and
all classes are equally likely. Repeated rows are scored each; an empty table gives no
rows; a text of any length is scored whole; bytes that are no UTF-8 are bytes of a word;
other columns are not read, whatever their names. Parameters are averaged over the
splits of the input: other splits give slightly other scores.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FREQUENT, RARE = 768, 256  # the end is the first of the frequent
K = FREQUENT + RARE
WIDTH = 24
NOISE = 32
#: Width of the second level, and its noise words for each word.
WIDTH2 = 8
NOISE2 = 2
BATCH = 4096
BATCH2 = 16384
RATE = 0.1
RATE2 = 0.3
DICTIONARY = 1 << 17
SMOOTH = 0.1
END = b""
#: Bytes of text that a task learns from on average, at least, and those whose words it tells apart at once.
PART = 8 << 20
CHUNK = 8 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Rows of parameters that are averaged together.
BLOCK = 1024


def group(word: bytes) -> int:
    """Class of a word that is not among the frequent."""
    return FREQUENT + zlib.crc32(word[-2:]) % RARE


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class LogBilinear:
    """Parameters of the first level with their squared-gradient sums."""

    def __init__(self, unigram: np.ndarray, seed: int = 1) -> None:
        random = np.random.default_rng(seed)
        small = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        self.unigram = unigram
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.values = [small(K, WIDTH), small(K, WIDTH), np.eye(WIDTH, dtype=np.float32), 0.5 * np.eye(WIDTH, dtype=np.float32), np.log(unigram).astype(np.float32)]
        self.squares = [np.full(v.shape, 1e-6, np.float32) for v in self.values]
        self.random = np.random.default_rng(seed + 1)

    def step(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        """One noise-contrastive step on a batch of words with their contexts."""
        r, q, a1, a2, b = self.values
        noise = self.random.choice(K, NOISE, p=self.unigram)
        r1, r2, qw, qn = r[c1], r[c2], q[w], q[noise]
        context = r1 @ a1 + r2 @ a2
        real = logistic((context * qw).sum(1) + b[w] - self.log_noise[w]) - 1
        false = logistic(context @ qn.T + b[noise] - self.log_noise[noise])
        d_context = real[:, None] * qw + false @ qn
        g_q = summed(w, real[:, None] * context, K)
        np.add.at(g_q, noise, false.T @ context)
        g_b = np.bincount(w, real, K).astype(np.float32)
        np.add.at(g_b, noise, false.sum(0))
        g_r = summed(c1, d_context @ a1.T, K)
        g_r += summed(c2, d_context @ a2.T, K)
        for v, s, g in zip(self.values, self.squares, (g_r, g_q, r1.T @ d_context, r2.T @ d_context, g_b), strict=True):
            g /= len(w)
            s += g * g
            v -= RATE * g / np.sqrt(s)


class Words:
    """Parameters of the second level: vectors of contexts and of the dictionary's words, and how often each word was met."""

    def __init__(self, n: np.ndarray, classes: np.ndarray, totals: np.ndarray, seed: int = 3) -> None:
        random = self.random = np.random.default_rng(seed)
        self.r = random.normal(0, 0.1, (K, WIDTH2)).astype(np.float32)
        self.q = random.normal(0, 0.1, (len(n), WIDTH2)).astype(np.float32)
        self.r_squares, self.q_squares = (np.full(v.shape, 1e-6, np.float32) for v in (self.r, self.q))
        self.met = np.zeros(len(n), np.int64)
        # noise: the words by group, so that a point of a group's mass names one of them or, beyond the dictionary, one of the next group's
        self.order = np.argsort(classes, kind="stable")
        self.classes = np.r_[classes[self.order], K]
        self.mass = np.cumsum((n + SMOOTH)[self.order])
        self.low = np.r_[0.0, self.mass][np.searchsorted(self.classes[:-1], np.arange(K))]
        self.totals = totals

    def step(self, c1: np.ndarray, w: np.ndarray, of: np.ndarray) -> None:
        """One noise-contrastive step on words (places in the dictionary) of groups."""
        groups, contexts = np.tile(of, NOISE2), np.tile(c1, NOISE2 + 1)
        at = np.searchsorted(self.mass, self.low[groups] + self.random.random(len(groups)) * self.totals[groups], side="right")
        words = np.concatenate([w, self.order[np.minimum(at, len(self.order) - 1)]])
        rows, vectors = self.r[contexts], self.q[words]
        d = logistic((rows * vectors).sum(1) - np.float32(np.log(NOISE2)))
        d[: len(w)] -= 1
        d[len(w) :] *= self.classes[at] == groups
        self.met += np.bincount(w, minlength=len(self.met))
        adjust(self.r, self.r_squares, contexts, d[:, None] * vectors)
        adjust(self.q, self.q_squares, words, d[:, None] * rows)


def adjust(values: np.ndarray, squares: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """A step against the sums of rows by their index, where there are some."""
    some = np.flatnonzero(np.bincount(at, minlength=len(values)))
    g = np.stack([np.bincount(at, rows[:, k], len(values))[some] for k in range(rows.shape[1])], 1).astype(np.float32)
    s = squares[some] + g * g
    squares[some] = s
    values[some] -= RATE2 * g / np.sqrt(s)


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their index."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    by = at[order]
    starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
    out[by[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


@dataclass
class Tokens:
    """The tokens of some texts, one text after the other, each with its end."""

    words: list[bytes]  # distinct ones
    code: np.ndarray  # of each token among them
    text: np.ndarray  # number of each token's text
    place: np.ndarray  # of each distinct word in the dictionary, -1: none
    kind: np.ndarray  # class of each distinct word

    def contexts(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes one and two before each token; ends before a text."""
        before = []
        for k in (1, 2):
            x = np.zeros(len(of), of.dtype)
            if len(of) > k:
                x[k:] = np.where(self.text[k:] == self.text[:-k], of[:-k], 0)
            before.append(x)
        return before[0], before[1]


def split(raw: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts (bytes), and for each of their words its place among those and its text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(raw.view(pa.string())))
    found = cut.flatten().dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(raw)), np.diff(cut.offsets.to_numpy()))
    blank = pc.index(found.dictionary, "").as_py()  # before and behind a text's white space
    if blank >= 0:
        own = code != blank
        code, text = code[own], text[own]
    return found.dictionary.view(pa.binary()), code, text


@dataclass
class Scorer:
    """What a task needs to score texts; of bounded size."""

    words: list[bytes]
    n: np.ndarray  # of words
    first: list[bytes]  # the frequent, the end first
    total: int
    distinct: int
    totals: np.ndarray  # smoothed count of each class, all its words and an unseen one together
    left: np.ndarray | None = None  # (c1, class) scores with the bias
    right: np.ndarray | None = None  # (c2, class) scores
    log_z: np.ndarray | None = None  # (c1, c2)
    r2: np.ndarray | None = None
    q2: np.ndarray | None = None
    log_z2: np.ndarray | None = None  # (c1, class), log10; 0 for the frequent
    unigram: np.ndarray | None = None  # of classes
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def prepare(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Places of words, their classes, and log10 of their smoothed counts."""
        if _ready.get("name") != self.name:
            frequent = {w: i for i, w in enumerate(self.first)}
            classes = np.array([frequent[w] if w in frequent else group(w) for w in self.words], np.int32)
            _ready.update(name=self.name, at={w: i for i, w in enumerate(self.words)}, classes=classes, logs=np.log10(self.n + SMOOTH))
        return _ready["at"], _ready["classes"], _ready["logs"]

    def tokens(self, raw: pa.Array) -> Tokens:
        at, classes, _ = self.prepare()
        words, code, text = split(raw)
        words = [*words.to_pylist(), END]
        ends = np.searchsorted(text, np.arange(len(raw)), side="right")
        code, text = np.insert(code, ends, len(words) - 1), np.insert(text, ends, np.arange(len(raw)))
        place = np.fromiter((at.get(w, -1) for w in words), np.int64, len(words))
        kind = classes[place] if len(classes) else np.zeros(len(place), np.int32)
        for i in np.flatnonzero(place < 0):
            kind[i] = group(words[i]) if words[i] else 0
        return Tokens(words, code, text, place, kind)

    def set_model(self, values: list[np.ndarray], r2: np.ndarray, q2: np.ndarray) -> None:
        r, q, a1, a2, b = values
        self.left, self.right = (r @ a1) @ q.T + b, (r @ a2) @ q.T
        top_l, top_r = self.left.max(1, keepdims=True), self.right.max(1, keepdims=True)
        z = np.exp(self.left - top_l, dtype=np.float64) @ np.exp(self.right - top_r, dtype=np.float64).T
        self.log_z = (np.log(z) + top_l + top_r.T).astype(np.float32)
        self.r2, self.q2 = r2, q2
        _, classes, _ = self.prepare()
        z2 = np.ones((K, K))
        for g in range(FREQUENT, K):
            own = np.flatnonzero(classes == g)
            n = self.n[own] + SMOOTH
            z2[:, g] = np.exp(r2 @ q2[own].T, dtype=np.float64) @ n + max(0.0, self.totals[g] - n.sum())
        self.log_z2 = np.log10(z2).astype(np.float32)

    def class_logs(self, c2: np.ndarray, c1: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's class."""
        return self.left[c1, of].astype(float) + self.right[c2, of] - self.log_z[c1, c2]

    def word_logs(self, c1: np.ndarray, place: np.ndarray, of: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """log10 of each token's probability inside its class; without the count of a word beyond the dictionary."""
        out = -self.log_z2[c1, of].astype(float)
        own = np.flatnonzero((of >= FREQUENT) & (place >= 0))
        if len(own):
            at = place[own]
            out[own] += logs[at] + (self.r2[c1[own]] * self.q2[at]).sum(1) / np.log(10)
        return out


_ready: dict = {}


def count_words(train: DataFrame) -> DataFrame:
    """word, n over all texts of train, with the end token as the empty word; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        texts = 0

        def out() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks()

        for raw in common.chunks(batches, CHUNK):
            words, code, _ = split(raw)
            held.append(pa.table({"word": words, "n": np.bincount(code, minlength=len(words))}).filter(pc.not_equal(pc.binary_length(words), 0)))
            texts += len(raw)
            if sum(t.num_rows for t in held) > HELD:
                held = [out()]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([texts], pa.int64())}))
        yield from out().to_batches()

    counted = train.select(common.utf8(F.col("text")).alias("text")).mapInArrow(run, "word binary, n long")
    return common.written(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "words")


def vocabulary(words: DataFrame) -> Scorer:
    """A scorer without a model from word counts."""
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = {bytes(r[0]): r[1] for r in words.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(FREQUENT - 1).collect()}
    first = [END, *top]
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True)  # 8 rows for each doubling
    least, seen = None, 0
    for at, k in sizes:
        seen += k
        if seen > DICTIONARY:
            break
        least = at
    top |= {bytes(r[0]): r[1] for r in words.filter((level >= least if least is not None else F.lit(False)) | (F.length("word") == 0)).collect()}
    known = sorted(top.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds, frequent = np.zeros(K, np.int64), np.zeros(K, np.int64), {w: i for i, w in enumerate(first)}
        for b in batches:
            of = np.array([frequent[w] if w in frequent else group(w) for w in b.column("word").to_pylist()], np.int64)
            sums += np.bincount(of, b.column("n").to_numpy(), K).astype(np.int64)
            kinds += np.bincount(of, minlength=K)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(K)), pa.array(sums), pa.array(kinds)], names=["class", "n", "kinds"])

    made = words.mapInArrow(run, "class long, n long, kinds long").groupBy("class").agg(F.sum("n"), F.sum("kinds")).collect()  # K rows
    sums, kinds = np.zeros(K), np.zeros(K)
    for c, n, k in made:
        sums[c], kinds[c] = n, k
    totals = sums + SMOOTH * (kinds + 1)
    return Scorer([w for w, _ in known], np.array([n for _, n in known], float), first, total, distinct, totals, unigram=(sums + 1) / (sums + 1).sum())


def parameters(model: LogBilinear, words: Words) -> np.ndarray:
    """All parameters as rows of WIDTH2; those of the dictionary's words come last."""
    flat = np.concatenate([v.ravel() for v in (*model.values, words.r)])
    head = np.pad(flat, (0, -len(flat) % WIDTH2)).reshape(-1, WIDTH2)
    return np.concatenate([head, words.q])


def train_model(train: DataFrame, scorer: Scorer) -> None:
    """Fit both levels on all texts of train and set them on the scorer."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(scorer)
    _, classes, _ = scorer.prepare()
    start, start2 = LogBilinear(scorer.unigram), Words(scorer.n, classes, scorer.totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        _, classes, _ = own.prepare()
        model, words = LogBilinear(own.unigram), Words(own.n, classes, own.totals)
        held: list[list[np.ndarray]] = []
        held2: list[list[np.ndarray]] = []
        seen = 0

        def learn(parts: list[list[np.ndarray]], size: int, step, last: bool) -> list[list[np.ndarray]]:
            """Steps over all whole batches of what is held, in random order, and the rest if it is the last."""
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            n = len(columns[0])
            order = np.random.default_rng(seen).permutation(n)
            columns = [x[order] for x in columns]
            whole = n if last else n - n % size
            for at in range(0, whole, size):
                step(*(x[at : at + size] for x in columns))
            return [[x[whole:] for x in columns]]

        for raw in common.chunks(batches, CHUNK):
            t = own.tokens(raw)
            of = t.kind[t.code]
            c1, c2 = t.contexts(of)
            place = t.place[t.code]
            held.append([c2, c1, of])
            rare = np.flatnonzero((of >= FREQUENT) & (place >= 0))
            held2.append([c1[rare], place[rare], of[rare]])
            seen += len(of)
            held, held2 = learn(held, BATCH, model.step, False), learn(held2, BATCH2, words.step, False)
        if seen:
            learn(held, BATCH, model.step, True)
            learn(held2, BATCH2, words.step, True)
            rows = parameters(model, words)
            times = np.r_[np.full(len(rows) - len(words.met), seen), words.met]
            for at in range(0, len(rows), BLOCK):
                met = np.flatnonzero(times[at : at + BLOCK]).astype("<i4")
                values = rows[at : at + BLOCK][met].astype("<f4").tobytes()
                yield pa.RecordBatch.from_pydict({"block": [at // BLOCK], "at": [met.tobytes()], "x": [values], "n": [times[at : at + BLOCK][met].astype("<i8").tobytes()]})

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, at, x, n in zip(*(b.column(c).to_pylist() for c in ("block", "at", "x", "n")), strict=True):
                total, times = sums.setdefault(block, (np.zeros((BLOCK, WIDTH2)), np.zeros(BLOCK)))
                at, n = np.frombuffer(at, "<i4"), np.frombuffer(n, "<i8")
                total[at] += np.frombuffer(x, "<f4").reshape(-1, WIDTH2) * n[:, None]
                times[at] += n
        for block, (total, times) in sums.items():
            met = np.flatnonzero(times).astype("<i4")
            yield pa.RecordBatch.from_pydict({"block": [block], "at": [met.tobytes()], "x": [(total[met] / times[met, None]).astype("<f4").tobytes()]})

    texts = common.gathered_splits(train.select(common.utf8(F.col("text")).alias("text")), PART)
    found = texts.mapInArrow(run, "block long, at binary, x binary, n binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = found.repartition(min(parts, 64), "block").mapInArrow(average, "block long, at binary, x binary").collect()  # one for each block
    # a word that training met with no context keeps no vector: its count alone tells
    flat = parameters(start, start2)
    flat[len(flat) - len(scorer.words) :] = 0
    for block, at, x in rows:
        flat[BLOCK * block + np.frombuffer(at, "<i4")] = np.frombuffer(x, "<f4").reshape(-1, WIDTH2)
    head, q2 = flat[: len(flat) - len(scorer.words)].ravel(), flat[len(flat) - len(scorer.words) :]
    values, at = [], 0
    for v in (*start.values, start2.r):
        values.append(head[at : at + v.size].reshape(v.shape))
        at += v.size
    scorer.set_model(values[:-1], values[-1], q2)


def fit(docs: DataFrame, held_out: Column) -> tuple[Scorer, DataFrame]:
    """A scorer from the rows of docs that are not held out, and the counts of all their words."""
    common.bounded_batches(docs.sparkSession)
    train = docs.filter(~held_out)
    words = count_words(train)
    scorer = vocabulary(words)
    train_model(train, scorer)
    return scorer, words


def score(docs: DataFrame, scorer: Scorer, words: DataFrame, kept: list[str]) -> DataFrame:
    """The columns in kept with n_tokens, n_known, base_score and score (log10) of each row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *kept, common.utf8(F.col("text")).alias("text"))
    fields = [f for f in rows.schema.fields if f.name in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        _, _, logs = own.prepare()
        for b in common.tables(batches, CHUNK):
            b = b.combine_chunks().to_batches()[0]
            t = own.tokens(b.column("text"))
            texts = b.num_rows
            place, of = t.place[t.code], t.kind[t.code]
            c1, c2 = t.contexts(of)
            have = place >= 0
            tokens, known = np.bincount(t.text, minlength=texts), np.bincount(t.text[have], minlength=texts)
            counts = np.bincount(t.text[have], logs[place[have]], texts) if len(logs) else np.zeros(texts)
            model = np.bincount(t.text, own.class_logs(c2, c1, of) / np.log(10) + own.word_logs(c1, place, of, logs), texts)
            # words beyond the dictionary, how often each text has them
            pair, times = np.unique(t.text[~have] * np.int64(len(t.words)) + t.code[~have], return_counts=True)
            ids = b.column("_row")
            n = texts + len(pair)
            pad = lambda x: pa.concat_arrays([x, pa.nulls(n - texts, x.type)])
            columns = [
                pa.concat_arrays([ids, ids.take(pa.array(pair // len(t.words)))]),
                # a word has no space: the row's own entry meets no word and no other row
                pa.array([b" %d" % i for i in ids.to_pylist()] + [t.words[i] for i in (pair % len(t.words)).tolist()], pa.binary()),
                pa.array(np.r_[np.zeros(texts, np.int64), times]),
                pad(pa.array(tokens)), pad(pa.array(known)), pad(pa.array(counts)), pad(pa.array(model)),
                *(pad(b.column(f.name)) for f in fields),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "word", "_times", "n_tokens", "n_known", "_counts", "_model", *(f.name for f in fields)])

    head = "_row long, word binary, _times long, n_tokens long, n_known long, _counts double, _model double"
    found = rows.mapInArrow(run, f"{head}, {schema}" if schema else head).join(words.withColumnRenamed("n", "_n"), "word", "left")
    rare = F.col("_times") * F.log10(F.coalesce("_n", F.lit(0)) + SMOOTH)
    is_known = F.when(F.col("_n") > 0, F.col("_times")).otherwise(0)
    sums = found.groupBy("_row").agg(
        *[F.max(c).alias(c) for c in (*(f.name for f in fields), "n_tokens", "n_known", "_counts", "_model")], F.sum(rare).alias("_rare"), F.sum(is_known).alias("_found")
    )
    each = float(np.log10(scorer.total + SMOOTH * (scorer.distinct + 1)))
    return sums.select(
        *kept, "n_tokens", (F.col("n_known") + F.col("_found")).alias("n_known"),
        (F.col("_counts") + F.col("_rare") - F.col("n_tokens") * each).alias("base_score"), (F.col("_model") + F.col("_rare")).alias("score"),
    )


def remainder(n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def report(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", (remainder(10) == 0).alias("held_out"), "text")
    scorer, words = fit(rows, F.col("held_out"))
    found = score(rows, scorer, words, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(scorer.total).cast("long").alias("train_tokens"), "base_score", "score")
