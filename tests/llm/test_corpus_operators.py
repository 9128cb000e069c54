"""Each operator against a brute-force version, on rows with nulls, ties, repeats, odd and long texts, and on no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reelgrid.llm import chat, common, exact_dedup, language_id, lm, mixing, packing, quality, simhash, suffix_dedup, token_counts
from reelgrid.llm.queries import vocabulary


def key(x):
    return (x is None, x if x is not None else 0)


# mixing


def test_mix_meets_targets_and_spares_documents(spark, odd_docs, odd_rows):
    out = mixing.report(odd_docs, block=64).collect()
    assert len(out) == len(odd_rows)
    size = Counter()
    for _, t, _, s in odd_rows:
        size[s] += len((t or "").encode().split())
    order = sorted((s for s in size if s is not None)) + [None]
    wanted = dict(zip(order, mixing.targets([size[s] for s in order], (3, 1, 2), mixing.Fraction(3, 2), 2), strict=True))
    assert sum(wanted.values()) == mixing.Fraction(3, 2) * sum(size.values())
    assert all(t <= 2 * size[s] for s, t in wanted.items())
    taken = Counter()
    for r in out:
        assert r.taken <= 2 * r.size
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for s in order:
        assert abs(taken[(size[s], round(float(wanted[s]), 6))] - wanted[s]) <= 1


def test_mix_agrees_on_reruns_and_partitions(odd_docs):
    one = sorted(map(tuple, mixing.report(odd_docs, block=64).collect()), key=str)
    two = sorted(map(tuple, mixing.report(odd_docs.repartition(5), block=64).collect()), key=str)
    assert one == two


def brute_mix(spark, rows, seed=42):
    """Targets and taken words by hand: water filling over float weights, and each source's tape as a list in the order of its hashes."""
    size, order = Counter(), []
    for d, t, _, s in rows:
        size[s] += len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    order = sorted(s for s in size if s is not None) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    rest = 1.5 * sum(size.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s] + 1e-9}
        target |= share if not over else {s: 2.0 * size[s] for s in over}
        rest -= sum(2 * size[s] for s in over)
        open_ = open_ - over if over else set()
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d in {x[0] for x in rows}], "doc_id long").selectExpr("doc_id", f"xxhash64(doc_id, {seed}) h").collect()}
    out = []
    for s in order:
        tape = sorted(((hashes[d] % (1 << 64), (d is not None, d), len((t or "").encode().split()), d) for d, t, _, x in rows if x == s), key=lambda x: x[:3])
        at, words = 0, round(target[s])
        for _, _, n, d in tape:
            taken = sum(max(0, min(at + e * size[s] + n, words) - min(at + e * size[s], words)) for e in (0, 1))
            out.append((d, n, size[s], round(target[s], 4), taken))
            at += n
    return sorted(out, key=str)


def test_mix_agrees_with_brute_force(spark, odd_docs, odd_rows):
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 4), r.taken) for r in mixing.report(odd_docs, block=64).collect()]
    assert sorted(got, key=str) == brute_mix(spark, odd_rows)


def test_mix_follows_its_schedule(spark, odd_docs, monkeypatch):
    """Each stretch of the mix holds the sources in their shares, and another schedule gives another mix."""
    rows = [(i, f"{'abc'[i % 3]} " * (5 + i % 7), "abc"[i % 3]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = [(r.source, len(r.text.split())) for r in mixing.mixed(docs, block=32).collect()]
    total, seen, n = Counter(), Counter(), 0
    for s, k in made:
        total[s] += k
    for s, k in made:
        seen[s] += k
        n += k
        assert all(abs(seen[x] - n * total[x] / sum(total.values())) < 8 * 32 for x in "abc")
    before = sorted(map(tuple, mixing.report(docs, block=32).collect()))

    def one_after_the_other(spark, needs, keys):
        slots = [(k, r) for k, n in zip(keys, needs, strict=True) for r in range(n)]
        return spark.createDataFrame([(k, r, i) for i, (k, r) in enumerate(slots)], "_key string, rank long, slot long")

    monkeypatch.setattr(mixing, "schedule", one_after_the_other)
    assert sorted(map(tuple, mixing.report(docs, block=32).collect())) != before
    assert [r.source for r in mixing.mixed(docs, block=32).collect()] != [s for s, _ in made]


def test_rows_of_files_are_numbered_without_a_copy(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "docs"))
    before = len(common._made)
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert common.numbered(read).select("_row").distinct().count() == read.count()
    assert len(common._made) == before
    common.numbered(read.filter("doc_id > 3"))
    assert len(common._made) == before + 1


def test_mixed_schedule_is_even(spark):
    needs = [300, 100, 200]
    got = sorted(map(tuple, mixing.schedule(spark, needs, ["a", "b", "c"]).select("slot", "_key", "rank").collect()))
    for k, n in zip("abc", needs, strict=True):
        assert sorted(r for _, x, r in got if x == k) == list(range(n))
    for at in range(50, 600, 50):
        played = Counter(k for _, k, _ in got[:at])
        for k, n in zip("abc", needs, strict=True):
            assert abs(played[k] - at * n / 600) < 6


def test_mixed_rows_keep_columns_and_words(odd_docs):
    out = mixing.mixed(odd_docs, block=64)
    assert out.columns == odd_docs.columns
    words = sum(len(r.text.encode().split()) for r in out.collect())
    taken = sum(r.taken for r in mixing.report(odd_docs, block=64).collect())
    assert words == taken


def test_mix_of_nothing(no_docs):
    assert mixing.report(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0


# language ID


def language_rows(n=60):
    r = random.Random(1)
    parts = {"en": ["the", "th", "ing", "and", "er"], "fr": ["é", "eau", "le", "que", "eux"], "de": ["sch", "ung", "ü", "der", "ein"]}
    return [(f"{k}{i}", " ".join("".join(r.choices(v, k=r.randrange(1, 4))) for _ in range(30)), k) for k, v in parts.items() for i in range(n)]


def test_language_of_held_out_rows(spark):
    rows = language_rows() + [("n1", None, "en"), ("n2", "12 ## \n", "fr"), (None, "eau que le", None)]
    out = {r.doc_id: r for r in language_id.report(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    assert len(out) == len(rows)
    lang = {d: k for d, _, k in rows}
    held = [r for d, r in out.items() if r.held_out and d and d[0] in "efd"]
    assert len(held) > 20
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32((d or "").encode()) % 4 == 2) for d, r in out.items())
    assert (out["n1"].lang_pred, out["n1"].score) == ("und", 0.0)
    assert out["n2"].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_without_labels_and_rows(spark, no_docs):
    rows = [(1, "some words", None), (2, None, None)]
    out = language_id.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} == {"und"}
    kept = language_id.recognised(spark.createDataFrame([*rows, (3, "12", None)], "doc_id long, text string, lang string")).collect()
    assert [r.doc_id for r in kept] == [1]
    assert language_id.report(no_docs).count() == 0


def test_language_filter_keeps_columns(spark, odd_docs):
    out = language_id.recognised(odd_docs)
    assert out.columns == odd_docs.columns
    assert all(any(c.isalpha() for c in r.text) for r in out.collect())


def test_temperature_lowers_overconfidence():
    y = np.array([0, 1] * 50)
    z = np.stack([8.0 * (1 - y), 8.0 * y], 1)
    z[:20] = z[:20, ::-1]
    assert language_id.fit_temperature(z, y) > 2


# suffix arrays


def passages(rows, length):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    where = defaultdict(set)
    for i, (_, w) in enumerate(texts):
        for j in range(len(w) - length + 1):
            where[tuple(w[j : j + length])].add(i)
    out = []
    for d, w in texts:
        spans = []
        for j in range(len(w) - length + 1):
            if len(where[tuple(w[j : j + length])]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        out += [(d, a, b - a) for a, b in spans]
    return sorted(out, key=lambda x: (key(x[0]), x[1:]))


@pytest.mark.parametrize(("length", "seed", "hot"), [(12, 4, 10**6), (12, 4, 5), (8, 8, 10**6), (15, 6, 3)])
def test_passages_are_all_found(spark, length, seed, hot):
    r = random.Random(5)
    base = [r.choice("abc") for _ in range(400)]
    rows = []
    for i in range(80):
        w = [r.choice("abcdefgh") for _ in range(r.randrange(0, 60))]
        for _ in range(3):
            p = r.randrange(380)
            w += base[p : p + r.randrange(1, 30)] + [r.choice("abcdefgh") for _ in range(r.randrange(0, 9))]
        rows.append((i, " ".join(w)))
    rows += [(900, None), (None, ""), (902, "x " * 100), (903, "x " * 80), (904, "y " * 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, suffix_dedup.passages(df, length, seed, hot).collect()), key=lambda x: (key(x[0]), x[1:]))
    assert got == passages(rows, length)


def test_passages_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, suffix_dedup.passages(odd_docs).collect()), key=lambda x: (key(x[0]), x[1:]))
    assert got == passages([(d, t) for d, t, *_ in odd_rows], 50)
    assert suffix_dedup.passages(no_docs).count() == 0


# language model


def test_language_model_counts_and_base(odd_docs, odd_rows):
    got = lm.report(odd_docs).collect()
    assert len(got) == len(odd_rows)
    counts = Counter()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    for d, t, *_ in odd_rows:
        if not held(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for d, t, *_ in odd_rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        wanted.append((key(d), held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)))
    assert sorted(wanted) == sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score <= 0 for r in got)


def test_language_model_is_normalised(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["a", "b", "c", "dd", "ee", f"w{r.randrange(2000)}"]) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scorer, words = lm.fit(df, lm.F.lit(False))
    for c1, c2 in ((0, 0), (3, 1), (900, 5)):
        p = np.exp((scorer.left[c1] + scorer.right[c2] - scorer.log_z[c1, c2]).astype(float))
        assert abs(p.sum() - 1) < 1e-3
    counts = {bytes(x.word): x.n for x in words.collect()}
    place = {w: i for i, w in enumerate(scorer.words)}
    for c1 in (0, 3, 900):
        total = Counter()
        for w, n in counts.items():
            if w not in scorer.first:
                turn = scorer.r2[c1] @ scorer.q2[place[w]] if w in place else 0.0
                total[lm.group(w)] += (n + lm.SMOOTH) * math.exp(turn) / 10.0 ** scorer.log_z2[c1, lm.group(w)]
        for c, p in total.items():  # and a word that was never seen
            assert abs(p + lm.SMOOTH / 10.0 ** scorer.log_z2[c1, c] - 1) < 1e-4


def test_language_model_scores_as_a_plain_pass_does(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 1500)  # some words are beyond it
    r = random.Random(12)
    odd_rows = [*odd_rows, *[(2000 + i, " ".join(f"v{int(r.paretovariate(0.4)) % 9000}" for _ in range(200)), "en", "a") for i in range(100)]]
    odd_docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in odd_rows if (x[0] or 0) >= 2000], "doc_id long, text string"))
    scorer, words = lm.fit(odd_docs, lm.F.col("doc_id") % 10 == 3)
    assert 767 < len(scorer.words) < words.count()
    counts = {bytes(x.word): x.n for x in words.collect()}
    place = {w: i for i, w in enumerate(scorer.words)}
    kind = lambda w: scorer.first.index(w) if w in scorer.first else lm.group(w)
    wanted = []
    for d, t, *_ in odd_rows:
        before, s = [0, 0], 0.0
        for w in [*(t or "").encode().lower().split(), b""]:
            c, (c2, c1) = kind(w), before
            z = np.exp(scorer.left[c1].astype(float) + scorer.right[c2])
            s += math.log10(z[c] / z.sum())
            if c >= lm.FREQUENT:
                turn = float(scorer.r2[c1] @ scorer.q2[place[w]]) if w in place else 0.0
                s += math.log10(counts.get(w, 0) + lm.SMOOTH) + turn / math.log(10) - scorer.log_z2[c1, c]
            before = [c1, c]
        wanted.append((key(d), s))
    got = sorted((key(r.doc_id), r.score) for r in lm.score(odd_docs, scorer, words, ["doc_id"]).collect())
    for (a, x), (b, y) in zip(sorted(wanted), got, strict=True):
        assert a == b
        assert abs(x - y) < 1e-3 + 1e-5 * abs(x)


def test_words_of_a_group_follow_their_context(spark):
    """Two words of one group, told apart by the word before them: the second level learns which comes."""
    r = random.Random(5)
    rare = [f"w{i}zz" for i in range(2000)]
    half = lambda i: rare[:1000] if i else rare[1000:]
    rows = []
    for d in range(300):
        sides = [r.randrange(2) for _ in range(150)]
        rows.append((d, " ".join(f"{'left' if i else 'right'} {r.choice(half(i))}" for i in sides)))
    df = spark.createDataFrame([*rows, (900, "left w5zz left w6zz"), (901, "right w5zz right w6zz")], "doc_id long, text string").coalesce(1)
    patched = [f"own{i}" for i in range(lm.FREQUENT)]  # the frequent are other words
    df = df.unionByName(spark.createDataFrame([(1000 + i, " ".join(patched)) for i in range(60)], "doc_id long, text string")).coalesce(1)
    out = {x.doc_id: x.score for x in lm.report(df).collect()}
    assert out[900] > out[901] + 0.3


def test_language_model_learns_order(spark):
    rows = [(i, "a b c d " * 90) for i in range(900)] + [(1000, "d c b a " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in lm.report(df).collect()}
    assert out[0].score > 0.2 * out[0].base_score  # a fifth of the base's bits, or fewer
    assert out[1000].score < out[0].score


def test_language_model_without_training(spark, no_docs):
    assert lm.report(no_docs).count() == 0


# chat


def digests(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in v)
        loss = "".join(x for _, _, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def odd_turns():
    r = random.Random(2)
    texts = [None, "", "<|", "<\\|", "<\\\\|a|>", "<|im_end|><|im_start|>assistant ok", "\\<|", "word " * 300, "é\U0001f600 " * 50, "$1 \\$"]
    roles = ["system", "user", "assistant", "assistant", "a\nb", "a\0b", "\\\0\n", "\\n", "\\\\n<|x", None, "tool"]
    return [(c or None, r.choice([k, k, 3, None]), r.choice(roles), r.choice(texts)) for c in range(40) for k in range(r.randrange(1, 30))]


def test_chat_round_trip(spark, odd_turns):
    df = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string")
    mark = "<|im_end|><|im_start|>assistant ok"
    want = digests([*odd_turns, (-1, 0, "user", mark), (-1, 1, "assistant", mark)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(df).collect()}
    assert got == want


def test_chat_windows_keep_to_the_budget(spark, odd_turns):
    df = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 window", "2 n_turns", "'x' loss", "3 _n")
    out = chat.windows(df, budget=400).collect()
    for w in out:
        assert w.size == len(w.formatted.encode())
        first = w.formatted[: w.formatted.index(chat.END)] if w.formatted.startswith("<|im_start|>system") else ""
        assert w.size <= 400 or w.n_turns == 1 or len(first.encode()) + len(chat.END) + 1 > 200
        assert w.n_context <= 3
        assert w.formatted.count(chat.START) == w.formatted.count(chat.END) == w.n_turns + w.n_context
        for s in w.loss:
            assert w.formatted[: s.start].endswith("<|im_start|>assistant\n")
            assert w.formatted[s.start + s.length :].startswith(chat.END)
    assert sum(w.n_turns for w in out) == len(odd_turns)


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.report(none).collect()] == [-1]


# packing


def test_packing_holds_every_id_once(odd_docs, odd_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = packing.report(odd_docs, vocabulary("word_bpe_49k.json")).collect()
    by = defaultdict(list)
    for r in out:
        by[(key(r.doc_id), r.doc_tokens)].append(r)
    want = Counter()
    ids = {}
    for d, text, *_ in odd_rows:
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(key(d), len(x))] += 1
        ids.setdefault((key(d), len(x)), []).append(x)
    assert set(by) == set(want)
    for k, pieces in by.items():
        assert sum(r.length for r in pieces) == k[1] * want[k]
        if want[k] == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                assert zlib.crc32(ids[k][0][at : at + r.length].tobytes()) == r.ids_crc32
                at += r.length
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_repeat_counts_solve_the_histogram():
    h = np.zeros(16)
    h[[3, 7, 11]] = 40, 20, 40  # lengths 4, 8, 12 of 16
    x = packing.repeat_counts(h, 16, 3, 2000)
    a, _ = packing.matrix(16, 3)
    assert (x >= 0).all()
    assert np.abs(a @ x - h).max() < 0.5


def test_packing_wastes_little(spark):
    r = random.Random(4)
    rows = [(i, "tea " * min(9000, int(r.expovariate(1 / 900)))) for i in range(3000)]
    out = packing.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), vocabulary("word_bpe_49k.json"))
    pieces = out.collect()
    assert sum(r.length for r in pieces) > 0.99 * 4096 * len({r.sequence_id for r in pieces})


def test_packing_of_nothing(no_docs):
    assert packing.report(no_docs, vocabulary("word_bpe_49k.json")).count() == 0


def test_words_of_a_tokenizer_are_whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    own = packing.WordEncoder(vocabulary("word_bpe_49k.json"))
    r = random.Random(6)
    bits = [" ", "a", "THE", "é", "É", "é", "İ", "'s", ".", "!!", "<|startoftext|>", "<|STARTOFTEXT|>", "\x85", "\xa0", "12", "日", "Σ", "ß", "º", "#", "\t"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 25))) for _ in range(3000)]
    ids, stops = own.encode(pa.array([x.encode() for x in texts], pa.binary()), 2)
    begin = 0
    for text, stop in zip(texts, stops.tolist(), strict=True):
        assert ids[begin:stop].tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
        begin = stop


def test_packing_defines_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1, b"ab \xff cd"), (2, "ab \ufffd cd".encode())], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) text")
    a, b = sorted(packing.report(docs, vocabulary("word_bpe_49k.json")).collect())
    assert (a.length, a.ids_crc32) == (b.length, b.ids_crc32)


def test_packing_of_many_small_splits_pads_little(spark):
    rows = spark.range(400).selectExpr("id doc_id", "repeat('tea house ', cast(200 + id % 300 as int)) text").repartition(200)
    out = packing.pack(rows, vocabulary("word_bpe_49k.json"), 2, part=1 << 19).select("length", "sequence_id").collect()
    assert sum(r.length for r in out) > 0.97 * 4096 * len({r.sequence_id for r in out})


def test_most_windows_come_from_combinations():
    r = random.Random(2)
    items = [(i, 0, max(1, min(4095, int(r.lognormvariate(6.5, 1.0))))) for i in range(4000)]
    bins = defaultdict(list)
    for x in items:
        bins[-(-x[2] // (4096 // packing.UNITS))].append(x)
    windows = packing.combined(bins)
    assert len(windows) > 0.9 * sum(x[2] for x in items) / 4096
    assert all(sum(x[2] for x in w) <= 4096 for w in windows)


# exact dedup


def test_exact_dedup_report(odd_docs, odd_rows, no_docs):
    out = exact_dedup.report(odd_docs).collect()
    groups = defaultdict(list)
    for d, t, *_ in odd_rows:
        groups[t or ""].append(d)
    want = Counter()
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        best = max(known) if known else None
        digest = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for d in ids:
            first = d == best and not kept
            kept = kept or first
            want[(key(d), key(best), len(ids), first, digest)] += 1
    assert Counter((key(r.doc_id), key(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in out) == want
    assert exact_dedup.report(no_docs).count() == 0


def test_exact_dedup_of_later_batches(spark, odd_docs):
    index = exact_dedup.DigestIndex(spark)
    index.add(exact_dedup.digests(odd_docs), batch=0)
    before = index.table().count()
    later = exact_dedup.digests(spark.createDataFrame([(9000, "quite new"), (9001, "quite new"), (9002, "")], "doc_id long, text string"))
    index.add(later, batch=1)
    assert index.table().count() == before + 1
    assert [r.doc_id for r in exact_dedup.decide(later, index, 1).filter("kept").collect()] == [9001]


def test_exact_dedup_of_ids_that_are_strings(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), (None, "y")], "doc_id string, text string").selectExpr("*", "1 keep_id", "'q' kept", "2 _row")
    assert sorted((r.doc_id or "", r.keep_id or "", r.group_size, r.kept) for r in exact_dedup.report(docs).collect()) == [("", "", 2, False), ("", "", 2, True), ("a", "b", 2, False), ("b", "b", 2, True)]
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or "" for r in kept.collect()) == ["", "b"]


def test_exact_dedup_keeps_columns(odd_docs):
    out = exact_dedup.exact_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in odd_docs.collect()})


def test_hot_digests_are_dealt_over_tasks(spark):
    rows = [(i, "same" if i % 2 else f"t{i}") for i in range(20_000)]
    out = exact_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.keep_id, r.group_size) for r in out.filter("group_size > 1").distinct().collect()} == {(19_999, 10_000)}
    assert out.filter("kept").count() == 10_001


# quality


def repeated_words(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    return len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)})


def test_quality_statistics(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.report(odd_docs, labels).collect()
    want = Counter()
    for d, t, *_ in odd_rows:
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        repeat = repeated_words(words)
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        want[(key(d), len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, failed)] += 1
    assert Counter((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_rules_are_learned_in_order():
    random_ = np.random.default_rng(3)
    x = {"symbols_per_word": random_.random(3000), "upper_chars": random_.random(3000), "n_words": random_.integers(1, 900, 3000).astype(float)}
    bad = (x["symbols_per_word"] > 0.8) | ((x["upper_chars"] > 0.7) & (x["n_words"] <= 300))
    rules = quality.learn(x, bad)
    said = np.zeros(3000, bool)
    for r in rules:
        said |= quality.covered(r, x, 3000)
    assert (said == bad).mean() > 0.97


def test_quality_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality.report(odd_docs, none).collect())
    assert quality.report(no_docs, none).count() == 0


# token counts


def test_token_counts_are_the_librarys(odd_docs, odd_rows, no_docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd_docs, path, 4096).collect())
    want = Counter()
    for d, t, *_ in odd_rows:
        n = len(model.encode(t or ""))
        want[(key(d), len((t or "").encode()), n, n > 4096)] += 1
    assert got == want
    assert token_counts.token_counts(no_docs, path, 4096).count() == 0


def test_prefix_table_answers_cuts_and_budgets():
    own = token_counts.counter(vocabulary("piece_bpe_32k.model"))
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice([" ", "  ", "a", "the", "\n", "é", "▁", "<s>", "日", "ing", "."]) for _ in range(r.randrange(0, 30)))
        table, segments = own.table([text])[0], own.segments(text)
        for i in range(len(segments)):
            prefix = "".join(segments[: i + 1])[1:]
            if i + 1 < len(segments):  # a prefix that ends inside a space run is another segment's
                assert table[i] == len(own.model.encode(prefix))
        exact = [len(own.model.encode(text[:n])) for n in range(len(text) + 1)]
        assert own.prefixes(text).tolist() == exact
        assert [own.at(text, n) for n in range(len(text) + 1)] == exact
        for budget in (0, 1, 3, 10, 1000):
            assert len(own.truncated(text, budget)) == max(n for n, c in enumerate(exact) if c <= budget)


@pytest.mark.parametrize("signs", ["日本語漢字仮名①", "QWxhZGRpbjpvcGVuIHNlc2FtZQ+/", "ab\n", "thersingeo", "e\u0301\U0001f600x"])
def test_prefixes_of_texts_without_spaces(signs):
    own = token_counts.counter(vocabulary("piece_bpe_32k.model"))
    r = random.Random(9)
    text = "".join(r.choice(signs) for _ in range(400))
    exact = [len(own.model.encode(text[:n])) for n in range(len(text) + 1)]
    assert own.prefixes(text).tolist() == exact
    for budget in (5, 50, 117):
        assert len(own.truncated(text, budget)) == max(n for n, c in enumerate(exact) if c <= budget)


def test_prefixes_within_a_limit_as_a_column(spark):
    rows = [(1, "abcdefgh" * 700), (2, "a b"), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 n_fit", "'x' over_limit")
    docs = docs.unionByName(spark.sql("select 5L doc_id, cast(unhex('61FF') as string) text, 1 n_fit, 'x' over_limit"))
    own = token_counts.counter(vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model"), 100).collect()}
    assert got[1].n_fit == len(own.truncated(rows[0][1], 100))
    assert 0 < got[1].n_fit < len(rows[0][1])
    assert (got[2].n_fit, got[3].n_fit, got[4].n_tokens) == (3, 0, 0)
    assert got[5].n_tokens == len(own.model.encode("a\ufffd"))


# SimHash


def slow_fingerprint(text, width):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            parent[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    return [find(i) for i in range(len(a))]


def test_simhash_components(odd_docs, odd_rows, no_docs):
    got = Counter((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in simhash.report(odd_docs).collect())
    fps = [slow_fingerprint(t, 4) for _, t, *_ in odd_rows]
    of = slow_components(fps, 4)
    least = {}
    for (d, *_), c in zip(odd_rows, of, strict=True):
        least[c] = min(least.get(c, key(None)), key(d))
    assert got == Counter((key(d), f"{f:016x}", least[c]) for (d, *_), f, c in zip(odd_rows, fps, of, strict=True))
    assert simhash.report(no_docs).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5])
def test_dense_fingerprints_lose_no_link(spark, radius):
    r = random.Random(11)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = [0, 2**63, 2**64 - 1]
    for _ in range(1500 if radius < 5 else 150):
        x = r.choice(centres)
        for _ in range(r.randrange(0, 2 * radius + 1)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    linked = {r.node: r.component for r in simhash.components(simhash.edges(df, radius)).collect()}
    of = slow_components(fps, radius)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    ours = defaultdict(set)
    for s in signed:
        ours[linked.get(s, s)].add(s)
    theirs = defaultdict(set)
    for s, c in zip(signed, of, strict=True):
        theirs[c].add(s)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_long_chains_are_one_component(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(df).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}


def test_simhash_keeps_one_of_each_group(odd_docs, odd_rows):
    out = simhash.deduplicated(odd_docs, 5, 4)
    assert out.columns == odd_docs.columns
    of = slow_components([slow_fingerprint(t, 5) for _, t, *_ in odd_rows], 4)
    assert out.count() == len(set(of))


def test_hot_fingerprints_and_components_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD_ROWS", 7)
    rows = [(i, "same text here and there" if i % 2 else f"own {i} " * 9) for i in range(400)]
    got = {r.doc_id: r.component_id for r in simhash.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == 400
    assert {got[i] for i in range(1, 400, 2)} == {1}


def test_written_tables_and_indexes_can_be_cleared(spark):
    index = exact_dedup.DigestIndex(spark)
    assert index.table().count() == 0
    df = common.written(spark.range(3), "numbers")
    assert df.count() == 3
    common.clear(spark)
    with pytest.raises(Exception, match="FILE|exist"):
        df.count()
    assert not spark.catalog.tableExists(index.name)
