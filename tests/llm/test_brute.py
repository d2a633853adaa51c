"""Operators against plain Python on tables with shared passages, near lines and repeated documents."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from spanloom.llm import _words, bin_packing, compression_bands, line_neighbourhood, near_copies, quality_qda, relative_lz, suffix_tree_lm
from tests.llm.test_near_copies import components, family

SCHEMA = "doc_id long, text string, n_lines string, _null string, chunk string"


def frame(spark, texts, parts=3, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(parts)


def words(t):
    return (t or "").encode().split()


def in_training(i, modulus, left_out):
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus != left_out


def test_suffix_tree_scores(spark):
    rng = random.Random(11)
    vocabulary = ["k%d" % i for i in range(25)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), None, "", " ".join(rng.choices(vocabulary, k=5000))]
    depth, least = 3, 2
    got = {r["doc_id"]: r for r in suffix_tree_lm.score_corpus(frame(spark, texts), depth, least).collect()}
    runs = {i: [*words((t or "").lower()), None] for i, t in enumerate(texts)}
    grams = defaultdict(Counter)
    for i, w in runs.items():
        if in_training(i, 5, 1):
            for t in range(len(w)):
                for k in range(depth + 1):
                    if t >= k:
                        grams[tuple(w[t - k : t])][w[t]] += 1
    n, v = sum(grams[()].values()), len(grams[()])
    states = set()

    def p(context, word):
        for k in range(len(context), 0, -1):
            s = context[len(context) - k :]
            if s in states:
                c, t = sum(grams[s].values()), len(grams[s])
                return (grams[s][word] + t * p(s[1:], word)) / (c + t)
        return (grams[()][word] + 0.5) / (n + 0.5 * (v + 1))

    for k in range(1, depth + 1):
        new = []
        for s, after in grams.items():
            c = sum(after.values())
            if len(s) == k and c >= least:
                kl = sum(x * (math.log(x) - math.log(p(s, w))) for w, x in after.items()) - c * math.log(c)
                if kl > 0.5 * len(after) * math.log(max(c, 2)):
                    new.append(s)
        states |= set(new)
    assert len(states) > 100 and any(len(s) == 3 for s in states)
    for i, w in runs.items():
        score = sum(math.log10(p(tuple(w[max(0, t - depth) : t]), w[t])) for t in range(len(w)))
        base = sum(math.log10((grams[()][x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(got[i]["score"] - score) < 1e-6 * max(1, abs(score)), i
        assert abs(got[i]["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(grams[()][x] > 0 for x in w), n)
        assert got[i]["held_out"] != in_training(i, 5, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_relative_parse_finds_all_repeated_windows(spark, seed):
    rng = random.Random(seed)
    prose = lambda n: ["p%d" % rng.randrange(4000) for _ in range(n)]
    shared = [prose(n) for n in (34, 35, 36, 50, 120, 400)]
    texts = []
    for _ in range(60):
        t = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t += s[a : a + rng.randint(20, 200)] + prose(rng.randint(0, 40))
        texts.append(" ".join(t))
    texts += ["same " * 200, "one two " * 60, texts[5], " ".join(shared[5]), " ".join(shared[5][:300]), None, ""]
    seen = Counter(tuple(w[k : k + 35]) for w in map(words, texts) for k in range(len(w) - 34))
    got = {r["doc_id"]: r for r in relative_lz.remove_repeats(frame(spark, texts)).collect()}
    factors = 0
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        assert got[i]["kept_text"] == b" ".join(x for x, g in zip(w, gone) if not g).decode(), i
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == sum(gone)
        for f in got[i]["factors"]:
            factors += 1
            assert f["end"] - f["start"] >= 35 and all(gone[f["start"] : f["end"]])
    assert factors > 20


def within_one(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_by_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["l%d" % i for i in range(12)]
    base = [rng.choices(vocabulary, k=rng.randint(1, 12)) for _ in range(12)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            at = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(at, rng.choice(vocabulary))
            elif kind == 1 and w:
                w.pop(at % len(w))
            elif w:
                w[at % len(w)] = rng.choice(vocabulary)
        return "  ".join(w) if rng.random() < 0.9 else " ".join(w).upper()

    texts = ["\n".join(line() for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None, ""]
    ids = rng.sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in line_neighbourhood.drop_near_lines(frame(spark, texts, 4, ids)).collect()}
    first, gone, kept_columns = {}, defaultdict(list), {("y", "z")}
    for i, t in sorted(zip(ids, texts)):
        for number, raw in enumerate((t or "").split("\n")):
            w = tuple(raw.lower().split())
            if not w:
                continue
            if w in first or len(w) >= 6 and any(len(u) >= 6 and within_one(w, u) for u in first):
                gone[i].append(number)
            first.setdefault(w, i)
    assert sum(map(len, gone.values())) > 60
    for i, t in zip(ids, texts):
        assert got[i]["removed_lines"] == gone[i], i
        lines = None if t is None else t.split("\n")
        assert got[i]["text"] == (t if not gone[i] else "\n".join(x for k, x in enumerate(lines) if k not in gone[i]))
        assert (got[i]["_null"], got[i]["chunk"]) in kept_columns


def test_words_of_a_line_decide():
    assert line_neighbourhood.within_one([b"a", b"b"], [b"a", b"b"]) and line_neighbourhood.within_one([b"a", b"b"], [b"b"])
    assert not line_neighbourhood.within_one([b"a", b"b"], [b"b", b"a"]) and not line_neighbourhood.within_one([b"a"], [b"a", b"b", b"c"])
    rng = random.Random(6)
    for _ in range(500):
        x, y = ([rng.choice((b"a", b"b")) for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert line_neighbourhood.within_one(x, y) == within_one(x, y)


def test_quadratic_discriminant_by_numpy(spark):
    """Scores from the same statistics by textbook formulas, and the statistics by plain Python."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["one", "two", "Three", "4", "five,", "six!", "#7"], k=rng.randint(1, 90))) + rng.choice(("", "\nsame\nsame")) for _ in range(150)] + [None, "", "é"]
    labels = {i: int(i % 3 > 0) for i in range(120)}
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in quality_qda.score(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    data, bounds = _words.buffers(__import__("pyarrow").array(texts))
    x = quality_qda.transformed(_words.Words(data, bounds))
    for i, t in enumerate(texts):
        w = words(t)
        assert abs(x[i][0] - math.log1p(len(w))) < 1e-9
        chars = max(1, sum(len(a.decode()) for a in w))
        assert abs(x[i][5] - math.sqrt(sum(a.isupper() and a.isascii() for a in t or "") / chars)) < 1e-9
        assert abs(x[i][9] - math.log((len(set(w)) + 1) / (max(1, len(w)) + 1)) / math.log(max(1, len(w)) + 2)) < 1e-9
    train = [i for i in labels if in_training(i, 5, 0)]
    y = np.array([labels[i] for i in train])
    part = [x[train][y == k] for k in (0, 1)]
    pooled = sum(len(p) * np.cov(p.T, bias=True) for p in part) / len(train)
    density = []
    for p in part:
        cov = (1 - quality_qda.SHRINKAGE) * np.cov(p.T, bias=True) + quality_qda.SHRINKAGE * pooled + quality_qda.RIDGE * np.eye(x.shape[1])
        d = x - p.mean(0)
        density.append(math.log(len(p) / len(train)) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    score = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    for i in range(len(texts)):
        assert abs(got[i]["score"] - score[i]) < 1e-5 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        assert got[i]["held_out"] != in_training(i, 5, 0)


def test_bands_by_hand(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))
    lines = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(40)]
    a, b = "", ""
    for bit in range(11):  # sequences of two letters whose polynomial hashes agree
        a, b = (a + b, b + a) if bit else ("a", "b")
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 400))) for _ in range(60)] + ["# $ % x#y\n\n x", a + "\n" + b, a + "\n" + a, None, "", "w " * 40, "abc def ghi " * 3000]
    got = {r["doc_id"]: r for r in compression_bands.judge(frame(spark, texts)).collect()}
    z = zstandard.ZstdCompressor(level=3)
    for i, t in enumerate(texts):
        t, w, raw = t or "", words(t), (t or "").encode()
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed), i
        fine = False
        if raw:
            low, high = next((lo, hi) for top, lo, hi in compression_bands.BANDS if len(raw) <= top)
            parts = [len(z.compress(raw[k : k + 4096])) / 4096 for k in range(0, len(raw) - 4095, 4096)]
            fine = low <= len(z.compress(raw)) / len(raw) <= high and all(compression_bands.CHUNK_BAND[0] <= p <= compression_bands.CHUNK_BAND[1] for p in parts)
        assert g["kept"] == (not failed and fine)


def test_packing_by_hand(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdéÀ'.,<|x1²\x01 ", k=rng.randint(1, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(80)] + [None, "", "it's don't <|endoftext|> x<|startoftext|>y", "A" * 3000, "İ ΣΣ ǅ ñ́"]
    packed = bin_packing.pack(frame(spark, texts), path, 128, with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        cut = [b"".join(x.to_bytes(4, "little") for x in ids[k : k + 128]) for k in range(0, len(ids), 128)]
        mine = sorted((p["piece"], p["start"], p["length"], bytes(p["ids"]), p["ids_crc32"]) for p in packed if p["doc_id"] == i)
        assert mine == [(k, 128 * k, len(c) // 4, c, zlib.crc32(c)) for k, c in enumerate(cut)], i
    total = sum(p["length"] for p in packed)
    # minimum bin slack is no exact packing: 366 sequences here, where the tokens would fill 365
    assert len({p["sequence_id"] for p in packed}) <= -(-total // 128) + 1
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in bin_packing.sequences(bin_packing.pack(frame(spark, texts), path, 128, with_ids=True)).collect()}
    assert sum(len(x) for x in whole.values()) == 4 * total and max(len(x) for x in whole.values()) <= 4 * 128


@pytest.mark.parametrize(("low", "high", "group"), [(1, 9, near_copies.GROUP), (1, 9, 40), (4, 8, 10)])
def test_near_copies_of_a_large_family(spark, low, high, group):
    data = family(400, low, high)
    docs = spark.createDataFrame([(r[0], r[1], 1, 2) for r in data], "doc_id long, text string, _gone int, _holder int").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, group=group).collect()}
    assert got == components(data)


def test_texts_longer_than_a_slice(spark):
    """A text of over 2 MB beside small ones, in every operator that cuts texts into slices."""
    rng = random.Random(2)
    vocabulary = ["u%d" % i for i in range(3000)]
    long = "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(36_000))
    assert len(long) > 2 << 20
    texts = ["short one here", long, long[: 1 << 20], None]
    docs = frame(spark, texts, 2)
    lz = {r["doc_id"]: r for r in relative_lz.remove_repeats(docs).collect()}
    n = len(words(texts[2]))
    assert lz[2]["n_words"] == n and len(lz[2]["kept_text"].split()) <= 1 and sum(s["end"] - s["start"] for s in lz[1]["spans"]) >= n - 1
    lines = {r["doc_id"]: r for r in line_neighbourhood.drop_near_lines(docs).collect()}
    assert lines[2]["text"].count("\n") <= 1 and lines[1]["n_lines"] == 36_000
    lm = {r["doc_id"]: r for r in suffix_tree_lm.score_corpus(docs).collect()}
    assert lm[1]["n_tokens"] == len(words(long)) + 1
    bands = {r["doc_id"]: r for r in compression_bands.judge(docs).collect()}
    assert bands[1]["n_words"] == len(words(long))
