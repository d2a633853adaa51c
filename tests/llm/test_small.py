"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import bin_packing, compression_bands, language_bitmask, line_neighbourhood, quality_qda, relative_lz, simhash_pivots, spaced_seeds, suffix_tree_lm, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, seed string"


def rows():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    texts = [prose(80), prose(30) + " " + passage, passage + "\n" + prose(20), None, "", "A  b\tC\n\nd", prose(3000), "x", "é ü ß"]
    texts += [texts[0], texts[0] + " end", "the same line of seven words\n" + prose(9), "the same line of seven words here\nThe same line of seven words"]
    out = [(i, t, "en" if i % 2 else "fr", "s", 0, 0.5, "z") for i, t in enumerate(texts)]
    return [*out, out[0], (None, "null id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def counted(df, key):
    return Counter(key(r) for r in df.collect())


def words(t):
    return (t or "").encode().split()


def test_substring_dedup(spark, docs):
    data = rows()
    seen = Counter(tuple(words(r[1])[k : k + 35]) for r in data for k in range(len(words(r[1])) - 34))

    def expected(r):
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        return r[0], len(w), b" ".join(x for x, g in zip(w, gone) if not g).decode()

    got = relative_lz.remove_repeats(docs)
    assert counted(got, lambda r: (r["doc_id"], r["n_words"], r["kept_text"])) == Counter(map(expected, data))
    assert relative_lz.remove_repeats(docs.limit(0)).count() == 0


def test_simhash(spark, docs):
    data = rows()
    fp = {r[0]: simhash_pivots.fingerprint((r[1] or "").encode()) for r in data}
    ids = [i for i in fp if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r["component_id"] for r in simhash_pivots.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert got == {i: root(i) for i in ids}
    assert simhash_pivots.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_refines_large_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = sorted({int(b) ^ int(sum(1 << int(k) for k in rng.choice(60, 2, replace=False))) for b in base for _ in range(40)})
    nodes = spark.createDataFrame([(f if f < 2**63 else f - 2**64, i) for i, f in enumerate(fps)], "fp long, rep long")
    exact = simhash_pivots.linked(np.zeros(len(fps), np.uint64), np.array(fps, np.uint64))
    groups = len(set(exact.tolist()))
    from spanloom.operators.components import connected_components

    found = connected_components(simhash_pivots.links(nodes, group=20))
    linked = {r["node"]: r["component"] for r in found.collect()}
    assert len({linked.get(i, i) for i in range(len(fps))}) == groups


def test_lines(spark, docs):
    done = line_neighbourhood.drop_near_lines(docs).collect()
    by = {r["doc_id"]: r for r in done if r["doc_id"] in (11, 12)}
    assert by[11]["removed_lines"] == [] and by[12]["removed_lines"] == [0, 1]
    assert by[12]["text"] == "" and by[12]["source"] == "s" and by[12]["seed"] == "z"
    assert next(r for r in done if r["doc_id"] == 3)["text"] is None
    assert sum(r["doc_id"] == 0 for r in done) == 2
    assert line_neighbourhood.drop_near_lines(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    packed = bin_packing.pack(docs, path, capacity=256, with_ids=True).collect()
    for r in rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [p for p in packed if p["doc_id"] == r[0] and p["piece"] == 0]
        assert mine and mine[0]["ids_crc32"] == zlib.crc32(ids[:256].tobytes())
    bins = {}
    for p in packed:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * sum(p["length"] for p in packed) / 256 + 1
    assert bin_packing.pack(docs.limit(0), path).count() == 0


def test_fullest_combination():
    rng = random.Random(2)
    for _ in range(60):
        stock = [(k, rng.randint(1, 3)) for k in sorted(rng.sample(range(1, 40), 6), reverse=True)]
        target = rng.randint(1, 80)
        sums = {0}
        for k, n in stock:
            sums |= {s + k * j for s in sums for j in range(1, n + 1)}
        got = bin_packing.fullest(target, stock)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= target)
        assert all(n <= dict(stock)[k] for k, n in got.items())


def test_suffix_tree(spark, docs):
    got = suffix_tree_lm.score_corpus(docs, min_count=2).collect()
    assert len(got) == len(rows())
    train = [w for r in rows() if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1 for w in [*words((r[1] or "").lower()), None]]
    c, n = Counter(train), len(train)
    for r in got:
        assert r["train_tokens"] == n
        if r["doc_id"] == 6:
            w = [*words(rows()[6][1].lower()), None]
            base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1))) for x in w)
            assert abs(r["base_score"] - base) < 1e-6 and r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w)
    assert suffix_tree_lm.score_corpus(docs.limit(0)).count() == 0


def test_quality_bands(spark, docs):
    got = {r["doc_id"]: r for r in compression_bands.judge(docs).collect()}
    for r in rows():
        w = words(r[1])
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = set()
        for k in range(len(w) - 2):
            if windows[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        g = got[r[0]]
        assert (g["n_words"], g["n_repeat_words"]) == (len(w), len(hit))
        assert g["word_chars"] == sum(len(x.decode()) for x in w)
    assert compression_bands.judge(docs.limit(0)).count() == 0
    dull = spark.createDataFrame([(1, "ab " * 500), (2, hashlib.sha512(b"x").hexdigest() * 1)], "doc_id long, text string")
    assert not any(r["kept"] for r in compression_bands.judge(dull).collect())


def test_quality_classifier(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_qda.score(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0.5 for r in quality_qda.score(docs, labels.limit(0)).collect())
    assert set(quality_qda.keep(docs, labels).columns) == set(docs.columns)


def test_language(spark, docs):
    prose = [(i, " ".join(random.Random(i).choices(["ab", "abc", "cab"] if i % 2 else ["xyz", "zyx", "yx"], k=40)), "aa" if i % 2 else "xx") for i in range(40)]
    train = spark.createDataFrame([*prose, (99, None, "aa"), (100, "12 34", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_bitmask.identify(train).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in prose)
    assert got[99]["lang_pred"] == got[100]["lang_pred"] == "und"
    assert language_bitmask.identify(train.limit(0)).count() == 0


def test_short_texts_and_many_languages(spark):
    """Texts of one short word, and more languages than a mask word has bits."""
    words = {f"l{k:02d}": ["".join(random.Random(f"{k}-{i}").choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(8)] for k in range(70)}
    rows = [(100 * k + i, " ".join(random.Random(i).choices(ws, k=30)), lang) for k, (lang, ws) in enumerate(words.items()) for i in range(6)]
    short = [(9000 + k, ws[0], None) for k, ws in enumerate(words.values())] + [(9900, "ab", None), (9901, "x", None), (9902, "  ", None)]
    got = {r["doc_id"]: r for r in language_bitmask.identify(spark.createDataFrame(rows + short, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(got[9000 + k]["lang_pred"] == lang for k, lang in enumerate(words))
    assert got[9901]["lang_pred"] == "l00" and got[9902]["lang_pred"] == "und"


def votes_by_hand(rows, held_out=(4, 2)):
    """The same model with plain sets of n-grams in place of Bloom filters."""
    def grams(t):
        padded = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t or "").split()) + " "
        return [padded[i : i + 4] for i in range(len(padded) - 3)]

    counts = {}
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % held_out[0] != held_out[1]:
            counts.setdefault(lang, Counter()).update(grams(t))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    most = Counter()
    for c in share.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    member = {x: {g for g, y in c.items() if y >= language_bitmask.FLOOR and y >= language_bitmask.RELATIVE * most[g]} for x, c in share.items()}
    return {i: {x: sum(g in m for g in grams(t)) for x, m in sorted(member.items())} for i, t, _ in rows}


def test_language_votes_by_plain_sets(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "aeioumn"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 7))) for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(rng.choices(list(letters), k=300))]
    got = {r["doc_id"]: r for r in language_bitmask.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    differ = 0
    for i, votes in votes_by_hand(rows).items():
        best = max(votes.values())
        if best and sum(v == best for v in votes.values()) == 1:
            differ += votes[got[i]["lang_pred"]] != best
            assert abs(got[i]["score"] - best / sum(votes.values())) < 0.05
    assert differ <= 2  # the filters' false positives are corrected on average only


def test_decontamination(spark, docs):
    item = " ".join("t%d" % i for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (4, "a question of six tokens only"), (5, "five t1 tokens t2 here"), (5, "five t1 tokens t2 here")], "item_id long, text string")
    changed = item.replace("t14", "other").replace("t22", "other")
    texts = ["before " + item.upper() + " after", changed, "nothing of that kind", None, "t1 t2 t3 t4", "This is: a question, of six tokens only!", "a question of six tokens", "five t1 tokens t2 here five t1 tokens t2 here", "short one"]
    some = spark.createDataFrame([(i + 1, t, 1, 2) for i, t in enumerate(texts)] + [(None, item, 1, 2)], "doc_id long, text string, _bad int, seed int")
    got = {(r["doc_id"], r["item_id"]): r["n_hits"] for r in spaced_seeds.overlaps(some, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 4), (8, 5), (None, 1)} and got[8, 5] == 4
    left = spaced_seeds.keep_clean(some, items)
    assert {r["doc_id"] for r in left.collect()} == {3, 4, 5, 7, 9} and left.columns == some.columns
    assert spaced_seeds.overlaps(docs, items.limit(0)).count() == 0
    assert spaced_seeds.overlaps(docs.limit(0), items).count() == 0


def test_decontamination_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join("b%d" % rng.randrange(500) for _ in range(rng.randint(3, 40)))) for i in range(40)]
    texts = [" ".join([*("b%d" % rng.randrange(500) for _ in range(20)), rng.choice(items)[1], "end"]) for _ in range(60)]
    d, b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: {tuple(r) for r in spaced_seeds.overlaps(d, b).collect()}
    whole = rows()
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 100)
    assert len(whole) > 40 and rows() == whole


def test_substituted_passages_are_found(spark):
    """Recall on passages with a share of their tokens replaced, away from any tuning rows."""
    rng = random.Random(77)
    items = [(i, " ".join("q%d" % rng.randrange(3000) for _ in range(30))) for i in range(100)]
    texts = []
    for i, t in items:
        w = t.split()
        for k in rng.sample(range(30), 3):
            w[k] = "z"
        texts.append((i, "intro words " + " ".join(w) + " closing words"))
    found = spaced_seeds.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["doc_id"] == r["item_id"] for r in found) and len(found) >= 95


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://d\n", ""), (5, "http://e", "é" * 90_000), (None, "http://f", "<p>same</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    for split in (64, 1000, 8 << 20):
        got = {r["page_id"]: r for r in warc.round_trip(df, split_bytes=split).collect()}
        assert len(got) == 6
        assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and got[2]["record_type"] == "response"
        assert got[None]["refers_to"] == 2 and got[3]["refers_to"] == 4
        assert bytes(got[5]["payload"]).decode() == "é" * 90_000 and got[1]["payload_bytes"] == 11
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ignores_members_inside_payloads():
    inner = warc.record(9, "http://x", b"inner", None)
    stored = [zlib_stored(warc_text(inner)), warc.record(2, "http://y", b"outer", None)]
    data = b"".join(stored)
    read = lambda at, n: data[at : at + n]
    found = [at for start in range(0, len(data), 16) for at, *_ in warc.scan(read, start, min(start + 16, len(data)), len(data))]
    assert found == [0, len(stored[0])]


def warc_text(payload):
    return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def zlib_stored(raw):
    gz = zlib.compressobj(0, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def test_short_lines_are_dropped_as_exact_copies(spark):
    url = "https://example.org/" + "a" * 80
    texts = ["Released under the MIT License.\n" + url + "\n\nHome\nno such line", "HOME\nreleased  under the MIT License.\n\n" + url + "\nno such word\n", "一行没有空格的文字\n \n一行没有空格的文字", "one two three\none two four", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in line_neighbourhood.drop_near_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[i]["removed_lines"] for i in range(5)] == [[], [0, 1, 3], [2], [], []]
    assert got[1]["text"] == "\nno such word" and got[3]["text"] == texts[3] and got[4]["text"] is None


def test_random_and_encoded_texts_leave_the_bands(spark):
    rng = random.Random(8)
    fold = lambda t, n: "\n".join(t[i : i + n] for i in range(0, len(t), n))
    lower, printable = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(33, 127)))
    word = lambda letters, n: "".join(rng.choices(letters, k=n))
    texts = [fold(base64.b64encode(rng.randbytes(n)).decode(), 76) for n in (6_000, 22_500)]
    texts += [" ".join(word(printable, 6) for _ in range(n)) for n in (100, 300, 900, 4000)]
    texts += [" ".join(word(lower, rng.randint(2, 9)) for _ in range(n)) for n in (1500, 5000)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = compression_bands.judge(made).collect()
    assert len(got) == 8 and all(r["n_words"] > 50 and not r["base_failed"] and not r["kept"] for r in got)


@pytest.mark.parametrize("n, size", [(10, 4), (2**31, 8)])
def test_states_of_a_chunk_hold_counts_no_wider_than_they_need(n, size):
    from spanloom.llm import _exchange, suffix_tree_lm

    one, words = np.array([1]), np.array([3, 5], np.uint64)
    payload = _exchange.pack(one, np.zeros(1, np.uint8), np.ones(1, np.uint8), np.array([4], np.int32), words, np.array([0, 1, 0, 1], np.uint32))
    answer = _exchange.rows_table([(0, 0, 0, _exchange.pack(np.array([-7, 2], np.int32)))])
    state = suffix_tree_lm.State(payload, answer, {"n": n, "v": 2, "min_count": 2, "depth": 1})
    assert state.count.tolist() == [7, 2, 7, 2] and state.count.itemsize == size
    state.open()
    assert state.before.itemsize == size


def test_packing_encodes_a_megabyte_at_a_time():
    bounds = np.arange(0, (5 << 20) + 1, 1 << 16)
    runs = list(bin_packing.slices(np.zeros(5 << 20, np.uint8), bounds, bin_packing.SLICE))
    assert max(len(data) for _, _, data, _ in runs) <= 1 << 20 and sum(hi - lo for lo, hi, _, _ in runs) == len(bounds) - 1


def test_encoder_remembers_words_by_hash():
    """Odd words are encoded as the tokenizer does; words met before do not reach it again, however many."""
    import public_tokenizers

    encoder = bin_packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = "Été ÉTÉ, ÀÖØÞ) ß×a a÷b ÿ... don't it's! A1b, !? É x×, 𝔸b \x01 Zürich-Öl ÑANDÚ¿ ǅa ab C".split(" ")
    texts = [" ".join(odd), "", odd[1], " ".join(f"W{i:x}," for i in range(250_000))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, at = encoder.ids(data, bounds, 1)
    assert [ids[a:b].tolist() for a, b in zip(at[:3], at[1:4])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts[:3]]
    met = []
    encoder._each = lambda parts: met.append(parts)
    again, _ = encoder.ids(data, bounds, 1)
    assert not met and (again == ids).all()
