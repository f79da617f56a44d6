"""The ten operators on small fixtures with nulls, empty and long texts, ties, copies and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from splicefind.llm.common import crc_mod
from splicefind.session import ship_code

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, chunk int"


def corpus(seed=7, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 6))) for _ in range(160)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = say(50)
    docs = []
    for i in range(n):
        t = say(rng.randrange(1, 160))
        if i % 6 == 1 and docs:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 7 == 2:
            t = f"{say(20)}\n{passage}\t{say(9)}"
        docs.append((i * 3, t))
    docs += [(901, ""), (902, " \n\t "), (904, "one two"), (905, "one  two"), (906, "ONE two"), (907, "x " * 3000), (908, passage), (909, docs[5][1]), (910, docs[5][1])]
    return docs


@pytest.fixture(scope="module")
def data(spark):
    ship_code(spark)
    docs = corpus()
    rows = [(i, t, ("en", "de", None)[i % 3], "s", len(t), 0.5, "k", 3) for i, t in docs] + [(903, None, None, None, None, None, None, None)]
    return docs + [(903, None)], spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    ship_code(spark)
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_lm_scoring(data, empty):
    from splicefind.llm.lm_scoring import lm_scoring

    docs, df = data
    got = lm_scoring(df, crc_mod("doc_id", 5) == 1).collect()
    want = {r[0]: r for r in brute.base_scores(docs)}
    assert len(got) == len(docs)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5]
        assert r["base_score"] == pytest.approx(w[5], rel=1e-9) and r["score"] < 0
    assert lm_scoring(empty, F.lit(False)).count() == 0


def test_ppm_is_a_distribution_and_equals_the_textbook():
    from splicefind.llm import lm_scoring as lm

    rng = random.Random(3)
    train = ["".join(rng.choice("abc d") for _ in range(rng.randrange(30))).encode() for _ in range(30)]
    k = lm.ORDER

    def block(texts):
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    sym, event, _ = lm.symbols(*block(train))
    keys, counts = lm.summed(lm.grams(sym, event), np.ones(len(event), np.int64))
    nodes = {k + 1: (keys, counts)}
    for size in range(k, 1, -1):
        keys, counts = lm.summed(keys & lm.low(size * lm.BITS), np.ones(len(keys), np.int64))
        nodes[size] = (keys, counts)
    trie = lm.Trie(nodes)
    seen = {}
    for x in train:
        seq = [lm.END] * k + list(x) + [lm.END]
        for i in range(k, len(seq)):
            for o in range(k, -1, -1):
                d = seen.setdefault(tuple(seq[i - o : i]), {})
                d[seq[i]] = d.get(seq[i], 0) + 1
                if d[seq[i]] > 1:
                    break

    def p(past, s):
        out, total = set(), 0.0
        for o in range(k, -1, -1):
            rest = {a: n for a, n in seen.get(tuple(past[len(past) - o :]), {}).items() if a not in out}
            whole = sum(rest.values())
            if s in rest:
                return total + np.log10((rest[s] - 0.5) / whole)
            if rest:
                total += np.log10(0.5 * len(rest) / whole)
            out |= rest.keys()
        return total - np.log10(lm.SYMBOLS - len(out))

    texts = [b"", b"abxc", b"dda  cab", train[3]]
    sym, event, of = lm.symbols(*block(texts))
    got = lm.tv.sum_by(of, trie.score(lm.grams(sym, event)))
    for x, g in zip(texts, got):
        seq = [lm.END] * k + list(x) + [lm.END]
        assert g == pytest.approx(sum(p(seq[i - k : i], seq[i]) for i in range(k, len(seq))))
    assert sum(10 ** p([256, 256, 97, 98, 32], s) for s in range(lm.SYMBOLS)) == pytest.approx(1)
    assert lm.adaptive(b"abababab" * 20) > lm.adaptive(bytes(range(160)))


def test_pruned_trie_is_still_a_distribution():
    from splicefind.llm import lm_scoring as lm

    text = [b"the cat sat on the mat and the rat sat on the cat"] * 3
    sym, event, _ = lm.symbols(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
    raw, counts = lm.summed(lm.grams(sym, event), np.ones(len(event), np.int64))
    keys, n, kinds = raw, counts, counts
    nodes = {}
    for size in range(lm.ORDER + 1, 1, -1):
        if size <= lm.ORDER:
            short = keys & lm.low(size * lm.BITS)
            kinds = lm.summed(short, np.ones(len(keys), np.int64))[1]
            keys, n = lm.summed(short, n)
        stay = n > 3 if size > 2 else n > 0
        nodes[size] = (keys[stay], kinds[stay])
    trie = lm.Trie(nodes)
    past = [ord(c) for c in "n the"[-lm.ORDER :]]
    base = 0
    for s in past:
        base = base << lm.BITS | s
    keys = np.array([base << lm.BITS | s for s in range(lm.SYMBOLS)], dtype=np.uint64)
    assert (10 ** trie.score(keys)).sum() == pytest.approx(1)


def test_lm_scoring_keeps_every_ngram(spark):
    """Over 1.5 million n-grams of 3 and more symbols, held against one trie of all counts."""
    import numpy as np
    from pyspark.sql import functions as F

    from splicefind.llm import lm_scoring as lm

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 7000, dtype=np.uint8)) for _ in range(100)]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.arange(101) * 7000
    sym, event, of = lm.symbols(buf, offs)
    key = lm.grams(sym, event)
    train = key[: of[90]]
    keys, counts = lm.summed(train, np.ones(len(train), np.int64))
    nodes = {6: (keys, counts)}
    for size in range(5, 1, -1):
        keys, counts = lm.summed(keys & lm.low(size * lm.BITS), np.ones(len(keys), np.int64))
        nodes[size] = (keys, counts)
    assert sum(len(nodes[size][0]) for size in (3, 4, 5, 6)) > 1_500_000
    want = np.add.reduceat(lm.Trie(nodes).score(key), of[:-1])
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.lm_scoring(df, F.col("doc_id") >= 90).collect()}
    assert np.allclose([got[i] for i in range(100)], want)


def test_jaccard_join(data, empty):
    from splicefind.llm.jaccard_join import jaccard_join

    docs, df = data
    assert by_id(jaccard_join(df), "doc_id", "n_shingles", "component_id") == sorted(brute.components(docs))
    assert jaccard_join(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_on_chains_of_near_copies(spark, seed):
    from splicefind.llm.jaccard_join import jaccard_join

    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs, cur = [], base
    for i in range(40):  # a chain: neighbours link, ends do not
        cur = list(cur)
        for _ in range(rng.randrange(1, 4)):
            cur[rng.randrange(len(cur))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(cur)))
    docs += [(100 + i, " ".join(base[: 60 + i])) for i in range(30)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(jaccard_join(df), "doc_id", "n_shingles", "component_id") == sorted(brute.components(docs))


@pytest.mark.parametrize("copies", [1, 6])
def test_jaccard_join_with_larger_partners(spark, copies):
    """A text whose shingles are frequent and the same text with words of its own, which sort first."""
    from splicefind.llm.jaccard_join import jaccard_join

    docs = []
    for j, more in enumerate((1, 8, 14, 15, 18, 20, 22, 24, 25, 26, 30)):
        for end in (0, 1):
            x = [f"t{j}e{end}w{i}" for i in range(104)]  # 100 shingles
            y = [f"u{j}e{end}w{i}" for i in range(more)]
            top = 1000 * j + 100 * end
            docs += [(top + i, " ".join(x)) for i in range(copies)] + [(top + 50, " ".join(x + y if end else y + x))]
    random.Random(copies).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert by_id(jaccard_join(df), "doc_id", "n_shingles", "component_id") == sorted(brute.components(docs))


def test_jaccard_join_keeps_rows_without_a_key(spark):
    from splicefind.llm.jaccard_join import jaccard_join

    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, text), (None, text), (None, None), (5, text), (None, "one two")], "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(df).collect()]
    assert sorted(got, key=str) == sorted([(3, 36, 3), (5, 36, 3), (None, 36, None), (None, 0, None), (None, 1, None)], key=str)


def test_jaccard_join_recurses_into_regions(spark, monkeypatch):
    """Chains and groups that share a passage, with every region cut again until none is left."""
    from splicefind.llm import jaccard_join as j

    monkeypatch.setattr(j, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(j, "HOT", 0)
    monkeypatch.setattr(j, "CUT", 0)
    monkeypatch.setattr(j, "PIVOTS", 2)
    rng = random.Random(8)
    docs, cur = [], [f"w{rng.randrange(500)}" for _ in range(90)]
    for i in range(10):
        cur = list(cur)
        for _ in range(2):
            cur[rng.randrange(len(cur))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(cur)))
    shared = [f"s{i}" for i in range(60)]
    docs += [(100 + i, " ".join(shared + [f"o{i % 7}x{k}" for k in range(14 + i % 3)])) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(j.jaccard_join(df), "doc_id", "n_shingles", "component_id") == sorted(brute.components(docs))


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_linked_sets_share_enough_cells(percent):
    from splicefind.llm import jaccard_join as j

    rng = np.random.default_rng(percent)
    for n in [*range(1, 14), 40, 200]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.3], rng.integers(0, 1 << 62, rng.integers(0, 2 + n // 4), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
                continue
            h, of = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
            cells, needs, signs = {0: {}, 1: {}}, {}, {}
            for own, cell, text, need, full, band in j.cells_of(h, of, percent):
                parts, start = j.fine_parts(h, of, band, percent)
                signs[own] = [parts[start[t] : start[t + 1]] for t in (0, 1)]
                for t in (0, 1):
                    cells[t][own] = set(cell[text == t].tolist())
                    needs[t, own] = max(need[t], full[t] - j.differing(*sorted((len(x), len(y))), percent))
            met = max((len(cells[0][a] & cells[1][b]) - max(needs[0, a], needs[1, b]) for a in (True, False) for b in (True, False) if a or b), default=-1)
            assert met >= 0, (n, len(x), len(y), both)
            agree = [(a[0] == b[1]).sum() - len(a[0]) for a in signs.values() for b in signs.values() if len(a[0]) == len(b[1]) > 0]
            assert max(agree) >= -j.differing(*sorted((len(x), len(y))), percent)


def test_jaccard_join_compares_large_groups_in_blocks(spark, monkeypatch):
    """Near copies of one text that mostly do not link with each other: every region counts as large."""
    from splicefind.llm import jaccard_join as j

    monkeypatch.setattr(j, "HOT", 0)
    monkeypatch.setattr(j, "BLOCK", 7)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(160)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        cur = list(base)
        for _ in range(rng.randrange(3, 9)):
            cur[rng.randrange(len(cur))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(cur)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute.components(docs))
    assert 5 < len({c for _, _, c in want}) < 60
    assert by_id(j.jaccard_join(df), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_join_of_string_ids(spark):
    from splicefind.llm.jaccard_join import jaccard_join

    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("z", text), ("b", text), ("c", text + " more"), (None, text), ("a", "other words only")], "id string, body string")
    got = {r["id"]: r["component_id"] for r in jaccard_join(df, "id", "body").collect()}
    assert got == {"z": "b", "b": "b", "c": "b", "a": "a", None: None}


def swaps(n):
    """Two words of n bytes that any polynomial hash modulo 2^64 confuses."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_differ_stay_apart(spark, n):
    from splicefind.llm.decontaminate import decontaminate
    from splicefind.llm.jaccard_join import jaccard_join
    from splicefind.llm.lm_scoring import lm_scoring
    from splicefind.llm.packing import best_fit_packing
    from splicefind.llm.substring_dedup import substring_dedup
    from splicefind.llm.token_output import token_output

    a, b = swaps(n)
    say = [" ".join([*(f"w{i}" for i in range(34)), x]) for x in (a, b)]
    df = spark.createDataFrame([(1, say[0]), (2, say[1])], "doc_id long, text string").coalesce(1)
    assert by_id(substring_dedup(df), "doc_id", "n_removed") == [(1, 0), (2, 0)]
    ones = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    assert by_id(jaccard_join(ones), "doc_id", "component_id") == [(1, 1), (2, 2)]
    assert by_id(decontaminate(ones, spark.createDataFrame([(5, a)], "item_id long, text string")), "doc_id", "n_hit") == [(1, 1), (2, 0)]
    assert by_id(lm_scoring(ones, F.col("doc_id") == 2), "doc_id", "n_known") == [(1, 2), (2, 1)]
    docs = [(1, a), (2, b)]
    ids = encoded("word_bpe_49k.json", docs, 2)
    assert by_id(token_output(ones, P.path("word_bpe_49k.json")), "doc_id", "ids_crc32") == [(i, crc(ids[i])) for i in (1, 2)]
    ids = encoded("byte_bpe_50k.json", docs, 0)
    assert by_id(best_fit_packing(ones, P.path("byte_bpe_50k.json"), capacity=1 << 14), "doc_id", "ids_crc32") == [(i, crc(ids[i])) for i in (1, 2)]


def test_units_of_one_hash_keep_their_own_ids(monkeypatch):
    from splicefind.llm import bpe
    from splicefind.llm import textvec as tv

    monkeypatch.setattr(tv.Words, "hashes", lambda self, second=False: np.zeros(len(self), tv.U64))
    text = b"some words of different ids and sizes, extraordinarily so"
    enc = bpe.UnitEncoder(P.path("byte_bpe_50k.json"), True)
    for _ in range(2):
        ids, _ = enc.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == enc.tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_quality_rules(data, empty):
    from splicefind.llm.quality_rules import quality_rules

    docs, df = data
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    for i, t in docs:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.rules(t), i
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality_rules(empty).count() == 0


def test_decontaminate(data, empty, spark):
    from splicefind.llm.decontaminate import build_index, decontaminate, search

    docs, df = data
    items = [(1, " ".join(docs[2][1].split()[5:25])), (10, docs[4][1]), (2, "ONE, two!"), (3, None), (4, "!!"), (5, "no such words here at all anywhere in these texts ever")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate(df, bench).collect())
    assert got == sorted(brute.contaminated(docs, items))
    assert decontaminate(empty, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate(df, bench.where("item_id < 0")).collect())
    w = docs[2][1].split()
    near = spark.createDataFrame([(7, f"{w[9]} {w[5]}")], "item_id long, text string")
    hit = {r["key"] for r in search(build_index(df), near, within=4).where("size(items) > 0").collect()}
    assert docs[2][0] in hit


def test_decontaminate_in_slices(data, spark, monkeypatch):
    from splicefind.llm import decontaminate as d

    docs, df = data
    items = [(i, " ".join(docs[i][1].split()[:14])) for i in range(0, 40, 2)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d, "SLICE_BYTES", 300)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in d.decontaminate(df, bench).collect())
    assert got == sorted(brute.contaminated(docs, items))


def test_substring_dedup(data, empty):
    from splicefind.llm.substring_dedup import substring_dedup

    docs, df = data
    out = substring_dedup(df)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect())
    assert got == sorted(brute.deduped(docs))
    assert substring_dedup(empty).count() == 0
    whole = {r["doc_id"]: r for r in substring_dedup(df.drop("chunk"), verbatim=True).collect()}
    assert all(whole[i]["text"] == (t or "") for i, t in docs if whole[i]["n_removed"] == 0)


def test_substring_dedup_by_batches(spark):
    from splicefind.llm.substring_dedup import FingerprintIndex, substring_dedup

    docs = [d for d in corpus(11) if d[1]]
    index = FingerprintIndex(spark, n_buckets=4, fan_in=2)
    past = []
    for k in range(4):
        batch = docs[k::4]
        df = spark.createDataFrame(batch, "doc_id long, text string")
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in substring_dedup(df, index=index).collect())
        assert got == sorted(brute.deduped(batch, history=past))
        past += [t for _, t in batch]
    assert len(index.levels) == 2 and index.levels[1].startswith("run-001")


def encoded(name, docs, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in docs}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output(data, empty):
    from splicefind.llm.token_output import token_output

    docs, df = data
    ids = encoded("word_bpe_49k.json", docs, 2)
    want, start = [], 0
    for i in sorted(ids):
        want.append((i, start, len(ids[i]), crc(ids[i])))
        start += len(ids[i])
    assert by_id(token_output(df, P.path("word_bpe_49k.json")), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_output(empty, P.path("word_bpe_49k.json")).count() == 0


def test_frame_of_reference_round_trip():
    from splicefind.llm.token_output import Shard, shard_bytes

    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        x = rng.integers(0, 900, n).astype(np.uint32)
        x[rng.random(n) < 0.02] = 2**32 - 1
        s = Shard(shard_bytes(np.arange(3), np.array([n, 0, 0]), x))
        assert (s.ids() == x).all() and s.keys.tolist() == [0, 1, 2]
        if n == 5000:
            assert (s.ids(3, 7) == x[3 * 128 : 7 * 128]).all()


def test_unit_encoder_equals_the_library():
    from splicefind.llm import bpe
    from splicefind.llm import textvec as tv
    import pyarrow as pa

    rng = random.Random(5)
    letters = list("ab  \n\n\t.,'!19é×ñß°  ’中 \x01\x1c|sŚ ") + ["'s", "'re", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(800)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc = bpe.encoder(P.path(name), spaced)
        want = [x.ids for x in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        got = []
        for lo, hi, buf, offs in tv.blocks(pa.record_batch({"text": pa.array(texts)}), limit=4000):
            ids, of = enc.encode(buf, offs)
            got += [ids[of[i] : of[i + 1]].tolist() for i in range(hi - lo)]
        assert got == want


def test_packing(data, empty):
    from splicefind.llm.packing import best_fit_packing

    docs, df = data
    ids = encoded("byte_bpe_50k.json", docs, 0)
    cap = 256
    rows = best_fit_packing(df, P.path("byte_bpe_50k.json"), capacity=cap).collect()
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= cap
    for i, x in ids.items():
        at = 0
        for k, r in enumerate(sorted(parts[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(x[at : at + r["length"]])) and (k == 0 or r["length"] == cap)
            at += r["length"]
        assert at == len(x)
    assert len(bins) <= 1.05 * (-(-sum(map(len, ids.values())) // cap)) + 1  # the least that any packing needs
    assert best_fit_packing(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_minimum_bin_slack_is_fullest():
    import itertools

    from splicefind.llm.packing import fullest

    rng = random.Random(9)
    for _ in range(60):
        counts = {rng.randrange(1, 20): rng.randrange(1, 3) for _ in range(5)}
        cap, longest = 20, max(counts)
        used = fullest(counts, longest, cap)
        assert used[longest] >= 1 and all(used[k] <= counts[k] for k in used)
        best = max(s for s in (longest + sum(k * c for k, c in zip(counts, combo)) for combo in itertools.product(*[range(n + 1 - (k == longest)) for k, n in counts.items()])) if s <= cap)
        assert sum(k * c for k, c in used.items()) == best


def test_quality_classifier(data, empty, spark):
    from splicefind.llm.quality_classifier import quality_classifier

    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(("good", "words", "here", "are", "fine", "and", "dandy")) for _ in range(40))) for i in range(200)]
    docs += [(1000 + i, "BUY!! NOW!! " * 20) for i in range(200)]
    df = spark.createDataFrame([*docs, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i < 1000)) for i, _ in docs), (7, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_classifier(df, labels, crc_mod("doc_id", 5) == 0).collect()}
    assert len(out) == 402 and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(out[i]["predicted"] == int(i < 1000) for i, _ in docs)
    assert quality_classifier(data[1], labels.limit(0), F.lit(False)).where("score is null").count() == 0
    assert quality_classifier(empty, labels, F.lit(False)).count() == 0


def test_url_filter(spark):
    from splicefind.llm.url_filter import url_filter

    urls = {
        1: ("https://A.example.com/en/5?x#y", "a.example.com", "/en/5", "example.com/en/", "block"),
        2: ("http://www.example.com/en/5", "www.example.com", "/en/5", "www.example.com/en/", "allow"),
        3: ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        4: ("http://xnet/es/1", "xnet", "/es/1", None, "allow"),
        5: ("http://other.com", "other.com", "", "com/", None),
        6: (None, "", "", None, "allow"),
        7: ("no scheme", "", "", None, "allow"),
        8: ("http://x.org#a/b", "x.org", "", None, "allow"),
    }
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame([(k, v[0]) for k, v in urls.items()], "page_id long, url string")).collect()}
    for k, (_, host, path, rule, verdict) in urls.items():
        r = got[k]
        assert (r["host"], r["path"]) == (host, path)
        if k != 5:  # a rule path starts with /, an empty path does not
            assert (r["rule"], r["verdict"]) == (rule, verdict), k
    assert got[5]["rule"] is None
    # a template that the rules block nearly always is rejected where no rule fits
    many = [(i, f"http://h.net/es/{i}") for i in range(50)] + [(100 + i, f"http://h.net/fr/{i}") for i in range(50)] + [(200, "http://h.net/en/1")]
    out = {r["page_id"]: r["verdict"] for r in url_filter(spark.createDataFrame(many, "page_id long, url string")).collect()}
    assert out[0] == "block" and out[200] == "block"


def test_url_templates_reject_by_purity(spark):
    from splicefind.llm.url_filter import segments, templates

    rows = [("h", f"/shop/{i}/buy", 1) for i in range(30)] + [("h", f"/shop/{i}/buy", None) for i in range(5)] + [("h", f"/news/{i}", 0) for i in range(30)]
    df = spark.createDataFrame(rows, "host string, path string, blocked int").withColumn("segments", segments(F.col("path")))
    got = {r["template"]: r["purity"] for r in templates(df).collect()}
    assert got["/shop/*/buy"] > 0.9 and got["/news/*"] < 0.1


def test_url_branches_share_evidence_and_split_where_they_differ(spark):
    from splicefind.llm.url_filter import segments, templates

    rows = [("bad", f"/{x}/{i}", 1) for x in ("es", "fr") for i in range(20)] + [("bad", f"/en/{i}", None) for i in range(5)]
    rows += [("mixed", f"/a/ads/{i}", 1) for i in range(20)] + [("mixed", f"/a/{x}/{i}", 0) for x in ("x", "y") for i in range(20)] + [("mixed", "/a/z/1", None)]
    rows += [("none", f"/{x}/1", None) for x in "abc"]
    deep = "/".join("abcdefghijkl")
    rows += [("deep", f"/{deep}/{x}", y) for x, y in (("good", 0), ("bad", 1)) for _ in range(20)]
    df = spark.createDataFrame(rows, "host string, path string, blocked int").withColumn("segments", segments(F.col("path")))
    got = {(r["host"], "/".join(r["segments"])): (r["template"], r["purity"]) for r in templates(df).collect()}
    assert got["bad", "en/*"][0] == "/*/*" and got["bad", "en/*"][1] > 0.9  # no label of its own
    assert got["mixed", "a/ads/*"][0] == "/a/ads/*" and got["mixed", "a/ads/*"][1] > 0.7
    assert got["mixed", "a/x/*"][0] == "/a/x/*" and got["mixed", "a/x/*"][1] < 0.1
    assert got["mixed", "a/z/*"][0] == "/a/*/*" and got["mixed", "a/z/*"][1] == pytest.approx(1 / 3, abs=0.01)  # the share of its parent
    assert got["none", "b/*"][1] == 0.5
    assert got["deep", f"{deep}/bad"][1] > 0.7 > 0.3 > got["deep", f"{deep}/good"][1]  # beyond the levels of the tree


def test_url_filter_blocks_undecided_urls_and_keeps_columns(spark):
    from splicefind.llm.url_filter import url_filter

    rows = [(i, f"http://h.net/{x}/{i}", 9.0, "t") for x in ("es", "fr", "en") for i in range(40)] + [(100 + i, f"http://o.org/en/{i}", None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, purity double, row string")
    out = url_filter(df).collect()
    assert {r["verdict"] for r in out if "h.net/en" in r["url"]} == {"block"} and {r["verdict"] for r in out if "o.org" in r["url"]} == {"allow"}
    assert sorted(out[0].asDict()) == sorted(["page_id", "url", "row", "host", "path", "rule", "verdict", "template", "purity"]) and len(out) == 125
    assert url_filter(df.limit(0)).count() == 0
    long = "http://h.net/en/" + "x" * 200_000
    assert url_filter(spark.createDataFrame([(1, long), (1, long)], "page_id long, url string")).count() == 2


def test_language_id(data, empty, spark):
    from splicefind.llm.language_id import language_id

    en, de = "the cat and the dog that was here with this thing", "der hund und die katze, das ist mit einem ding hier"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, None), (101, "", "en"), (102, "123 !!", None), (103, "中文字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id(df, crc_mod("doc_id", 4) == 2).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[103]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id(empty, F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in language_id(df, F.lit(True)).collect()} == {"und"}


ODD = "doc_id long, text string, _words string, s_words string, score double, held_out string, purity double, shingles binary, node long, bucket int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, repeated and very large ids, columns that bear inner names, ties and a very long text."""
    ship_code(spark)
    rng = random.Random(12)
    say = lambda k: " ".join(f"w{rng.randrange(900)}" for _ in range(k))
    a, b, long = say(90), say(70), say(60_000)
    texts = [(2**53 + 1, a), (None, b), (7, a), (7, b), (7, b), (None, None), (3, ""), (None, a), (9, long), (4, say(40))]
    rows = [(i, t, f"x{k}", "y", 0.25, "z", 0.5, b"s", k, k) for k, (i, t) in enumerate(texts)]
    return texts, spark.createDataFrame(rows, ODD).repartition(2), rows


def test_decontaminate_keeps_any_key(odd, spark):
    from splicefind.llm.decontaminate import decontaminate

    texts, df, _ = odd
    items = [(1, " ".join(texts[0][1].split()[10:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate(df, bench).collect()), key=str)
    assert got == sorted(brute.contaminated(texts, items), key=str)
    named = decontaminate(df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), bench).where("n_hit > 0")
    assert sorted(r["doc_id"] or "" for r in named.collect()) == ["", "d7", f"d{2**53 + 1}"]


def test_substring_dedup_of_odd_rows(odd):
    from splicefind.llm.substring_dedup import substring_dedup

    texts, df, rows = odd
    out = substring_dedup(df)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == sorted(brute.deduped(texts), key=str)
    assert sorted(r["bucket"] for r in out.collect()) == list(range(len(rows)))


def test_token_output_of_odd_rows(odd, spark):
    from splicefind.llm.token_output import token_output

    texts, df, _ = odd
    path = P.path("word_bpe_49k.json")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output(df, path).collect())
    ids = sorted(((i is not None, i or 0, len(x), crc(x)) for (i, _), x in zip(texts, (encoded("word_bpe_49k.json", [(0, t)], 2)[0] for _, t in texts))))
    assert sorted((i is not None, i or 0, n, c) for _, i, n, c in got) == ids
    assert [s for s, *_ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1].tolist()]
    order = [(i is not None, i or 0) for _, i, _, _ in got]
    assert order == sorted(order)
    with pytest.raises(TypeError):
        token_output(df.withColumn("doc_id", F.lit("a")), path)


def test_token_output_over_several_shards(data, spark, monkeypatch):
    from splicefind.llm import token_output as t

    docs, df = data
    path = P.path("word_bpe_49k.json")
    whole = by_id(t.token_output(df, path), "doc_id", "start", "n_tokens", "ids_crc32")
    out = t.shared_dir(spark)
    manifest = t.write_tokens(df, out, path, 2, each=2000)
    assert manifest.count() > 3
    got = [(r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in t.read_tokens(spark, out, manifest).collect()]
    assert sorted(got) == whole


def test_columns_of_inner_names_stay(odd, spark):
    from splicefind.llm.quality_classifier import quality_classifier
    from splicefind.llm.quality_rules import quality_rules

    texts, df, rows = odd
    got = quality_rules(df).collect()
    assert sorted(r["_words"] for r in got) == sorted(r[2] for r in rows) and len(got) == len(texts)
    labels = spark.createDataFrame([(i, int(i > 5)) for i, _ in texts if i is not None], "doc_id long, quality int")
    got = quality_classifier(df, labels, F.lit(False)).collect()
    assert len(got) == len(texts) and {r["s_words"] for r in got} == {"y"} and all(0 <= r["score"] <= 1 for r in got)


def test_packing_of_odd_rows(odd):
    from splicefind.llm.packing import best_fit_packing

    texts, df, _ = odd
    rows = best_fit_packing(df, P.path("byte_bpe_50k.json")).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["piece"] == 0) == sorted(str(i) for i, _ in texts)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_lm_scoring_of_odd_rows(odd):
    from splicefind.llm.lm_scoring import lm_scoring

    texts, df, _ = odd
    got = lm_scoring(df, F.col("bucket") == 3).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts)
    assert len({round(r["score"], 6) for r in got if r["n_tokens"] == 91}) == 1  # texts alike score alike


def test_language_id_of_odd_rows(odd):
    from splicefind.llm.language_id import fit, language_id

    texts, df, _ = odd
    rows = df.withColumn("lang", F.when(F.col("bucket") % 2 == 0, "b").otherwise("a"))
    got = language_id(rows, F.lit(False)).collect()
    assert len(got) == len(texts) and sum(r["lang_pred"] == "und" for r in got) == 2
    tied = df.select("doc_id", F.lit("same text").alias("text"), F.when(F.col("bucket") < 5, "b").otherwise("a").alias("lang"))
    assert {r["lang_pred"] for r in language_id(tied, F.lit(False)).collect()} == {"a"}
    with pytest.raises(ValueError):
        fit(rows, most_bytes=1000)


def test_fingerprint_index_reopens(spark):
    from splicefind.llm.substring_dedup import FingerprintIndex, substring_dedup

    docs = [d for d in corpus(5) if d[1]]
    first = spark.createDataFrame(docs[::2], "doc_id long, text string")
    path = FingerprintIndex(spark, n_buckets=2).path
    substring_dedup(first, index=FingerprintIndex(spark, path))
    again = FingerprintIndex(spark, path, n_buckets=64)
    assert again.n_buckets == 2 and len(again.levels) == 1
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in substring_dedup(spark.createDataFrame(docs[1::2], "doc_id long, text string"), index=again).collect())
    assert got == sorted(brute.deduped(docs[1::2], history=[t for _, t in docs[::2]]))
