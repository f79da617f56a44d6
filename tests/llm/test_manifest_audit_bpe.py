"""Merkle manifest, divergence audit and word BPE against brute force, on odd rows and on the registered queries."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from splicefind.llm import merkle, queries, word_bpe
from splicefind.llm.divergence import _share, source_divergence
from splicefind.llm.ranks import numbered
from splicefind.session import ship_code

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, k string, pos long, n string, path string, term string, chunk int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows, empty and long texts, one hot language, columns that bear inner names."""
    ship_code(spark)
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("aBcdéß'") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", ",", " 12"]) for _ in range(n))
    rows = []
    for i in range(150):
        lang = rng.choice(["en"] * 6 + ["de", "", None, "ß"])
        text = rng.choice([say(rng.randrange(1, 60)), say(3), "", None])
        rows.append((rng.choice([i, i, 7, None]), rng.choice(["a", "b", "c", "d", "", None]), lang, rng.choice([len(text or ""), None]), text))
    rows += [rows[3], rows[3], rows[9], (10**15, "a", "zz", 1, say(30_000)), (5, "solo", "one", 3, "  \n\t x 　 y's  don't \U0001f600")]
    return rows, spark.createDataFrame([(*r, "k", 1, "n", "p", "t", 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    ship_code(spark)
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(level):
    """(root, per leaf the list of (sibling, sibling is left)) of a list of hashes."""
    paths, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(place):
            s = level[p ^ 1] if p ^ 1 < len(level) else None
            paths[i].append((s, p % 2 == 1))
        level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        place = [p // 2 for p in place]
    return level[0], paths


def fold(h, path):
    for s, left in path:
        h = sha((s or "") + h if left else h + (s or ""))
    return h


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) from the definition."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {g: (sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))) for g, v in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([leaf(r) for r in trees[g]]) for g in order}
    root, tops = tree([made[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for r, path in zip(trees[g], made[g][1]):
            path = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            f = fold(leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r), path)
            out.append((r[0], leaf(r), made[g][0], root, sha("".join(s or "" for s, _ in path)), f, f == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 2, 3, 4])
def test_traversal_gives_every_path(span):
    for n in [*range(1, 36), 64, 100]:
        nodes = [sha(str(i)) for i in range(n)]
        root, want = tree(nodes)
        height = max(0, n - 1).bit_length()
        got = list(merkle.traverse(nodes, height, span))
        assert got == [[s for s, _ in p] for p in want]


def test_traversal_holds_few_nodes():
    nodes = [sha(str(i)) for i in range(1 << 10)]
    held = []
    made = merkle.Subtree.__init__

    class Counted(merkle.Subtree):
        def __init__(self, *a):
            made(self, *a)
            held.append(self)

    before, merkle.Subtree = merkle.Subtree, Counted
    try:
        steps = merkle.traverse(nodes, 10, 2)
        for i, _ in enumerate(steps):
            live = {}
            for t in held:
                live.setdefault(t.base, []).append(t)
            assert sum(len(x) for ts in live.values() for t in ts[-2:] for x in t.level) <= 5 * 2 * 6
    finally:
        merkle.Subtree = before
    # each desired subtree was whole when its turn came: nothing was left to grow
    assert all(next(t._growing, "end") == "end" for t in held if t.index < 1 << 10 - t.top)


@pytest.mark.parametrize("height", [1, 3, 12])
def test_manifest_of_odd_rows(odd, height):
    rows, df = odd
    out = merkle.merkle_manifest(df, FIELDS, height=height, carry={"extra": F.col("k")})
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha("".join(p["left"] or p["right"] or "" for p in r["path"]))) for r in out.collect()), key=str)
    assert got == sorted((r[:5] for r in manifest(rows)), key=str)
    assert out.where(merkle.folded("leaf", F.col("path")) != F.col("root")).count() == 0 and out.where("extra <> 'k'").count() == 0
    assert out.where(merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0


def test_manifest_of_one_group_one_row_and_none(odd, empty, spark):
    rows, df = odd
    one = merkle.merkle_manifest(df.where("lang = 'one'"), FIELDS).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["root"] == one[0]["subroot"] and one[0]["path"] == []
    same = merkle.merkle_manifest(df.where("lang = 'en'"), FIELDS, height=2)
    assert {r["root"] for r in same.collect()} == {r["subroot"] for r in same.collect()} == {manifest([r for r in rows if r[2] == "en"])[0][3]}
    assert merkle.merkle_manifest(empty, FIELDS).count() == 0


def test_manifest_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    assert sorted(map(tuple, queries.op11_merkle_manifest(spark, sf).collect()), key=str) == manifest(rows)


def test_numbers_within_hot_groups(spark):
    from splicefind.llm.common import stored

    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 11}", rng.randrange(500), i) for i in range(6000)]
    df = stored(spark.createDataFrame(rows, "g string, v long, i long"))
    out = [(r["g"], r["pos"], r["v"], r["i"], r["n"]) for r in numbered(df, ["g"], [F.col("v").desc(), "i"]).collect()]
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want += [(g, k, r[1], r[2], len(own)) for k, r in enumerate(own)]
    assert sorted(out) == sorted(want)


def audit(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(r[2] or "", r[1] or "", Counter(term.findall(lower(r[4] or "")))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in own for t in d[2]).items() if n >= least]
        counts = {}
        for _, s, c in own:
            counts.setdefault(s, Counter()).update(c)

        def share(c):
            n, v = sum(c[t] for t in kept), len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            used = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", used, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("least, top, wide, long", [(1, 5, 32, 2048), (2, 3, 2, 7), (5, 1000, 1, 1), (10**6, 5, 3, 10)])
def test_divergence_of_odd_rows(odd, least, top, wide, long):
    rows, df = odd
    got = sorted(map(tuple, source_divergence(df, least=least, top=top, wide=wide, long=long).collect()))
    assert got == audit(rows, least, top)


def test_divergence_of_many_groups_and_none(spark, empty):
    rng = random.Random(5)
    rows = [(i, f"s{i % 90}", "en", 0, " ".join(rng.choice("abcdefgh") * 2 for _ in range(6))) for i in range(400)]
    df = spark.createDataFrame([(*r, "k", 1, "n", "p", "t", 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, source_divergence(df, least=30).collect())) == audit(rows, 30, 50)
    assert source_divergence(empty).count() == 0


def test_shares_are_exact_where_products_pass_64_bits():
    rng = random.Random(6)
    of = [rng.randrange(1, 9 * 10**15) for _ in range(300)]
    n = [rng.randrange(0, x + 1) for x in of]
    assert _share(np.array(n), np.array(of)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, of)]


def test_divergence_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    assert sorted(map(tuple, queries.op12_source_divergence(spark, sf).collect())) == audit(rows, 30, 50)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk_bytes", [1, 900, 8 << 20])
def test_word_bpe_of_odd_rows(odd, library, chunk_bytes):
    rows, df = odd
    coded = word_bpe.bpe_encode(df, PATH, P.PATTERN, chunk_bytes=chunk_bytes)
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["bytes"])) for r in word_bpe.bpe_decode(coded, PATH).collect()), key=str)
    assert got == sorted(((r[0], library.encode_ordinary(r[4] or ""), (r[4] or "").encode()) for r in rows), key=str)


def test_word_bpe_of_other_keys_and_none(odd, empty, library):
    rows, df = odd
    named = word_bpe.bpe_encode(df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), PATH, P.PATTERN)
    assert Counter((r["doc_id"], len(r["ids"])) for r in named.collect()) == Counter((None if r[0] is None else f"d{r[0]}", len(library.encode_ordinary(r[4] or ""))) for r in rows)
    for packed in (False, True):
        out = word_bpe.bpe_decode(word_bpe.bpe_encode(empty, PATH, P.PATTERN, packed=packed), PATH)
        assert out.columns == ["doc_id", "ids", "bytes"] and out.count() == 0


def test_decoding_of_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1, 50255])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["bytes"] for r in word_bpe.bpe_decode(df, PATH).collect()}
    table = {i: b for b, i in word_bpe.ranks(PATH).items()}
    assert got[1] is None and got[2] == b"" and got[3] == table[0] + table[1] + table[50255]
    packed = df.select("doc_id", F.when(F.col("doc_id") == 3, F.lit(bytearray(np.array([0, 1, 50255], "<u4").tobytes()))).when(F.col("doc_id") == 2, F.lit(bytearray())).alias("ids"))
    assert {r["doc_id"]: r["bytes"] for r in word_bpe.bpe_decode(packed, PATH).collect()} == got
    for bad in ([50257], [-1], [None]):
        with pytest.raises(Exception, match="no entry"):
            word_bpe.bpe_decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), PATH).collect()


def test_pieces_of_stretches_are_those_of_the_whole(monkeypatch):
    cut, rng = regex.compile(P.PATTERN), random.Random(8)
    texts = ["".join(rng.choice("ab1 é\n .'s ") for _ in range(rng.randrange(0, 400))) for _ in range(300)] + [" " * 100, "a" * 100, "a " * 60, ""]
    want = [cut.findall(t) for t in texts]
    monkeypatch.setattr(word_bpe, "PIECE_CHARS", 20)
    parts = [list(word_bpe.pieces(t, cut)) for t in texts]
    assert [[w for p in x for w in p] for x in parts] == want and max(map(len, parts)) > 5


def test_packed_words_and_positions_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31, 5, 0])
    assert word_bpe.unpack(word_bpe.pack(x), len(x)).tolist() == x.tolist()
    rng = np.random.default_rng(2)
    for n_buckets in (1, 3, 50):
        words = [str(i).encode() * (i % 3) for i in range(40)]
        stream = np.concatenate([np.arange(40), rng.zipf(1.5, 3000) % 40])
        back = [None] * len(stream)
        for _, own, places in word_bpe.bucketed(words, stream, n_buckets):
            own, (times, at) = word_bpe._word_list(own), word_bpe.positions(places)
            for place, w in zip(at.tolist(), (w for w, n in zip(own, times) for _ in range(n))):
                assert back[place] is None
                back[place] = w
        assert back == [words[i] for i in stream]


def test_word_bpe_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r["doc_id"], len(i := library.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), sha(r["text"] or "")) for r in docs)
    assert sorted(map(tuple, queries.op13_word_bpe(spark, sf).collect())) == want
