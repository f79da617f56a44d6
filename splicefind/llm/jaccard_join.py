"""Exact Jaccard join of shingle sets in metric regions, and its connected components.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric.  Two texts link when d <= tau.

1. Equal sets collapse to one representative: copies never make pairs.
2. Cells.  Unrelated texts are all at distance 1, so a Voronoi diagram of documents alone
   leaves nearly all of them in one boundary region.  The space is first cut by projection:
   for sizes of one band, the universe of shingles is hashed into m parts, and a
   document lies in one cell a part, named by the shingles that it has there.  A link of
   sizes a <= c differs in at most k = (a + c)(1 - J)/(1 + J) shingles, so linked documents lie in the
   same cell in all but k parts.  m exceeds the largest k of the band, and a document that shares
   fewer cells with others than a link must share (``need``) has no partner and leaves at once.
   A pair is looked for in the band of its smaller size; a document also visits the band below.
3. Regions.  Inside a cell, pivots are documents.  The first level takes one pivot a cell, the member that
   shares the largest part of its cells, which contracts groups of near copies.  Where a large region still holds many pairs of
   different components, and some members lie over 2 tau from the pivot (else no pivot can part them), the next levels take up to ``PIVOTS`` pivots of different components:
   each member goes to the Voronoi region of its nearest pivot and is replicated to every region whose
   pivot is at most 2 tau farther; in a region it stays only while the triangle-inequality
   window (distances to the pivot that differ by at most tau) holds a member of another component.
   Regions recurse while that makes fewer pairs; pivots are done once measured.
   What is left in small regions meets there, at most ``HOT`` pairs a member.  The members of large ones (near copies of one
   text, too far apart to link and too close for any window) are compared in blocks of bounded size by one byte a part:
   no pair is emitted unless as many parts agree as a link must share.  Pairs that share enough are measured exactly.
4. Links are contracted onto the labels so far by alternating large and small stars, in tables on the
   shared folder; a superseded table is deleted.

Every step is a join or aggregation whose rows are linear in the postings; hot pivots
are joins that AQE can split; nothing of the links or sets goes to the driver.

Defined cases: null and wordless texts have the empty set, link with nothing and are
their own component; fewer than ``k`` words are one shingle; repeated rows are copies;
rows whose key is null link with nothing and keep a row with ``n_shingles`` and a null
component.  A key may be of any type that has an order (others than integers are named by a 64-bit
hash inside).  Only the key and the result columns are returned, so extra columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import textvec as tv
from .common import Scratch, parts_for, text_bytes
from .substring_dedup import BUCKET_ROWS, CHUNK_BYTES, RUN, among, at_most_twice, cut, merge_join, pack, squeeze, wanted_keys, widened

K = 5
PERCENT = 80
PAIRS_PER_ROW = 4
PIVOTS = 8
HOT = 4  # pairs a member beyond which a region is compared in blocks
CUT = 4 * 1024  # members beyond which a region is cut by pivots first: below, few blocks hold it
BLOCK = 1024
MOST_BROADCAST = 1_000_000
CELLS_PER_BYTE = 0.15  # a word takes about six bytes and a shingle enters about 0.7 cells


def differing(a, c, percent: int = PERCENT):
    """The most shingles in which two linked sets of sizes a <= c can differ."""
    return (a + c) * (100 - percent) // (100 + percent)


def size_bands(most: int, percent: int = PERCENT) -> np.ndarray:
    """Lower bounds of size bands such that sizes that may link lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array([*out, -(-out[-1] * 100 // percent) + 1], dtype=np.int64)


def sets_of(buf: np.ndarray, offs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, ascending, and where each text's start."""
    w = tv.Words(tv.LOWER[buf], offs, tv.WORD_BYTES)
    h = w.hashes()
    count = np.diff(w.of)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    of = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(of[-1]), dtype=tv.U64)
    starts, text = tv.starts_within(w.of, k)
    if len(starts):
        out[starts - w.of[text] + of[text]] = tv.window_hashes(h, k)[starts]
    for n in range(1, k):  # too short for a window: the whole sequence is the one shingle
        few = np.flatnonzero(count == n)
        if len(few):
            out[of[few]] = tv.mix(tv.window_hashes(h, n)[w.of[few]] ^ tv.U64(n))
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[of[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[of]


def cells_of(h: np.ndarray, of: np.ndarray, percent: int):
    """Per band (own, then the one below): (is it the own one, cells, their texts, and of each text need, cells and band).

    The number of cells is 0 where empty parts count, too: it then bounds nothing.
    """
    n = np.diff(of)
    bands = size_bands(int(n.max(initial=1)), percent)
    top = bands[1:] - 1
    far = differing(top, top * 100 // percent, percent)
    parts = far + 1 + far // 3
    text = np.repeat(np.arange(len(n)), n)
    body = tv.mix(h)
    own = np.searchsorted(bands, n, side="right") - 1
    for back in (0, 1):
        band = own - back
        m = np.where(band >= 0, parts[band], 0)
        name = tv.mix(band.astype(tv.U64))
        start = np.concatenate([[0], np.cumsum(m)])
        part = ((tv.mix(h ^ name[text]) >> tv.U64(33)).astype(np.int64) * m[text]) >> np.int64(31)
        used = m[text] > 0
        sums = np.zeros(int(start[-1]), dtype=tv.U64)
        np.add.at(sums, (start[text] + part)[used], body[used])
        owner = np.repeat(np.arange(len(n)), m)
        place = (np.arange(len(sums)) - start[owner]).astype(tv.U64)
        empty = np.bincount(owner, weights=sums == 0, minlength=len(n)).astype(np.int64)
        largest = n * 100 // percent if back == 0 else np.minimum(n, bands[own] - 1)  # of the partner
        need = m - differing(n, largest, percent) - empty
        # where a link could rest on empty parts alone, they are cells, too
        keep = (sums != 0) | (need <= 0)[owner]
        yield back == 0, tv.mix(sums[keep] ^ tv.mix(place[keep] ^ name[owner[keep]])), owner[keep], np.maximum(need, 1), np.where(need > 0, m - empty, 0), band


def fine_parts(h: np.ndarray, of: np.ndarray, band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets hashed into four times as many parts as a link of the band can differ in, a byte each (0: empty); where each text's start."""
    n = np.diff(of)
    bands = size_bands(int(n.max(initial=1)), percent)
    top = bands[1:] - 1
    m = np.where(band >= 0, 4 * differing(top, top * 100 // percent, percent)[band] + 1, 0)
    start = np.concatenate([[0], np.cumsum(m)])
    text = np.repeat(np.arange(len(n)), n)
    part = ((tv.mix2(h) >> tv.U64(33)).astype(np.int64) * m[text]) >> np.int64(31)
    used = m[text] > 0
    sums = np.zeros(int(start[-1]), dtype=tv.U64)
    np.add.at(sums, (start[text] + part)[used], tv.mix(h)[used])
    return np.where(sums != 0, 1 + (tv.mix(sums) >> tv.U64(32)) % tv.U64(255), 0).astype(np.uint8), start


def marks(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each whole set."""
    a, b = tv.mix(h + tv.U64(0x1234567)), tv.mix2(h ^ tv.U64(0xABCDEF987654321))
    total = lambda x: np.concatenate([np.zeros(1, tv.U64), np.cumsum(x)])
    ta, tb = total(a), total(b)
    return ta[of[1:]] - ta[of[:-1]], tb[of[1:]] - tb[of[:-1]]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` (key, node, chunk, text) with size and two hashes of the set in place of the text."""
    names = ["key", "node", "chunk", "n", "h1", "h2"]

    def task(batches):
        for batch in batches:
            for lo, hi, buf, offs in tv.blocks(batch, "text"):
                h, of = sets_of(buf, offs, k)
                h1, h2 = marks(h, of)
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part["key"], part["node"], part["chunk"], pa.array(np.diff(of).astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names)

    return docs.mapInArrow(task, f"key {docs.schema['key'].dataType.simpleString()}, node long, chunk int, n long, h1 long, h2 long")


def representatives(block: pa.Table, right: pa.Table, k: int):
    """Of a chunk's rows those that stand for their set: (nodes, sets, where each starts) per block."""
    nodes, h1 = right["node"].to_numpy(), right["mark"].to_numpy()
    order = np.lexsort((h1, nodes))
    nodes, h1 = nodes[order], h1[order]
    done: set[tuple[int, int]] = set()
    named = block["node"].to_numpy()
    block = block.filter(pa.array(np.isin(named, nodes)))
    for batch in block.to_batches():
        names = batch["node"].to_numpy()
        for lo, hi, buf, offs in tv.blocks(batch, "text"):
            h, of = sets_of(buf, offs, k)
            mark = marks(h, of)[0].view(np.int64)
            a, b = np.searchsorted(nodes, names[lo:hi]), np.searchsorted(nodes, names[lo:hi], side="right")
            stay = np.zeros(hi - lo, dtype=bool)
            for i in range(hi - lo):
                pair = (int(names[lo + i]), int(mark[i]))
                if pair[1] in h1[a[i] : b[i]] and pair not in done:
                    done.add(pair)
                    stay[i] = True
            size = np.where(stay, np.diff(of), 0)
            kept = np.repeat(stay, np.diff(of))
            yield names[lo:hi][stay], h[kept], np.concatenate([[0], np.cumsum(size[stay])])


def postings(docs: DataFrame, reps: DataFrame, n_chunks: int, total: int, k: int, percent: int) -> DataFrame:
    """Rows (cell, node, set size) of shared cells, kind 0 of the own band, 1 of the one below; kind 2: the sets of documents in them, kind 3: their parts in a band."""
    n_buckets = 1 << (parts_for(int(total * CELLS_PER_BYTE), BUCKET_ROWS) - 1).bit_length()
    chunks = docs.select("node", "chunk", "text").where("node is not null").repartition(n_chunks, "chunk")
    own = reps.select("chunk", "node", F.col("h1").alias("mark"))

    def run(key_, left, right):
        got = [tv.U64([])]
        for _, h, of in representatives(left, right, k):
            got += [x[1] for x in cells_of(h, of, percent)]
        cells = at_most_twice(np.concatenate(got))
        at = cut(cells, n_buckets)
        used = np.flatnonzero(np.diff(at))
        packed = [pack(squeeze(cells[at[b] : at[b + 1]], n_buckets)) for b in used]
        return pa.table({"bucket": pa.array(used.astype(np.int32)), "chunk": pa.array([key_[0].as_py()] * len(used), pa.int32()), "bits": pa.array(packed, pa.binary())})

    shared = merge_join(chunks.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, RUN))
    # one partner per chunk: its shared cells and its representatives side by side
    hints = shared.select("chunk", "bucket", "bits", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("mark")).unionByName(
        own.select("chunk", F.lit(-1).alias("bucket"), F.lit(b"").alias("bits"), "node", "mark")
    )

    def emit(key_, left, right):
        is_rep = np.asarray(right["bucket"].to_numpy()) < 0
        wanted = wanted_keys(right.filter(pa.array(~is_rep)), n_buckets)
        parts = {"kind": [np.int32([])], "cell": [np.int64([])], "node": [np.int64([])], "n": [np.int64([])], "full": [np.int64([])], "rank": [np.float64([])], "first": [np.zeros(0, bool)], "band": [np.int32([])]}
        blobs: list = []
        for nodes, h, of in representatives(left, right.filter(pa.array(is_rep)), k):
            n = np.diff(of)
            met = np.zeros(len(n), dtype=bool)

            def add(kind: int, text: np.ndarray, nodes=nodes, n=n, **more) -> None:
                for c, x in parts.items():
                    value = {"kind": kind, "node": nodes[text], "n": n[text], **more}.get(c, 0)
                    x.append(np.broadcast_to(np.asarray(value).astype(x[0].dtype), len(text)))

            for own, cell, text, need, full, band in cells_of(h, of, percent):
                every = np.maximum(np.bincount(text, minlength=len(n)), 1)
                hit = among(widened(cell, n_buckets), wanted)
                cell, text = cell[hit], text[hit]
                held = np.bincount(text, minlength=len(n))
                stay = (held >= need)[text]
                cell, text = cell[stay], text[stay]
                met[text] = True
                # of s shared cells the first s - need + 1 in one order hold one of every link
                order = np.lexsort((cell, text))
                cell, text = cell[order], text[order]
                begin = np.searchsorted(text, np.arange(len(n)))
                first = np.arange(len(cell)) - begin[text] <= (held - need)[text]
                add(kind=0 if own else 1, text=text, cell=cell.view(np.int64), full=full[text], rank=-(held / every)[text], first=first, band=band[text])
                blobs += [None] * len(cell)
                there = np.unique(text)
                sign, start = fine_parts(h, of, np.where(np.isin(np.arange(len(n)), there), band, -1), percent)
                add(kind=3, text=there, band=band[there])
                blobs += [sign[start[i] : start[i + 1]].tobytes() for i in there]
            used = np.flatnonzero(met)
            add(kind=2, text=used)
            blobs += [h[of[i] : of[i + 1]].tobytes() for i in used]
        return pa.table({**{c: np.concatenate(x) for c, x in parts.items()}, "shingles": pa.array(blobs, pa.binary())})

    return chunks.groupBy("chunk").cogroup(hints.groupBy("chunk")).applyInArrow(emit, "kind int, cell long, node long, n long, full long, rank double, first boolean, band int, shingles binary")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, size of the intersection, of the union); ``pairs`` is stored."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if pairs.count() <= MOST_BROADCAST:  # at most two ids of 8 bytes a pair
        needed = F.broadcast(needed)
    sets = sets.join(needed, "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def task(batches):
        for batch in batches:
            both, union = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), tv.U64), np.frombuffer(y.as_buffer(), tv.U64)
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                n = int((z[1:] == z[:-1]).sum())
                both.append(n)
                union.append(len(x) + len(y) - n)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "either"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long, both long, either long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, root) for all nodes of ``edges`` (a, b) but the roots, by alternating large and small stars."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        # large star: larger neighbours go to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.put("edges", small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # done once all are stars: no node has two roots, and no root has one itself
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty():
            return edges.select("u", F.col("v").alias("root"))


def relabelled(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``label`` (node, component) after the links (a, b): only links between components are worked on."""
    side = lambda c: label.select(F.col("node").alias(c), F.col("component").alias("c" + c))
    news = links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    news = scratch.put("news", news)
    if news.isEmpty():
        return label
    roots = components(news, scratch).withColumnRenamed("u", "component")
    return scratch.put("label", label.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def chosen(rows: DataFrame, most: int) -> DataFrame:
    """(region, pivot): up to ``most`` pivots a region, of different components, by rank."""
    per = rows.groupBy("region", "component").agg(F.min(F.struct("rank", F.xxhash64("node").alias("h"), "node")).alias("p"))
    if most == 1:
        return per.groupBy("region").agg(F.min("p").alias("p")).select("region", F.col("p.node").alias("pivot"))
    place = F.row_number().over(W.partitionBy("region").orderBy("p"))
    return per.withColumn("place", place).where(F.col("place") <= most).select("region", F.col("p.node").alias("pivot"))


def apart(rows: DataFrame) -> DataFrame:
    """(region, members, pairs): pairs of different components in each region, some of them in its band."""
    per = rows.groupBy("region", "component").agg(F.count("*").alias("m"), F.max("own").alias("own"))
    size = per.groupBy("region").agg(F.sum("m").alias("members"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max("own").alias("own"))
    return size.select("region", "members", ((F.col("members") * F.col("members") - F.col("same")) / 2).alias("pairs")).where("own and pairs > 0")


KEPT = ["region", "band", "node", "n", "own", "full", "rank"]


def voronoi(rows: DataFrame, pivots: DataFrame, distance: DataFrame, tau: float) -> DataFrame:
    """The members of the regions below: at home with the nearest pivot, replicated to those at most 2 tau farther.

    If y's home is pivot q and x's is p, d(x, y) <= tau gives
    d(x, q) <= tau + d(y, q) <= tau + d(y, p) <= 2 tau + d(x, p): x is replicated to where y is at home.
    """
    far = rows.select(*KEPT).join(pivots, "region").join(distance, ["pivot", "node"])
    far = far.groupBy(*KEPT).agg(F.sort_array(F.collect_list(F.struct("d", "pivot"))).alias("to"))  # as many as pivots
    far = far.where(F.col("to")[0]["d"] > 0)  # pivots are done
    near = F.filter("to", lambda x: x["d"] - F.col("to")[0]["d"] <= 2 * tau + 1e-9)
    out = far.select(*KEPT, F.posexplode(near).alias("place", "x"))
    return out.select(F.xxhash64("region", "x.pivot").alias("region"), *KEPT[1:], (F.col("place") == 0).alias("home"), F.col("x.d").alias("d"))


def windowed(rows: DataFrame, tau: float) -> DataFrame:
    """Rows whose triangle-inequality window holds a member of another component that they must meet.

    The window is looked at in bands of width tau: partners lie in one band or in neighbours.
    """
    ring = F.floor(F.col("d") / max(tau, 1e-9) + 1e-9)
    rows = rows.withColumn("ring", ring)
    held = rows.groupBy("region", "ring").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("own").alias("o"), F.max("home").alias("h"))
    held = held.withColumn("ring", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    held = held.groupBy("region", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("o").alias("o"), F.max("h").alias("h")).where("lo <> hi and o and h")
    return rows.join(held, ["region", "ring"]).drop("ring", "lo", "hi", "o", "h")


def promising(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components whose sizes and shared cells leave a link possible.

    In each shared cell a linked pair meets once: where the smaller name is at home.  Where a document has
    ``full`` cells, at most as many of them as shingles differ are not shared.  (A pair that also meets in a
    large region may fall short here; it is found there.)
    """
    side = lambda c: rows.select("region", F.col("node").alias(c), *(F.col(x).alias(x + c) for x in ("n", "own", "full", "home", "d", "component")))
    tau = 1 - percent / 100
    window = F.coalesce(F.abs(F.col("da") - F.col("db")) <= tau + 1e-9, F.lit(True))
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    met = side("a").join(side("b"), "region").where((F.col("a") < F.col("b")) & (F.col("componenta") != F.col("componentb")) & (F.col("owna") | F.col("ownb")) & F.col("homea") & window & fit)
    shared = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.greatest(F.max("fulla"), F.max("fullb")).alias("full"))
    differ = F.floor((F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent) + 1e-9)
    return shared.where(F.col("shared") >= F.col("full") - differ).select("a", "b")


def promising_in_blocks(rows: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The same of large regions, without making pairs: regions of one main component and band go together.

    The members of other components are held against all members, block by block of at most about
    ``BLOCK`` rows a side, by how many of their parts agree.
    """
    main = rows.groupBy("region", "component").agg(F.count("*").alias("m")).groupBy("region").agg(F.max(F.struct("m", "component"))["component"].alias("main"))
    rows = rows.join(main, "region").select("main", "band", "node", "n", "own", "component").distinct()
    rows = scratch.put("large", rows.join(parts, ["node", "band"]))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    odd = F.col("component") != F.col("main")
    sizes = rows.groupBy("main", "band").agg(blocks(F.sum(odd.cast("long"))).alias("odd_blocks"), blocks(F.count("*")).alias("all_blocks")).where("odd_blocks > 0")
    rows = rows.join(sizes, ["main", "band"])
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where(odd).withColumn("i", slot("odd_blocks")).withColumn("j", every("all_blocks"))
    right = rows.withColumn("j", slot("all_blocks")).withColumn("i", every("odd_blocks"))
    key = ["main", "band", "i", "j"]

    def task(left, right):
        right = right.rename_columns([c.rstrip("_") for c in right.column_names])
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        (a, na, oa, ca, x), (b, nb, ob, cb, y) = ([t[c].to_numpy() for c in ("node", "n", "own", "component")] + [np.frombuffer(b"".join(t["parts"].to_pylist()), np.uint8).reshape(len(t), -1)] for t in (left, right))
        agree = np.zeros((len(a), len(b)), np.int32)
        for k in range(x.shape[1]):
            agree += x[:, k, None] == y[None, :, k]
        low, high = np.minimum(na[:, None], nb), np.maximum(na[:, None], nb)
        ok = (agree >= x.shape[1] - differing(low, high, percent)) & (low * 100 >= high * percent) & (ca[:, None] != cb) & (oa[:, None] | ob)
        i, j = np.nonzero(ok)
        return pa.table({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])})

    columns = [*key, "node", "n", "own", "component", "parts"]
    other = right.select([F.col(c).alias(f"{c}_") for c in columns])  # two sides of one table need names of their own
    return left.select(columns).groupBy(*key).cogroup(other.groupBy(*[f"{c}_" for c in key])).applyInArrow(task, "a long, b long")


def joined(rows: DataFrame, sets: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes of ``sets``; ``rows`` has region (a cell), band, node, n, own, full, rank, first."""
    tau = 1 - percent / 100
    link = F.col("both") * 100 >= F.col("either") * percent
    budget = PAIRS_PER_ROW * rows.count()

    def distances(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """(pivots, measured pairs of each member and pivot)."""
        pivots = scratch.put("pivots", chosen(rows, most))
        met = rows.select("region", "node").join(pivots, "region").where("node <> pivot")
        pairs = scratch.put("pairs", met.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct())
        return pivots, scratch.put("found", measured(pairs, sets))

    def gaps(found: DataFrame, pivots: DataFrame) -> DataFrame:
        """(pivot, node, d) of the measured pairs, both ways, and of each pivot and itself."""
        gap = (1 - F.col("both") / F.col("either")).alias("d")
        both = found.select(F.col("a").alias("pivot"), F.col("b").alias("node"), gap).unionByName(found.select(F.col("b").alias("pivot"), F.col("a").alias("node"), gap))
        return both.unionByName(pivots.select("pivot", F.col("pivot").alias("node"), F.lit(0.0).alias("d")).distinct())

    label = sets.select("node", F.col("node").alias("component"))
    pivots, found = distances(rows.where("first").withColumn("component", F.col("node")), 1)
    label = relabelled(label, found.where(link).select("a", "b"), scratch)
    open_ = rows.drop("first").withColumns({"home": F.lit(True), "d": F.lit(None).cast("double")}).join(label, "node")
    rows = scratch.put("rows", open_.join(apart(open_).select("region"), "region"))
    before = None
    while True:
        sizes = scratch.put("sizes", apart(rows))
        pairs = sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        if not pairs:
            return label
        hot = sizes.where(F.col("pairs") > HOT * F.col("members")).select("region")
        if pairs <= budget or (before is not None and pairs > 0.75 * before):
            break
        wide = rows.join(sizes.where((F.col("pairs") > HOT * F.col("members")) & (F.col("members") > CUT)).select("region"), "region", "left_semi")
        if before is None:  # distances to the pivot of the first level
            wide = wide.drop("d").join(pivots, "region").join(gaps(found, pivots), ["pivot", "node"])
        wide = scratch.put("wide", wide.groupBy("region").agg(F.max("d").alias("d")).where(F.col("d") > 2 * tau).select("region"))
        if wide.isEmpty():
            break
        before = pairs
        cut = rows.join(wide, "region", "left_semi")
        pivots, found = distances(cut, PIVOTS)
        label = relabelled(label, found.where(link).select("a", "b"), scratch)
        below = windowed(voronoi(cut, pivots, gaps(found, pivots), tau).join(label, "node"), tau)
        cool = rows.join(wide, "region", "left_anti").drop("component").join(label, "node")
        rows = scratch.put("rows", cool.unionByName(below.select(cool.columns)))
    rows = rows.join(sizes.select("region"), "region")
    near = promising(rows.join(hot, "region", "left_anti"), percent).unionByName(promising_in_blocks(rows.join(hot, "region", "left_semi"), parts, percent, scratch))
    found = measured(scratch.put("pairs", near.distinct()), sets)
    return relabelled(label, scratch.put("found", found.where(link).select("a", "b")), scratch)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession)
    plain = isinstance(docs.schema[key].dataType, IntegralType)
    total = text_bytes(docs, text)
    n_chunks = parts_for(total, CHUNK_BYTES)
    node = F.col("key").cast("long") if plain else F.when(F.col("key").isNotNull(), F.xxhash64("key"))
    chunk = F.pmod(F.xxhash64("key", "text"), F.lit(n_chunks)).cast("int")  # rows of one key are spread by their texts
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("key", node.alias("node"), chunk.alias("chunk"), "text")
    seen = scratch.put("seen", signatures(named, k))
    group = ["h1", "h2", "n"]
    reps = seen.where("n > 0 and node is not null").groupBy(*group).agg(F.min(F.struct("node", "chunk")).alias("r"), F.min("key").alias("low")).select(*group, "low", "r.node", "r.chunk")
    found = scratch.put("postings", postings(named, reps, n_chunks, total, k, percent), free=True)
    cells = found.where("kind < 2").select(F.col("cell").alias("region"), "node", "n", (F.col("kind") == 0).alias("own"), "full", "rank", "first", "band")
    open_ = cells.groupBy("region").agg(F.count("*").alias("m"), F.max("own").alias("any")).where("m > 1 and any").select("region")
    cells = scratch.put("cells", cells.join(open_, "region"))
    sets, parts = found.where("kind = 2").select("node", "shingles"), found.where("kind = 3").select("node", "band", F.col("shingles").alias("parts"))
    label = joined(cells, sets, parts, percent, scratch)
    whole = reps.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # the smallest key of a component: its name, but for hashed ones
    lowest = F.col("component").cast(docs.schema[key].dataType) if plain else F.min("low").over(W.partitionBy("component"))
    out = seen.join(whole.select(*group, lowest.alias("lowest")), group, "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("lowest", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + least(5, len(ws)) - 1), ' ')) AS h, least(5, len(ws)) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.h = b.h AND a.k = b.k GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
