"""Exhaustive cosine retrieval: queries against all rows, block by block.

Queries and library are dealt in blocks of at most about ``BLOCK_ROWS`` rows, and every pair of blocks is one task of a cogroup: a query
row is sent to as many tasks as the library has blocks, and the other way round; nothing passes the driver.  A task multiplies slices of its
blocks (``PRODUCTS`` products at once; a slice becomes doubles when its turn comes) and sends on what its consumer needs: k rows a query, or one value a shot.  So the second shuffle holds
blocks x queries x k rows however large the library is.  Similarities are rounded to ``DIGITS`` before they
are ranked, which makes ties (broken by time) the same on any partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.operators.asof import range_join
from splicefind.operators.suppress import numbered_rows

BLOCK_ROWS = 20_000
PRODUCTS = 1_000_000
DIGITS = 9
NORMED = 1000  # rows brought to unit length at once


def topk_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark cuts each partition to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def _matrix(column) -> np.ndarray:
    """Rows of a list column at unit length, in double."""
    if not len(column):
        return np.zeros((0, 1))
    chunks = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    out, a = np.empty((len(column), len(chunks[0].flatten()) // len(chunks[0]))), 0
    for chunk in chunks:  # no copy of the whole beside the result
        for i in range(0, len(chunk), NORMED):
            few = chunk.slice(i, NORMED)
            rows = out[a : a + len(few)]
            rows[:] = few.flatten().to_numpy(zero_copy_only=False).reshape(len(few), out.shape[1])
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-8)
            a += len(few)
    return out


def _times(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def n_blocks(queries: DataFrame, library: DataFrame) -> tuple[int, int]:
    """Blocks of either side: by rows, and the library's at least one a core where it has a thousand rows for each."""
    sides = queries.select(F.lit(0).alias("side")).unionByName(library.select(F.lit(1).alias("side")))
    n = {r["side"]: r["n"] for r in sides.groupBy("side").agg(F.count("*").alias("n")).collect()}
    by = lambda rows, each: max(1, -(-rows // each))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return by(n.get(0, 0), BLOCK_ROWS), max(by(n.get(1, 0), BLOCK_ROWS), min(cores, by(n.get(1, 0), 1000)))


def crossed(queries: DataFrame, library: DataFrame, block: Column, lib_block: Column, nq: int, nl: int):
    """The cogroup of every pair of a query block (0 .. nq - 1) and a library block (0 .. nl - 1)."""
    q = queries.withColumn("_b", block).withColumn("_pair", F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))).withColumn("_pair", F.col("_b") * nl + F.col("_pair")).drop("_b")
    lib = library.withColumn("_b", lib_block).withColumn("_pair", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("_pair", F.col("_pair") * nl + F.col("_b")).drop("_b")
    return q.groupBy("_pair").cogroup(lib.withColumnRenamed("_pair", "_with").groupBy("_with"))


def _slices(rows: int, width: int):
    step = max(1, PRODUCTS // max(width, 1))
    return (slice(a, a + step) for a in range(0, rows, step))


def _leaders(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of each row's k largest, the lower column first on ties."""
    n = sims.shape[1]
    least = np.partition(sims, n - k, axis=1)[:, n - k, None] if k < n else -np.inf
    row, col = np.nonzero(sims >= least)
    value = sims[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[few], col[few], value[few]


def top_k(queries: DataFrame, library: DataFrame, k: int, feature: str = "feature", t: str = "t", shot: str = "shot_no", floor: float | None = None) -> DataFrame:
    """(shot_no, q_t, l_t, sim, rank): the k most similar library rows of each query row.

    Query rows are told apart by ``shot`` and ``t``.  Rows with a null vector or time
    take no part; an empty library gives no rows.  ``floor`` drops what is less similar.
    """
    q = queries.where(F.col(feature).isNotNull() & F.col(t).isNotNull()).select(F.col(shot).cast("long").alias("shot_no"), F.col(t).cast("double").alias("q_t"), F.col(feature).alias("f"))
    lib = library.where(F.col(feature).isNotNull() & F.col(t).isNotNull()).select(F.col(t).cast("double").alias("l_t"), F.col(feature).alias("f"))
    nq, nl = n_blocks(q, lib)
    names = ["shot_no", "q_t", "l_t", "sim"]

    def task(q, lib):
        parts = []
        if len(q) and len(lib):
            lib = lib.sort_by("l_t")
            shots, times, lt, ls = _times(q["shot_no"]), _times(q["q_t"]), _times(lib["l_t"]), _matrix(lib["f"])
            for part in _slices(len(q), len(ls)):
                sims = _matrix(q["f"].slice(part.start, part.stop - part.start)) @ ls.T
                row, col, sim = _leaders(np.round(sims, DIGITS, out=sims), k)
                ok = np.ones(len(sim), bool) if floor is None else sim >= floor
                parts.append((shots[part][row[ok]], times[part][row[ok]], lt[col[ok]], sim[ok]))
        kinds = (np.int64, np.float64, np.float64, np.float64)
        return pa.table([pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)) for i, kind in enumerate(kinds)], names)

    found = crossed(q, lib, F.pmod(F.xxhash64("shot_no", "q_t"), F.lit(nq)), F.pmod(F.xxhash64("l_t"), F.lit(nl)), nq, nl).applyInArrow(task, "shot_no long, q_t double, l_t double, sim double")
    return topk_per_key(found, ["shot_no", "q_t"], [F.desc("sim"), "l_t"], k)


def mutual_nearest(left: DataFrame, right: DataFrame, least: float, feature: str = "feature", t: str = "t", shot: str = "shot_no") -> DataFrame:
    """Pairs that are each other's nearest neighbour with at least ``least`` cosine: (q_t, l_t, sim)."""
    there = top_k(left, right, 1, feature, t, shot)
    back = top_k(right.withColumn("shot_no", F.lit(0)), left, 1, feature, t, "shot_no").select(F.col("q_t").alias("l_t"), F.col("l_t").alias("q_t"))
    return there.join(back, ["q_t", "l_t"]).where(F.col("sim") >= least).select("q_t", "l_t", "sim")


def patch_score(left: DataFrame, right: DataFrame, best: int = 100, feature: str = "feature", t: str = "t", shot: str = "shot_no") -> DataFrame:
    """Per shot: mean of the ``best`` largest of each row's maximum similarity to the right side."""
    peak = top_k(left, right, 1, feature, t, shot)
    return topk_per_key(peak.drop("rank"), ["shot_no"], [F.desc("sim"), "q_t"], best).groupBy("shot_no").agg(F.avg("sim").alias("score"), F.count("*").alias("n"))


def _shot_maxima(q, lib, shot: str = "shot_no"):
    """(shots, for each the largest similarity to each library row), in slices of library rows."""
    q = q.sort_by(shot)
    names, first = np.unique(_times(q[shot]), return_index=True)
    qs, ls = _matrix(q["f"]), _matrix(lib["f"])
    sims = [np.maximum.reduceat(np.round(qs @ ls[part].T, DIGITS), first, axis=0) for part in _slices(len(ls), len(qs))]
    return names, np.concatenate(sims, axis=1)


def _by_shot(queries: DataFrame, feature: str, group: str) -> DataFrame:
    return queries.where(F.col(feature).isNotNull()).select(F.col(group).cast("long").alias("shot_no"), F.col(feature).alias("f"))


def set_similarity(left: DataFrame, right: DataFrame, feature: str = "feature", t: str = "t", group: str = "shot_no") -> DataFrame:
    """(shot_no, forward, backward, symmetric): mean-of-max similarity of each left set and the whole right side.

    A left set is in one block; each block of the right side sends one sum a set.
    """
    forward = top_k(left, right, 1, feature, t, group).groupBy("shot_no").agg(F.avg("sim").alias("forward"))
    q, lib = _by_shot(left, feature, group), right.where(F.col(feature).isNotNull() & F.col(t).isNotNull()).select(F.col(t).cast("double").alias("l_t"), F.col(feature).alias("f"))
    nq, nl = n_blocks(q, lib)

    def task(q, lib):
        if not len(q) or not len(lib):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], ["shot_no", "s", "n"])
        names, sims = _shot_maxima(q, lib)
        return pa.table([pa.array(names), pa.array(sims.sum(axis=1)), pa.array(np.full(len(names), sims.shape[1]))], ["shot_no", "s", "n"])

    sums = crossed(q, lib, F.pmod(F.xxhash64("shot_no"), F.lit(nq)), F.pmod(F.xxhash64("l_t"), F.lit(nl)), nq, nl).applyInArrow(task, "shot_no long, s double, n long")
    backward = sums.groupBy("shot_no").agg((F.sum("s") / F.sum("n")).alias("backward"))
    return forward.join(backward, "shot_no").withColumn("symmetric", (F.col("forward") + F.col("backward")) / 2)


def best_windows(queries: DataFrame, library: DataFrame, rows: int, width: float, feature: str = "feature", t: str = "t", group: str = "shot_no") -> DataFrame:
    """(shot_no, start, end, mean_sim): the ``rows`` consecutive library rows whose largest similarities to the shot have the best mean.

    Stretches over ``width`` + 2 s are skipped, the first of equal ones wins.  The library is dealt by ranges of its rows, each with the next
    ``rows`` - 1 rows lent; a range sends its best stretch of each shot, never its similarities.
    """
    q, lib = _by_shot(queries, feature, group), library.where(F.col(feature).isNotNull() & F.col(t).isNotNull()).select(F.col(t).cast("double").alias("l_t"), F.col(feature).alias("f"))
    nq, nl = n_blocks(q, lib)
    lib = numbered_rows(lib, [], "l_t", 4096.0)
    each = F.greatest(F.ceil(F.col("place_n") / nl), F.lit(rows)).cast("long")
    block = F.floor(F.col("place") / each)
    lent = F.when((F.col("place") % each < rows - 1) & (block > 0), block - 1)
    lib = lib.withColumn("_r", F.explode(F.array_compact(F.array(block, lent)))).withColumn("own", F.floor(F.col("place") / each) == F.col("_r"))

    def task(q, lib):
        names = ["shot_no", "start", "mean_sim"]
        if not len(q) or len(lib) < rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names)
        lib = lib.sort_by("l_t")
        shots, sims = _shot_maxima(q, lib)
        at = _times(lib["l_t"])
        mean = np.round(np.lib.stride_tricks.sliding_window_view(sims, rows, axis=1).mean(axis=2), DIGITS)
        ok = (at[rows - 1 :] - at[: len(at) - rows + 1] <= width + 2) & _times(lib["own"])[: len(at) - rows + 1]
        mean = np.where(ok, mean, -np.inf)
        top = mean.argmax(axis=1)
        some = np.isfinite(mean.max(axis=1))
        return pa.table([pa.array(shots[some]), pa.array(at[top[some]]), pa.array(mean.max(axis=1)[some])], names)

    got = crossed(q, lib.drop("place", "place_n"), F.pmod(F.xxhash64("shot_no"), F.lit(nq)), F.col("_r"), nq, nl)
    best = topk_per_key(got.applyInArrow(task, "shot_no long, start double, mean_sim double"), ["shot_no"], [F.desc("mean_sim"), "start"], 1)
    return best.select("shot_no", "start", (F.col("start") + width).alias("end"), "mean_sim")


def window_sims(windows: DataFrame, queries: DataFrame, library: DataFrame, lo: str, hi: str, width: float, feature: str = "feature", t: str = "t", group: str = "shot_no") -> DataFrame:
    """(shot_no, t, sim): the largest similarity to the shot of each library row inside one of its windows (shot_no, lo, hi; closed).

    Only rows that lie in a window are fetched and multiplied. Of library rows of one time the most similar counts.
    """
    lib = library.where(F.col(feature).isNotNull()).select(F.col(t).cast("double").alias("t"), F.col(feature).alias("f"))
    rows = range_join(lib, windows.select(F.col("shot_no").cast("long").alias("shot_no"), lo, hi), [], "t", lo, hi, width).select("shot_no", "t", "f").distinct()

    def task(rows, q):
        if not len(q) or not len(rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], ["shot_no", "t", "sim"])
        _, sims = _shot_maxima(q, rows, "_shot")
        at, place = np.unique(_times(rows["t"]), return_inverse=True)
        best = np.full(len(at), -np.inf)
        np.maximum.at(best, place, sims[0])
        return pa.table([rows["shot_no"].slice(0, len(at)), pa.array(at), pa.array(best)], ["shot_no", "t", "sim"])

    q = _by_shot(queries, feature, group).withColumnRenamed("shot_no", "_shot")
    return rows.groupBy("shot_no").cogroup(q.groupBy("_shot")).applyInArrow(task, "shot_no long, t double, sim double")


def nearest_apart(rows: DataFrame, keys: list[str], place: str, apart: int, feature: str = "feature") -> DataFrame:
    """Per row the largest cosine to a row of its series more than ``apart`` places away: (keys, place, nearest).

    A series' rows are dealt in blocks by their place (0 or 1 on, without large gaps); each pair of blocks of one series is one task, which
    answers for both. Series never meet. A task multiplies tiles of about ``PRODUCTS`` products, whose rows alone are doubles.
    """
    names = [*keys, place]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", sim double"
    rows = rows.where(F.col(feature).isNotNull()).select(*names, F.struct(F.lit(0).alias("_"), *keys).alias("_series"), F.col(feature).alias("f"), F.floor(F.col(place) / BLOCK_ROWS).alias("_block"))
    size = rows.groupBy("_series").agg(F.max("_block").alias("_last")).withColumnRenamed("_series", "_of")
    dealt = rows.join(size, rows["_series"].eqNullSafe(size["_of"])).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    dealt = dealt.select(*names, "_series", "f", "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))

    def task(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        block = _times(table["_block"])
        both = [table.filter(pa.array(block == b)) for b in ((i,) if i == j else (i, j))]
        left, right = both[0], both[-1]
        lp, rp = _times(left[place]), _times(right[place])
        up, down = np.full(len(lp), -np.inf), np.full(len(rp), -np.inf)
        step = max(1, math.isqrt(PRODUCTS))
        for b in range(0, len(rp), step) if len(lp) else ():
            cols = slice(b, b + step)
            rs, order = _matrix(right["f"].slice(b, step)), np.argsort(rp[cols], kind="stable")
            line = rp[cols][order]
            for a in range(0, len(lp), step):
                rows = slice(a, a + step)
                sims = _matrix(left["f"].slice(a, step)) @ rs.T
                # each row's near columns are one stretch of the places in order
                first = np.searchsorted(line, lp[rows] - apart)
                many = np.searchsorted(line, lp[rows] + apart, side="right") - first
                at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                sims[np.repeat(np.arange(len(many)), many), order[at]] = -np.inf
                np.maximum(up[rows], sims.max(axis=1), out=up[rows])
                np.maximum(down[cols], sims.max(axis=0), out=down[cols])
        out = []
        for side, best in ((left, up), (right, down))[: len(both)]:
            ok = np.isfinite(best)
            # rounding keeps the order, so the largest is rounded once
            out.append(side.select(names).filter(pa.array(ok)).append_column("sim", pa.array(np.round(best[ok], DIGITS))))
        return pa.concat_tables(out)

    found = dealt.groupBy("_series", "_low", "_high").applyInArrow(task, schema)
    return found.groupBy(*names).agg(F.max("sim").alias("nearest"))


ITEM_GRAMS = 4_000_000
POSTINGS = 1_000_000


def bounded(weight: np.ndarray, most: int):
    """Slices of consecutive rows that weigh at most ``most`` together, or hold one row."""
    total, lo = np.cumsum(weight), 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def best_containment(docs: DataFrame, items: DataFrame, doc: str, item: str, grams: str = "grams") -> DataFrame:
    """Per document the item with the largest symmetric gram containment (the first by name on ties): (doc, item, sim).

    The items are the stated query set: their gram sets go out in slices of at most about ``ITEM_GRAMS``
    postings, and each document is counted against a slice by its posting lists, at most about ``POSTINGS`` places
    (or one document's) at once.  Documents that share no gram with any item have no row.
    """
    hashed = lambda df, name: df.select(F.col(name), F.transform(grams, lambda g: F.xxhash64(g)).alias("g"))
    wanted, rows = hashed(items, item), hashed(docs, doc)
    parts = max(1, -(-(wanted.agg(F.sum(F.size("g")).alias("n")).first()["n"] or 0) // ITEM_GRAMS))
    schema = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}, sim double"

    def count(batch, own, row, i, many, part, sent):
        """Best items of the documents ``part``; ``row``, ``i`` and ``many`` are all hit grams' documents, places in the vocabulary and postings."""
        names, size, _, first, owner = sent.value
        names, n = names.column(0).combine_chunks(), len(size)
        inside = slice(np.searchsorted(row, part.start), np.searchsorted(row, part.stop))
        row, i, many = row[inside] - part.start, i[inside], many[inside]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[i], many)
        both = np.bincount(np.repeat(row, many) * n + owner[at], minlength=len(own) * n).reshape(len(own), n)
        sims = np.round((both / np.maximum(own, 1)[:, None] + both / np.maximum(size, 1)) / 2, DIGITS)
        best = sims.argmax(axis=1)
        some = np.flatnonzero(both.max(axis=1) > 0)
        return pa.record_batch([batch[doc].take(pa.array(some)), names.take(pa.array(best[some])), pa.array(sims[some, best[some]])], [doc, item, "sim"])

    found = None
    for part in range(parts):
        few = wanted.where(F.pmod(F.xxhash64(item), F.lit(parts)) == part).sort(item).toArrow().combine_chunks()
        size = np.array([len(x) for x in few["g"]], np.int64)
        flat = few["g"].combine_chunks().flatten().to_numpy() if len(few) else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        vocabulary, first = np.unique(flat[order], return_index=True)
        owner = np.repeat(np.arange(len(few)), size)[order]
        sent = docs.sparkSession.sparkContext.broadcast((few.select([item]), size, vocabulary, np.append(first, len(flat)), owner))

        def task(batches, sent=sent):
            _, size, vocabulary, first, _ = sent.value
            n = len(size)
            for whole in batches:
                # documents are cut where their grams, and then the item places these lead to, reach the bound
                for cut in bounded(np.diff(whole["g"].offsets.to_numpy()), POSTINGS) if len(vocabulary) else ():
                    batch = whole.slice(cut.start, cut.stop - cut.start)
                    own = np.diff(batch["g"].offsets.to_numpy())
                    flat = batch["g"].flatten().to_numpy()
                    i = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                    hit = vocabulary[i] == flat
                    row, i = np.repeat(np.arange(len(own)), own)[hit], i[hit]
                    many = first[i + 1] - first[i]
                    for part in bounded(np.maximum(np.bincount(row, many, len(own)), n), POSTINGS):
                        yield count(batch.slice(part.start, part.stop - part.start), own[part], row, i, many, part, sent)

        got = rows.mapInArrow(task, schema)
        found = got if found is None else found.unionByName(got)
    return topk_per_key(found, [doc], [F.desc("sim"), item], 1).drop("rank") if parts > 1 else found
