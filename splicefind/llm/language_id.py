"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) per task in numpy and sums them in one small
aggregation; the log-probability matrix has a fixed number of buckets and as many rows
as languages, so its size is checked before anything is collected or broadcast (with more
languages than ``most_bytes`` has room for, fitting stops with an error).  Scoring reads each text once.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any
training text every text is ``und``; ties go to the language that sorts first.  Null
languages do not train.  Other columns are not carried.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MOST_BYTES = 256 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Boolean table over all code points: is it a letter?"""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool))
    return _letters[0]


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of a block and where each text starts in them."""
    text = buf.tobytes().decode("utf-8", "replace")
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered
        low = "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return points, lead[offs]


def buckets(points: np.ndarray, of: np.ndarray, order: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram that lies within one text, and where each text's n-grams start."""
    count = np.maximum(np.diff(of) - order + 1, 0)
    if len(points) < order or not count.sum():
        return np.zeros(0, dtype=np.int64), np.zeros(len(count) + 1, dtype=np.int64)
    h = points[: len(points) - order + 1].astype(np.uint64)
    for k in range(1, order):
        h = h * tv.U64(0x100000001B3) + points[k : len(points) - order + 1 + k]
    h = (h + tv.U64(order)) * tv.U64(0x9E3779B97F4A7C15)
    h ^= h >> tv.U64(29)
    h *= tv.U64(0xBF58476D1CE4E5B9)
    idx = (h >> tv.U64(40)).astype(np.int64) & (n_buckets - 1)
    if order > 1:  # drop those that reach into the next text
        inside = np.ones(len(idx), dtype=bool)
        for k in range(1, order):
            cut = of[1:-1] - k
            inside[cut[(cut >= 0) & (cut < len(idx))]] = False
        idx = idx[inside]
    return idx, np.concatenate([[0], np.cumsum(count)])


def counts(docs: DataFrame, text: str, lang: str, n_buckets: int = BUCKETS, orders=ORDERS) -> DataFrame:
    """Training counts as rows (lang, bucket, n); bucket -1 counts texts."""

    def task(batches):
        seen: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = np.asarray(batch.column(batch.schema.get_field_index("lang")).to_pylist(), dtype=object)
            for lo, hi, buf, offs in tv.blocks(batch, limit=1 << 20):
                points, of = code_points(buf, offs)
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                for name, k in zip(names, np.bincount(code)):
                    texts[name] = texts.get(name, 0) + int(k)
                    seen.setdefault(name, np.zeros(n_buckets, dtype=np.int64))
                for order in orders:
                    idx, at = buckets(points, of, order, n_buckets)
                    per = np.repeat(code, np.diff(at))
                    for i, name in enumerate(names):
                        seen[name] += np.bincount(idx[per == i] if len(names) > 1 else idx, minlength=n_buckets)
        for name in sorted(seen):
            used = np.flatnonzero(seen[name])
            yield pa.record_batch(
                [pa.array([name] * (len(used) + 1)), pa.array(np.concatenate([[-1], used]).astype(np.int32)), pa.array(np.concatenate([[texts[name]], seen[name][used]]).astype(np.int64))],
                ["lang", "bucket", "n"],
            )

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", orders=ORDERS, alpha: float = 0.5, most_bytes: int = MOST_BYTES) -> dict:
    """The model: languages, log priors and the (buckets + 1, languages) log-probability matrix."""
    n_buckets = BUCKETS
    room = most_bytes // (4 * n_buckets)
    n_langs = docs.select(F.col(lang).cast("string").alias("lang")).where("lang is not null").distinct().count()
    if n_langs > room:
        raise ValueError(f"{n_langs} languages need more than most_bytes = {most_bytes} (room for {room})")
    got: pd.DataFrame = counts(docs, text, lang, n_buckets, orders).toPandas()
    langs = sorted(set(got["lang"])) if len(got) else []
    total = np.zeros((n_buckets, len(langs)))
    prior = np.zeros(len(langs))
    code = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    np.add.at(prior, code[bucket < 0], n[bucket < 0])
    total[bucket[bucket >= 0], code[bucket >= 0]] = n[bucket >= 0]
    logs = np.log((total + alpha) / (total.sum(axis=0) + alpha * n_buckets))
    return {"langs": langs, "prior": np.log(prior / max(prior.sum(), 1)), "logs": np.ascontiguousarray(logs.T.astype(np.float32)), "orders": tuple(orders)}


def predict(docs: DataFrame, model: dict, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns with lang_pred and score (posterior of the prediction)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = sent.value
        names = np.array([*m["langs"], "und"], dtype=object)
        logs, k, n_buckets = m["logs"], len(m["langs"]), m["logs"].shape[1]
        for batch in batches:
            preds, scores = [], []
            for lo, hi, buf, offs in tv.blocks(batch, limit=1 << 20):
                points, of = code_points(buf, offs)
                has = tv.sum_by(of, letters()[points]) > 0
                total = np.tile(m["prior"], (hi - lo, 1))
                for order in m["orders"] if k else ():
                    idx, at = buckets(points, of, order, n_buckets)
                    for i in range(k):
                        total[:, i] += tv.sum_by(at, logs[i][idx].astype(np.float64))
                if k:
                    best = total.argmax(axis=1)
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    share = 1 / odds.sum(axis=1)
                else:
                    best, share = np.zeros(hi - lo, dtype=int), np.zeros(hi - lo)
                preds.append(np.where(has, best, k))
                scores.append(np.where(has, share, 0.0))
            best = np.concatenate(preds) if preds else np.zeros(0, dtype=int)
            out = batch.drop_columns(["text"])
            yield pa.record_batch([*out.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*out.schema.names, "lang_pred", "score"])

    rows = docs.select(*[c for c in key], F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(task, f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows where ``held_out`` is false, predict every row."""
    rows = docs.select(key, text, lang, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), text, lang)
    return predict(rows, model, [key, "held_out"], text)
