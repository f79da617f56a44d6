"""Ordered placement: the shots of a film find their places one after the other, near where the last one ended.

Each shot brings a list of scored starts (`apply.score_starts`).  A step asks the nearest region first and takes the best start that passes
the gates; three shots in order lock the order, after which a start before the last one is refused.  A step looks only at its own list,
so a film of n shots costs one pass over its lists, and films are dealt by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from splicefind.operators.folds import fold

# Seconds ahead that are searched in turn, seconds back that are allowed, gates, shots that lock the order
REACHES, BACK = (300.0, 900.0, 1800.0), 15.0
COARSE, SUPPORT, REFINED, LOCK = 0.55, 0.35, 0.62, 3
SCORES = ("start", "coarse", "support", "refined")
OUT = "placed double, placed_end double, region string, in_order int, locked boolean"


def place_in_order(rows: list[dict], last: float, reaches=REACHES, back: float = BACK, coarse: float = COARSE, support: float = SUPPORT, refined: float = REFINED, lock: int | None = LOCK) -> list[dict]:
    """Rows (duration, candidates: structs of SCORES) in order with what OUT names; without a place nulls.

    Candidates with a null in them do not count; a null duration is 0.
    ``last`` is the library's end.  A region's best start is the one with the highest coarse score, the earliest of equal ones; if it fails a gate, the next
    region is asked, at last all starts.  A shot without a place forgets the order.  ``lock`` None never locks.
    """
    out, prev, prev_end, run, locked = [], None, 0.0, 0, False
    for r in rows:
        dur, given = r["duration"] or 0.0, [tuple(c[n] for n in SCORES) for c in r["candidates"] or [] if c is not None]
        found = sorted((c for c in given if None not in c), key=lambda c: (-c[1], c[0]))
        asked = []
        if prev is not None:
            for reach in reaches:
                lo, hi = max(0.0, prev_end - back), min(last, prev_end + reach) - dur
                asked.append((f"{reach:g}", [c for c in found if lo <= c[0] <= hi]))
        asked.append(("global" if prev is None else "rest", found))
        got = None
        for region, inside in asked:
            if not inside:
                continue
            s, a, b, c = inside[0]
            fine = a >= coarse and b >= support and c >= refined
            if fine and not (prev is not None and locked and s < prev - back):
                got = region, s
                break
        if got is None:
            prev, run, locked = None, 0, False
            out.append({**r, "placed": None, "placed_end": None, "region": None, "in_order": 0, "locked": False})
            continue
        region, s = got
        run = 1 if prev is None else run + 1 if s >= prev - 1e-6 else 0
        locked = locked or (lock is not None and run >= lock)
        prev, prev_end = s, s + dur
        out.append({**r, "placed": s, "placed_end": min(last, s + dur), "region": region, "in_order": run, "locked": locked})
    return out


def ordered_search(shots: DataFrame, keys: list[str], order: list[str], last: float, columns: list[str], **options) -> DataFrame:
    """`place_in_order` of each film (``keys``) of ``shots`` in the order of its shots; ``columns`` are carried."""
    return fold(shots, keys, order, lambda rows: place_in_order(rows, last, **options), OUT, columns)
