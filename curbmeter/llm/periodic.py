"""Periodic runs of words, found by a sparse diagonal DP over earlier occurrences.

A run is a maximal stretch whose words repeat ``q`` words apart, of at least
``max(6, 4 q)`` words, ``q`` being its smallest period. Put every pair of equal
words on a grid of position and lag: a run is a diagonal (one lag) on which
equal pairs follow each other without a gap. So each word's earlier occurrences
lengthen the matches of their lags, and a lag whose match ends with sufficient
length emits a run at once.

Three things keep the grid sparse, and none of them loses a run:

* Lags are taken in classes ``(Q/2, Q]``. A run of such a lag lies in a stretch
  where every word occurred at most ``Q`` words before. Prose has no such
  stretches for small ``Q`` and no room for those of large ``Q``.
* For long lags the occurrences that are followed are those of ``Q/4`` words
  in a row, and not those which recur within half their own length. A run whose
  words all recur so has a smaller period, so at least one start remains in it;
  and remaining ones lie over ``Q/8`` words apart, so a word that is repeated a
  million times does not make a million million pairs.
* A start is followed only if its lag matches for half the needed length on one
  side. This compares hashes; matches are followed on the words themselves.
"""

from __future__ import annotations

from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.llm.words import BASE, give_back_memory, mix

LEAST = 6
REPEATS = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "runs",
            T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])),
        ),
        T.StructField("collapsed", T.StringType()),
    ]
)


def word_numbers(words: list) -> np.ndarray:
    """For every word the position where it first occurs, which is the same for equal words."""
    first: dict = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def _back(numbers: np.ndarray) -> np.ndarray:
    """How many words before each one it last occurred; the number of words where it did not."""
    order = np.argsort(numbers, kind="stable")
    out = np.full(len(numbers), len(numbers), np.int64)
    same = numbers[order[1:]] == numbers[order[:-1]]
    out[order[1:][same]] = np.diff(order)[same]
    return out


def _stretches(inside: np.ndarray, least: int) -> list:
    """``(first, past)`` of the maximal stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, past = edges[::2], edges[1::2]
    long = past - first >= least
    return list(zip(first[long].tolist(), past[long].tolist()))


def _needed(period: int) -> int:
    """Matches of one lag, one after the other, that make a run."""
    return max(LEAST, REPEATS * period) - period


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` words from every position that has so many, from hashes of half as many."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    width, base = 1, np.uint64(BASE)
    while 2 * width <= size:
        codes = mix(codes[:-width] * base + codes[width:])
        width *= 2
    return codes if width == size else mix(codes[:n] * base + codes[size - width :])


def _starts(codes: np.ndarray, low: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """``(lag, position)`` in order: places where a run of a lag in ``(low, top]`` may be; each has at least one."""
    size = max(1, top // 4)
    grams = _window_hashes(codes, size)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    near = np.zeros(len(order), bool)
    near[1:] = (grams[1:] == grams[:-1]) & (np.diff(order) <= size // 2)
    order, grams = order[~near], grams[~near]
    lags, places = [], []
    for k in range(1, len(order)):
        apart = order[k:] - order[:-k]
        close = (grams[k:] == grams[:-k]) & (apart <= top)
        if not close.any():
            break
        close &= apart > low
        lags.append(apart[close])
        places.append(order[k:][close])
    if not lags:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lag, place = np.concatenate(lags), np.concatenate(places)
    # Of the needed matches, at least half are on one side of any of them, itself included.
    half = _needed(low + 1) // 2 + 1
    windows = _window_hashes(codes, half)
    last = len(windows) - 1

    def match(at: np.ndarray) -> np.ndarray:
        here = (at - lag >= 0) & (at <= last)
        out = np.zeros(len(at), bool)
        out[here] = windows[at[here]] == windows[at[here] - lag[here]]
        return out

    good = match(place) | match(place - half + 1)
    lag, place = lag[good], place[good]
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _follow(numbers: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """First and last position of the unbroken match of ``lag`` that holds position ``at``."""
    n, step, last = len(numbers), 64, at
    while last < n:
        end = min(n, last + step)
        differ = np.flatnonzero(numbers[last:end] != numbers[last - lag : end - lag])
        if len(differ):
            last += int(differ[0])
            break
        last, step = end, 2 * step
    first, step = at, 64
    while first > lag:
        start = max(lag, first - step)
        differ = np.flatnonzero(numbers[start:first] != numbers[start - lag : first - lag])
        if len(differ):
            first = start + int(differ[-1]) + 1
            break
        first, step = start, 2 * step
    return first, last - 1


def runs_of(numbers: np.ndarray) -> list:
    """``(start, length, period)`` of all runs of a text's word numbers, by start, then period."""
    n = len(numbers)
    if n < LEAST:
        return []
    back = _back(numbers)
    found: dict = {}
    longest = max((past - first for first, past in _stretches(back <= n // REPEATS, _needed(1))), default=0)
    codes, low, top = None, 0, 1
    while (low + 1) * REPEATS <= n and _needed(low + 1) <= longest:
        for lo, past in _stretches(back <= top, _needed(low + 1)):
            if codes is None:
                codes = mix(numbers.astype(np.uint64) + np.uint64(1))
            left = max(0, lo - top)
            lags, places = _starts(codes[left:past], low, top)
            places += left
            i = 0
            while i < len(lags):
                lag = int(lags[i])
                first, last = _follow(numbers, int(places[i]), lag)
                if last - first + 1 >= _needed(lag):
                    stretch = (first - lag, last - first + 1 + lag)
                    # Of several periods of a stretch the smallest is its own; classes come in ascending order.
                    found.setdefault(stretch, lag)
                # On to the first start beyond this match, or to the next lag.
                past_lag = int(np.searchsorted(lags, lag, "right"))
                i += int(np.searchsorted(places[i:past_lag], last, "right"))
        low, top = top, 2 * top
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list) -> list:
    """The words, without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, np.cumsum(change[:-1]) == 0))


def _scan():
    def scan(texts: pa.Array) -> pa.Array:
        counts, runs, collapsed = [], [], []
        for i in range(len(texts)):
            value = texts[i].as_py()
            # Splits at ASCII blanks, which are single bytes in UTF-8.
            words = value.encode().split() if value is not None else []
            found = runs_of(word_numbers(words))
            counts.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            collapsed.append(b" ".join(collapse(words, found)).decode())
        give_back_memory()
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.string())],
            fields=list(FOUND),
        )

    return F.arrow_udf(scan, FOUND_TYPE)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_words, runs, collapsed``.

    Words are what lies between ASCII blanks (``[\\x20\\x09-\\x0D]``). ``runs``
    lists ``start`` (word number from 0), ``length`` and ``period`` of every run
    by start, then period; ``collapsed`` is the text's words joined by one space,
    without those that any run holds after its first period.

    A null or blank text has no words, no runs and an empty ``collapsed``. Rows
    with null or repeated ids are rows like any other; an empty table gives no
    rows. Other columns are not read, whatever their names. Whole texts are
    taken, each by one task without a shuffle; a text needs some fifteen times
    its bytes there.
    """
    scan = _scan()
    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("found")).select(id_col, "found.*")


def longest_run(runs: str = "runs"):
    """The longest run of a list as a struct ``start, length, period``; ties go to the smaller start, then period."""
    ranked = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    run = F.struct((-ranked["s"]).alias("start"), ranked["length"].alias("length"), (-ranked["p"]).alias("period"))
    return F.when(F.size(runs) > 0, run)


def written_runs(runs: str = "runs"):
    """All runs of a list as text, one line ``start,length,period`` each."""
    line = F.transform(
        runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    )
    return F.array_join(line, "")
