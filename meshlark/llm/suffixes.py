"""Removal of recurring byte strings by a logarithmic family of suffix arrays.

The stretches in which a 200-byte string may recur are taken up in batches. A batch gets a suffix array over all its
suffixes that hold such a string; it is then merge-scanned against every level that stands (neighbours whose common
prefix is 200 bytes or more are a match), and as long as a level of its own size stands, the two arrays are merged in one linear
pass into a level of twice the size. Levels are tables in the shared folder, one row for each part of the index, so a
family of n batches has at most log2(n) + 1 of them, and every suffix is merged that often.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm._common import discard, partitions, stored
from meshlark.llm._passages import Units, chained, runs_of, without_recurring

WINDOW, ANCHOR = 200, 100
#: Batches in which a corpus that is given at once is taken up.
BATCHES = 4
#: Stretches of a part of the index, about.
PART = 4000
_GRAM = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "shard int, cid binary, lo int, hi int, ids binary, body binary, size binary, suffixes binary"
_ARROW = pa.schema([("shard", pa.int32()), ("cid", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), *((c, pa.binary()) for c in ("ids", "body", "size", "suffixes"))])


def _order(anchor: int):
    def order(texts: list[bytes]):
        body = b"".join(texts)
        n = len(body)
        gram = np.ndarray(n, "<u8", body + bytes(8), strides=(1,))

        def run(at: np.ndarray) -> np.ndarray:
            return chained([gram[at + k] for k in [*range(0, anchor - 8, 8), anchor - 8]])

        key = gram * _GRAM
        key ^= key >> np.uint64(32)
        return key * np.uint64(0xD6E8FEB86659FD93), run

    return order


class Level:
    """A suffix array of stretches: ids (16 bytes each), their joined bytes, their sizes, and the places of all suffixes of `window` bytes or more, in order.

    Suffixes are ordered by their first `window` bytes, which is all that a scan for matches of that length compares.
    """

    def __init__(self, ids: bytes, body: bytes, size: np.ndarray, suffixes: np.ndarray | None, window: int) -> None:
        self.ids, self.body, self.size, self.window = ids, body, size, window
        off = np.concatenate(([0], np.cumsum(size)))
        self.off = off
        if suffixes is None:
            steps = np.zeros(off[-1] + 1, np.int32)
            np.add.at(steps, off[:-1], 1)
            np.add.at(steps, off[1:] - window + 1, -1)
            starts = np.flatnonzero(np.cumsum(steps[:-1])).astype(np.int32)
            suffixes = starts[np.argsort(self.heads(starts), kind="stable")]
        self.suffixes = suffixes

    def heads(self, at: np.ndarray) -> np.ndarray:
        """The first `window` bytes of the suffixes at these places; all have so many, so zero bytes at the end are told apart."""
        return np.ndarray(max(len(self.body) - self.window + 1, 0), f"S{self.window}", self.body, strides=(1,))[at]

    def spans(self, matched: np.ndarray, shard: int) -> list[dict]:
        """Rows (cid, lo, hi) of the bytes under the matched suffixes."""
        mark = np.zeros(len(self.body) + 1, bool)
        mark[self.suffixes[matched]] = True
        runs = np.array(runs_of(mark), np.int64).reshape(-1, 2)  # none reaches from one stretch into the next
        owner = np.searchsorted(self.off, runs[:, 0], "right") - 1
        lo, hi = runs[:, 0] - self.off[owner], runs[:, 1] - 1 - self.off[owner] + self.window
        return [{"shard": shard, "cid": self.ids[16 * k : 16 * k + 16], "lo": a, "hi": b} for k, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True)]

    def row(self, shard: int) -> dict:
        return {"shard": shard, "ids": self.ids, "body": self.body, "size": self.size.astype(np.int32).tobytes(), "suffixes": self.suffixes.astype(np.int32).tobytes()}


def _neighbours_agree(heads: np.ndarray) -> np.ndarray:
    """Which heads of an ordered array equal the one before or after."""
    same = heads[1:] == heads[:-1]
    return np.append(same, False) | np.append(False, same) if len(heads) else np.empty(0, bool)


def first_level(rows: pa.Table, window: int) -> pa.Table:
    """The suffix array of a batch of stretches (shard, cid, many, body), and its own matches."""
    body = [x.as_py() for x in rows["body"]]
    level = Level(b"".join(x.as_py() for x in rows["cid"]), b"".join(body), np.fromiter(map(len, body), np.int64, len(body)), None, window)
    many = np.asarray(rows["many"].combine_chunks().to_numpy(zero_copy_only=False), bool)
    owner = np.searchsorted(level.off, level.suffixes, "right") - 1
    shard = rows["shard"][0].as_py()
    matched = _neighbours_agree(level.heads(level.suffixes)) | many[owner]
    return pa.Table.from_pylist([*level.spans(matched, shard), level.row(shard)], schema=_ARROW)


def merge_scan(new: pa.Table, old: pa.Table, window: int, merged: bool) -> pa.Table:
    """Matches between a part's rows of two levels, found where their merged order has neighbours of both; with merged, also the level of both."""
    if not new.num_rows or not old.num_rows:
        only = (new if new.num_rows else old).select(_ARROW.names)
        return only.cast(_ARROW) if merged else _ARROW.empty_table()
    a, b = (Level(t["ids"][0].as_py(), t["body"][0].as_py(), np.frombuffer(t["size"][0].as_py(), np.int32).astype(np.int64), np.frombuffer(t["suffixes"][0].as_py(), np.int32), window) for t in (new, old))
    shard = new["shard"][0].as_py()
    x, y = a.heads(a.suffixes), b.heads(b.suffixes)
    before = np.searchsorted(y, x)  # both are in order, so this is one walk along them
    meets = y[np.minimum(before, len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
    met = np.zeros(len(y) + 1, np.int32)  # runs of equal heads in y that some x meets
    hit = np.unique(before[meets])
    if len(hit):
        run_end = np.append(np.flatnonzero(y[1:] != y[:-1]) + 1, len(y))
        met[hit] = 1
        met[run_end[np.searchsorted(run_end, hit, "right")]] -= 1
    rows = [*a.spans(meets, shard), *b.spans(np.cumsum(met[:-1]) > 0, shard)]
    if merged:
        place = before + np.arange(len(x))
        order = np.empty(len(x) + len(y), np.int32)
        rest = np.ones(len(order), bool)
        rest[place] = False
        order[place], order[rest] = a.suffixes, b.suffixes + np.int32(len(a.body))
        rows.append(Level(a.ids + b.ids, a.body + b.body, np.concatenate((a.size, b.size)), order, window).row(shard))
    return pa.Table.from_pylist(rows, schema=_ARROW)


class Family:
    """Levels of suffix arrays, as tables; add() takes up a batch and gives its matches with all that came before, and within it."""

    def __init__(self, window: int) -> None:
        self.window, self.levels = window, []  # (batches, table), largest first

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """batch: shard, cid, many, body. Returns tables of (cid, lo, hi)."""
        window, found = self.window, []

        def kept(rows: DataFrame) -> DataFrame:
            """rows of a step, stored; its matches go to found."""
            table = stored(rows)
            found.append(stored(table.where(F.col("cid").isNotNull()).select("cid", "lo", "hi")))
            return table

        def met(x: DataFrame, y: DataFrame, merged: bool) -> DataFrame:
            own = [t.where(F.col("cid").isNull()).groupBy("shard") for t in (x, y)]
            return kept(own[0].cogroup(own[1]).applyInArrow(lambda a, b: merge_scan(a, b, window, merged), _SCHEMA))

        new, size = kept(batch.groupBy("shard").applyInArrow(lambda t: first_level(t, window), _SCHEMA)), 1
        while self.levels and self.levels[-1][0] == size:
            parts = new, self.levels.pop()[1]
            new, size = met(*parts, True), 2 * size
            discard(*parts)
        for _, old in self.levels:  # larger levels stay as they are
            discard(met(new, old, False))
        self.levels.append((size, new))
        return found


def matches(stretches: DataFrame, window: int, batches: int = BATCHES) -> DataFrame:
    """(cid, lo, hi) of the strings of `window` bytes that recur in stretches (cid, hash, many, body; stored). Equal strings have equal hashes."""
    parts = max(partitions(stretches.sparkSession), -(-stretches.count() // PART))
    rows = stretches.select(F.pmod("hash", F.lit(parts)).cast("int").alias("shard"), F.pmod(F.xxhash64("cid"), F.lit(batches)).alias("batch"), "cid", "many", "body")
    family, out = Family(window), []
    for k in range(batches):
        out += family.add(rows.where(F.col("batch") == k).drop("batch"))
    discard(*(table for _, table in family.levels))
    for other in out[1:]:
        out[0] = out[0].unionAll(other)
    return out[0]


def _digest(text: bytes, gone: np.ndarray) -> tuple:
    body = np.frombuffer(text, np.uint8)
    starts = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
    return len(text), int(gone.sum()), starts, hashlib.sha256(body[~gone].tobytes()).hexdigest()


def recurring_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, **columns) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes outside strings of `window` bytes that occur anywhere else.

    Null and empty texts have no bytes. Rows that repeat are documents of their own. Overlapping occurrences within one
    document count. Other columns of docs play no part. Anchors with more than _passages.CROWD stretches are settled by
    digests of windows; the rows are the same either way.
    """
    units = Units(window, anchor, bytes, bytes, _order(anchor))
    return without_recurring(docs, units, lambda s: matches(s, window), _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", (0, 0, 0, hashlib.sha256(b"").hexdigest()), **columns)


__all__ = ["Family", "Level", "matches", "recurring_bytes"]
