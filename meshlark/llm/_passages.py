"""Passages that recur anywhere in the corpus, found without shuffling every window of every text.

Texts are units: words or bytes. Each window of W units has an anchor, the run of k units that begins where a short hash
is least among the runs inside it (the leftmost of equals), so equal windows have equal anchors at equal places. Only
anchors that occur twice can carry a recurring window. The stretch of a text that holds all windows of such an anchor goes
to the part of the corpus-wide index that owns the anchor, equal stretches once, and the answer is joined back.

Equal texts are one text with a count, so a group of copies, whatever its size, is one row in all that follows. An anchor
with more than CROWD different stretches is settled by 128-bit digests of its windows instead, one key a window, so no part of
the index gets more than that many stretches of one anchor; the rows are the same either way.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm._common import discard, partitions, shared_dir, shuffles_dropped, stored

#: Bytes of text whose anchors are sought together; longer texts are taken in overlapping pieces.
TOGETHER = 1 << 20
#: Different stretches of an anchor that go to one part of the index.
CROWD = 1000
_PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Units:
    """What a text is made of. split: bytes -> list of words, or the bytes; join: its inverse for a slice; hashes: (order, run words) of many split texts."""

    window: int
    anchor: int
    split: Callable
    join: Callable
    order: Callable


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(words: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of the values that stand at the same index of all arrays."""
    out = np.full(len(words[0]), 0x9E3779B97F4A7C15, np.uint64)
    for w in words:
        out = mixed((out ^ w) * np.uint64(0xD6E8FEB86659FD93))
    return out


def least_ahead(key: np.ndarray, w: int) -> np.ndarray:
    """The least of key[i : i + w] for each i that has so many, by doubling."""
    width = 1
    while 2 * width <= w:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    return key if width == w else np.minimum(key[: len(key) - (w - width)], key[w - width :])


def anchors_of(texts: list, units: Units) -> tuple[np.ndarray, ...]:
    """(text number, anchor place, first window, last window, anchor hash) of each anchor of the texts, in order."""
    window, w = units.window, units.window - units.anchor + 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    off = np.concatenate(([0], np.cumsum(size)))
    if off[-1] < window:
        return (np.empty(0, np.int64),) * 5
    order, run = units.order(texts)
    key = (order & ~_PLACE) | np.arange(len(order), dtype=np.uint64)
    place = (least_ahead(key, w) & _PLACE).astype(np.int64)
    steps = np.zeros(off[-1] + 1, np.int32)
    has = size >= window
    steps[off[:-1][has]] += 1
    np.add.at(steps, off[:-1][has] + size[has] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(steps[:-1]))
    place = place[starts]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(starts) != 1)))
    first, last = starts[new], starts[np.append(new[1:], True)]
    place = place[new]
    text = np.searchsorted(off, first, "right") - 1
    return text, place - off[text], first - off[text], last - off[text], run(place).view(np.int64)


def _pieces(texts: list, window: int) -> Iterator[tuple[list, list[tuple[int, int]]]]:
    """Lists of pieces of texts of about TOGETHER bytes, and the text number and offset of each piece; every window lies in one piece."""
    held, where, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), TOGETHER):
            piece = text[at : at + TOGETHER + window - 1]
            held.append(piece)
            where.append((k, at))
            size += len(piece)
            if size >= TOGETHER:
                yield held, where
                held, where, size = [], [], 0
    if held:
        yield held, where


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (half a SHA-256), text (bytes) and copies of each distinct text that is neither null nor empty, bucketed by key in the shared folder."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.where(F.length(text) > 0).select(_key(text).alias("key"), text.cast("binary").alias("text"))
    rows = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"meshlark_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        rows.write.option("path", f"{shared_dir(spark)}/meshlark-tables/{name}").option("compression", "zstd").bucketBy(partitions(spark), "key").format("parquet").saveAsTable(name)
    return spark.table(name)


def _key(text):
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


_ANCHOR = "key binary, place int, first int, last int, hash long"
_STRETCH = "key binary, start int, cid binary, hash long, suspect boolean, many boolean, body binary"
_STRETCH_TYPES = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]


def recurring_spans(texts: DataFrame, units: Units, spans_of: Callable[[DataFrame], DataFrame], crowd: int = CROWD) -> DataFrame:
    """(key, spans): for each distinct text with recurring windows, the places [lo, hi) in units that they cover, unordered.

    spans_of(stretches: cid, hash, many, body) -> (cid, lo, hi), the recurring places of stretches. Stretches of an anchor
    share its hash, equal stretches come once, with many set.
    """
    window = units.window

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), object)
            for pieces, where in _pieces([units.split(t.as_py()) for t in batch.column("text")], window):
                text, *found = anchors_of(pieces, units)
                number, at = np.array(where).T
                place, first, last = (x + at[text] for x in found[:3])
                yield pa.RecordBatch.from_arrays([pa.array(keys[number[text]], pa.binary()), *(pa.array(x.astype(np.int32)) for x in (place, first, last)), pa.array(found[3])], names=["key", "place", "first", "last", "hash"])

    # A text with copies recurs whole and needs no answer, but others may share windows with it.
    rows = stored(texts.select("key", "text").mapInArrow(anchors, _ANCHOR))
    # Written, so that the join deals out its rows itself and can split an anchor that very many texts share.
    again = stored(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", (F.col("n") > crowd).alias("suspect")))
    hits = rows.join(again, "hash").groupBy("key").agg(F.collect_list(F.struct("first", "last", "hash", "suspect")).alias("hits"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ends, fields = _lists(batch.column("hits"))
            first, last, hash_, suspect = (fields[c].tolist() for c in ("first", "last", "hash", "suspect"))
            for k, (key, text, copies) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("copies").to_pylist(), strict=True)):
                parts, many = units.split(text.as_py()), copies > 1
                for i in range(ends[k], ends[k + 1]):
                    body = units.join(parts[first[i] : last[i] + window])
                    cid = hashlib.blake2b(body, digest_size=16, salt=hash_[i].to_bytes(8, "little", signed=True)).digest()
                    out.append((key, first[i], cid, hash_[i], suspect[i], many, body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STRETCH_TYPES, strict=True)], names=[x.split()[0] for x in _STRETCH.split(", ")])

    found = stored(texts.join(hits, "key").mapInArrow(_merged(stretches), _STRETCH))
    discard(rows, again)
    one = [F.first(c).alias(c) for c in ("hash", "suspect", "body")]
    once = stored(found.groupBy("cid").agg(*one, ((F.count("*") > 1) | F.max("many")).alias("many")))
    suspects = once.where("suspect")
    crowded = stored(suspects.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("hash"))
    columns = ["cid", "hash", "many", "body"]
    quiet = once.where("not suspect").select(*columns).unionAll(suspects.join(crowded, "hash", "left_anti").select(*columns))
    answers = spans_of(quiet).select("cid", "lo", "hi").unionAll(_by_digest(suspects.join(crowded, "hash", "left_semi"), units))
    per = stored(answers.groupBy("cid").agg(F.collect_list(F.struct("lo", "hi")).alias("s")))  # written for the same reason: a stretch may have very many places
    spans = found.select("key", "start", "cid").join(per, "cid").select("key", F.explode("s").alias("s"), "start")
    return spans.groupBy("key").agg(F.collect_set(F.struct((F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi"))).alias("spans"))


def _by_digest(stretches: DataFrame, units: Units) -> DataFrame:
    """(cid, lo, hi) of the windows of stretches whose 128-bit digest occurs again, or whose stretch does."""
    window = units.window

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, many, body in zip(batch.column("cid").to_pylist(), batch.column("many").to_pylist(), batch.column("body").to_pylist(), strict=True):
                parts = units.split(body)
                digests = [hashlib.blake2b(units.join(parts[k : k + window]), digest_size=16).digest() for k in range(len(parts) - window + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([cid] * len(digests), pa.binary()), pa.array(range(len(digests)), pa.int32()), pa.array(digests, pa.binary()), pa.array([many] * len(digests), pa.bool_())], names=["cid", "lo", "digest", "many"])

    rows = stored(stretches.select("cid", "many", "body").mapInArrow(_merged(windows), "cid binary, lo int, digest binary, many boolean"))
    again = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 or many").select("digest"))
    return rows.join(again, "digest").select("cid", "lo", (F.col("lo") + window).alias("hi"))


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    """[a, b) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _merged(f: Callable) -> Callable:
    """f with its small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in f(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= 4_000_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _lists(column: pa.ListArray) -> tuple[list[int], dict[str, np.ndarray]]:
    """Where the lists of structs of a column begin and end, and their fields; a null is an empty list."""
    rows = column.flatten()
    size = column.value_lengths().fill_null(0).to_numpy()
    fields = {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type}
    return np.concatenate(([0], np.cumsum(size))).tolist(), fields


def covered(n: int, lo: np.ndarray, hi: np.ndarray, whole: bool) -> np.ndarray:
    """Which of n units lie in a span [lo, hi); all of them if whole."""
    if whole or not len(lo):
        return np.full(n, whole)
    return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:-1] > 0


def without_recurring(docs: DataFrame, units: Units, spans_of: Callable[[DataFrame], DataFrame], digest: Callable, schema: str, empty: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and the columns of schema. digest(parts, mask of recurring units) -> a tuple of them; empty: the tuple for null and empty texts."""
    texts = distinct_texts(docs, text_col)
    names = [x.split()[0] for x in schema.split(", ")]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ends, fields = _lists(batch.column("spans"))
            for k, (key, text, copies) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("copies").to_pylist(), strict=True)):
                parts = units.split(text.as_py())
                lo, hi = (fields[c][ends[k] : ends[k + 1]] for c in ("lo", "hi"))
                out.append((key, *digest(parts, covered(len(parts), lo, hi, copies > 1 and len(parts) >= units.window))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", *names])

    per = texts.join(recurring_spans(texts, units, spans_of), "key", "left").mapInArrow(results, f"key binary, {schema}")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.length(text) > 0, _key(text)).alias("key"))
    return rows.join(per, "key", "left").select("doc_id", *(F.coalesce(c, F.lit(e)).alias(c) for c, e in zip(names, empty, strict=True)))


__all__ = ["Units", "anchors_of", "chained", "mixed", "recurring_spans", "runs_of", "without_recurring"]
