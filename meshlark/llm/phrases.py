"""Removal of recurring passages of words by Aho-Corasick automata.

Passages are confirmed first: windows of 35 words that a part of the index meets in more than one stretch, and stretches
that more than one text holds. Each part compiles the passages of its anchors into an automaton over word numbers, and
all documents stream through the parts that own one of their anchors (the stretch around it, equal stretches once), since
no other part can match them. Occurrences are what the automaton locates: a passage that it locates once is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshlark.llm._common import partitions
from meshlark.llm._passages import Units, chained, mixed, runs_of, without_recurring

WINDOW, ANCHOR = 35, 12
#: Stretches that an automaton serves, at least; anchors are not split, and have at most CROWD stretches.
SERVED = 4000


def _order(anchor: int):
    def order(texts: list[list[bytes]]):
        import xxhash

        h = np.fromiter((xxhash.xxh64_intdigest(w) for t in texts for w in t), np.uint64)
        return h, lambda at: chained([h[at + k] for k in range(anchor)])

    return order


def repeated_windows(numbers: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """Places in the joined stretches (word numbers, sizes) of the first of each windows that several stretches seem to hold, by their hashes."""
    off = np.concatenate(([0], np.cumsum(size)))
    h = mixed(numbers.astype(np.uint64) + np.uint64(1))
    starts = np.concatenate([np.arange(a, max(a, b - window + 1)) for a, b in zip(off[:-1], off[1:], strict=True)])
    width, run = 1, h
    powers = []
    while 2 * width <= window:
        powers.append((width, run))
        run = mixed(run[:-width] * np.uint64(0xD6E8FEB86659FD93) + run[width:])
        width *= 2
    out, done = run[starts], width
    for w, r in reversed(powers):
        if done + w <= window:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + r[starts + done])
            done += w
    _, first, count = np.unique(out, return_index=True, return_counts=True)
    return starts[first[count > 1]]


def located(stretches: list[list[bytes]], many: list[bool], window: int) -> list[tuple[int, int, int]]:
    """(stretch, lo, hi) of the words under passages that the automaton of these stretches finds twice or more."""
    import ahocorasick

    number: dict[bytes, int] = {}
    ids = [tuple([number.setdefault(w, len(number)) for w in s]) for s in stretches]
    joined = np.fromiter((x for s in ids for x in s), np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    words = joined.tolist()
    passages = {tuple(words[at : at + window]) for at in repeated_windows(joined, np.fromiter(map(len, ids), np.int64, len(ids)), window).tolist()}
    passages.update(s for s, again in zip(ids, many, strict=True) if again)
    for k, passage in enumerate(passages):
        automaton.add_word(passage, (k, len(passage)))
    if not passages:
        return []
    automaton.make_automaton()
    at = [(i, end + 1 - n, end + 1, k) for i, s in enumerate(ids) for end, (k, n) in automaton.iter(s)]
    where, lo, hi, which = np.array(at, np.int64).T
    weight = 1 + np.array(many, np.int64)
    again = np.bincount(which, weight[where], len(passages)) > 1
    where, lo, hi = where[again[which]], lo[again[which]], hi[again[which]]
    off = np.concatenate(([0], np.cumsum([len(s) + 1 for s in ids])))  # a place between stretches keeps their spans apart
    steps = np.zeros(off[-1] + 1, np.int64)
    np.add.at(steps, off[where] + lo, 1)
    np.add.at(steps, off[where] + hi, -1)
    spans = np.array(runs_of(np.cumsum(steps[:-1]) > 0)).reshape(-1, 2)
    owner = np.searchsorted(off, spans[:, 0], "right") - 1
    return list(zip(owner.tolist(), (spans[:, 0] - off[owner]).tolist(), (spans[:, 1] - off[owner]).tolist(), strict=True))


def occurrences(stretches: DataFrame, window: int) -> DataFrame:
    """(cid, lo, hi) of recurring places of stretches (cid, hash, many, body): one automaton for the anchors of every SERVED stretches or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def answer(rows: list[tuple]) -> pa.RecordBatch:
            spans = located([r[3].split(b" ") for r in rows], [r[2] for r in rows], window)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _, _ in spans], pa.binary()), pa.array([lo for _, lo, _ in spans], pa.int32()), pa.array([hi for _, _, hi in spans], pa.int32())], names=["cid", "lo", "hi"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("cid", "hash", "many", "body")), strict=True)
            if len(held) >= SERVED:  # whole anchors only
                end = next((i for i in range(len(held) - 1, 0, -1) if held[i][1] != held[i - 1][1]), 0)
                if end:
                    yield answer(held[:end])
                    held = held[end:]
        if held:
            yield answer(held)

    n = partitions(stretches.sparkSession)
    return stretches.select("cid", "hash", "many", "body").repartition(n, "hash").sortWithinPartitions("hash").mapInArrow(run, "cid binary, lo int, hi int")


def _digest(words: list[bytes], gone: np.ndarray) -> tuple:
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def recurring_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, **columns) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the words outside windows that occur anywhere else.

    Null and blank texts have no words. Texts of fewer than `window` words lose none. Rows that repeat are documents of
    their own, so they remove each other's words; so do overlapping windows within one document. Other columns of docs play no part.
    Anchors with more than _passages.CROWD stretches are settled by digests of windows; the rows are the same either way.
    """
    units = Units(window, anchor, bytes.split, b" ".join, _order(anchor))
    return without_recurring(docs, units, lambda s: occurrences(s, window), _digest, "n_words long, n_removed long, kept_sha256 string", (0, 0, hashlib.sha256(b"").hexdigest()), **columns)
