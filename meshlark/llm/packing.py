"""Best-fit packing of documents into sequences of a fixed length.

The plan is made over the histogram of piece lengths (at most `capacity` counts, whatever the corpus), and each piece
then takes the planned slot that has its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlark.llm._common import partitions, stored

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Bytes of chunks between blanks, and of their ids, that a worker remembers; beyond that it forgets all that the next texts do not use.
REMEMBERED = 32 << 20
#: What a remembered chunk costs besides its bytes and ids.
ENTRY = 150
#: Bytes of text that are encoded together.
TOGETHER = 2_000_000


#: Where a mark ends a word: a splitter that parts letters, digits and marks cuts here anyway.
_MARK_AFTER = re.compile(rb"(?<=[a-z0-9])(?=[.,;:!?](?:\s|$))")


def _visible_bytes() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in prints)}


@functools.cache
def _encoder(path: str, end_id: int):
    """One for all tasks of a worker: texts -> their little-endian 32-bit ids.

    No pattern of the tokenizer's splitter spans a blank, so each chunk between blanks is encoded once. If the tokenizer
    makes A-Z small and parts letters from marks (which is tried on all Latin letters), chunks are lower-cased first,
    marks at their ends are chunks of their own, and letters alone go straight to its model.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
    mark, mark_id = next(iter(special.items()), (b"", -1))
    known: dict[bytes, bytes] = {}
    held = 0
    end, model, visible = end_id.to_bytes(4, "little"), tokenizer.model, _visible_bytes()

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(chunk: bytes) -> bytes | None:
        """Ids of a chunk of Latin letters, none for other chunks."""
        if chunk.isalpha():
            word = chunk.decode().lower()
        else:
            small = chunk.decode().lower()
            if not small.isalpha() or max(small) >= "\u0250":
                return None
            word = small.encode().decode("latin-1").translate(visible)
        return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(word)])

    def simple() -> bool:
        latin = [x for x in map(chr, range(0x250)) if x.isalpha()]
        words = [y for x in latin for y in (x, f"{x}{x}", f"an{x}er")]
        if any(letters(w.encode()) not in (None, got.tobytes()) for w, got in zip(words, ids(words), strict=True)):
            return False
        pairs = [(x, y) for x in "abcdefghijklmnopqrstuvwxyz0123456789" for y in ".,;:!?"]
        alone = dict(zip(got := sorted({c for p in pairs for c in p}), (x.tobytes() for x in ids(got)), strict=True))
        return all(x.tobytes() == alone[p[0]] + alone[p[1]] for p, x in zip(pairs, ids(["".join(p) for p in pairs]), strict=True))

    parted = simple()

    def chunks_of(text: bytes) -> list[bytes]:
        if parted:
            small = text.lower()
            if all(small.count(s) == text.count(s) for s in special):
                return _MARK_AFTER.sub(b" ", small).split()
        return text.split()

    def learn(chunks: list[bytes]) -> None:
        """A special token between the chunks shows where the ids of each begin."""
        if parted:
            for c in chunks:
                if (got := letters(c)) is not None:
                    known[c] = got
            chunks = [c for c in chunks if c not in known]
        plain = [c for c in chunks if not any(s in c.lower() for s in special)] if mark else []
        if plain:
            got = ids([mark.join(plain).decode()])[0]
            cuts = [-1, *np.flatnonzero(got == mark_id).tolist(), len(got)]
            raw = got.tobytes()
            if len(cuts) == len(plain) + 1:
                known.update(zip(plain, (raw[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        other = [c for c in chunks if c not in known]
        known.update(zip(other, (x.tobytes() for x in ids([c.decode() for c in other])), strict=True))

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal held
        split = [chunks_of(t) for t in texts]
        here = set().union(*split)
        if held > REMEMBERED:  # keep what these texts use
            used = {c: known[c] for c in here if c in known}
            known.clear()
            known.update(used)
            held = sum(len(c) + len(x) + ENTRY for c, x in used.items())
        new = [c for c in here if c not in known]
        learn(new)
        held += sum(len(c) + len(known[c]) + ENTRY for c in new)
        return [b"".join([known[c] for c in chunks]) + end for chunks in split]

    return encode


def _together(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        part.append(text or b"")
        size += len(part[-1])
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Only documents of more than `capacity` ids are cut.

    A null text counts as empty and gives one piece that holds the end id; a null id stays null; repeated rows are
    packed as often as they occur. tokenizer: path of a `tokenizers` file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, end_id)
        step = 4 * capacity
        for batch in batches:
            docs_of, done = batch.column(0).to_pylist(), 0
            for texts in _together(batch.column(1).to_pylist()):
                rows = [(doc, k, at // 4, len(part) // 4, zlib.crc32(part)) for doc, ids in zip(docs_of[done:], encode(texts), strict=False) for k, at in enumerate(range(0, len(ids), step)) for part in (ids[at : at + step],)]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, ranks, first sequence, pieces a sequence, first offset) runs.

    All pieces of a length are placed at once: a run of sequences with the same room left takes as many each as fit, so
    the work and the plan depend on the capacity and not on how many pieces there are.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences
    rooms: list[int] = []
    runs, fresh = [], 0

    def put(left: int, run: tuple[int, int]) -> None:
        if left:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append(run)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    rooms.pop(at)
            else:
                left, first, n = capacity, fresh, -(-count // (capacity // length))
                fresh += n
            each = left // length
            used = min(n, count // each)
            if not used:
                used, each = 1, count
            runs.append((length, rank, used * each, first, each, capacity - left))
            put(left - each * length, (first, used))
            if n > used and left < capacity:
                put(left, (first + used, n - used))
            elif n > used:  # a fresh sequence that the rest of this length goes to
                rest = count - used * each
                runs.append((length, rank + used * each, rest, first + used, rest, 0))
                put(capacity - rest * length, (first + used, 1))
                count -= rest
                rank += rest
            count -= used * each
            rank += used * each
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length, and row, a number that tells rows apart) and their sequence_id and offset. pieces is read twice: store it first.

    Ranks within a length come from counts by (length, salt of row), so a length that most pieces share is ranked in as
    many tasks as there are salts, be they of one repeated document. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    salts = 4 * partitions(spark)
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_slots(histogram, capacity), "plan_length long, first_rank long, ranks long, first_sequence long, each long, first_offset long")
    ranked = rows.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("length", "salt").orderBy("row")) - 1)
    at = F.col("rank") - F.col("first_rank")
    # The plan's size follows from the capacity alone, so it may be broadcast.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length")) & (at >= 0) & (at < F.col("ranks")))
    return placed.select(*pieces.columns, (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("first_offset") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, **columns) -> DataFrame:
    """Tokenizes, cuts and packs docs; see token_pieces and pack. Columns of docs other than the id and the text play no part."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id, **columns)
    return pack(stored(pieces.withColumn("row", F.monotonically_increasing_id())), capacity).drop("row")
