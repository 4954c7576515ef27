"""Chat transcripts: roles recovered by a hidden Markov model, then rendered as canonical turns.

States are a role and whether a line begins a turn or goes on with it; a line is seen as its speaker marker, whether a
blank line stands before it, and a few features of its words. The model is counted from labelled transcripts, Viterbi finds the states.

A conversation of any length is one sequence. It is kept in segments of bounded size; where it has several, each gives the
matrix of best scores from the state before it to the state at its end, the matrices of a conversation chain up to the
states between its segments, and each segment is then decoded between these: the same path as in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlark.llm._common import partitions, stored

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in ROLES for b in (True, False)]
#: Words that name a speaker.
SPEAKERS = {"system": ("system", "instructions", "sys"), "user": ("user", "human", "q", "question", "customer", "me", "prompter"), "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "model", "gpt")}
_MARK = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?\s*(" + "|".join(sorted((w for s in SPEAKERS.values() for w in s), key=len, reverse=True)) + r")\s*(?:\|?>|\]|\*\*)?\s*(?::\s*\**|(?<=[>\]*])|$)\s*", re.I)
_ROLE_OF = {w: r for r, s in SPEAKERS.items() for w in s}
#: Marker styles of transcripts: prefix of a turn by role, and what stands between turns.
STYLES = (
    ("System: ", "User: ", "Assistant: ", "\n\n"), ("### System:\n", "### Human:\n", "### Assistant:\n", "\n\n"), ("[system] ", "[user] ", "[assistant] ", "\n"),
    ("**Instructions:** ", "**Q:** ", "**A:** ", "\n\n"), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n", "\n"),
)
#: Transcripts that the model is counted from, at most, and the turns that one of them may have.
TRAINED_ON, TRAINED_TURNS = 2000, 64
#: Turns and characters at which a segment ends.
SEGMENT_TURNS, SEGMENT_CHARS = 4096, 1 << 21
_MARKERS = 4
_SYMBOLS = _MARKERS * 2 * 2 * 3 * 2


def observe(line: str, after_blank: bool = False) -> tuple[int, str]:
    """The symbol of a line, and the line without its marker."""
    m = _MARK.match(line)
    mark = 1 + ROLES.index(_ROLE_OF[m[1].lower()]) if m else 0
    body = line[m.end() :] if m else line
    n = len(body.split())
    return (((mark * 2 + after_blank) * 2 + body.rstrip().endswith("?")) * 3 + (0 if n == 0 else 1 if n < 12 else 2)) * 2 + (body[:1].isupper()), body


def observed(text: str, blank: bool = False) -> list[tuple[int, str]]:
    """observe() of all lines of a transcript; blank: whether a blank line stands before it."""
    out = []
    for line in text.split("\n"):
        out.append(observe(line, blank))
        blank = not line.strip()
    return out


def count_model(lines: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of start, transition and emission from transcripts of (state, symbol), with smoothing."""
    start, move, emit = np.ones(len(STATES)), np.ones((len(STATES), len(STATES))) * 0.1, np.ones((len(STATES), _SYMBOLS)) * 0.1
    for seq in lines:
        for k, (s, o) in enumerate(seq):
            emit[s, o] += 1
            if k:
                move[seq[k - 1][0], s] += 1
            else:
                start[s] += 1
    for a, (role, _) in enumerate(STATES):  # a turn goes on only in its own role
        for b, (other, begins) in enumerate(STATES):
            if not begins and other != role:
                move[a, b] = 1e-12
    start[[i for i, (_, b) in enumerate(STATES) if not b]] = 1e-12
    return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True))


def viterbi(symbols: list[int], model: tuple[np.ndarray, np.ndarray, np.ndarray], before: int | None = None, last: int | None = None) -> list[int]:
    """The best states of the symbols; of all sequences, or of those after the state `before` that end in `last`."""
    start, move, emit = model
    if not symbols:
        return []
    score, back = (start if before is None else move[before]) + emit[:, symbols[0]], []
    for o in symbols[1:]:
        ways = score[:, None] + move
        back.append(ways.argmax(0))
        score = ways.max(0) + emit[:, o]
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def passage(symbols: list[int], model: tuple[np.ndarray, np.ndarray, np.ndarray], first: bool) -> np.ndarray:
    """The best score from each state before the symbols to each state at their end; for the first segment all rows are the start's."""
    start, move, emit = model
    score = (np.tile(start, (len(STATES), 1)) if first else move) + emit[:, symbols[0]]
    for o in symbols[1:]:
        score = (score[:, :, None] + move[None]).max(1) + emit[:, o]
    return score


def boundaries(steps: list[np.ndarray]) -> list[int]:
    """The states at the ends of the segments on the best path, from their passages in order."""
    score, back = steps[0][0], []
    for step in steps[1:]:
        ways = score[:, None] + step
        back.append(ways.argmax(0))
        score = ways.max(0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def transcript(role: Column, text: Column, style: Column) -> Column:
    """A turn as it stands in a transcript: marker of its role in that style (none for an unknown role) and text."""
    mark = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in STYLES)), style + 1)
    which = F.coalesce(*(F.when(role == r, mark(k)) for k, r in enumerate(ROLES)), F.lit(""))
    return F.concat(which, F.coalesce(text, F.lit("")))


def transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, part, first, after_blank, roles, lines (of each turn) and text: the turns (conv_id, turn, role, text) of each conversation as a transcript, stored.

    Turns are in order of turn, then role and text; null turns come first, a null conv_id is a conversation. Every seventh turn but
    turn 0 stands without its marker. A conversation of more than SEGMENT_TURNS turns or SEGMENT_CHARS characters is in
    several parts, in the order of their numbers; it is first where it begins, and after_blank tells that a blank line stands before a part. Rows are dealt by range of all
    these columns and a row number, so no conversation and no repeated turn comes to one task.
    """
    spark = turns.sparkSession
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    bare = F.coalesce((F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7)) == 0), F.lit(False))
    line = transcript(F.when(~bare, F.col("role")), F.col("text"), style)
    rows = stored(turns.select(F.struct("conv_id").alias("conv"), "turn", "role", "text", line.alias("line"), F.monotonically_increasing_id().alias("row")))
    order = ["conv", "turn", "role", "text", "row"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("conv", "role", "line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        kind = None

        def out() -> pa.RecordBatch:
            nonlocal part
            part += 1
            columns = [pa.array([held[0][0]], kind), pa.array([part]), pa.array([[h[1] for h in held]], pa.list_(pa.string())), pa.array([[h[2] for h in held]], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["conv", "part", "roles", "turns"])

        for batch in batches:
            kind = batch.column("conv").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "line")), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= SEGMENT_TURNS or size >= SEGMENT_CHARS):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield out()

    cuts = stored(dealt.mapInArrow(cut, f"conv {rows.schema['conv'].dataType.simpleString()}, part long, roles array<string>, turns array<string>"))
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    sums = cuts.groupBy("conv").agg(F.count("*").alias("parts"), F.min("part").alias("begin"), F.max("part").alias("end"), F.sum(F.size("roles")).alias("n"), F.sum(chars).alias("chars"))
    known = cuts.join(stored(sums.where("parts > 1")), "conv", "left").withColumn("whole", F.coalesce((F.col("n") <= SEGMENT_TURNS) & (F.col("chars") <= SEGMENT_CHARS), F.lit(False)))
    # A short conversation that lies across an edge between tasks is put together again.
    whole = known.where("whole").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "roles", "turns"))).alias("p"))
    whole = whole.select("conv", F.col("p")[0]["part"].alias("part"), F.lit(True).alias("first"), F.lit(True).alias("final"), F.flatten("p.roles").alias("roles"), F.flatten("p.turns").alias("turns"))
    same = lambda c: F.coalesce(c, "part") == F.col("part")
    every = known.where("not whole").select("conv", "part", same("begin").alias("first"), same("end").alias("final"), "roles", "turns").unionAll(whole)
    between = F.element_at(F.array(*(F.lit(s[3]) for s in STYLES)), F.pmod(F.xxhash64("conv.conv_id"), F.lit(len(STYLES))).cast("int") + 1)
    every = every.withColumn("between", between)
    ends_blank = (F.length("between") > 1) | F.element_at("turns", -1).rlike("(?:^|\n)\\s*$")
    edges = every.where("not (first and final)").select("part", F.lag(ends_blank).over(W.partitionBy("conv").orderBy("part")).alias("after_blank"))
    blank = lambda k: F.when((k + 1 < F.size("turns")) | ~F.col("final"), F.length("between") - 1).otherwise(0)
    lines = F.transform("turns", lambda x, k: F.size(F.split(x, "\n")) + blank(k))
    text = F.concat(F.expr("array_join(turns, between)"), F.when(F.col("final"), "").otherwise(F.expr("substring(between, 2)")))
    return stored(every.join(edges, "part", "left").select("conv.conv_id", "part", "first", F.coalesce("after_blank", F.lit(False)).alias("after_blank"), "roles", lines.alias("lines"), text.alias("text")))


def train(labelled: DataFrame, most: int = TRAINED_ON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model counted from at most `most` transcripts of up to TRAINED_TURNS turns with known roles; the first in order of a hash, so reruns agree."""
    some = labelled.where("first").where(F.exists("roles", lambda r: r.isin(*ROLES)) & (F.size("roles") <= TRAINED_TURNS))
    rows = some.orderBy(F.xxhash64("conv_id"), "part").limit(most).select("roles", "text", "lines").collect()
    sequences = []
    for row in rows:
        symbols, at, seq = [o for o, _ in observed(row["text"])], 0, []
        for role, n in zip(row["roles"], row["lines"], strict=True):
            if role in ROLES:
                seq += [(STATES.index((role, k == 0)), o) for k, o in enumerate(symbols[at : at + n])]
            at += n
        sequences.append(seq)
    return count_model(sequences)


def parse(text: str, model: tuple[np.ndarray, np.ndarray, np.ndarray], blank: bool = False, before: int | None = None, last: int | None = None) -> list[tuple[str, str, bool]]:
    """(role, text, whether it begins here) of the turns of a transcript, or of a segment between two states."""
    seen = observed(text, blank)
    turns: list[tuple[str, list[str], bool]] = []
    for state, (_, body) in zip(viterbi([o for o, _ in seen], model, before, last), seen, strict=True):
        role, begins = STATES[state]
        if begins or not turns:
            turns.append((role, [], begins or before is None))
        turns[-1][1].append(body)
    return [(role, "\n".join(body).strip(), begins) for role, body, begins in turns]


def render(turns: list[tuple[str, str, bool]], first: bool = True, final: bool = True) -> str:
    """Canonical turns. Those of the segments of a conversation make one text when put together: what ends a turn stands before the next one, or at the end."""
    out = []
    for k, (role, text, begins) in enumerate(turns):
        out.append((("" if first and k == 0 else "\n<|end|>\n") + f"<|{role}|>\n" if begins else "\n") + text)
    return "".join(out) + ("\n<|end|>\n" if final and turns else "")


def segment_states(texts: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """part, before, last, final for the segments of conversations that have several: the states before and at the end, and whether it is the last."""
    several = texts.groupBy(F.struct("conv_id").alias("conv")).agg(F.count("*").alias("n")).where("n > 1").select("conv")
    rows = texts.select(F.struct("conv_id").alias("conv"), "part", "first", "after_blank", "text").join(several, "conv", "left_semi")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (part, first, blank, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "first", "after_blank", "text")), strict=True)):
                step = passage([o for o, _ in observed(text or "", blank)], model, first)
                yield pa.RecordBatch.from_arrays([batch.column("conv").slice(k, 1), pa.array([part]), pa.array([step.tobytes()], pa.binary())], names=["conv", "part", "step"])

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        ends = boundaries([np.frombuffer(x.as_py()).reshape(len(STATES), -1) for x in t["step"]])
        return pa.table({"part": t["part"], "before": pa.array([None, *ends[:-1]], pa.int32()), "last": pa.array(ends, pa.int32()), "final": pa.array([False] * (len(ends) - 1) + [True])})

    kind = rows.schema["conv"].dataType.simpleString()
    steps = stored(rows.mapInArrow(passages, f"conv {kind}, part long, step binary"))
    return steps.groupBy("conv").applyInArrow(chain, "part long, before int, last int, final boolean")


def format_chats(texts: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], keep: tuple[str, ...] = ("conv_id", "part")) -> DataFrame:
    """keep columns, n_turns, recovered (the roles, joined by spaces) and rendered of every row of transcripts(). Empty ones have no turns.

    n_turns and recovered count the turns that begin in a part; the rendered texts of a conversation's parts make one when put together.
    """
    rows = texts.join(segment_states(texts, model), "part", "left").select(*keep, F.coalesce("text", F.lit("")).alias("_text"), F.col("first").alias("_first"), F.col("after_blank").alias("_blank"), F.col("before").alias("_before"), F.col("last").alias("_last"), F.coalesce("final", F.lit(True)).alias("_final"))
    schema = rows.select(*keep).withColumns({"n_turns": F.lit(0), "recovered": F.lit(""), "rendered": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = list(zip(*(batch.column(c).to_pylist() for c in ("_text", "_first", "_blank", "_before", "_last", "_final")), strict=True))
            got = [parse(x, model, blank, before, last) if x else [] for x, _, blank, before, last, _ in given]
            begun = [[r for r, _, begins in t if begins] for t in got]
            rendered = [render(t, first, final) for t, (_, first, _, _, _, final) in zip(got, given, strict=True)]
            columns = [pa.array(map(len, begun), pa.int32()), pa.array([" ".join(r) for r in begun], pa.string()), pa.array(rendered, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "n_turns", "recovered", "rendered"])

    return rows.mapInArrow(run, schema)
