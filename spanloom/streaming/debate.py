"""Debates over disputed labels: replay of turn logs, agreement, escalation, outcomes.

A debate is a sequence of turns of one comment. Its state is what the participants said last, so a
log is replayed per comment; logs are bounded by the number of turns a debate may have.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.worklist import parse_block

#: Turns of two participants, and turns after a third has joined.
MAX_TURNS, MAX_EXTRA = 6, 6
# The lines in which a turn states its verdict and asks its questions.
VERDICT_LINE, VERDICT_WORDS = "VERDICT:", ("A", "B", "NEUTRAL", "CUSTOM", "UNSURE")
QUESTION_LINES = ("QUESTION FOR A & B:", "QUESTION FOR A AND B:")

SUMMARY = "comment_id string, opener string, outcome string, consensus string, majority string, escalated boolean, n_turns int, n_questions int"


@dataclass(frozen=True)
class Turn:
    """What a turn says: its last verdict (UNSURE without one), its last proposed pairs, its questions."""

    verdict: str
    proposal: tuple | None
    questions: tuple[str, ...]


def read_turn(content: str | None) -> Turn:
    """Read a turn line by line.

    A proposal starts at a line ``- emotion:`` and reaches to the next verdict line or the end; it
    counts by its parsed pairs, so blanks and the order of fields make no difference. A proposal whose
    values can't be parsed counts by its text.
    """
    verdict, block, last, questions = "UNSURE", [], None, []
    for line in [*(content or "").splitlines(), VERDICT_LINE]:
        text = line.strip()
        head = text.upper()
        if head.startswith(VERDICT_LINE):
            word = re.split(r"\W", text[len(VERDICT_LINE) :].strip(), maxsplit=1)[0].upper()
            verdict = word if word in VERDICT_WORDS else verdict
            last, block = tuple(block) or last, []
            continue
        if block or line.startswith("- emotion:"):
            block.append(text)
        for q in QUESTION_LINES:
            if head.startswith(q) and text[len(q) :].strip():
                questions.append(text[len(q) :].strip())
    if last is None:
        return Turn(verdict, None, tuple(questions))
    try:
        return Turn(verdict, tuple(tuple(sorted(p.items(), key=lambda kv: kv[0])) for p in parse_block(list(last))), tuple(questions))
    except ValueError:
        return Turn(verdict, last, tuple(questions))


def scripted(cid: str, turn: int) -> str:
    """A stand-in for a model: each speaker holds its own view for some turns, drawn from the id, then gives way.

    Even turns argue for A, odd ones for B. A speaker that gives way adopts the other's letter, or a
    pair of its own on every fifth id; the first turn of a speaker that will propose one asks a question.
    """
    draw = zlib.crc32(cid.encode())
    own, other = "AB"[turn % 2], "BA"[turn % 2]
    patience = 1 + (draw >> (4 * (turn % 2))) % 9
    custom = draw % 5 == 0
    if turn // 2 < patience:
        asked = "QUESTION FOR A & B: which words carry the feeling?\n" if custom and turn < 2 else ""
        return f"{asked}I stay with my reading.\nVERDICT: {own}"
    if custom:
        return "- emotion: surprise\n  emotion_span: x\n  intensity: 0.5\nVERDICT: CUSTOM"
    return f"The other reading is better.\nVERDICT: {other}"


@dataclass
class Position:
    """A participant's last verdict, and its last proposal, which only counts with the verdict CUSTOM."""

    verdict: str = "UNSURE"
    proposal: tuple | None = None

    def key(self) -> tuple:
        return (self.verdict, self.proposal if self.verdict == "CUSTOM" else None)


def unanimous(positions: list[tuple]) -> bool:
    """All say the same, it is a verdict, and a custom one has pairs."""
    verdict, proposal = positions[0]
    return positions.count(positions[0]) == len(positions) and verdict != "UNSURE" and (verdict != "CUSTOM" or proposal is not None)


def play(cid: str, models: tuple[str, str], third: str | None, speak: Callable[[str, int], str], prior: list[str] = ()) -> dict:
    """Run a debate to its end; ``prior`` turns are replayed, later ones come from ``speak``.

    Two participants take turns, the one drawn from the id first, until they agree after both have
    spoken or ``MAX_TURNS`` are used. A third, if there is one, then joins and opens a second phase
    of ``MAX_EXTRA`` turns. Without agreement at its end the outcome is a split, with the verdict of
    two or more as majority.
    """
    order = list(models)
    if int(hashlib.md5(cid.encode()).hexdigest(), 16) >> 8 & 1:
        order.reverse()
    phases = [(order, MAX_TURNS)] + ([([third, *order], MAX_EXTRA)] if third is not None else [])
    state = {m: Position() for m in order}
    asked: dict[str, None] = {}
    at, agreed, phase = 0, False, 0
    for phase, (speakers, most) in enumerate(phases):
        state.update({m: Position() for m in speakers if m not in state})
        for k in range(most):
            turn = read_turn(prior[at] if at < len(prior) else speak(cid, at))
            at += 1
            me = state[speakers[k % len(speakers)]]
            me.verdict = turn.verdict
            me.proposal = turn.proposal or me.proposal
            asked.update(dict.fromkeys(turn.questions))
            agreed = k > 0 and unanimous([p.key() for p in state.values()])
            if agreed:
                break
        if agreed:
            break
    keys = [p.key() for p in state.values()]
    top = max(keys, key=keys.count)
    majority = top[0] if keys.count(top) >= 2 and top[0] != "UNSURE" else None
    return {
        "comment_id": cid, "opener": order[0], "outcome": "consensus" if agreed else "split", "consensus": keys[0][0] if agreed else None,
        "majority": None if agreed else majority, "escalated": phase > 0, "n_turns": at, "n_questions": len(asked),
    }


def debates(ids: DataFrame, models: tuple[str, str] = ("m1", "m2"), third: str | None = "m3", speak: Callable[[str, int], str] = scripted) -> DataFrame:
    """One summary per comment id."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([play(c, models, third, speak) for c in f["comment_id"]], columns=[x.split()[0] for x in SUMMARY.split(", ")])

    return ids.select("comment_id").mapInPandas(run, SUMMARY)


def valid_prefix(turns: DataFrame, speaker: str = "model", expected: str = "expected") -> DataFrame:
    """The longest prefix of each log whose speakers are the expected ones."""
    bad = turns.where(~F.col(speaker).eqNullSafe(F.col(expected))).groupBy(F.col("comment_id").alias("b_id")).agg(F.min("turn").alias("b_turn"))
    j = turns.join(bad, F.col("comment_id") == F.col("b_id"), "left")
    return j.where(F.col("b_turn").isNull() | (F.col("turn") < F.col("b_turn"))).drop("b_id", "b_turn")


def without_stale(turns: DataFrame, debates: DataFrame) -> DataFrame:
    """Turns that belong to their debate as it ended: below its own number of turns (``comment_id, n_turns``).

    What a superseded, longer run left behind goes, and so do turns of unknown debates.
    """
    n = debates.select(F.col("comment_id").alias("n_id"), "n_turns")
    return turns.join(n, (F.col("comment_id") == F.col("n_id")) & (F.col("turn") < F.col("n_turns"))).drop("n_id", "n_turns")


def questions(turns: DataFrame) -> DataFrame:
    """``comment_id, questions``: the questions of each debate in the order they were first asked."""
    per = turns.groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.questions("content").alias("q")))).alias("t"))
    return per.select("comment_id", T.in_first_order(F.flatten(F.transform("t", lambda x: x["q"]))).alias("questions")).where(F.size("questions") > 0)


def contiguous(turns: DataFrame) -> DataFrame:
    """``comment_id, n, whole``: whether the turns are exactly 0 .. n-1."""
    return turns.groupBy("comment_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi")).select("comment_id", "n", ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("whole"))


def positions(turns: DataFrame) -> DataFrame:
    """``comment_id, model, verdict, block``: each speaker's last position in a log."""
    t = turns.select("comment_id", "model", "turn", T.verdict("content").alias("verdict"), T.custom_block("content").alias("block"))
    return t.groupBy("comment_id", "model").agg(F.max_by("verdict", "turn").alias("verdict"), F.max_by("block", F.when(F.col("block").isNotNull(), F.col("turn"))).alias("block"))


def agreement(pos: DataFrame) -> DataFrame:
    """``comment_id, unanimous, majority`` over positions; custom ones are equal only if their blocks are."""
    key = F.struct("verdict", F.when(F.col("verdict") == "CUSTOM", F.col("block")).alias("block"))
    per = pos.select("comment_id", key.alias("k")).groupBy("comment_id", "k").agg(F.count(F.lit(1)).alias("c"))
    best = per.groupBy("comment_id").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("k", "c").alias("k"), F.max("c").alias("c"))
    sure = F.col("k.verdict") != "UNSURE"
    named = (F.col("k.verdict") != "CUSTOM") | F.col("k.block").isNotNull()
    return best.select("comment_id", ((F.col("kinds") == 1) & sure & named).alias("unanimous"), F.when((F.col("c") >= 2) & sure, F.col("k.verdict")).alias("majority"))
