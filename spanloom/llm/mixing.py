"""Mixing sources to target weights (problem 9): dependent rounding of fractional copies.

Goals. Every source asks for its weight of all tokens. A source that is short even when all its
documents are used ``max_repeats`` times gives everything it has, and what it lacks is asked of the
others in proportion to their weights, again and again until nobody is short of what is asked
(``goals``). So the mix reaches its full size, the sources that aren't short stand to each other as
their weights do, and no other mix of that size has this property.

Rounding. A source gets the same fractional number of copies for each of its documents. The whole
part is taken as it is; the fractions are rounded by the pivotal method: two fractions are paired,
mass moves randomly from one to the other until one of them is 0 or 1, and the other goes on. Rows
form groups of one source and one band of sizes, large bands several; a task sorts a group by size and
pairs neighbours, all pairs of a round at once, and halves its undecided rows with every round until
one per group is left. These residuals are combined in a reduction tree: the residuals of a source form
groups of ``FAN_IN`` neighbours, each of which leaves one, so a level divides every source's residuals
by the fan-in and the tree ends for any number of sources and groups. A source's last residual is
rounded alone. Every document's expected copies are kept, and the copies of a source differ from
their target by less than one.

Groups and draws depend on keys, sizes and the seed alone, so a mix can be made again.

Error. In one round the pairs are disjoint ranges of the sizes of a group, so their transfers move its
tokens by at most (largest - smallest size): the width of its band, in the tree the range of its source.
``error_bound`` of the shares adds that up over all groups and rounds, and the last rounding adds one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import VOCABULARY, encoder
from ..plans.scratch import Scratch
from .arrow_text import slices

#: A rank file of a public byte-level vocabulary; read where the query is built and sent to the tasks.
TOKENIZER = VOCABULARY
#: Documents of a group, on average; and residuals of a source that one group of the reduction tree pairs.
GROUP_ROWS, FAN_IN = 200_000, 50_000
#: Bands of sizes per doubling.
BANDS = 8
#: Characters of a text that are tokenized at once.
PIECE = 200_000
EPS = 1e-9


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _tokenizer(path: str):
    return encoder(_ranks(path))


@lru_cache(maxsize=1)
def _word_end():
    import regex

    # after a blank-free run, before a blank that a word follows: never inside a pretoken of the pattern
    return regex.compile(r"\S(?= \S)")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces whose tokens add up to its own: cut only before a blank that a word follows.

    Such a blank always begins a pretoken, and nothing before it looks past it. A stretch without
    such a place stays whole, however long it is.
    """
    at = 0
    while len(text) - at > PIECE:
        m = _word_end().search(text, at + PIECE)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def with_tokens(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text`` and with ``n_tokens``, counted over the whole text; null texts have 0."""
    names = [c for c in df.columns if c != text]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text], "n_tokens bigint"])
    # the size of a vocabulary file doesn't grow with the data
    ranks = df.sparkSession.sparkContext.broadcast(_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(ranks.value)
        for batch in batches:
            for part in slices(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                n = np.array([sum(len(tok.encode_ordinary(p)) for p in (_pieces(t) if len(t) > PIECE else (t,))) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(n)], [*names, "n_tokens"])

    return df.mapInArrow(run, schema)


def goals(plan: DataFrame, scratch: Scratch) -> DataFrame:
    """``plan`` (``source, weight, cap, total``) with ``goal``: tokens asked of the source, at most its cap.

    The level at which weights times level meet the caps is found by raising it: with the sources at
    their caps fixed, the others share what is left by weight; a round that caps nobody new ends it.
    The level only rises, so every round settles a source; each is one aggregation over one row per
    source. If all are capped the mix is smaller than ``total``.
    """
    level = 0.0
    total = plan.agg(F.max("total").alias("t")).first()["t"] or 0
    while total > 0:
        capped = F.col("cap") < F.col("weight") * F.lit(level * total)
        r = plan.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)).alias("fixed"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if r["free"] <= EPS:
            break
        new = (total - r["fixed"]) / (r["free"] * total)
        if new <= level * (1 + 1e-12):
            break
        level = new
    return plan.withColumn("goal", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level * total)))


def source_plan(tokens: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Per listed source: ``source, weight, max_repeats, n_docs, have, largest, smallest, total, target, goal, copies, is_short``.

    ``total`` counts the tokens of all listed sources, ``target`` is the source's weight of it,
    ``goal`` what the mix asks of it and ``copies`` the fractional copies per document, at most
    ``max_repeats``. A listed source without tokens is short of a positive target. Targets with a
    null source, weight or max_repeats don't count; a source listed twice counts by its largest
    weight. Negative weights and repeats count as 0.
    """
    listed = targets.where("source is not null and weight is not null and max_repeats is not null").groupBy("source").agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("weight"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    have = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("largest"), F.min("n_tokens").alias("smallest"))
    per = listed.join(have, "source", "left").na.fill({"n_docs": 0, "have": 0, "largest": 0, "smallest": 0})
    total = per.agg(F.sum("have").alias("total"))
    per = per.crossJoin(F.broadcast(total)).withColumn("target", F.col("weight") * F.col("total")).withColumn("cap", F.col("have") * F.col("max_repeats"))
    per = goals(scratch.table(per, "per-source"), scratch)
    copies = F.when(F.col("have") > 0, F.least(F.col("max_repeats").cast("double"), F.col("goal") / F.col("have"))).otherwise(0.0)
    return per.withColumn("copies", copies).withColumn("is_short", F.col("cap") < F.col("target")).drop("cap")


def _uniform(h: np.ndarray, turn: int) -> np.ndarray:
    """Draws in [0, 1) from the rows' hashes, other ones for every turn."""
    x = h.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * (1.0 / (1 << 53))


def pair_off(group: np.ndarray, p: np.ndarray, h: np.ndarray, turn: int) -> tuple[np.ndarray, int]:
    """Fractions after pairing neighbours of one group until each group has one undecided row; and the rounds.

    ``group`` is sorted. Every round pairs the undecided rows of a group two by two and decides one of
    each pair at least.
    """
    p, rounds = p.copy(), 0
    open_rows = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    while open_rows.size > 1:
        g = group[open_rows]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        nth = np.arange(g.size) - np.maximum.accumulate(np.where(first, np.arange(g.size), 0))
        left = np.flatnonzero((nth[:-1] % 2 == 0) & ~first[1:])
        if not left.size:
            break
        i, j = open_rows[left], open_rows[left + 1]
        a, b, s = p[i], p[j], p[i] + p[j]
        u = _uniform(h[j], turn + rounds)
        low = s < 1
        # below one, the pair's mass goes to one of them in proportion; above, one is filled up
        to_j = np.where(low, u * s < b, u * (2 - s) < 1 - a)
        full, rest = np.where(low, 0.0, 1.0), np.where(low, s, s - 1)
        p[i] = np.where(to_j, np.where(low, full, rest), np.where(low, rest, full))
        p[j] = np.where(to_j, np.where(low, rest, full), np.where(low, full, rest))
        near = np.concatenate([i, j])
        p[near] = np.where(p[near] < EPS, 0.0, np.where(p[near] > 1 - EPS, 1.0, p[near]))
        open_rows = open_rows[(p[open_rows] > 0) & (p[open_rows] < 1)]
        rounds += 1
    return p, rounds


def _reduce(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """One level: ``rows`` sorted by group within tasks come back with new ``p``, 0 or 1 where decided.

    ``rounds`` counts the rounds that the row's group has had on this ``level`` when it was decided. A
    group that goes on into the next batch carries its undecided row there, so a task holds one batch
    at a time.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn, name, had = None, level * 1_000_000, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # batches differ in what their columns say of nulls
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=pa.schema([pa.field(f.name, f.type) for f in batch.schema]))
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            group = t.column("grp").combine_chunks().dictionary_encode().indices.to_numpy()
            p, rounds = pair_off(group, t.column("p").to_numpy(), t.column("h").to_numpy(), turn)
            if last:
                u = _uniform(t.column("h").to_numpy(), 999_983)
                p = np.where((p > 0) & (p < 1), (u < p).astype(float), p)
            turn += rounds
            # a group that began in an earlier batch has had that one's rounds too
            used = np.where((group == group[0]) & (t.column("grp")[0].as_py() == name), had, 0) + rounds
            name, had = t.column("grp")[-1].as_py(), int(used[-1])
            fixed = lambda v: pa.array(v.astype(np.int32))
            t = t.set_column(at["p"], "p", pa.array(p)).set_column(at["rounds"], "rounds", fixed(used)).set_column(at["level"], "level", fixed(np.full(t.num_rows, level)))
            # the last group may go on
            tail = np.flatnonzero((group == group[-1]) & (p > 0) & (p < 1))
            held = None
            if tail.size:
                held = t.slice(int(tail[-1]), 1).to_batches()[0]
                t = pa.concat_tables([t.slice(0, int(tail[-1])), t.slice(int(tail[-1]) + 1)]).combine_chunks()
            yield from t.to_batches()
        if held is not None:
            yield held

    return rows.mapInArrow(run, schema)


def round_fractions(rows: DataFrame, scratch: Scratch, seed: int = 0) -> DataFrame:
    """The rows with ``up`` (1 where the fraction was rounded up), and the ``level``, ``grp`` and ``rounds`` that decided it.

    rows: ``k, source, p`` in [0, 1], ``n_tokens`` and any other columns. Rows are told apart by
    nothing, so repeated keys do no harm.
    """
    cols = [c for c in rows.columns if c != "p"]
    level = rows.select(*cols, "p", F.xxhash64("k", F.lit(seed)).alias("h"), F.lit("").alias("grp"), F.lit(0).alias("rounds"), F.lit(0).alias("level"))
    settled = level.where((F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)).withColumn("p", F.round("p"))
    band = F.floor(F.log2(F.col("n_tokens") + 1.0) * BANDS).cast("int")
    level = level.where((F.col("p") > EPS) & (F.col("p") < 1 - EPS)).withColumn("band", band)
    # one row per source and band
    parts = level.groupBy(F.col("source").alias("b_source"), F.col("band").alias("b_band")).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    level = level.join(parts, (F.col("source") == F.col("b_source")) & (F.col("band") == F.col("b_band")))
    level = level.withColumn("grp", F.concat_ws("\x01", "source", F.col("band").cast("string"), F.pmod(F.shiftright("h", 7), F.col("parts")).cast("string"))).select(*settled.columns)
    level = level.repartition(F.xxhash64("grp")).sortWithinPartitions("grp", "n_tokens", "h")
    done, depth, last = [settled], 0, False
    while True:
        out = scratch.table(_reduce(level, depth, last), "pivot")
        done.append(out.where("p = 0 or p = 1"))
        if last:
            break
        depth += 1
        rest = out.where("p > 0 and p < 1")
        most = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most")).first()["most"] or 0
        # with one residual per source all are rounded where they lie
        last = most <= 1
        if last:
            level = rest.withColumn("grp", F.col("source"))
            continue
        # a source has one residual per group of the level before
        nth = F.row_number().over(Window.partitionBy("source").orderBy("n_tokens", "h"))
        grouped = rest.withColumn("grp", F.concat_ws("\x01", "source", F.floor((nth - 1) / FAN_IN).cast("string")))
        level = grouped.repartition(F.xxhash64("grp")).sortWithinPartitions("grp", "n_tokens", "h")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.select(*cols, F.col("p").cast("int").alias("up"), "rounds", "level", "grp")


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixture: ``(copies, plan, shares)``.

    copies: ``key, source, n_tokens, copies`` for every document of a listed source, 0 included.
    plan: see ``source_plan``. shares: per listed source the tokens asked for (``target``, ``goal``)
    and got, the shares, and ``error_bound``, which ``abs(got - goal)`` never exceeds. Documents with
    a null source or one that isn't listed take no part; one with a null text has no tokens. Empty
    tables give empty results; a source without documents has a row in the shares.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    names = targets.where("source is not null").select(F.col("source").alias("s")).distinct()
    kept = docs.select(F.col(key).alias("k"), "source", F.col(text).alias("t")).join(names, F.col("source") == F.col("s"), "left_semi")
    tokens = scratch.table(with_tokens(kept, "t", tokenizer), "tokens")
    plan = scratch.table(source_plan(tokens, targets, scratch), "plan")
    # a number within the tolerance of a whole one is that number
    near = F.round("copies")
    even = F.abs(F.col("copies") - near) < EPS
    whole = F.when(even, near).otherwise(F.floor("copies")).cast("int")
    frac = plan.select(F.col("source").alias("p_source"), whole.alias("whole"), F.when(even, 0.0).otherwise(F.col("copies") - F.floor("copies")).alias("p"))
    rows = tokens.join(frac, F.col("source") == F.col("p_source")).select("k", "source", "n_tokens", "whole", "p")
    rounded = scratch.table(round_fractions(rows, scratch, seed), "copies")
    copies = rounded.select(F.col("k").alias(key), "source", "n_tokens", (F.col("whole") + F.col("up")).cast("int").alias("copies"))
    # what each group of each level can have moved: by the width of its band first, by the source's range then
    per_group = rounded.groupBy("source", "level", "grp").agg(F.sum(F.col("n_tokens") * (F.col("whole") + F.col("up"))).cast("bigint").alias("got"), F.max("rounds").alias("rounds"), F.min("n_tokens").alias("least"))
    width = F.when(F.col("level") == 0, F.col("rounds") * (F.col("least") + 1) * (2.0 ** (1 / BANDS) - 1))
    got = per_group.groupBy(F.col("source").alias("g_source")).agg(F.sum("got").alias("got"), F.sum(width).alias("near"), F.sum(F.when(F.col("level") > 0, F.col("rounds"))).alias("far"))
    shares = plan.join(got, F.col("source") == F.col("g_source"), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    whole_mix = shares.agg(F.sum("got").alias("all_got"), F.sum("goal").alias("all_goal"))
    bound = F.when(F.abs(F.col("copies") - F.round("copies")) < EPS, F.abs(F.col("copies") - F.round("copies")) * F.col("have")).otherwise(F.coalesce("near", F.lit(0.0)) + F.coalesce("far", F.lit(0)) * (F.col("largest") - F.col("smallest")) + F.col("largest"))
    shares = shares.crossJoin(F.broadcast(whole_mix)).select(
        "source", "weight", "max_repeats", "n_docs", "have", "target", F.round("goal", 3).alias("goal"), "got", F.try_divide("goal", "all_goal").alias("goal_share"), F.try_divide("got", "all_got").alias("actual_share"), F.round(bound + 0.001, 3).alias("error_bound"), "is_short"
    )
    return copies, plan, shares
