"""Consensus from several annotators' labels (problem 5): latent ability and difficulty.

The model: annotator j labels item i rightly with probability sigmoid(a_j * exp(b_i)), where a_j is
the annotator's ability (negative for one who is worse than chance) and exp(b_i) the item's ease; a
wrong label is any of the others with equal probability. Expectation-maximisation: given abilities,
each item's ease and label posterior are found together from its own votes alone, so items need no
state between passes; each pass returns the gradient and curvature of every ability, summed per
bucket before the shuffle, and a Newton step moves the abilities. Passes go on until no ability moves
by more than ``TOLERANCE``. Labels settled by adjudication are given to the expectation step as known.
A label without a vote on an item is no candidate there; all such labels share the rest of its
posterior, so their number plays no part.

Items lie in buckets of about ``BUCKET_VOTES`` votes. Abilities and label frequencies are a table; a pass
brings each bucket the rows that its votes name (a join over one row per bucket and annotator) and
nothing about annotators, labels or items comes to the driver.

Annotators who copy from each other would count several times, and could even carry the estimate.
Two annotators form a circle if they agree far more often than independent ones of their reliability
would (judged by their overall reliability, which copying can raise but not to certainty), or if
they share nearly all of their errors. Votes of one circle on an item share one weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Votes per bucket, on average; an item's votes lie together.
BUCKET_VOTES = 50_000
#: Joint votes expanded at a time, and sums of annotator pairs that a bucket holds before it passes them on.
JOINT_VOTES, HELD_PAIRS = 500_000, 500_000
#: The largest move of an ability that counts as none, and passes after which the estimate is taken as it is.
TOLERANCE, MOST_PASSES = 0.02, 60
#: Precision of the prior of abilities, which is normal around 1.
PRIOR = 0.05
INNER = 6
#: Copying by errors: share of equal labels among joint errors, and joint errors needed.
COPY_SHARE, COPY_LEAST = 0.85, 8.0
#: Copying by agreement: share of the room above the expected agreement that is used, and standard errors above it.
EXCESS_SHARE, EXCESS_Z = 0.6, 5.0
#: Passes after which circles are looked for again; then every ``CIRCLE_EVERY`` passes until they stay the same.
CIRCLE_PASSES, CIRCLE_EVERY = (0, 2, 6), 4

PERSON, LABEL = 0, 1


def vote_of(pairs: str | Column = "pairs") -> Column:
    """``neutral`` for no pairs, else the emotion (trimmed, lower case) of the pair of greatest intensity.

    Null ``pairs`` count as none, a null intensity as lowest; of equal ones the first counts. A null or
    blank emotion there is no vote (null).
    """
    p = F.coalesce(F.col(pairs) if isinstance(pairs, str) else pairs, F.array())
    p = F.filter(p, lambda x: x.isNotNull())
    best = F.array_max(F.transform(p, lambda x, i: F.struct(F.coalesce(x["intensity"], F.lit(-1.0)).alias("v"), (-i).alias("at"))))
    emotion = F.lower(F.trim(F.get(p, -best["at"])["emotion"]))
    return F.when(F.size(p) == 0, "neutral").otherwise(F.nullif(emotion, F.lit("")))


def current_votes(labels: DataFrame) -> DataFrame:
    """``item, annotator, label``: the newest row per comment and annotator (trimmed, upper case).

    Rows without comment or annotator don't count, nor do votes without a label. Rows that tie are
    expected to be equal; the greatest vote wins otherwise.
    """
    a = F.nullif(F.upper(F.trim("annotator")), F.lit(""))
    rows = labels.select(F.col("comment_id").alias("item"), a.alias("annotator"), F.col("updated_at").cast("timestamp_ntz").alias("at"), vote_of().alias("label"))
    rows = rows.where("item is not null and annotator is not null")
    newest = rows.groupBy("item", "annotator").agg(F.max(F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")), "label")).alias("m"))
    return newest.select("item", "annotator", F.col("m.label").alias("label")).where("label is not null")


def resolved(adjudications: DataFrame, votes: DataFrame) -> DataFrame:
    """``item, known``: the label that the newest resolved adjudication gives.

    ``A`` and ``B`` stand for that annotator's vote, or the row's own pairs if there is none;
    ``CUSTOM`` for the row's pairs. Null, blank, ``TBD`` and unknown verdicts are unresolved.
    """
    final = F.upper(F.trim("final"))
    rows = adjudications.where(F.col("comment_id").isNotNull() & final.isin("A", "B", "NEUTRAL", "CUSTOM"))
    rows = rows.select(F.col("comment_id").alias("item"), F.coalesce(F.col("updated_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), final.alias("final"), vote_of().alias("own"))
    last = rows.groupBy("item").agg(F.max(F.struct("at", "final", "own")).alias("m")).select("item", "m.final", "m.own")
    ab = votes.where(F.col("annotator").isin("A", "B")).select(F.col("item").alias("v_item"), "annotator", F.col("label").alias("voted"))
    joined = last.join(ab, (F.col("item") == F.col("v_item")) & (F.col("final") == F.col("annotator")), "left")
    known = F.when(F.col("final") == "NEUTRAL", "neutral").when(F.col("final") == "CUSTOM", F.col("own")).otherwise(F.coalesce("voted", "own"))
    return joined.select("item", known.alias("known")).where("known is not null")


def _later(item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of every two votes on one item, a slice at a time; votes of an item lie together."""
    end = np.searchsorted(item, item, side="right")
    more = end - np.arange(len(item)) - 1
    total = np.concatenate([[0], np.cumsum(more)])
    at = 0
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(total, total[at] + JOINT_VOTES, side="right")) - 1)
        left = np.repeat(np.arange(at, to), more[at:to])
        yield left, left + 1 + np.arange(len(left)) - np.repeat(total[at:to] - total[at], more[at:to])
        at = to


class _PairSums:
    """Sums per annotator pair; what is held stays bounded, as full tables are passed on."""

    def __init__(self, m: int):
        self.m, self.parts, self.held = m, [], 0

    def add(self, x: np.ndarray, y: np.ndarray, *values: np.ndarray) -> None:
        key, inverse = np.unique(x.astype(np.int64) * self.m + y, return_inverse=True)
        self.parts.append((key, *[np.bincount(inverse, v, len(key)) for v in values]))
        self.held += len(key)

    def take(self, full: int) -> Iterator[pa.RecordBatch]:
        """The table, if at least ``full`` pairs are left in it."""
        if self.held <= full or not self.parts:
            return
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.held = [], 0
        self.add(cols[0] // self.m, cols[0] % self.m, *cols[1:])
        if self.held > full // 2:
            key, *sums = self.parts.pop()
            self.held = 0
            yield pa.RecordBatch.from_arrays([pa.array(key // self.m, pa.int32()), pa.array(key % self.m, pa.int32()), *[pa.array(v) for v in sums]], ["x", "y", "joint", "same", "both", "equal"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Bucket:
    """The votes of a bucket as flat arrays, with the inner solution for given abilities.

    ``n_items`` and ``k`` are the numbers of items and labels of the whole table.
    """

    def __init__(self, items: pa.Table, params: pa.Table, n_items: int, k: int):
        items, params = items.combine_chunks(), params.combine_chunks().sort_by("name")
        self.items, self.k = items, k
        who, what = (items.column(c).combine_chunks() for c in ("who", "what"))
        person, label = (params.filter(pc.equal(params.column("kind"), kind)) for kind in (PERSON, LABEL))
        self.people, self.labels = person.column("name").combine_chunks(), label.column("name").combine_chunks()
        find = lambda values, names: pc.index_in(values, value_set=names).fill_null(-1).to_numpy().astype(np.int64)
        size = np.diff(who.offsets.to_numpy())
        self.n = len(size)
        self.item = np.repeat(np.arange(self.n), size)
        self.j, self.l = find(who.flatten(), self.people), find(what.flatten(), self.labels)
        self.known = find(items.column("known").combine_chunks(), self.labels)
        self.a = person.column("value").to_numpy()[self.j]
        circle = person.column("circle").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        _, inverse, count = np.unique(self.item * (len(circle) + 1) + circle[self.j], return_inverse=True, return_counts=True)
        self.w = 1.0 / count[inverse]
        # candidates: the labels of an item's votes and its known one, sorted by item and label
        m = max(len(self.labels), 1)
        fixed = np.flatnonzero(self.known >= 0)
        key = np.unique(np.concatenate([self.item * m + self.l, fixed * m + self.known[fixed]]))
        self.c_item, self.c_label = key // m, key % m
        self.seat = np.searchsorted(key, self.item * m + self.l)
        self.first = np.searchsorted(self.c_item, np.arange(self.n))
        prior = (label.column("value").to_numpy()[self.c_label] + 1) / (n_items + k)
        self.log_prior = np.log(prior)
        rest = np.maximum(1 - np.bincount(self.c_item, prior, self.n), 1e-9)
        n_cand = np.bincount(self.c_item, minlength=self.n)
        self.log_rest = np.where(n_cand < k, np.log(rest), -np.inf)
        self.certain = np.full(len(key), np.nan)
        is_fixed = (self.known >= 0)[self.c_item]
        self.certain[is_fixed] = (self.c_label == self.known[self.c_item])[is_fixed]

    def solve(self) -> None:
        """Ease ``b`` of every item, posterior ``p`` of every candidate and ``pc`` of each vote's label."""
        a, item, w = self.a, self.item, self.w
        self.b = b = np.zeros(self.n)
        for _ in range(INNER):
            s = np.clip(_sigmoid(a * np.exp(b)[item]), 1e-6, 1 - 1e-6)
            gain = w * (np.log(s) - np.log((1 - s) / (self.k - 1)))
            x = np.bincount(self.seat, gain, len(self.c_item)) + self.log_prior
            top = np.maximum(np.maximum.reduceat(x, self.first), self.log_rest) if self.n else x
            x = np.exp(x - top[self.c_item])
            p = x / (np.add.reduceat(x, self.first) + np.exp(self.log_rest - top))[self.c_item] if self.n else x
            p = np.where(np.isnan(self.certain), p, self.certain)
            vote_p = p[self.seat]
            for _ in range(2):
                e = np.exp(b)[item]
                s = _sigmoid(a * e)
                g = np.bincount(item, w * (vote_p - s) * a * e, self.n) - b
                h = np.bincount(item, w * (a * e) ** 2 * s * (1 - s), self.n) + 1
                b += np.clip(g / h, -0.5, 0.5)
        self.p, self.pc = p, vote_p


def connected(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``c_name, lowest``: the smallest name that each name of ``pairs`` (``x, y``) is connected to.

    Each round takes the smallest label of the neighbours and the label of the own label, in one job.
    """
    both = scratch.table(pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y").distinct(), "links")
    label = scratch.table(both.select(F.col("x").alias("name"), F.col("x").alias("lab")).distinct(), "label")
    while True:
        of = label.select(F.col("name").alias("o_name"), F.col("lab").alias("o_lab"))
        near = both.join(of, F.col("y") == F.col("o_name")).select(F.col("x").alias("name"), F.col("o_lab").alias("new"))
        own = label.select("name", F.col("lab").alias("new"))
        jump = label.join(of, F.col("lab") == F.col("o_name")).select("name", F.col("o_lab").alias("new"))
        low = near.unionByName(own).unionByName(jump).groupBy("name").agg(F.min("new").alias("lab"), F.max("new").alias("most"))
        seen = Observation()
        new = scratch.table(low.observe(seen, F.count_if(F.col("lab") != F.col("most")).alias("open")), "label")
        scratch.drop(label)
        label = new
        if not seen.get["open"]:
            return label.select(F.col("name").alias("c_name"), F.col("lab").alias("lowest"))


class _Model:
    """The tables of an estimation and its passes."""

    def __init__(self, votes: DataFrame, known: DataFrame, scratch: Scratch):
        self.scratch, self.spark = scratch, votes.sparkSession
        labels = votes.select("label").union(known.select("known")).distinct()
        self.k = max(2, labels.count())
        n_votes = votes.count()
        buckets = max(1, -(-n_votes // BUCKET_VOTES), min(n_votes // 2000, self.spark.sparkContext.defaultParallelism))
        per = votes.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("v"))
        fixed = known.select(F.col("item").alias("k_item"), "known")
        items = per.join(fixed, F.col("item") == F.col("k_item"), "left").select(
            F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int").alias("bucket"), "item", F.col("v.annotator").alias("who"), F.col("v.label").alias("what"), "known"
        )
        self.items, self.n_items = scratch.counted(items, "items")
        named = lambda kind, col: self.items.select("bucket", F.lit(kind).alias("kind"), F.explode(col).alias("name"))
        named_known = self.items.where("known is not null").select("bucket", F.lit(LABEL).alias("kind"), F.col("known").alias("name"))
        self.needs = scratch.table(named(PERSON, "who").union(named(LABEL, "what")).union(named_known).distinct(), "needs")
        start = self.needs.select("kind", "name").distinct()
        # everybody starts with ability 1, every label with the same frequency
        self.params = scratch.table(start.select("kind", "name", F.when(F.col("kind") == PERSON, 1.0).otherwise(F.lit(self.n_items / self.k)).alias("value"), F.col("name").alias("circle")), "params")

    def each(self, run, schema: str) -> DataFrame:
        """``run(bucket)`` yields record batches for every bucket with its items and parameters."""
        params = self.params.select(F.col("kind").alias("p_kind"), F.col("name").alias("p_name"), "value", "circle")
        right = self.needs.join(params, (F.col("kind") == F.col("p_kind")) & (F.col("name") == F.col("p_name"))).select("bucket", "kind", "name", "value", "circle")
        n_items, k = self.n_items, self.k
        types = pa.schema([])

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            batches = list(run(_Bucket(left, right, n_items, k))) if left.num_rows else []
            return pa.Table.from_batches(batches) if batches else None

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        types = to_arrow_schema(StructType.fromDDL(schema))
        safe = lambda x, y: both(x, y) or types.empty_table()
        return self.items.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(safe, schema)

    def step(self) -> float:
        """One pass; returns the largest move of an ability."""

        def run(v: _Bucket) -> Iterator[pa.RecordBatch]:
            v.solve()
            e = np.exp(v.b)[v.item]
            s = _sigmoid(v.a * e)
            g = np.bincount(v.j, v.w * (v.pc - s) * e, len(v.people))
            h = np.bincount(v.j, v.w * e * e * s * (1 - s), len(v.people))
            mass = np.bincount(v.c_label, v.p, len(v.labels))
            kind = np.concatenate([np.full(len(g), PERSON), np.full(len(mass), LABEL)])
            names = pa.concat_arrays([v.people, v.labels])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), names, pa.array(np.concatenate([g, mass])), pa.array(np.concatenate([h, np.zeros(len(mass))]))], ["s_kind", "s_name", "g", "h"])

        stats = self.each(run, "s_kind int, s_name string, g double, h double").groupBy("s_kind", "s_name").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        j = self.params.join(stats, (F.col("kind") == F.col("s_kind")) & (F.col("name") == F.col("s_name")))
        # summation order differs between runs; rounding keeps results equal
        move = (F.round("g", 7) - PRIOR * (F.col("value") - 1)) / (F.round("h", 7) + 1 + PRIOR)
        move = F.when(F.col("kind") == PERSON, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move)))
        new = j.select("kind", "name", F.when(F.col("kind") == PERSON, F.round(F.col("value") + move, 9)).otherwise(F.round("g", 7)).alias("value"), "circle", F.coalesce(F.abs(move), F.lit(0.0)).alias("move"))
        seen = Observation()
        out = self.scratch.table(new.observe(seen, F.max("move").alias("most")), "params")
        self.scratch.drop(self.params)
        self.params = out.drop("move")
        self.params._spanloom_path = out._spanloom_path
        return seen.get["most"] or 0.0

    def find_circles(self, before: tuple | None) -> tuple:
        """Set the circles anew; the result compares equal if they are those of ``before``.

        All annotators with joint items are compared: sums exist only for pairs that occur, and are added
        up per bucket before the shuffle.
        """
        cols = ["joint", "same", "both", "equal"]

        def run(v: _Bucket) -> Iterator[pa.RecordBatch]:
            v.solve()
            m = len(v.people)
            sums = _PairSums(m)
            wrong, one, none = 1 - v.pc, np.ones(len(v.j)), np.zeros(len(v.j))
            # an annotator's own sums travel as a pair with itself
            sums.add(v.j, v.j, v.pc, one, none, none)
            out = []
            for a, b in _later(v.item):
                joint, equal = wrong[a] * wrong[b], v.l[a] == v.l[b]
                sums.add(np.minimum(v.j[a], v.j[b]), np.maximum(v.j[a], v.j[b]), joint, joint * equal, np.ones(len(a)), equal)
                out += sums.take(HELD_PAIRS)
            for x in [*out, *sums.take(0)]:
                yield pa.RecordBatch.from_arrays([v.people.take(x.column("x")), v.people.take(x.column("y")), *x.columns[2:]], x.schema.names)

        table = self.scratch.table(self.each(run, "x string, y string, joint double, same double, both double, equal double").groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in cols]), "joint")
        own = table.where("x = y").select(F.col("x").alias("name"), F.round(F.col("joint") / F.greatest(F.col("same"), F.lit(1.0)), 6).alias("rate"))
        side = lambda n: own.select(F.col("name").alias(f"{n}_name"), F.col("rate").alias(f"r{n}"))
        pairs = table.where("x < y")
        for n in ("x", "y"):
            # one rate per annotator: broadcast if small by its real size, else split by AQE at dominant ones
            pairs = pairs.join(side(n), F.col(n) == F.col(f"{n}_name"))
        chance = F.col("rx") * F.col("ry") + (1 - F.col("rx")) * (1 - F.col("ry")) / (self.k - 1)
        more = F.col("equal") / F.col("both") - chance
        z = more / F.sqrt(F.greatest(chance * (1 - chance), F.lit(1e-9)) / F.col("both"))
        excess = (more >= EXCESS_SHARE * (1 - chance)) & (z >= EXCESS_Z)
        errors = (F.col("joint") >= COPY_LEAST) & (F.col("same") >= COPY_SHARE * F.col("joint"))
        found = self.scratch.table(pairs.where(excess | errors).select("x", "y"), "copying")
        self.scratch.drop(table)
        sign = tuple(found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if sign == before:
            return sign
        params = self.params.drop("circle")
        if sign[0]:
            params = params.join(connected(found, self.scratch), (F.col("kind") == PERSON) & (F.col("name") == F.col("c_name")), "left")
            circle = F.coalesce("lowest", "name")
        else:
            circle = F.col("name")
        new = self.scratch.table(params.select("kind", "name", "value", circle.alias("circle")), "params")
        self.scratch.drop(self.params)
        self.params = new
        return sign


def estimate(votes: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Consensus and reliability from ``votes`` (``item, annotator, label``, one per item and annotator).

    Returns items (``item, consensus, p, difficulty, n_votes, n_labels, posterior`` - the candidate
    labels with their probabilities, which labels without a vote lack to 1) and annotators
    (``annotator, n_votes, ability, reliability, circle``), where ``reliability`` is the mean posterior
    of the annotator's votes and ``circle`` the smallest name among those who copy from each other.
    ``known`` (``item, known``, one per item) fixes labels. Ties go to the label that sorts first.
    Without votes both results are empty. The votes of one item lie in one row.
    """
    scratch = Scratch(votes.sparkSession, "consensus")
    votes = scratch.table(votes.select("item", "annotator", "label"), "votes")
    known = scratch.table(known.select("item", "known") if known is not None else votes.select("item", F.col("label").alias("known")).limit(0), "known")
    model = _Model(votes, known, scratch)
    circles, stable = None, False
    for t in range(MOST_PASSES if model.n_items else 0):
        move = model.step()
        if t in CIRCLE_PASSES or (not stable and t > CIRCLE_PASSES[-1] and (t - CIRCLE_PASSES[-1]) % CIRCLE_EVERY == 0):
            before, circles = circles, model.find_circles(circles)
            stable = t >= CIRCLE_PASSES[-1] and circles == before
        elif move < TOLERANCE and stable:
            break

    def final(v: _Bucket) -> Iterator[pa.RecordBatch]:
        v.solve()
        p = np.round(v.p, 9)
        # the first of an item's candidates with its greatest probability; candidates are sorted by label
        top = np.maximum.reduceat(p, v.first)
        is_top = np.flatnonzero(p == top[v.c_item])
        best = is_top[np.searchsorted(v.c_item[is_top], np.arange(v.n))]
        off = lambda at, n: pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32))
        post = pa.ListArray.from_arrays(off(v.c_item, v.n), pa.StructArray.from_arrays([v.labels.take(pa.array(v.c_label)), pa.array(p)], ["label", "p"]))
        vote_p = pa.ListArray.from_arrays(off(v.item, v.n), pa.array(np.round(v.pc, 9)))
        voted = np.unique(v.seat)
        n_labels = np.bincount(v.c_item[voted], minlength=v.n)
        ints = lambda x: pa.array(x.astype(np.int32))
        cols = [v.items.column("item").combine_chunks(), v.labels.take(pa.array(v.c_label[best])), pa.array(top), pa.array(np.exp(-v.b)), ints(np.bincount(v.item, minlength=v.n)), ints(n_labels), post, v.items.column("who").combine_chunks(), vote_p]
        yield pa.RecordBatch.from_arrays(cols, ["item", "consensus", "p", "difficulty", "n_votes", "n_labels", "posterior", "who", "vote_p"])

    schema = "item string, consensus string, p double, difficulty double, n_votes int, n_labels int, posterior array<struct<label:string,p:double>>, who array<string>, vote_p array<double>"
    solved = scratch.table(model.each(final, schema), "solved")
    mean = solved.select(F.explode(F.arrays_zip("who", "vote_p")).alias("z")).groupBy(F.col("z.who").alias("m_name")).agg(F.count(F.lit(1)).alias("n_votes"), F.avg("z.vote_p").alias("reliability"))
    people = model.params.where(F.col("kind") == PERSON).join(mean, F.col("name") == F.col("m_name"))
    annotators = people.select(F.col("name").alias("annotator"), "n_votes", F.round("value", 4).alias("ability"), F.round("reliability", 6).alias("reliability"), "circle")
    return solved.select("item", "consensus", "p", "difficulty", "n_votes", "n_labels", "posterior"), annotators


def agreement(votes: DataFrame) -> DataFrame:
    """One row: Krippendorff's nominal alpha with its parts, over items with two or more votes.

    ``observed`` and ``expected`` are disagreements; ``alpha`` is null without pairable votes and 1
    if only one label occurs.
    """
    per = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    units = per.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("m > 1")
    do = units.agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_votes"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    margins = per.join(units.select("item"), "item").groupBy("label").agg(F.sum("c").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("nn"))
    n = F.col("n_votes")
    observed = F.try_divide("d", n)
    expected = F.try_divide(n * n - F.col("nn"), n * (n - 1))
    alpha = F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(observed, expected))
    return do.crossJoin(margins).select("n_items", F.coalesce(n, F.lit(0)).alias("n_votes"), F.round(observed, 9).alias("observed"), F.round(expected, 9).alias("expected"), F.round(alpha, 9).alias("alpha"))
