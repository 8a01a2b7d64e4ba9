"""Linking documents: duplicates, weighted evidence, unreferenced postings.

A document is a row of facts: document_id, document_type, source_name,
identifiers (array), amount, currency, date, entity, category, entry_type,
low_confidence.  Links are judged by all values that a document has: ``names``
(as ``normalize.entity`` leaves them), ``amounts`` (amount, currency) and
``dates``, arrays in order of position; facts without those columns have the one
name, amount and date of their own.

No step compares all documents with all: pairs come from equal identifier keys,
equal names in a bucket of like amounts, or a grid of amounts and dates, where a
bound of the names' likeness is tested before two names are scored, and only pairs
whose score can reach a threshold leave the grid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import compare, normalize, similarity
from tallywright.operators.components import cut, kept

# Fixed values.
PARTNERS = ("PURCHASE_ORDER", "PAYMENT", "LEDGER")
EXPENSE_WORDS = ("expense", "cost", "debit", "payable")
REVENUE_WORDS = ("revenue", "income", "credit", "sale", "receivable")

#: Amounts within two percent lie in the same or in neighbouring powers of this.
LIKE_AMOUNTS = 1 / 0.98
#: Such powers in a cell of amounts; an invoice goes to each cell that its partners can be in, mostly one.
WIDE = 8
#: Rows of one side of a cell that a task holds at once, about; a fuller cell is dealt in parts, each of which meets each.
PART = 1 << 14
#: Pairs that are tested at once, so few that what a step leaves stays near the core.
TESTED = 1 << 15
#: Pairs tested before those that are left are scored.
SCORED = 1 << 20
#: Pairs that are sifted at once.
SIFTED = 1 << 17
#: Pairs of a document that are tried for an unsure one, time after time, before all of its pairs are.
TRIED = (16, 64, 256, 1024)


@dataclass(frozen=True)
class LinkingConfig:
    identifier_weight: float = 0.60
    entity_weight: float = 0.20
    amount_weight: float = 0.15
    date_weight: float = 0.05
    linked: float = 0.38
    ambiguous: float = 0.35
    date_window: int = 90
    amount_tolerance: float = 2.0

    def __post_init__(self) -> None:
        weights = (self.identifier_weight, self.entity_weight, self.amount_weight, self.date_weight)
        if min(weights) < 0 or abs(sum(weights) - 1) > 1e-9:
            raise ValueError("weights must be non-negative and add up to one")
        if not 0 <= self.ambiguous <= self.linked <= 1 or self.date_window <= 0:
            raise ValueError("thresholds must be in order within 0 and 1, and the window positive")
        if self.entity_weight + self.date_weight >= self.ambiguous or self.amount_tolerance > 2:
            # Pairs that blocking by identifier or by amount and entity would miss could then count.
            raise ValueError("entity and date alone must stay under the ambiguous threshold, and amounts within 2 percent")
        if self.amount_weight + self.date_weight >= self.ambiguous:
            raise ValueError("amount and date alone must stay under the ambiguous threshold")

    def least_name_score(self, date_score):  # noqa: ANN001, ANN201  a column or an array
        """What two names must reach for a pair with like amounts and without a common identifier."""
        return (self.ambiguous - self.amount_weight - self.date_weight * date_score) / self.entity_weight

    @property
    def above(self) -> float:
        """How much more two names must reach for a linked pair."""
        return (self.linked - self.ambiguous) / self.entity_weight

    @property
    def linked_window(self) -> int:
        """Days within which two names can reach that much, at least one."""
        needed = self.least_name_score(1 - np.arange(self.date_window) / self.date_window) + self.above
        return max(1, int((needed <= 1 + 2 * similarity.ROUNDING).sum()))


def keys(facts: DataFrame) -> DataFrame:
    """(document_id, document_type, identifier, key): identifiers that have a key; others match nothing."""
    own = facts.select("document_id", "document_type", F.explode("identifiers").alias("identifier"))
    return own.withColumn("key", normalize.match_key(F.col("identifier"))).where("key IS NOT NULL")


def sides(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs with the facts of both, as structs ``l`` and ``r``; the smaller id is the left. Facts that were cut look small, so they are merged by hint."""
    row = F.struct(*facts.columns)
    left = facts.select(F.col("document_id").alias("left_id"), row.alias("l"))
    right = facts.select(F.col("document_id").alias("right_id"), row.alias("r"))
    return pairs.join(left.hint("merge"), "left_id").join(right.hint("merge"), "right_id")


def duplicates(facts: DataFrame) -> DataFrame:
    """(left_id, right_id, shared): documents of one type with a key in common, and the left's spellings of it."""
    own = kept(keys(facts).where("document_type <> 'UNKNOWN'"))  # both sides read the keys
    right = own.select(F.col("document_id").alias("right_id"), "document_type", "key").distinct()
    met = own.withColumnRenamed("document_id", "left_id").join(right, ["document_type", "key"]).where("left_id < right_id")
    return met.groupBy("left_id", "right_id").agg(F.sort_array(F.collect_set("identifier")).alias("shared"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")]


def evidence_values(facts: DataFrame) -> DataFrame:
    """(document_id, document_type, keys, names, amounts, dates): what links are judged by; ``full`` too if facts have it."""

    def values(name: str, flag: Column, value: Column) -> Column:
        return F.col(name) if name in facts.columns else F.when(flag, F.array(value)).otherwise(F.filter(F.array(value), lambda _: F.lit(False)))

    amount, name, day = F.col("amount"), F.col("entity"), F.col("date")
    return facts.select(
        "document_id", "document_type", F.array_compact(F.transform("identifiers", normalize.match_key)).alias("keys"),
        F.filter(values("names", name.isNotNull(), name), lambda n: ~normalize.missing(n)).alias("names"),
        values("amounts", amount.isNotNull(), F.struct(amount.alias("amount"), F.col("currency").alias("currency"))).alias("amounts"),
        values("dates", day.isNotNull(), day).alias("dates"), *[c for c in facts.columns if c == "full"],
    )


def _bucket(amount: Column, base: float) -> Column:
    return F.floor(F.log(F.greatest(F.abs(amount), F.lit(1)).cast("double")) / math.log(base))


def _bands(amount: Column) -> tuple[Column, Column]:
    """The cell of an amount, and the cells of all amounts within two percent and a hair of it."""
    power = F.log(F.greatest(F.abs(amount), F.lit(1)).cast("double")) / math.log(LIKE_AMOUNTS)
    low, own, high = (F.floor((power + reach) / WIDE) for reach in (-1.001, 0, 1.001))
    return own, F.sequence(low, high)


def _around(bucket: str) -> Column:
    return F.explode(F.array(F.col(bucket) - 1, F.col(bucket), F.col(bucket) + 1))


def _like(x: str, y: str, tolerance: float) -> Column:
    """Amounts within the tolerance, of one currency or an unknown one; a hair wider than ``link_evidence`` judges."""
    a, b = F.col(f"{x}.amount"), F.col(f"{y}.amount")
    near = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * (tolerance / 100 + 1e-9)
    return near & F.coalesce(F.col(f"{x}.currency") == F.col(f"{y}.currency"), F.lit(True))


class _Cell:
    """Two sides of a cell (a or b, name, amount, currency, day), in order of amount, and its pairs that were found.

    Where documents stand alone they have their price and key with them, what a pair is judged by; such pairs are left
    out if they meet by name or key.  Where the sides say which documents are wanted in ``full``, of the other documents'
    pairs come all that can be linked, and of the unsure ones some of each document's at each end.
    """

    def __init__(self, left: pa.Table, right: pa.Table, config: LinkingConfig) -> None:
        self.config, self.alone, self.few = config, "x" in left.column_names, "full" in left.column_names
        self.left, self.right = left, right = [side.sort_by("amount") for side in (left, right)]
        self.texts, (self.x, self.y) = similarity.indexed(left["name"], right["name"])
        _, self.money = similarity.indexed(pc.fill_null(left["currency"], ""), pc.fill_null(right["currency"], ""))
        self.unknown = [pc.is_null(side["currency"]).to_numpy() for side in (left, right)]
        self.p, self.q = (side["amount"].to_numpy() for side in (left, right))
        self.d, self.e = (side["day"].to_numpy().astype(np.int32) for side in (left, right))
        self.traits, self.scorer = similarity.Traits(self.texts), similarity.Scorer(self.texts)
        if self.alone:
            (_, self.keys), self.keyless = similarity.indexed(pc.fill_null(left["key"], ""), pc.fill_null(right["key"], "")), pc.is_null(left["key"]).to_numpy()
        self.enough = _Enough(left, right, config) if self.few else None
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting: list[tuple[np.ndarray, ...]] = []
        # What a pair at this many days needs, a hair less; ``sure`` is wider than an amount's partners lie.
        least = (config.least_name_score(1 - np.arange(config.date_window) / config.date_window) - 1e-9 - similarity.ROUNDING).astype(np.float32) - similarity.SINGLE
        self.least = np.append(least, np.float32(np.inf))
        self.share = config.amount_tolerance / 100 + 2e-9
        self.sure = self.share / (1 - self.share) * (1 + 1e-6)

    def partners(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each amount the place of the first that may be near it, and the place behind the last."""
        hair = np.maximum(np.abs(p), 1) * self.sure
        return np.searchsorted(q, p - hair), np.searchsorted(q, p + hair, side="right")

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs have like amounts and, standing alone, names that differ."""
        mine, theirs = self.p[i], self.q[j]
        near = np.abs(mine - theirs) <= np.maximum(np.maximum(np.abs(mine), np.abs(theirs)), 1) * self.share
        near &= (self.money[0][i] == self.money[1][j]) | self.unknown[0][i] | self.unknown[1][j]
        return near & (self.x[i] != self.y[j]) if self.alone else near

    def days(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(np.abs(self.d[i] - self.e[j]), self.config.date_window)

    def scored(self, i: np.ndarray, j: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = self.x[i], self.y[j]
        scores = np.where(a == b, 1.0, self.scorer.name_scores(a, b, needed - similarity.ROUNDING))
        near = (a == b) | (scores >= needed)
        return i[near], j[near], scores[near]

    def score(self) -> None:
        """Scores the pairs (i, j, bound of likeness) that wait."""
        if self.waiting:
            i, j, alike = (np.concatenate([w[k] for w in self.waiting]) for k in range(3))
            self.waiting.clear()
            if self.alone:
                apart = self.keyless[i] | (self.keys[0][i] != self.keys[1][j])
                i, j, alike = i[apart], j[apart], alike[apart]
            needed = self.config.least_name_score(1 - np.abs(self.d[i] - self.e[j]) / self.config.date_window) - 1e-9
            self.found.extend(self.enough.of(i, j, needed, alike, self.scored) if self.enough else [self.scored(i, j, needed)])

    def test(self) -> None:
        """Tests all pairs and scores those that can reach a threshold."""
        tested = 0
        first, last = self.partners(self.p, self.q)
        step = max(1, int(TESTED // max((last - first).mean() if len(self.p) else 0, 1)))
        for start in range(0, len(self.p) if len(self.q) else 0, step):
            own = slice(start, start + step)
            facing = slice(int(first[own].min()), int(last[own].max()))
            mine, theirs = self.p[own, None], self.q[None, facing]
            if not theirs.size:
                continue
            near = np.abs(mine - theirs) <= np.maximum(np.maximum(np.abs(mine), np.abs(theirs)), 1) * self.share
            near &= (self.money[0][own, None] == self.money[1][None, facing]) | self.unknown[0][own, None] | self.unknown[1][None, facing]
            if self.alone:
                near &= self.x[own, None] != self.y[None, facing]
            alike = similarity.most_alike_of(self.traits, self.x[own], self.y[facing])
            near &= alike >= self.least[np.minimum(np.abs(self.d[own, None] - self.e[None, facing]), self.config.date_window)]
            i, j = np.nonzero(near)
            self.waiting.append((i + start, j + facing.start, alike[i, j]))
            tested += near.size
            if tested >= SCORED:
                self.score()
                tested = 0
        self.score()

    def wait(self, i: np.ndarray, j: np.ndarray, more: float) -> None:
        """Lets pairs wait whose names can reach ``more`` than an unsure link needs."""
        near = np.flatnonzero(self.near(i, j))
        i, j = i[near], j[near]
        alike = similarity.most_alike_at(self.traits, self.x[i], self.y[j])
        can = alike >= self.least[self.days(i, j)] + more
        self.waiting.append((i[can], j[can], alike[can]))

    def sift(self) -> None:
        """Scores all pairs that can be linked, and tries some of each document for an unsure one.

        Few names are so much alike, so most pairs are told by the letters that they have in common and their dates.
        """
        if not len(self.p) or not len(self.q):
            return
        config, sieve = self.config, similarity.Sieve(self.texts)
        first, last = self.partners(self.p, self.q)
        self._try(first, last, False)
        self._try(*self.partners(self.q, self.p), True)
        self.score()
        most, step = 0, max(1, int(SIFTED // max((last - first).mean(), 1)))
        at = config.least_name_score(1.0) + config.above - 2e-9 - 2 * similarity.ROUNDING
        base = np.float32(similarity.Sieve.shares(at) - 1e-4)
        slope = np.float32(3 / 0.6 * config.date_weight / config.date_window / config.entity_weight)
        d, e = self.d.astype(np.float32) * slope, self.e.astype(np.float32) * slope
        d, e = d - e.min(), e - e.min()
        parts = [sieve.part[own] for own in (self.x, self.y)]
        for start in range(0, len(self.p), step):
            own = slice(start, start + step)
            facing = slice(int(first[own].min()), int(last[own].max()))
            if facing.stop <= facing.start:
                continue
            held = parts[0][own, None] + parts[1][None, facing]
            held *= sieve.common(self.x[own], self.y[facing])
            apart = d[own, None] - e[None, facing]
            np.abs(apart, out=apart)
            held -= apart
            i, j = np.nonzero(held >= base) if sieve.whole else np.nonzero(np.ones(held.shape, bool))
            self.wait(i + start, j + facing.start, config.above)
            most += len(self.waiting[-1][0])
            if most >= SCORED >> 4:
                self.score()
                most = 0
        self.score()

    def _try(self, first: np.ndarray, last: np.ndarray, turned: bool) -> None:
        """Scores some pairs of each document of a side for an unsure one, evenly from those of like amounts, and more of the documents that have none yet."""
        window, side = self.config.linked_window, int(turned)
        # An invoice stands in the neighbouring cells too, where fewer dates are near.
        at_home = np.ones(len(first), bool) if turned else self.d // window == self.e[0] // window
        for tries in TRIED:
            lacking = np.flatnonzero(at_home & ~self.enough.have[side].any(axis=0) & (last > first))
            for own in np.split(lacking, range(step := max(1, SCORED // tries), len(lacking), step)):
                many = (last - first)[own]
                few = np.minimum(many, tries)
                i = np.repeat(own, few)
                k = np.arange(len(i)) - np.repeat(np.cumsum(few) - few, few)
                j = np.repeat(first[own], few) + k * np.repeat(many, few) // np.maximum(np.repeat(few, few), 1)
                if turned:
                    order = np.argsort(j, kind="stable")
                    i, j = j[order], i[order]
                self.wait(i, j, 0.0)
                self.score()

    def table(self) -> pa.Table:
        """(a, b) of the pairs found, and what they are judged by."""
        left, right, config = self.left, self.right, self.config
        i, j, scores = (np.concatenate([f[k] for f in self.found]) if self.found else np.zeros(0, np.int64) for k in range(3))
        i, j = i.astype(np.int64), j.astype(np.int64)
        if self.few:  # tried more than once
            _, once = np.unique(i * max(right.num_rows, 1) + j, return_index=True)
            i, j, scores = i[once], j[once], scores[once]

        def taken(side: pa.Table, name: str, at: np.ndarray) -> pa.Array:
            return pc.take(side[name].combine_chunks(), pa.array(at))

        pairs = {"a": taken(left, "a", i), "b": taken(right, "b", j)}
        if self.alone:
            resolved = np.zeros(len(i), bool)
            close = np.flatnonzero(scores >= similarity.RESOLVED)
            resolved[close] = similarity.covered(self.texts, self.x[i[close]], self.y[j[close]])
            days = np.abs(self.d[i] - self.e[j]) if len(i) else np.zeros(0)
            pairs |= {"kind": taken(right, "kind", j), "entity_score": pa.array(scores.astype(float)), "entity_match": pa.array(resolved), "days": pa.array(days.astype(np.int32))}
            pairs |= {"x": taken(left, "x", i), "y": taken(right, "y", j), "near": pa.array(_plainly_near(self.p[i], self.q[j], config))}
            full = self.enough.full[0][i] | self.enough.full[1][j] if self.few else np.zeros(len(i), bool)
            pairs["wanted"] = pa.array(full)
        return pa.table(pairs)


def _alike(left: pa.Table, right: pa.Table, config: LinkingConfig) -> pa.Table:
    """Of all pairs of two sides those whose amounts, dates and names can reach a threshold."""
    cell = _Cell(left, right, config)
    cell.test()
    return cell.table()


def _firm(left: pa.Table, right: pa.Table, config: LinkingConfig) -> pa.Table:
    """All pairs that can be linked, and for most documents an unsure one at each end."""
    cell = _Cell(left, right, config)
    cell.sift()
    return cell.table()


def _lacking(left: pa.Table, right: pa.Table, config: LinkingConfig) -> pa.Table:
    """Pairs of documents that still lack an unsure one or whose pairs are all wanted."""
    asked = [pc.or_(side["full"], pc.greater(side["lacks"], 0)) for side in (left, right)]
    halves = [_Cell(left.filter(asked[0]), right, config), _Cell(left.filter(pc.invert(asked[0])), right.filter(asked[1]), config)]
    for cell in halves:
        cell.test()
    return pa.concat_tables([cell.table() for cell in halves])


def _plainly_near(p: np.ndarray, q: np.ndarray, config: LinkingConfig) -> np.ndarray:
    """Whether doubles lie so far within the tolerance that the amounts they stand for do too."""
    return np.abs(p - q) <= np.maximum(np.maximum(np.abs(p), np.abs(q)), 1) * (config.amount_tolerance / 100 - 1e-9)


class _Enough:
    """Which documents of a cell still lack an unsure pair, by the end at which they would stand in it."""

    def __init__(self, left: pa.Table, right: pa.Table, config: LinkingConfig) -> None:
        self.config = config
        self.full = [side["full"].to_numpy() for side in (left, right)]
        self.amounts = [side["amount"].to_numpy() for side in (left, right)]
        self.days = [side["day"].to_numpy().astype(np.int32) for side in (left, right)]
        ids = pa.concat_arrays([side[c].combine_chunks().cast(pa.string()) for side, c in ((left, "a"), (right, "b"))])
        place = np.empty(len(ids), np.int64)
        place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        self.places = place[: left.num_rows], place[left.num_rows :]
        self.have = [np.zeros((2, side.num_rows), bool) for side in (left, right)]
        self.rest = "lacks" in left.column_names
        if self.rest:
            # Bit 0 as the left one of a pair, bit 1 as the right one; a row of ``have`` for invoices on the right and one for those on the left.
            for have, side, bits in zip(self.have, (left, right), ((1, 0), (0, 1))):
                lacks = side["lacks"].to_numpy()
                for row, bit in enumerate(bits):
                    have[row] = (lacks >> bit) & 1 == 0

    def of(self, i: np.ndarray, j: np.ndarray, needed: np.ndarray, alike: np.ndarray, scored) -> list[tuple[np.ndarray, ...]]:  # noqa: ANN001
        """Of candidates, in order of ``i``, the pairs (i, j, score) that are wanted; names are scored a few of each document at a time."""
        at, found, few, more = self.places[0][i] < self.places[1][j], [], 4, self.config.above
        if self.rest:
            asked = self.full[0][i] | self.full[1][j] | ~self._served(at, i, j)
            at, i, j, needed, alike = (v[asked] for v in (at, i, j, needed, alike))
        wanted = self.full[0][i] | self.full[1][j] | (alike >= needed + more - similarity.ROUNDING)
        found.append(self._chosen(*scored(i[wanted], j[wanted], needed[wanted])))
        rest = np.flatnonzero(~wanted)
        while True:
            rest = rest[~self._served(at[rest], i[rest], j[rest])]
            if not len(rest):
                return found
            first = np.flatnonzero(np.diff(i[rest], prepend=-1))
            rank = np.arange(len(rest)) - np.repeat(first, np.diff(first, append=len(rest)))
            now, rest, few = rest[rank < few], rest[rank >= few], few * 4
            found.append(self._chosen(*scored(i[now], j[now], needed[now])))

    def _served(self, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.have[0][at.astype(int), i] & self.have[1][at.astype(int), j]

    def _chosen(self, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is or may be linked, what is wanted in full, what is too near a bound to be told here, and of plainly unsure pairs the first of each document that has none."""
        config, at = self.config, (self.places[0][i] < self.places[1][j]).astype(int)
        total = config.entity_weight * scores + config.amount_weight + config.date_weight * (1 - np.abs(self.days[0][i] - self.days[1][j]) / config.date_window)
        plain = _plainly_near(self.amounts[0][i], self.amounts[1][j], config)
        plain &= (total >= config.ambiguous + 1e-9) & (total < config.linked - 1e-9)
        chosen = ~plain | self.full[0][i] | self.full[1][j]
        for have, k in zip(self.have, (i, j)):
            lacking = np.flatnonzero(plain & ~have[at, k])
            chosen[lacking[np.unique(at[lacking] * have.shape[1] + k[lacking], return_index=True)[1]]] = True
            have[at[lacking], k[lacking]] = True
        return i[chosen], j[chosen], scores[chosen]


def candidates(facts: DataFrame, config: LinkingConfig = LinkingConfig()) -> DataFrame:
    """(left_id, right_id): every pair of an invoice and a partner that can reach a threshold.

    Without a common identifier that takes like amounts and names.  Equal names meet by
    name and amount.  Others need dates within the window, and names the more alike the
    further the dates lie apart: they meet in cells of amount and date, and go on if their
    likeness, and a bound of it before, reaches what their dates leave to the names.
    """
    met, graded = _candidates(kept(evidence_values(facts).drop("full")), config)
    return met.unionByName(graded.select(*_ordered(F.col("a"), F.col("b")))).distinct()


def _alone() -> Column:
    """Whether a document has one name, amount and date and at most one key, so that all of its evidence fits into a cell's row."""
    whole = F.get("amounts", F.lit(0))["amount"].isNotNull() & F.get("dates", F.lit(0)).isNotNull()
    return F.coalesce((F.size("names") == 1) & (F.size("amounts") == 1) & (F.size("dates") == 1) & (F.size("keys") <= 1) & whole, F.lit(False))


def _candidates(values: DataFrame, config: LinkingConfig) -> tuple[DataFrame, DataFrame]:
    """Pairs (left_id, right_id) that are still to be judged, and the others, which were judged where they met: they are most of all.

    A document is in one cell and its partners come there, so that of documents that stand alone each pair is met once,
    in a cell or by its name; it has no key in common, or else it is among the first.  Where values have ``full`` the
    others are such as can be linked, and one for most documents; where they have ``lacks`` too, what these still lack.
    """
    few = [c for c in values.columns if c in ("full", "lacks")]
    kernel, window = (_lacking, config.date_window) if "lacks" in few else (_firm, config.linked_window) if few else (_alike, config.date_window)
    keyed = values.select("document_id", "document_type", F.explode("keys").alias("key"))
    named = values.select("document_id", "document_type", F.explode("names").alias("name"), F.col("amounts"), "dates", _alone().alias("alone"), F.get("keys", F.lit(0)).alias("key"), *few)
    priced = named.select("*", F.explode("amounts").alias("x")).drop("amounts").withColumn("bucket", _bucket(F.col("x.amount"), LIKE_AMOUNTS))
    # Doubles differ from decimals by less than the hair that ``_like`` leaves, and many more pairs are tested than documents read.
    priced = priced.withColumn("price", F.col("x.amount")).withColumn("x", F.struct(F.col("x.amount").cast("double").alias("amount"), F.col("x.currency").alias("currency")))
    dated = priced.select("*", F.explode("dates").alias("day")).drop("dates", "bucket").withColumn("cell", F.floor(F.unix_date("day") / config.date_window))
    band, bands = _bands(F.col("x.amount"))
    dated = dated.withColumns({"band": band, "bands": bands})

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def split(rows: DataFrame, *near: str) -> tuple[DataFrame, DataFrame]:
        """Invoices, also in neighbouring buckets, and partners; the columns that both have named apart."""
        invoice = rows.where("document_type = 'INVOICE'").drop("document_type", "dates").withColumnRenamed("document_id", "a")
        for name in near:
            invoice = invoice.withColumn(name, _around(name))
        if "bands" in rows.columns:
            invoice = invoice.withColumn("band", F.explode("bands")).drop("bands")
        partner = rows.where(F.col("document_type").isin(*PARTNERS)).drop("dates", "bands").withColumnRenamed("document_id", "b")
        partner = partner.withColumnsRenamed({"x": "y", "document_type": "kind"})
        return invoice, partner

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        """Few rows make many pairs, so they are dealt over all tasks, which their own size would not call for."""
        return rows.repartition(parts, *by)

    cell = ("band", "cell", "part", "facing")

    def in_cells(invoice: DataFrame, partner: DataFrame, made: str, alike=_alike) -> DataFrame:  # noqa: ANN001
        sizes = [rows.groupBy("band", "cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias(n)) for rows, n in ((invoice, "n"), (partner, "m"))]
        sizes = sizes[0].join(sizes[1], ["band", "cell"])

        def in_parts(rows: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
            """Rows of cells that have both sides, dealt in parts of their own side, once for each part of the other."""
            held = rows.join(sizes, ["band", "cell"]).withColumn(names[0], F.pmod(F.xxhash64(*rows.columns), F.col(own)))
            held = held.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("n", "m")
            return dealt(held.select(*[F.col(c).alias(c) for c in held.columns]), *cell)  # both sides come from the same rows

        left, right = in_parts(invoice, "n", "m", ("part", "facing")).groupBy(*cell), in_parts(partner, "m", "n", ("facing", "part")).groupBy(*cell)
        return left.cogroup(right).applyInArrow(lambda x, y: alike(x, y, config), made)

    invoice, partner = split(keyed)
    by_key = dealt(invoice, "key").join(dealt(partner, "key"), "key")
    wanted = F.col("full") if few else F.lit(False)
    invoice, partner = split(priced.withColumns({"day": F.get("dates", F.lit(0)), "full": wanted}).drop("lacks"), "bucket")
    partner = partner.withColumnsRenamed({"price": "sum", "day": "due", "key": "other", "alone": "lone", "full": "so"})
    same_name = dealt(invoice, "name", "bucket").join(dealt(partner, "name", "bucket"), ["name", "bucket"]).where(_like("x", "y", config.amount_tolerance))
    p, q = F.col("x.amount"), F.col("y.amount")
    plainly = F.abs(p - q) <= F.greatest(F.abs(p), F.abs(q), F.lit(1.0)) * (config.amount_tolerance / 100 - 1e-9)
    # Equal names are judged where they meet, since they may be as many as the square of the documents too.
    equal = same_name.where("alone AND lone AND coalesce(key <> other, true)").select(
        "a", "b", "kind", F.lit(1.0).alias("entity_score"), F.lit(True).alias("entity_match"), F.abs(F.datediff("day", "due")).alias("days"),
        F.col("price").alias("x"), F.col("sum").alias("y"), plainly.alias("near"), (F.col("full") | F.col("so")).alias("wanted"),
    )
    place = dated.select(
        "document_id", "document_type", "name", F.col("x.amount").alias("amount"), F.col("x.currency").alias("currency"), F.unix_date("day").alias("day"), "band", "bands", "cell",
        "alone", "key", F.col("price").alias("x"), *few,
    )
    within = place.where("alone").drop("alone").withColumn("cell", F.floor(F.col("day") / window))
    one, whole, several = split(within, "cell"), split(place.where("alone").drop("alone"), "cell"), split(place.where("NOT alone").drop("alone", "key", "x", *few), "cell")
    money = dict(values.select(F.explode("amounts").alias("x")).select("x.amount").dtypes)["amount"]
    graded = in_cells(
        *one, f"a string, b string, kind string, entity_score double, entity_match boolean, days int, x {money}, y {money}, near boolean, wanted boolean", kernel,
    )
    if "lacks" not in few:
        graded = graded.unionByName(equal)
    ways = [by_key]
    if not named.where("NOT alone").isEmpty():  # mostly all documents stand alone
        plain = [rows.select(*[c for c in rows.columns if c not in ("key", "x", "y", "kind", *few)]) for rows in (*whole, *several)]
        ways += [same_name.where("NOT (alone AND lone)"), *(in_cells(i, p, "a string, b string") for i, p in ((plain[2], plain[1].unionByName(plain[3])), (plain[0], plain[3])))]
    met = [rows.select(*_ordered(F.col("a"), F.col("b"))) for rows in ways]
    return reduce(DataFrame.union, met).distinct(), graded


def _difference(x: Column, y: Column) -> tuple[Column, Column]:
    """How far two amounts lie apart, and in percent of the greater one."""
    difference = F.abs(x - y).cast("double")
    return difference, difference / F.greatest(F.abs(x), F.abs(y), F.lit(1)).cast("double") * 100


def _amount_evidence() -> Column:
    """Of the pairs of amounts in compatible currencies the one of the least percentage, the first of equals."""

    def against(x: Column, i: Column) -> Column:
        def one(y: Column, j: Column) -> Column:
            difference, percent = _difference(x["amount"], y["amount"])
            compatible = F.coalesce(x["currency"] == y["currency"], F.lit(True))
            return F.when(compatible, F.struct(percent.alias("percent"), i.alias("i"), j.alias("j"), difference.alias("difference")))

        return F.transform("r.amounts", one)

    return F.array_min(F.flatten(F.transform("l.amounts", against)))


def _days_apart() -> Column:
    return F.array_min(F.flatten(F.transform("l.dates", lambda x: F.transform("r.dates", lambda y: F.abs(F.datediff(x, y))))))


def link_evidence(facts: DataFrame, config: LinkingConfig = LinkingConfig(), full: DataFrame | None = None) -> DataFrame:
    """Evidence, score and status of every candidate pair that is at least ambiguous.

    Of several identifiers, names, amounts and dates the best pair counts, each by itself.
    The score is judged as it is and given to three places.

    Ambiguous pairs may be as many as the square of the documents.  Who only asks which documents have one names in
    ``full`` (document_id) those whose pairs are all wanted, and gets all linked pairs, all pairs of these documents, and
    of the other ambiguous ones at least one for each document that is the left one of any, and for each that is the right one.
    """
    values = kept(evidence_values(facts.drop("full")))  # read by each way to meet and by both sides of a pair, a few columns each time
    if full is None:
        return _judged(*_candidates(values, config), values, config).drop("wanted")
    full = full.select("document_id", F.lit(True).alias("full")).distinct()
    values = values.join(full, "document_id", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    first = kept(_judged(*_candidates(values, config), values.drop("full"), config).where("NOT wanted OR status = 'LINKED'").drop("wanted"))
    rest = _judged(None, _candidates(_with_lacks(values, first), config)[1], values, config)
    return first.unionByName(rest.where("status = 'AMBIGUOUS'").drop("wanted"))  # the linked are among the first


def _with_lacks(values: DataFrame, links: DataFrame) -> DataFrame:
    """Values of documents that stand alone, with ``lacks``: bit 0 if they are the left one of no unsure link although they could be, bit 1 if the right one."""
    ends = F.explode(F.array(F.struct(F.col("left_id").alias("document_id"), F.lit(1).alias("bit")), F.struct(F.col("right_id").alias("document_id"), F.lit(2).alias("bit"))))
    held = links.where("status = 'AMBIGUOUS'").select(ends.alias("e")).select("e.*").groupBy("document_id").agg(F.bit_or("bit").alias("held"))
    invoice, partner = F.col("document_type") == "INVOICE", F.col("document_type").isin(*PARTNERS)
    least = values.agg(*[f(F.when(kind, F.col("document_id"))).alias(n) for f, n, kind in ((F.min, "il", invoice), (F.max, "ih", invoice), (F.min, "pl", partner), (F.max, "ph", partner))])
    own = values.where(_alone() & (invoice | partner)).crossJoin(F.broadcast(least))  # one row
    low, high = (F.when(invoice, F.col(p)).otherwise(F.col(i)) for p, i in (("pl", "il"), ("ph", "ih")))
    may = F.when(F.col("document_id") < high, 1).otherwise(0).bitwiseOR(F.when(F.col("document_id") > low, 2).otherwise(0))
    lacks = may.bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0))))
    return kept(own.join(held.hint("merge"), "document_id", "left").withColumn("lacks", F.coalesce(lacks, F.lit(0))).select(*values.columns, "lacks"))


def _judged(met: DataFrame | None, graded: DataFrame, values: DataFrame, config: LinkingConfig) -> DataFrame:
    """Evidence, score and status of pairs that have met and of those that a cell has judged, and whether a document of a pair is one whose pairs are all wanted."""
    rows = _met_evidence(met, values, config) if met is not None else None
    difference, percent = _difference(F.col("x"), F.col("y"))
    own = graded.select(
        *_ordered(F.col("a"), F.col("b")), F.concat(F.lit("INVOICE_"), "kind").alias("relationship"), F.lit(False).alias("identifier_match"), "entity_match", "entity_score", "days",
        difference.alias("amount_difference"), percent.alias("amount_percent"), (F.col("near") | (percent <= config.amount_tolerance)).alias("amount_compatible"), "wanted",
    )
    rows = own if rows is None else rows.withColumn("wanted", F.lit(False)).unionByName(own)
    score = (
        config.identifier_weight * F.col("identifier_match").cast("int") + config.entity_weight * F.coalesce("entity_score", F.lit(0.0))
        + config.amount_weight * F.coalesce(F.col("amount_compatible"), F.lit(False)).cast("int")
        + config.date_weight * F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("days") / config.date_window), F.lit(0.0))
    )
    status = F.when(score >= config.linked, "LINKED").when(score >= config.ambiguous, "AMBIGUOUS")
    return rows.withColumn("status", status).where("status IS NOT NULL").withColumn("score", F.round(score, 3))


def _met_evidence(met: DataFrame, values: DataFrame, config: LinkingConfig) -> DataFrame:
    both = sides(cut(met), values)  # cut, or the planner takes longer over all steps at once than they do on small tables
    invoice_left = F.col("l.document_type") == "INVOICE"
    relationship = F.concat(F.lit("INVOICE_"), F.when(invoice_left, F.col("r.document_type")).otherwise(F.col("l.document_type")))
    both = both.withColumns({"amounts": _amount_evidence(), "days": _days_apart(), "named": similarity.best_of(F.col("l.names"), F.col("r.names"))})
    known = (F.size("l.amounts") > 0) & (F.size("r.amounts") > 0)
    return both.select(
        "left_id", "right_id", relationship.alias("relationship"),
        F.coalesce(F.arrays_overlap("l.keys", "r.keys"), F.lit(False)).alias("identifier_match"),
        F.coalesce("named.resolved", F.lit(False)).alias("entity_match"), F.col("named.score").alias("entity_score"), "days",
        F.col("amounts.difference").alias("amount_difference"), F.col("amounts.percent").alias("amount_percent"),
        F.when(known, F.coalesce(F.col("amounts.percent") <= config.amount_tolerance, F.lit(False))).alias("amount_compatible"),
    )


def competition(links: DataFrame) -> DataFrame:
    """Of a left document with several links all become ambiguous.

    Only what is linked is counted and shuffled, since unsure links may be as many as the square of the documents; links are read twice.
    """
    linked = links.where("status = 'LINKED'").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("left_id")))
    linked = linked.withColumn("status", F.when(F.col("n") > 1, "AMBIGUOUS").otherwise(F.col("status"))).drop("n")
    return links.where("status <> 'LINKED'").unionByName(linked.select(links.columns))


def entry_kind(entry_type: Column) -> Column:
    """Expense or revenue from what an entry's type says; null if it says neither."""
    text = F.lower(entry_type)
    return F.when(text.rlike("|".join(EXPENSE_WORDS)), "expense").when(text.rlike("|".join(REVENUE_WORDS)), "revenue")


def unreferenced(facts: DataFrame, links: DataFrame, window: float = 0.25, days: int = compare.DATE_TOLERANCE) -> DataFrame:
    """(left_id, right_id): invoices and revenue postings without identifiers that are each other's only candidate.

    They meet in cells of ``days`` and of amounts by which ``window`` reaches one cell on.  Documents that have a
    link to a ledger are left out, and invoices, not postings, that have an ambiguous one.
    """
    ends = F.explode(F.array("left_id", "right_id")).alias("document_id")
    paired = links.where("relationship = 'INVOICE_LEDGER' AND status = 'LINKED'").select(ends)
    contested = links.where("status = 'AMBIGUOUS'").select(ends).distinct()  # before they are joined, since links may be many times the documents
    contested = contested.join(facts.where("document_type = 'INVOICE'").select("document_id"), "document_id", "left_semi")
    own = facts.where("amount IS NOT NULL AND date IS NOT NULL").join(paired.union(contested).distinct(), "document_id", "left_anti")
    # A hair wider than the window, for amounts at its edge.
    reach = max(1 + window, 1 / (1 - window))
    own = own.withColumns({"week": F.floor(F.unix_date("date") / days), "cell": _bucket(F.col("amount"), reach * (1 + 1e-9))})
    kind = F.coalesce(entry_kind(F.col("entry_type")), F.lit("revenue"))
    invoice = own.where("document_type = 'INVOICE'").select(F.col("document_id").alias("a"), F.col("amount").alias("x"), F.col("date").alias("d"), "week", "cell")
    invoice = invoice.withColumn("week", _around("week")).withColumn("cell", _around("cell"))
    posting = own.where((F.col("document_type") == "LEDGER") & (F.size("identifiers") == 0) & (kind == "revenue"))
    posting = posting.select(F.col("document_id").alias("b"), F.col("amount").alias("y"), F.col("date").alias("e"), "week", "cell")
    share = F.abs(F.col("x") - F.col("y")).cast("double") / F.greatest(F.abs("x"), F.lit(1)).cast("double")
    met = invoice.join(posting, ["week", "cell"]).where((F.abs(F.datediff("d", "e")) <= days) & (share <= window)).select("a", "b")
    count = F.count(F.lit(1))
    alone = met.withColumn("n", count.over(Window.partitionBy("a"))).withColumn("m", count.over(Window.partitionBy("b"))).where("n = 1 AND m = 1")
    return alone.select(*_ordered(F.col("a"), F.col("b")))
