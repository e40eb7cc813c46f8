"""Greedy held-out search over blocked merges: gates, leave-one-out, cooldown, journal, and the round loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(cov: Column, comp: Column, dead: Column, dead_tolerance: float = 0.0, comp_tolerance: float = 0.0) -> Column:
    """Keep: no axis is worse and one is better; or compression is bought with some dead tokens; or coverage with some compression."""
    keep = (cov >= 0) & (comp <= 0) & (dead <= 0) & ((cov > 0) | (comp < 0) | (dead < 0))
    if dead_tolerance > 0:
        keep = keep | ((cov >= 0) & (comp < 0) & (dead <= dead_tolerance))
    if comp_tolerance > 0:
        keep = keep | ((cov > 0) & (comp <= comp_tolerance) & (dead <= dead_tolerance))
    return keep


def harvest_gate(cov: Column, comp: Column, dead: Column, comp_tolerance: float = 3.0, dead_tolerance: float = 1.0) -> Column:
    """A looser one: coverage isn't lost, compression and dead tokens cost no more than is tolerated, and one axis gains."""
    return (cov >= 0) & (comp <= comp_tolerance) & (dead <= dead_tolerance) & ((cov > 0) | (comp < 0) | (dead < 0))


def free_wins(scored: DataFrame, floor: float) -> DataFrame:
    """Scored candidates (l, r, cov, comp, dead) that pass the harvest gate and compress at least to the floor, the most compressive first."""
    passing = scored.where(harvest_gate(F.col("cov"), F.col("comp"), F.col("dead")) & (F.col("comp") <= floor))
    return passing.withColumn("place", F.row_number().over(Window.orderBy("comp", "l", "r")))


def keyed_verdicts(verdicts: DataFrame, pool: DataFrame) -> DataFrame:
    """Verdicts (pair: "L+R", ...) with the operands l and r of the pool's pair of that key, and whether another pair has that key too: such a verdict stands
    beside each of them, told to be ambiguous."""
    keys = pool.select("l", "r", F.concat_ws("+", "l", "r").alias("pair")).distinct()
    many = keys.groupBy("pair").agg((F.count("*") > 1).alias("ambiguous"))
    return verdicts.join(keys, "pair").join(many, "pair")


def round_tallies(verdicts: DataFrame) -> DataFrame:
    """(round, mode, n, least_comp, most_cov) of scored candidates (round, l, r, cov, comp, dead)."""
    mode = failure(F.col("cov"), F.col("comp"), F.col("dead"))
    return verdicts.groupBy("round", mode.alias("mode")).agg(F.count("*").alias("n"), F.min("comp").alias("least_comp"), F.max("cov").alias("most_cov"))


def common_rights(kept: DataFrame, k: int = 8) -> DataFrame:
    """(r, n): the right operands that most kept pairs share."""
    return kept.groupBy("r").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r").limit(k)


def trajectory(events: DataFrame, every: int, rounds: int) -> DataFrame:
    """(round, n_kept, l, r): the kept pairs after every so many rounds and the last; rounds whose set is that of the sampled round before are left out.

    events: (round, seq, l, r, kind) with kinds commit, eject.
    """
    at = sorted({r for r in range(every, rounds + 1, every)} | {rounds})
    steps = events.sparkSession.createDataFrame([(r,) for r in at], "at int")
    last = events.join(F.broadcast(steps), events["round"] <= steps["at"]).groupBy("at", "l", "r").agg(F.max_by("kind", F.struct("round", "seq")).alias("kind")).where("kind = 'commit'")
    sets = steps.join(last.groupBy("at").agg(F.array_sort(F.collect_set(F.struct("l", "r"))).alias("kept")), "at", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<l: string, r: string>>")))
    w = Window.orderBy("at")  # a row for each sampled round
    own = sets.withColumn("_before", F.lag("kept").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("kept")))
    return own.select(F.col("at").alias("round"), F.size("kept").alias("n_kept"), F.explode_outer("kept").alias("p")).select("round", "n_kept", "p.l", "p.r")


def failure(cov: Column, comp: Column, dead: Column) -> Column:
    """KEEP, or the first axis that fails: A coverage, B compression, C dead tokens."""
    return F.when(gate(cov, comp, dead), "KEEP").when(cov <= 0, "A").when(comp > 0, "B").otherwise("C")


def tenths(total: Column, shards: int) -> Column:
    """A mean over shards in tenths, from an integer sum, halves to even as Python rounds."""
    return F.bround(total.cast("decimal(38,6)") * 10 / shards, 0).cast("long")


def deltas(now: DataFrame, reference: DataFrame, shards: int) -> DataFrame:
    """(cand, d_cov, d_comp, d_dead): coverage change, and changes of mean tokens and dead tokens in tenths. now: (cand, cov, tokens, dead); reference: one such row."""
    r = reference.select(*[F.col(c).alias(f"_{c}") for c in ("cov", "tokens", "dead")])
    j = now.crossJoin(F.broadcast(r))
    return j.select("cand", (F.col("cov") - F.col("_cov")).alias("d_cov"), tenths(F.col("tokens") - F.col("_tokens"), shards).alias("d_comp"), tenths(F.col("dead") - F.col("_dead"), shards).alias("d_dead"))


def best_first(keeps: DataFrame) -> DataFrame:
    """keeps in order: free ones before costed ones, then by coverage, compression, dead tokens, pair."""
    costed = (F.col("d_comp") > 0) | (F.col("d_dead") > 0)
    return keeps.withColumn("_costed", costed).withColumn("place", F.row_number().over(Window.orderBy("_costed", F.desc("d_cov"), "d_comp", "d_dead", "l", "r"))).drop("_costed")


def cooldown(events: DataFrame, base: int) -> DataFrame:
    """(l, r, ejects, until): a pair's k-th ejection or veto in round i benches it until i + base * 2^min(k - 1, 10); a release ends it.

    events: (round, l, r, kind) with kinds eject, veto, release.
    """
    w = Window.partitionBy("l", "r")
    jail = F.col("kind") != "release"
    k = F.count(F.when(jail, 1)).over(w.orderBy("round", F.when(jail, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0))
    until = F.when(jail, F.col("round") + base * F.pow(F.lit(2), F.least(F.col("_k") - 1, F.lit(10)))).otherwise(F.col("round")).cast("long")
    e = events.withColumn("_k", k).where("_k > 0").withColumn("until", until)
    last = F.struct("round", F.when(jail, 0).otherwise(1).alias("o"), "_k")
    return e.groupBy("l", "r").agg(F.max("_k").alias("ejects"), F.max_by("until", last).alias("until"))


def benched(events: DataFrame, base: int, next_round: int) -> DataFrame:
    return cooldown(events, base).where(F.col("until") >= next_round).select("l", "r")


def pool_of(mined: DataFrame, kept: DataFrame, bench: DataFrame) -> DataFrame:
    """Mined pairs without those kept or benched."""
    return mined.select("l", "r").distinct().join(kept.select("l", "r"), ["l", "r"], "left_anti").join(bench.select("l", "r"), ["l", "r"], "left_anti")


def kept_at(events: DataFrame, round: int) -> DataFrame:
    """Pairs whose last event up to the round is a commit. events: (round, seq, l, r, kind) with kinds commit, eject."""
    last = events.where(F.col("round") <= round).groupBy("l", "r").agg(F.max_by("kind", F.struct("round", "seq")).alias("kind"))
    return last.where("kind = 'commit'").select("l", "r")


Pair = tuple[str, str]
Delta = tuple[int, int, int]  # coverage, tenths of mean tokens, tenths of mean dead tokens


def passes(d: Delta, dead_tolerance: int = 0, comp_tolerance: int = 0) -> bool:
    """gate() for one candidate, in tenths."""
    cov, comp, dead = d
    if cov >= 0 and comp <= 0 and dead <= 0 and (cov > 0 or comp < 0 or dead < 0):
        return True
    if dead_tolerance > 0 and cov >= 0 and comp < 0 and dead <= dead_tolerance:
        return True
    return comp_tolerance > 0 and cov > 0 and comp <= comp_tolerance and dead <= dead_tolerance


@dataclass
class State:
    """A search as its journal tells it: rounds of what was pooled, committed, ejected, vetoed and released."""

    kept: list[Pair] = field(default_factory=list)
    rounds: list[dict] = field(default_factory=list)
    status: str = "running"
    saves: int = 0  # how often it was written
    scored: dict[Pair, Delta | None] = field(default_factory=dict)  # candidates of the round that is under way
    ejected: list[Pair] | None = None  # what that round has ejected, once it has

    def bench(self, base: int) -> dict[Pair, tuple[int, int]]:
        out: dict[Pair, tuple[int, int]] = {}
        for i, r in enumerate(self.rounds, 1):
            for p in [*r.get("ejected", []), *r.get("vetoed", [])]:
                k = out.get(p, (0, 0))[0] + 1
                out[p] = (k, i + base * 2 ** min(k - 1, 10))
            for p in r.get("released", []):
                if p in out:
                    out[p] = (out[p][0], i)
        return out if base else {}


def search(
    evaluate: Callable[[list[list[Pair]]], list[Delta | None]],
    mine: Callable[[list[Pair]], list[Pair]],
    rounds: int = 10,
    cooldown_base: int = 2,
    net_commit: bool = True,
    state: State | None = None,
    journal: Callable[[State], None] = lambda state: None,
    batch: int | None = None,
    **tolerance,
) -> State:
    """Rounds until no pair helps and none is benched, or `rounds` of them.

    evaluate(sets): figures (coverage, tenths, tenths) of each set of blocked pairs, None where one failed; mine(kept): candidate pairs.
    A round ejects kept pairs that no longer earn their place, scores the pool, and commits the best keep; with net_commit
    the commit is undone if, after the ejections that it causes, the set as a whole isn't better.

    The pool is scored in batches, if told; journal(state) is called when a round has ejected, after each batch and after each round, so a search that
    stops goes on behind the last batch.
    """
    state = state or State()

    def minus(a: Delta, b: Delta) -> Delta:
        return (a[0] - b[0], a[1] - b[1], a[2] - b[2])

    def non_earners(kept: list[Pair]) -> list[Pair]:
        if len(kept) < 2:
            return []
        whole, *others = evaluate([kept, *[[x for x in kept if x != k] for k in kept]])
        return [k for k, o in zip(kept, others, strict=True) if o is not None and whole is not None and not passes(minus(whole, o), **tolerance)]

    while len(state.rounds) < rounds:
        if state.ejected is None:
            state.ejected = non_earners(state.kept)
            state.kept = [k for k in state.kept if k not in state.ejected]
            state.scored = {}
            journal(state)
        entry: dict = {"ejected": list(state.ejected), "vetoed": [], "released": []}
        number = len(state.rounds) + 1
        bench = State(rounds=[*state.rounds, entry]).bench(cooldown_base)
        resting = {p for p, (_, until) in bench.items() if until >= number}
        pool = sorted(p for p in set(mine(state.kept)) if p not in state.kept and p not in resting)
        reference, todo = None, [p for p in pool if p not in state.scored]
        for i in range(0, max(1, len(todo)), batch or max(1, len(todo))):
            part = todo[i : i + (batch or len(todo))]
            reference, *scores = evaluate([state.kept, *[[*state.kept, p] for p in part]])
            state.scored |= {p: None if s is None or reference is None else minus(s, reference) for p, s in zip(part, scores, strict=True)}
            if part:
                journal(state)
        verdicts = {p: state.scored[p] for p in pool if state.scored.get(p) is not None}
        keeps = sorted((p for p, d in verdicts.items() if passes(d, **tolerance)), key=lambda p: (verdicts[p][1] > 0 or verdicts[p][2] > 0, -verdicts[p][0], verdicts[p][1], verdicts[p][2], p))
        entry |= {"n_pool": len(pool), "n_keeps": len(keeps), "verdicts": verdicts, "committed": None}
        for p in keeps:
            trial = [*state.kept, p]
            if net_commit:
                while out := non_earners(trial):
                    trial = [k for k in trial if k not in out]
                after = evaluate([trial])[0]
                if after is None or not passes(minus(after, reference), **tolerance):
                    entry["vetoed"].append(p)
                    continue
                entry["ejected"] += [k for k in state.kept if k not in trial]
            state.kept, entry["committed"] = trial, p
            break
        if entry["committed"] is None and not keeps and resting:
            entry["released"] = [min(resting, key=lambda p: (bench[p][1], bench[p][0], p))]
        state.rounds.append(entry)
        state.scored, state.ejected = {}, None
        if entry["committed"] is None and not entry["vetoed"] and not resting:
            state.status = "converged"
        journal(state)
        if state.status == "converged":
            break
    return state
