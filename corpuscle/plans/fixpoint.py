"""The held-out search over Spark: candidate sets are trained and measured as one table, a task each; its state is a journal of files.

Figures of a set are coverage (words and inflected words among its tokens), and the sums over held-out shards of tokens and of dead
tokens, as tenths of their means. A state holds the kept pairs and the rounds; it is written after each round and read again to go on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.cluster import checkpointed
from corpuscle.operators import bpe, evaluation, metrics, morphology, search
from corpuscle.operators.search import Delta, Pair, State
from corpuscle.sources.vocabularies import exists


class Evaluator:
    """Figures of sets of blocked pairs, over a corpus that is counted once."""

    def __init__(self, spark: SparkSession, train_chunks: DataFrame, held_out: DataFrame, words: list[str], vocab_size: int, base: tuple[Pair, ...] = (), **rules):
        """held_out: (shard, chunk, n); base: pairs that every set blocks; rules: what else bpe.Rules.of() takes."""
        self.spark, self.words, self.vocab_size, self.base, self.rules = spark, words, vocab_size, base, rules
        self.train, self.held = checkpointed(train_chunks.select("chunk", "n")), checkpointed(held_out.select("shard", "chunk", "n"))
        self.shards = self.held.select("shard").distinct().count()

    def table(self, sets: list[list[Pair]]) -> DataFrame:
        """(cand, base, infl, tokens, dead, error), with sums over shards."""
        rules = [(k, bpe.Rules.of(blocked=(*s, *self.base), **self.rules)) for k, s in enumerate(sets)]
        out = evaluation.evaluate_candidates(self.spark, self.train, self.held, self.words, rules, self.vocab_size)
        total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
        return out.select("cand", "base", "infl", total("tokens").alias("tokens"), total("dead").alias("dead"), "error")

    def __call__(self, sets: list[list[Pair]]) -> list[Delta | None]:
        rows = {r.cand: r for r in self.table(sets).collect()}  # a row for each candidate set
        tenths = lambda n: round(n * 10 / self.shards)
        return [None if rows[k].error else (rows[k].base + rows[k].infl, tenths(rows[k].tokens), tenths(rows[k].dead)) for k in range(len(sets))]


def save_state(spark: SparkSession, state: State, folder: str) -> None:
    """Appends the state to the journal: one small file each time, numbered; the last number counts."""
    state.saves += 1
    plain = asdict(state)
    for r in plain["rounds"]:
        r["verdicts"] = [[*p, *d] for p, d in r.get("verdicts", {}).items()]
    plain["scored"] = [[*p, *(d or ())] for p, d in state.scored.items()]
    spark.createDataFrame([(state.saves, json.dumps(plain))], "save int, state string").coalesce(1).write.mode("overwrite").json(f"{folder}/state/save={state.saves:06d}-{uuid.uuid4().hex[:8]}")


def load_state(spark: SparkSession, folder: str) -> State | None:
    """The state written last to a journal; None if there is none."""
    if not exists(spark, f"{folder}/state"):
        return None
    row = spark.read.schema("save int, state string").option("recursiveFileLookup", True).json(f"{folder}/state").where("state is not null").orderBy(F.desc("save")).first()
    if row is None:
        return None
    plain = json.loads(row.state)
    pairs = lambda xs: [tuple(p) for p in xs]
    for r in plain["rounds"]:
        r["verdicts"] = {(v[0], v[1]): tuple(v[2:]) for v in r.get("verdicts", [])}
        for k in ("ejected", "vetoed", "released"):
            r[k] = pairs(r.get(k, []))
        r["committed"] = tuple(r["committed"]) if r.get("committed") else None
    scored = {(v[0], v[1]): tuple(v[2:]) or None for v in plain["scored"]}
    return State(pairs(plain["kept"]), plain["rounds"], plain["status"], plain["saves"], scored, None if plain["ejected"] is None else pairs(plain["ejected"]))


def events(spark: SparkSession, state: State) -> DataFrame:
    """(round, seq, l, r, kind) of all rounds; within one, what went comes before what came."""
    rows, seq = [], 0
    for k, r in enumerate(state.rounds, 1):
        for kind, pairs in (("eject", r.get("ejected", [])), ("veto", r.get("vetoed", [])), ("release", r.get("released", [])), ("commit", [r["committed"]] if r.get("committed") else [])):
            for p in pairs:
                rows.append((k, seq, *p, kind))
                seq += 1
    return spark.createDataFrame(rows, "round int, seq int, l string, r string, kind string")


def verdict_table(spark: SparkSession, state: State) -> DataFrame:
    """(round, l, r, cov, comp, dead) of all scored candidates."""
    rows = [(k, *p, *d) for k, r in enumerate(state.rounds, 1) for p, d in r.get("verdicts", {}).items()]
    return spark.createDataFrame(rows, "round int, l string, r string, cov int, comp int, dead int")


def run(evaluate: Callable, mine: Callable, folder: str, spark: SparkSession, rounds: int = 10, **options) -> State:
    """Goes on from the journal in the folder, if there is one, until the search converges or there are so many rounds; writes it after each step, also within a round.
    options: of search.search(), such as batch."""
    state = load_state(spark, folder) or State()
    if state.status == "converged":
        return state
    return search.search(evaluate, mine, rounds=rounds, state=state, journal=lambda s: save_state(spark, s, folder), **options)


def miner(evaluator: Evaluator, percentile: float = 40, most: int = 50) -> Callable[[list[Pair]], list[Pair]]:
    """Proposes the merges of the tokens that fire least: those at or below a percentile of the merged tokens' firings, the rarest first, in the vocabulary that bars what is kept."""

    def mine(kept: list[Pair]) -> list[Pair]:
        rules = bpe.Rules.of(blocked=(*kept, *evaluator.base), **evaluator.rules)
        made = bpe.collected(bpe.train(evaluator.train, evaluator.vocab_size, rules))
        table = evaluator.spark.createDataFrame(bpe._frame(made), bpe.MERGES)
        fires = metrics.fire_counts(bpe.encoded(evaluator.train, made))
        rare = morphology.below_percentile(bpe.vocabulary(table), fires, percentile).orderBy("fires", "id").limit(most).collect()
        whole = {i: bytes((i,)) for i in range(bpe.BYTES)} | {m.id: m.bytes for m in made}
        of = {m.id: (whole[m.left], whole[m.right]) for m in made if not m.forced}
        out = []
        for r in rare:
            try:
                out.append(tuple(x.decode() for x in of[r.id]))
            except (KeyError, UnicodeDecodeError):  # half a character can't be told as text
                continue
        return out

    return mine


def searched(evaluator: Evaluator, mine: Callable, rounds: int, **options) -> State:
    """A search from nothing, without a journal."""
    return search.search(evaluator, mine, rounds=rounds, **options)


def kept_table(spark: SparkSession, state: State) -> DataFrame:
    """(l, r, kept) of the pairs that a search keeps."""
    return spark.createDataFrame([(*p, True) for p in state.kept], "l string, r string, kept boolean")


def propose(evaluate: Callable, mine: Callable, state: State, **tolerance) -> list[tuple[Pair, Delta]]:
    """Scored candidates that would be kept now, the best first; nothing is committed."""
    pool = sorted(set(mine(state.kept)) - set(state.kept))
    reference, *scores = evaluate([state.kept, *[[*state.kept, p] for p in pool]])
    deltas = {p: tuple(a - b for a, b in zip(s, reference, strict=True)) for p, s in zip(pool, scores, strict=True) if s is not None}
    keeps = [(p, d) for p, d in deltas.items() if search.passes(d, **tolerance)]
    return sorted(keeps, key=lambda x: (x[1][1] > 0 or x[1][2] > 0, -x[1][0], x[1][1], x[1][2], x[0]))


def commit(evaluate: Callable, state: State, pairs: list[Pair], passes: Callable[[Delta], bool] = search.passes, journal: Callable[[State], None] = lambda state: None) -> dict[Pair, str]:
    """Commits vetted pairs in order, each measured against what is kept by then: committed, evaporated (it helps no more), vetoed
    (the set is worse after the ejections that it causes), or error. The state gets a round for each that is committed; journal(state) is called behind it."""
    out: dict[Pair, str] = {}
    minus = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    for p in pairs:
        reference, alone = evaluate([state.kept, [*state.kept, p]])
        if reference is None or alone is None:
            out[p] = "error"
            continue
        if p in state.kept or not passes(minus(alone, reference)):
            out[p] = "evaporated"
            continue
        trial = [*state.kept, p]
        while bad := left_out(evaluate, trial, passes):
            trial = [k for k in trial if k not in bad]
        after = evaluate([trial])[0]
        if after is None or not passes(minus(after, reference)):
            out[p] = "vetoed"
            continue
        state.rounds.append({"ejected": [k for k in state.kept if k not in trial], "vetoed": [], "released": [], "committed": p, "verdicts": {p: minus(alone, reference)}})
        state.kept, out[p] = trial, "committed"
        journal(state)
    return out


def left_out(evaluate: Callable, kept: list[Pair], passes: Callable[[Delta], bool] = search.passes) -> list[Pair]:
    """The kept pairs that don't earn their place: leaving one out alone isn't worse."""
    if len(kept) < 2:
        return []
    whole, *others = evaluate([kept, *[[x for x in kept if x != k] for k in kept]])
    return [k for k, o in zip(kept, others, strict=True) if whole is not None and o is not None and not passes(tuple(a - b for a, b in zip(whole, o, strict=True)))]


def harvest(evaluate: Callable, state: State, candidates: list[Pair], chunk: int = 32, clean_every: int = 16, most_cov: int | None = None, passes: Callable[[Delta], bool] = search.passes, journal: Callable[[State], None] = lambda state: None) -> int:
    """Commits many candidates: a chunk is scored at once, and what passes is measured again against what is kept by then, the most
    compressive first. After so many commits, and at the end, pairs that no longer earn their place go. journal(state) is called after each change. Returns the number of commits."""
    minus = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    good = lambda d: passes(d) and (most_cov is None or d[0] <= most_cov)
    reference, done, since = evaluate([state.kept])[0], 0, 0

    def clean() -> None:
        nonlocal reference
        if bad := left_out(evaluate, state.kept, passes):
            state.kept = [k for k in state.kept if k not in bad]
            state.rounds.append({"ejected": bad, "vetoed": [], "released": [], "committed": None, "verdicts": {}})
            journal(state)
            reference = evaluate([state.kept])[0]

    todo = [p for p in candidates if p not in state.kept]
    for i in range(0, len(todo), chunk):
        part = todo[i : i + chunk]
        scores = evaluate([[*state.kept, p] for p in part])
        first = sorted((minus(s, reference)[1], p) for p, s in zip(part, scores, strict=True) if s is not None and good(minus(s, reference)))
        for _, p in first:
            now = evaluate([[*state.kept, p]])[0]
            if now is None or not good(minus(now, reference)):
                continue
            state.rounds.append({"ejected": [], "vetoed": [], "released": [], "committed": p, "verdicts": {p: minus(now, reference)}})
            state.kept, reference, done, since = [*state.kept, p], now, done + 1, since + 1
            journal(state)
        if since >= clean_every:
            clean()
            since = 0
    clean()
    return done


def generalization(spark: SparkSession, evaluator: Evaluator, state: State, every: int) -> DataFrame:
    """(round, n_kept, d_cov, d_comp, d_dead): the kept sets after every so many rounds against no set at all, on the evaluator's (fresh) shards; comp and dead in tenths of means."""
    steps = search.trajectory(events(spark, state), every, len(state.rounds)).collect()  # a row for each kept pair of a sampled round
    sets: dict[int, list[Pair]] = {}
    for r in steps:
        sets.setdefault(r["round"], [])
        if r.l is not None:
            sets[r["round"]].append((r.l, r.r))
    baseline, *figures = evaluator([[], *sets.values()])
    rows = [(k, len(s), *(a - b for a, b in zip(f, baseline, strict=True))) for (k, s), f in zip(sets.items(), figures, strict=True) if f is not None]
    return spark.createDataFrame(rows, "round int, n_kept int, d_cov int, d_comp int, d_dead int")
