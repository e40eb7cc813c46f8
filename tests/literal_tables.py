"""Operators over small tables and files given here, each with SQL for the same: tests of what no given table can feed. They are no queries of the library."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.cluster import shared_dir
from corpuscle.functions import text as T
from corpuscle.operators import metrics, morphology, probes, registers, search
from corpuscle.plans import reports, sinks
from corpuscle.sources import corpus, vocabularies

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add

_DELTAS = [("a", "b", 1, 0, 0), ("a", "c", 0, -11, -2), ("b", "c", 0, -5, 2), ("c", "d", 2, 4, 0), ("d", "e", -1, -30, -4), ("e", "f", 0, 0, 0), ("f", "g", 0, 2, -3), ("g", "h", 3, -1, 9)]

_EVENTS = [(1, 1, "a", "b", "commit"), (2, 2, "c", "d", "commit"), (3, 3, "a", "b", "eject"), (4, 4, "a", "b", "commit"), (5, 5, "e", "f", "veto"), (6, 6, "a", "b", "eject"), (7, 7, "e", "f", "veto"), (8, 8, "e", "f", "release"), (9, 9, "c", "d", "eject"), (10, 10, "e", "f", "veto")]


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query(f"""SELECT l, r, (cov >= 0 AND comp <= 0 AND dead <= 0 AND (cov > 0 OR comp < 0 OR dead < 0)) OR (cov >= 0 AND comp < 0 AND dead <= 2) OR (cov > 0 AND comp <= 5 AND dead <= 2) AS keep,
CASE WHEN cov >= 0 AND comp <= 0 AND dead <= 0 AND (cov > 0 OR comp < 0 OR dead < 0) THEN 'KEEP' WHEN cov <= 0 THEN 'A' WHEN comp > 0 THEN 'B' ELSE 'C' END AS mode FROM (VALUES {values(_DELTAS)}) t(l, r, cov, comp, dead)""")
def pareto_gate(spark, sf_dir):
    t = spark.createDataFrame(_DELTAS, "l string, r string, cov int, comp int, dead int")
    c = [F.col(x) for x in ("cov", "comp", "dead")]
    return t.select("l", "r", search.gate(*c, 2, 5).alias("keep"), search.failure(*c).alias("mode"))


@query(f"""WITH e AS (SELECT * FROM (VALUES {values(_EVENTS)}) t(round, seq, l, r, kind) WHERE kind <> 'commit'), k AS (SELECT *, count(*) FILTER (kind <> 'release') OVER (PARTITION BY l, r ORDER BY round) AS k FROM e)
SELECT l, r, max(k) AS ejects, max_by(CASE WHEN kind = 'release' THEN round ELSE round + 2 * 2 ** least(k - 1, 10) END, round)::BIGINT AS until FROM k GROUP BY l, r""")
def cooldown_bench(spark, sf_dir):
    return search.cooldown(spark.createDataFrame(_EVENTS, "round int, seq int, l string, r string, kind string").where("kind <> 'commit'"), 2)


@query(f"""SELECT l, r FROM (SELECT l, r, max_by(kind, seq) AS kind FROM (VALUES {values(_EVENTS)}) t(round, seq, l, r, kind) WHERE round <= 8 AND kind IN ('commit', 'eject') GROUP BY l, r) WHERE kind = 'commit'""")
def journal_replay(spark, sf_dir):
    e = spark.createDataFrame(_EVENTS, "round int, seq int, l string, r string, kind string")
    return search.kept_at(e.where(F.col("kind").isin("commit", "eject")), 8)

_RUNS_ROWS = [("base", "arc", 0.40, 0.20), ("base", "boolq", 0.62, 0.24), ("base", "piqa", 0.71, 0.42), ("new", "arc", 0.43, 0.24), ("new", "boolq", 0.60, 0.20)]

_META_ROWS = [("arc", 1172), ("boolq", 3270), ("piqa", 1838)]

_HISTORY = [(r, "loss", s, float(5 - s + (r == "b"))) for r in "ab" for s in range(1, 8) if not (r == "b" and s == 3)]


@query(f"""WITH e AS (SELECT * FROM (VALUES {values(_RUNS_ROWS)}) t(run, task, accuracy, centered)), m AS (SELECT * FROM (VALUES {values(_META_ROWS)}) t(task, n))
SELECT task, n, round((b.centered - a.centered)::DOUBLE, 9) AS d_centered, round(sqrt(a.accuracy::DOUBLE * (1 - a.accuracy::DOUBLE) / n), 9) AS se FROM e a JOIN e b USING (task) JOIN m USING (task) WHERE a.run = 'base' AND b.run = 'new'""")
def task_se(spark, sf_dir):
    e = spark.createDataFrame(_RUNS_ROWS, "run string, task string, accuracy double, centered double")
    out = registers.task_changes(e.where("run = 'base'"), e.where("run = 'new'"), spark.createDataFrame(_META_ROWS, "task string, n int"))
    return out.select("task", "n", F.round("d_centered", 9).alias("d_centered"), F.round("se", 9).alias("se"))


@query(f"SELECT key, step FROM (VALUES {values(_HISTORY)}) t(run, key, step, value) GROUP BY ALL HAVING count(DISTINCT run) = 2")
def trajectory_common_steps(spark, sf_dir):
    return registers.common_steps(spark.createDataFrame(_HISTORY, "run string, key string, step int, value double"), 2)


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM (VALUES {values(_HISTORY)}) t(run, key, step, value))
SELECT run, count(*) AS count, max(value)::DOUBLE AS max, min(value)::DOUBLE AS min, avg(value) FILTER (r <= 5) AS last_mean FROM h GROUP BY run""")
def loss_summary(spark, sf_dir):
    return registers.loss_summary(spark.createDataFrame(_HISTORY, "run string, key string, step int, value double"))


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def file(spark: SparkSession, name: str, text: str) -> str:
    """A folder in the shared place with one file of that text; readers read it as they would any other."""
    path = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.text(path)
    return path

_ROUNDS = [(r, *d) for r in (1, 2) for d in _DELTAS if (r, d[0]) != (2, "a")]

_SCORED = "l string, r string, cov int, comp int, dead int"


@query(f"SELECT l, r, NOT (cov < 0 OR comp > 3 OR dead > 1) AND (cov > 0 OR comp < 0 OR dead < 0) AS keep FROM (VALUES {values([*_DELTAS, ('x', 'a', 0, -5, 1), ('x', 'b', 1, 0, 1), ('x', 'c', 0, 3, -1), ('x', 'd', 1, 4, 0)])}) t(l, r, cov, comp, dead)")
def harvest_gate(spark, sf_dir):
    t = frame(spark, [*_DELTAS, ("x", "a", 0, -5, 1), ("x", "b", 1, 0, 1), ("x", "c", 0, 3, -1), ("x", "d", 1, 4, 0)], _SCORED)
    return t.select("l", "r", search.harvest_gate(*[F.col(c) for c in ("cov", "comp", "dead")]).alias("keep"))


@query(f"SELECT l, r, cov, comp, dead, row_number() OVER (ORDER BY comp, l, r)::INT AS place FROM (VALUES {values(_DELTAS)}) t(l, r, cov, comp, dead) WHERE NOT (cov < 0 OR comp > 3 OR dead > 1) AND (cov > 0 OR comp < 0 OR dead < 0) AND comp <= -2")
def free_wins(spark, sf_dir):
    return search.free_wins(frame(spark, _DELTAS, _SCORED), -2.0)


@query(f"SELECT l, r, row_number() OVER (ORDER BY comp > 0 OR dead > 0, cov DESC, comp, dead, l, r)::INT AS place FROM (VALUES {values(_DELTAS)}) t(l, r, cov, comp, dead)")
def keeps_in_order(spark, sf_dir):
    t = frame(spark, _DELTAS, "l string, r string, d_cov int, d_comp int, d_dead int")
    return search.best_first(t).select("l", "r", "place")


@query(f"""SELECT l, r FROM (VALUES {values([d[:2] for d in _DELTAS])}) t(l, r) WHERE (l, r) NOT IN (('c', 'd'), ('a', 'c')) AND (l, r) NOT IN (('e', 'f'), ('z', 'z'))""")
def pool_left(spark, sf_dir):
    pairs = lambda rows: frame(spark, rows, "l string, r string")
    return search.pool_of(pairs([d[:2] for d in _DELTAS]), pairs([("c", "d"), ("a", "c")]), pairs([("e", "f"), ("z", "z")]))


@query(f"""SELECT round, CASE WHEN cov >= 0 AND comp <= 0 AND dead <= 0 AND (cov > 0 OR comp < 0 OR dead < 0) THEN 'KEEP' WHEN cov <= 0 THEN 'A' WHEN comp > 0 THEN 'B' ELSE 'C' END AS mode, count(*) AS n, min(comp) AS least_comp, max(cov) AS most_cov FROM (VALUES {values(_ROUNDS)}) t(round, l, r, cov, comp, dead) GROUP BY ALL""")
def round_tallies(spark, sf_dir):
    return search.round_tallies(frame(spark, _ROUNDS, f"round int, {_SCORED}"))


@query(f"SELECT r, count(*) AS n FROM (VALUES {values([d[:2] for d in _DELTAS])}) t(l, r) WHERE r <> 'd' GROUP BY r")
def blocks_by_right(spark, sf_dir):
    return morphology.blocks_by_right(frame(spark, [d[:2] for d in _DELTAS], "l string, r string"), ("d",))


@query(f"SELECT r, count(*) AS n FROM (VALUES {values([d[:2] for d in _DELTAS])}) t(l, r) GROUP BY r ORDER BY n DESC, r LIMIT 3")
def common_rights(spark, sf_dir):
    return search.common_rights(frame(spark, [d[:2] for d in _DELTAS], "l string, r string"), 3)


@query("SELECT v.pair, v.cov, p.l, p.r, count(*) OVER (PARTITION BY v.pair) > 1 AS ambiguous FROM (VALUES ('a+b', 1), ('a++b', 2), ('q+r', 3)) v(pair, cov) JOIN (VALUES ('a', 'b'), ('a', '+b'), ('a+', 'b'), ('c', 'd')) p(l, r) ON v.pair = p.l || '+' || p.r")
def keyed_verdicts(spark, sf_dir):
    v = frame(spark, [("a+b", 1), ("a++b", 2), ("q+r", 3)], "pair string, cov int")
    return search.keyed_verdicts(v, frame(spark, [("a", "b"), ("a", "+b"), ("a+", "b"), ("c", "d")], "l string, r string"))


@query(f"""WITH e AS (SELECT * FROM (VALUES {values(_EVENTS)}) t(round, seq, l, r, kind) WHERE kind IN ('commit', 'eject')), s AS (SELECT unnest([2, 4, 6, 8, 10]) AS pt), k AS (SELECT pt, l, r, max_by(kind, seq) AS kind FROM s JOIN e ON round <= pt GROUP BY ALL),
g AS (SELECT pt, list_sort(list(l || r) FILTER (kind = 'commit')) AS kept FROM s LEFT JOIN k USING (pt) GROUP BY pt), w AS (SELECT *, lag(kept) OVER (ORDER BY pt) AS before, lag(pt) OVER (ORDER BY pt) AS prev FROM g)
SELECT w.pt AS round, coalesce(len(kept), 0)::INT AS n_kept, k.l, k.r FROM w LEFT JOIN k ON k.pt = w.pt AND kind = 'commit' WHERE prev IS NULL OR coalesce(kept, []) <> coalesce(before, [])""")
def kept_trajectory(spark, sf_dir):
    e = frame(spark, _EVENTS, "round int, seq int, l string, r string, kind string").where(F.col("kind").isin("commit", "eject"))
    return search.trajectory(e, 2, 10)


@query("SELECT cand, (c - 10)::INT AS d_cov, round_even((t - 1003) * 10 / 4.0, 0)::BIGINT AS d_comp, round_even((d - 50) * 10 / 4.0, 0)::BIGINT AS d_dead FROM (VALUES (1, 12, 1001, 50), (2, 10, 1008, 47), (3, 9, 990, 53)) t(cand, c, t, d)")
def search_deltas(spark, sf_dir):
    """Changes of means over four shards, in tenths."""
    s = "cov int, tokens long, dead long"
    return search.deltas(frame(spark, [(1, 12, 1001, 50), (2, 10, 1008, 47), (3, 9, 990, 53)], f"cand int, {s}"), frame(spark, [(10, 1003, 50)], s), 4)


@query(f"SELECT l, r, ((row_number() OVER (ORDER BY l, r) - 1) // 3)::INT AS batch FROM (VALUES {values([d[:2] for d in _DELTAS])}) t(l, r)")
def candidate_batches(spark, sf_dir):
    return registers.in_batches(frame(spark, [d[:2] for d in _DELTAS], "l string, r string"), 3, ("l", "r"))

_RANKS = [("a", 10), ("b", 50), ("ab", 30), ("c", 12), ("bc", 60), ("d", 99), ("cd", 20)]


@query(f"""WITH k AS (SELECT * FROM (VALUES {values(_RANKS)}) t(s, rank)) SELECT p.l, p.r, t.rank AS target, x.rank AS l_rank, y.rank AS r_rank, greatest(x.rank, y.rank) - t.rank AS gap FROM (VALUES ('a', 'b'), ('b', 'c'), ('c', 'd'), ('x', 'a')) p(l, r) JOIN k t ON t.s = p.l || p.r JOIN k x ON x.s = p.l JOIN k y ON y.s = p.r WHERE x.rank >= t.rank OR y.rank >= t.rank""")
def latent_routes(spark, sf_dir):
    return morphology.latent_routes(frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "l string, r string"), frame(spark, _RANKS, "s string, rank int"))

_PAIRS = [(0, "a", "b", 50), (1, "b", "c", 40), (2, "c", "d", 30), (3, "x", "y", 20), (4, "a", "b", 10), (5, "d", "a", 9)]


@query(f"SELECT l, r, min(ord) AS ord FROM (VALUES {values(_PAIRS)}) t(ord, l, r, n) GROUP BY l, r")
def pairs_once(spark, sf_dir):
    return vocabularies.first_wins(frame(spark, _PAIRS, "ord int, l string, r string, n long"))


@query(f"SELECT DISTINCT l, r FROM (VALUES {values(_PAIRS)}, (9, 'q', 'r', 1)) t(ord, l, r, n)")
def excluded_blocks(spark, sf_dir):
    a = frame(spark, _PAIRS, "ord int, l string, r string, n long")
    return vocabularies.excluded([a, frame(spark, [("q", "r"), ("a", "b")], "l string, r string")])


@query(f"SELECT * FROM (VALUES {values(_PAIRS)}) t(ord, l, r, n) WHERE ord IN (1, 4)")
def pair_subset(spark, sf_dir):
    return vocabularies.subset(frame(spark, _PAIRS, "ord int, l string, r string, n long"), places=[4, 1])


@query(f"SELECT *, ord IN (1, 5) AS shadowed FROM (VALUES {values(_PAIRS)}) t(ord, l, r, n)")
def mined_artefact(spark, sf_dir):
    """(b, c) comes behind (a, b), (d, a) behind (c, d), which isn't shadowed because (b, c) is."""
    return vocabularies.mined_artefact(frame(spark, _PAIRS, "ord int, l string, r string, n long"))


@query("SELECT l, r, list_sort(list(DISTINCT m)) AS miners FROM (VALUES ('a', 'b', 'x'), ('a', 'b', 'y'), ('c', 'd', 'y')) t(l, r, m) GROUP BY l, r")
def pooled_miners(spark, sf_dir):
    pairs = lambda rows: frame(spark, rows, "l string, r string")
    return vocabularies.pooled({"x": pairs([("a", "b")]), "y": pairs([("a", "b"), ("c", "d")])})

_PREDICTIONS = [(1, "x", "a", "a", "b"), (2, "x", "b", "a", "a"), (3, "y", "a", "a", "a"), (4, "y", "c", "c", "c"), (5, "y", "b", "c", "b")]

_NLL = [("train", 0, 3.0, 10), ("train", 1, 5.0, 12), ("val", 0, 4.0, 10), ("val", 1, 9.0, 15), ("train", 0, 1.5, 7), ("val", 2, 2.5, 4), ("train", 2, 2.0, 5)]

_SERIES = [("a", 1, 4.0), ("a", 2, 2.5), ("a", 4, 6.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0)]

_PRED_SCHEMA, _NLL_SCHEMA, _SERIES_SCHEMA = "item int, task string, gold string, pred string, pred_changed string", "split string, bucket int, nats double, bytes int", "key string, step int, value double"


@query(f"SELECT task, count(*) AS n, round(avg((pred = gold)::INT), 9) AS accuracy, round(avg((pred <> pred_changed)::INT), 9) AS flip_rate FROM (VALUES {values(_PREDICTIONS)}) t(item, task, gold, pred, pred_changed) GROUP BY task")
def prediction_accuracy(spark, sf_dir):
    out = registers.accuracy(frame(spark, _PREDICTIONS, _PRED_SCHEMA), ("task",))
    return out.select("task", "n", F.round("accuracy", 9).alias("accuracy"), F.round("flip_rate", 9).alias("flip_rate"))


@query(f"SELECT pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (VALUES {values(_PREDICTIONS)}) t(item, task, gold, pred, pred_changed) GROUP BY pred")
def prediction_shares(spark, sf_dir):
    return registers.prediction_shares(frame(spark, _PREDICTIONS, _PRED_SCHEMA)).select("pred", "n", F.round("share", 9).alias("share"))


@query("SELECT item, min_by(option, (nats / tokens, option)) AS pred FROM (VALUES (1, 'a', 4.0, 2), (1, 'b', 3.0, 2), (2, 'b', 6.0, 3), (2, 'a', 4.0, 2), (2, 'c', 9.0, 1)) t(item, option, nats, tokens) GROUP BY item")
def chosen_options(spark, sf_dir):
    return registers.chosen(frame(spark, [(1, "a", 4.0, 2), (1, "b", 3.0, 2), (2, "b", 6.0, 3), (2, "a", 4.0, 2), (2, "c", 9.0, 1)], "item int, option string, nats double, tokens int"))


@query(f"SELECT bucket, round(sum(nats)::DOUBLE / ln(2), 9) AS bits, sum(bytes)::BIGINT AS bytes, round(sum(nats)::DOUBLE / ln(2) / sum(bytes), 9) AS bits_per_byte, round(sum(bytes) / sum(sum(bytes)) OVER (), 9) AS byte_share FROM (VALUES {values(_NLL)}) t(split, bucket, nats, bytes) GROUP BY bucket")
def bits_by_bucket(spark, sf_dir):
    out = metrics.bits_per_byte(frame(spark, _NLL, _NLL_SCHEMA), "bucket")
    return out.select("bucket", F.round("bits", 9).alias("bits"), "bytes", F.round("bits_per_byte", 9).alias("bits_per_byte"), F.round("byte_share", 9).alias("byte_share"))


@query(f"""WITH g AS (SELECT bucket, sum(nats) FILTER (split = 'train')::DOUBLE / ln(2) / sum(bytes) FILTER (split = 'train') AS train, sum(nats) FILTER (split = 'val')::DOUBLE / ln(2) / sum(bytes) FILTER (split = 'val') AS val FROM (VALUES {values(_NLL)}) t(split, bucket, nats, bytes) GROUP BY bucket) SELECT bucket, round(train, 9) AS train, round(val, 9) AS val, round(val - train, 9) AS gap FROM g""")
def rank_split_gap(spark, sf_dir):
    out = registers.split_gap(frame(spark, _NLL, _NLL_SCHEMA), "bucket", "split")
    return out.select("bucket", *[F.round(c, 9).alias(c) for c in ("train", "val", "gap")])


@query(f"SELECT key, step, value::DOUBLE AS value, CASE WHEN lag(step) OVER w = step - 1 THEN (value - lag(value) OVER w)::DOUBLE END AS change FROM (VALUES {values(_SERIES)}) t(key, step, value) WINDOW w AS (PARTITION BY key ORDER BY step)")
def pass_changes(spark, sf_dir):
    return registers.changes(frame(spark, _SERIES, _SERIES_SCHEMA), "key", "step", "value")


@query(f"SELECT key, step, value::DOUBLE AS value, (value - first(value) OVER (PARTITION BY key ORDER BY step))::DOUBLE AS from_first FROM (VALUES {values(_SERIES)}) t(key, step, value)")
def changes_from_first(spark, sf_dir):
    return registers.from_first(frame(spark, _SERIES, _SERIES_SCHEMA), "key", "step", "value")


@query(f"SELECT key, step, value::DOUBLE AS value, CASE WHEN max(value) OVER w > min(value) OVER w THEN least(7, floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 8)) ELSE 0 END::INT AS level FROM (VALUES {values(_SERIES)}) t(key, step, value) WINDOW w AS (PARTITION BY key)")
def sparkline_levels(spark, sf_dir):
    return registers.sparklines(frame(spark, _SERIES, _SERIES_SCHEMA), "key", "value")

_TASKS = [("base", "arc", 0.40, 0.20), ("base", "piqa", 0.71, 0.42), ("base", "hella", 0.5, 0.3), ("new", "arc", 0.43, 0.24), ("new", "piqa", 0.72, 0.44), ("new", "hella", 0.49, 0.29), ("old", "arc", 0.3, 0.1)]

_META = [("arc", 1172, 0.25), ("piqa", 1838, 0.5), ("hella", 10042, 0.25)]

_TRIO = ("arc", "piqa", "hella")


@query(f"SELECT run, round(CASE WHEN count(centered) FILTER (task IN {_TRIO}) = 3 THEN avg(centered::DOUBLE) FILTER (task IN {_TRIO}) END, 9) AS mean FROM (VALUES {values(_TASKS)}) t(run, task, accuracy, centered) GROUP BY run")
def trio_means(spark, sf_dir):
    return registers.mean_of_all(frame(spark, _TASKS, "run string, task string, accuracy double, centered double"), "run", "task", "centered", _TRIO).select("run", F.round("mean", 9).alias("mean"))


@query(f"""WITH e AS (SELECT * FROM (VALUES {values(_TASKS)}) t(run, task, accuracy, centered)), j AS (SELECT (b.centered::DOUBLE - a.centered::DOUBLE) / 3 AS d, sqrt(a.accuracy::DOUBLE * (1 - a.accuracy::DOUBLE) / n) / (1 - rb::DOUBLE) / 3 AS se FROM e a JOIN e b USING (task) JOIN (VALUES {values(_META)}) m(task, n, rb) USING (task) WHERE a.run = 'base' AND b.run = 'new')
SELECT round(sum(d), 9) AS change, round(sqrt(sum(se * se)), 9) AS se, round(abs(sum(d)) / sqrt(sum(se * se)), 9) AS sigma FROM j""")
def trio_sigma(spark, sf_dir):
    e = frame(spark, _TASKS, "run string, task string, accuracy double, centered double")
    out = registers.combined_change(e.where("run = 'base'"), e.where("run = 'new'"), frame(spark, _META, "task string, n int, baseline double"), _TRIO)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])

_READOUT = [("a", 0.02, 0.9, 1.0, True), ("b", 0.005, 1.2, None, True), ("c", 0.02, 1.2, 0.5, False)]


@query(f"SELECT run, core > 0.01 AND bpb < 1 AND coalesce(gap > 0.1, false) AND ok AS promoted, list_filter([CASE WHEN NOT core > 0.01 THEN 'core' END, CASE WHEN NOT bpb < 1 THEN 'bpb' END, CASE WHEN NOT coalesce(gap > 0.1, false) THEN 'gap' END, CASE WHEN NOT ok THEN 'ok' END], lambda x: x IS NOT NULL) AS failed FROM (VALUES ('a', 0.02, 0.9, 1.0, true), ('b', 0.005, 1.2, NULL, true), ('c', 0.02, 1.2, 0.5, false)) t(run, core, bpb, gap, ok)")
def promotion_verdicts(spark, sf_dir):
    t = frame(spark, _READOUT, "run string, core double, bpb double, gap double, ok boolean")
    v = probes.verdict(core=F.col("core") > 0.01, bpb=F.col("bpb") < 1, gap=F.col("gap") > 0.1, ok=F.col("ok"))
    return t.select("run", v.alias("v")).select("run", "v.promoted", "v.failed")


@query("SELECT * FROM (VALUES ('Tools/My Dir/', 'my_dir'), ('/x/a--B.9', 'a_b_9'), ('Plain', 'plain')) t(path, slug)")
def slugs(spark, sf_dir):
    t = frame(spark, [("Tools/My Dir/",), ("/x/a--B.9",), ("Plain",)], "path string")
    return t.select("path", T.slug(F.col("path")).alias("slug"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) t(item, lettered)")
def lettered_items(spark, sf_dir):
    t = frame(spark, [(1, ["A", "B"]), (2, ["A", "bb"]), (3, ["C"]), (4, ["AB", "C"])], "item int, choices array<string>")
    return t.select("item", registers.is_lettered(F.col("choices")).alias("lettered"))


@query("SELECT i::BIGINT AS step, round(0.1 + (0.9 - 0.1) * least(i / 10.0, 1.0)::DOUBLE, 9) AS linear, round(0.1 + (0.9 - 0.1) * (1 - cos(pi() * least(i / 10.0, 1.0)::DOUBLE)) / 2, 9) AS cosine FROM range(13) t(i)")
def weight_schedule(spark, sf_dir):
    t = spark.range(13).withColumnRenamed("id", "step")
    shape = lambda s: F.round(T.lambda_schedule(F.col("step"), 10, 0.1, 0.9, s), 9).alias(s)
    return t.select("step", shape("linear"), shape("cosine"))


@query("SELECT run, task, round(accuracy::DOUBLE, 9) AS accuracy, pct::DOUBLE AS boundary_pct, folder FROM (VALUES ('base', 'arc', 0.4), ('new', 'arc', 0.5), ('lost', 'arc', 0.1)) e(run, task, accuracy) LEFT JOIN (VALUES ('base', 12.5)) b(run, pct) USING (run) LEFT JOIN (VALUES ('base', 'x/1'), ('new', 'x/2')) i(run, folder) USING (run)")
def run_chain(spark, sf_dir):
    """Scores of runs with their boundary counters and folders, where there are any."""
    e = frame(spark, [("base", "arc", 0.4), ("new", "arc", 0.5), ("lost", "arc", 0.1)], "run string, task string, accuracy double")
    return reports.run_table(e, frame(spark, [("base", 12.5)], "run string, boundary_pct double"), frame(spark, [("base", "x/1"), ("new", "x/2")], "run string, folder string"))


@query("SELECT * FROM (VALUES ('arc', 0.5, 0.2), ('CORE', NULL, 0.25)) t(task, accuracy, centered)".replace("0.5, 0.2", "0.5::DOUBLE, 0.2::DOUBLE"))
def eval_rows(spark, sf_dir):
    path = file(spark, "eval.csv", "Task, Accuracy, Centered\narc, 0.5, 0.2\nshort\nboolq, x, nan?\nCORE,,0.25")
    return corpus.eval_csv(spark, path).select("task", "accuracy", "centered")


@query("SELECT * FROM (VALUES ('arc', 1172::BIGINT, 0.25::DOUBLE), ('piqa', 1838::BIGINT, 0.5::DOUBLE)) t(task, n, baseline)")
def eval_meta_rows(spark, sf_dir):
    return corpus.eval_meta(spark, file(spark, "meta.csv", "task,a,b,c,n,baseline\narc,x,y,z, 1172, 25\npiqa,x,y,z,1838,50\nshort,1\nbad,x,y,z,many,50"))


@query("SELECT 1.25::DOUBLE AS joint, 0.25::DOUBLE AS overhead")
def last_log_match(spark, sf_dir):
    path = file(spark, "train.log", "bpb 1.5 + 0.5\nnoise\nbpb 2 + 1 then bpb 1.25 + 0.25\nend")
    return corpus.last_match(spark, path, r"bpb ([0-9.]+) \+ ([0-9.]+)", ("joint", "overhead")).select("joint", "overhead")


@query("SELECT 1 AS schema_version, 200::BIGINT AS n_total, 25::BIGINT AS n_boundary_crossing, 12.5::DOUBLE AS boundary_crossing_pct")
def boundary_counters(spark, sf_dir):
    """Written by the sink, read by the source."""
    path = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}/stats"
    sinks.write_boundary_stats(frame(spark, [("a", 150, 20), ("b", 50, 5)], "task string, n_total long, n_crossing long"), path)
    return corpus.boundary_stats(spark, path)


@query("SELECT * FROM (VALUES ('apple'), ('pear')) t(word)")
def word_list(spark, sf_dir):
    assert corpus.word_list(spark, f"{shared_dir(spark).rstrip('/')}/no such file") is None
    return corpus.word_list(spark, file(spark, "words", "Apple\n  pear \n\napple"))


@query("SELECT * FROM (VALUES (0, 5::BIGINT, 1, 'b''a'''), (7, 3::BIGINT, 2, 'b'' t''')) t(rank, count, byte_len, repr)")
def vocab_dump_rows(spark, sf_dir):
    return corpus.vocab_dump(spark, file(spark, "vocab.txt", "# rank count len repr\n0 5 1 b'a'\n6 9 2 b' t'\n7 3 2 b' t'\nrank count byte_len repr"))


@query("SELECT * FROM (VALUES (1, 'a+b', 1.0::DOUBLE, -2.0::DOUBLE, 0.0::DOUBLE), (2, 'c+d', 0.0, 1.5, -1.0)) t(round, pair, d_cov, d_comp, d_dead)")
def journal_verdicts(spark, sf_dir):
    state = {"rounds": [{"round": 1, "verdicts": {"a+b": [1, -2, 0]}}, {"round": 2, "verdicts": {"c+d": [0, 1.5, -1]}}]}
    return corpus.checkpoint_rounds(spark, file(spark, "checkpoint.json", json.dumps(state)))


@query("SELECT * FROM (VALUES (1, 'born', 'a', 'b', 'ab', 5::BIGINT), (2, 'died', 'c', 'd', 'cd', 0::BIGINT)) t(round, kind, l, r, string, fires)")
def lineage_rows(spark, sf_dir):
    rows = [{"round": 1, "kind": "born", "l": "a", "r": "b", "string": "ab", "fires": 5}, {"round": 2, "kind": "died", "l": "c", "r": "d", "string": "cd", "fires": 0}]
    return vocabularies.lineage_lines(spark, file(spark, "lineage.jsonl", "\n".join([json.dumps(rows[0]), "{broken", json.dumps(rows[1])])))


@query("SELECT * FROM (VALUES (3, 'x/keep_0003'), (12, 'x/keep_0012/')) t(keep, folder)")
def kept_folders(spark, sf_dir):
    return vocabularies.kept_folders(frame(spark, [("x/keep_0012/",), ("x/keep_0003",), ("x/keep_bad",), ("x/other",)], "folder string"))


@query("SELECT * FROM (VALUES ('q1', 0, 'items'), ('q2', 1, 'items')) t(query, gold, task)")
def benchmark_rows(spark, sf_dir):
    rows = [{"query": "q1", "choices": ["a", "b"], "gold": 0}, {"query": "q2", "choices": ["c", "d"], "gold": 1}]
    path = file(spark, "parts", "\n".join(map(json.dumps, rows)))
    return corpus.benchmark_items(spark, path).select("query", "gold", F.lit("items").alias("task"))


@query("SELECT * FROM (VALUES (0, '61', false), (1, '62', false), (2, '2061', false), (3, '206162', false), (4, '3C7C656E647C3E', true)) t(id, hex, is_special)")
def loaded_vocabulary(spark, sf_dir):
    """A byte-level JSON file: glyphs are bytes again; the merges come along."""
    spec = {"model": {"vocab": {"a": 0, "b": 1, "Ġa": 2, "Ġab": 3, "<|end|>": 4}, "merges": [["Ġa", "b"]]}, "added_tokens": [{"id": 4, "content": "<|end|>", "special": True}]}
    path = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}/tokenizer.json"
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(path)
    vocab, merges = vocabularies.load_tokenizer(spark, path)
    assert [(r.id, r.left, r.right, bytes(r.bytes)) for r in merges.collect()] == [(3, 2, 1, b" ab")]
    return vocab.select("id", F.hex("bytes").alias("hex"), "is_special")
