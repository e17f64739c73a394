"""Exact ranking metrics from score counts.

Rows are first counted per (group, score); every metric then needs running
counts from the highest score down, which `running_sums` provides for any number
of distinct scores and for any share of rows in one group.
"""

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import fixed_values as fv
from pulsegrid.functions.scalar import ensemble_mean, hours_between
from pulsegrid.operators.keys import merge_scores
from pulsegrid.operators.ordered import PIECE, _same, percentiles, range_pieces, running_sums
from pulsegrid.operators.quality import with_row
from pulsegrid.session import stored


def score_counts(df: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    """Positives and negatives per group and distinct score."""
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(
        *groups, F.col(score).alias("score")
    ).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def curve(df: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    """One point per distinct score: tp, fp, positives, negatives in total."""
    ranked = running_sums(score_counts(df, groups, y, score), groups,
                          [F.col("score").desc()], ["pos", "neg"])
    return ranked.select(
        *groups, "score", "pos", "neg",
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("tot_pos").alias("n_pos"), F.col("tot_neg").alias("n_neg"),
    )


def roc_points(df: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    c = curve(df, groups, y, score)
    return c.select(
        *groups, F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def pr_points(df: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    c = curve(df, groups, y, score)
    return c.select(
        *groups, F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def _auroc() -> Column:
    """Every positive beats the negatives below it and half of those it ties with."""
    below = F.col("n_neg") - F.col("fp")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return F.try_divide(wins, F.max("n_pos") * F.max("n_neg"))


def _average_precision() -> Column:
    steps = F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    return F.try_divide(steps, F.max("n_pos"))


def _specific(spec: float) -> Column:
    """fp within the allowance; compared in whole counts, not in rounded rates."""
    return F.col("fp") <= (F.lit(1.0 - spec) + 1e-12) * F.col("n_neg")


def _sens_at_spec(spec: float) -> Column:
    hit = F.max(F.when(_specific(spec), F.col("tp")))
    return F.coalesce(F.try_divide(hit, F.max("n_pos")), F.lit(0.0))


def _threshold_at_spec(spec: float) -> Column:
    return F.min(F.when(_specific(spec), F.col("score")))


def auroc(df: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    return curve(df, groups, y, score).groupBy(*groups).agg(_auroc().alias("auroc"))


def average_precision(df: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    return curve(df, groups, y, score).groupBy(*groups).agg(
        _average_precision().alias("average_precision")
    )


def sens_at_spec(df: DataFrame, groups: list[str], y: str, score: str,
                 specs: list[float] = fv.SPECIFICITIES) -> DataFrame:
    return curve(df, groups, y, score).groupBy(*groups).agg(
        *[_sens_at_spec(s).alias(f"sens_at_{round(s * 100)}") for s in specs]
    )


def threshold_at_spec(df: DataFrame, groups: list[str], y: str, score: str,
                      spec: float = fv.SPECIFICITIES[0]) -> DataFrame:
    """The lowest score that still keeps the specificity."""
    return curve(df, groups, y, score).groupBy(*groups).agg(
        _threshold_at_spec(spec).alias("threshold")
    )


def metric_table(df: DataFrame, groups: list[str], y: str, score: str,
                 specs: list[float] = fv.SPECIFICITIES) -> DataFrame:
    """All metrics per group from one curve; groups without positives drop out."""
    table = curve(df, groups, y, score).groupBy(*groups).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        _auroc().alias("auroc"), _average_precision().alias("average_precision"),
        *[_sens_at_spec(s).alias(f"sens_at_{round(s * 100)}") for s in specs],
        _threshold_at_spec(specs[0]).alias("threshold"),
    )
    return table.where(F.col("n_pos") > 0)


def ap_lift(table: DataFrame) -> DataFrame:
    """Average precision over prevalence, from a metric table."""
    prevalence = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return table.withColumn("prevalence", prevalence).withColumn(
        "lift", F.try_divide(F.col("average_precision"), F.col("prevalence"))
    )


def long_scores(df: DataFrame, keep: list[str], models: list[str], labels: list[str]) -> DataFrame:
    """<model>_<label> score columns as rows (model, label, y, score)."""
    entries = [
        F.struct(F.lit(m).alias("model"), F.lit(l).alias("label"),
                 F.col(l).cast("int").alias("y"), F.col(f"{m}_{l}").alias("score"))
        for m in models for l in labels
    ]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_e")).select(*keep, "_e.*")


def ensemble(a: DataFrame, b: DataFrame, keys: list[str], model_a: str, model_b: str,
             labels: list[str], name: str = "ens") -> DataFrame:
    """Join two prediction sets and add their null-skipping mean per label."""
    both = merge_scores(a, b.select(*keys, *[f"{model_b}_{l}" for l in labels]), keys)
    return both.withColumns({
        f"{name}_{l}": ensemble_mean([f"{model_a}_{l}", f"{model_b}_{l}"]) for l in labels
    })


# --- lead times ---------------------------------------------------------------------

def lead_times(scored: DataFrame, cohort: DataFrame, key: str, score: str, threshold: float,
               end: str = "window_end_time", positive: str = "sepsis_label",
               onset: str = "sepsis_onset_time") -> DataFrame:
    """Hours from the first alarm at or before onset to onset, per detected entity."""
    alarms = scored.where(F.col(score) >= threshold).select(key, end)
    onsets = cohort.where(F.col(positive) == 1).select(key, onset)
    return (
        alarms.join(onsets, key).where(F.col(end) <= F.col(onset))
        .groupBy(key).agg(F.min(end).alias("first_alarm"), F.max(onset).alias("onset"))
        .withColumn("lead_hours", hours_between("first_alarm", "onset"))
    )


def lead_summary(leads: DataFrame, cohort: DataFrame, positive: str = "sepsis_label") -> DataFrame:
    """Detected out of all positives, mean, median, 80th percentile, early shares."""
    part = leads.agg(
        F.count("*").alias("n_detected"), F.mean("lead_hours").alias("mean_hours"),
        F.mean((F.col("lead_hours") > 4).cast("double")).alias("share_over_4h"),
        F.mean((F.col("lead_hours") > 8).cast("double")).alias("share_over_8h"),
    )
    ranks = percentiles(leads, [], "lead_hours", {"median_hours": 0.5, "p80_hours": 0.8})
    total = cohort.agg(F.coalesce(F.sum(positive), F.lit(0)).cast("long").alias("n_positive"))
    return with_row(with_row(part, ranks), total)


# --- bootstrap ----------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit integer mixer: well spread and the same on every machine."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON_ONE = np.cumsum(np.exp(-1.0) / np.array(
    [1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800, 479001600], dtype=float
))


def _weights(ids: np.ndarray, counts: np.ndarray, draws: int, salt: int) -> np.ndarray:
    """Poisson(count) weight per row and replica, fixed by the row id and replica."""
    with np.errstate(over="ignore"):
        seeds = _mix(ids.astype(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(ids), draws))
    single = counts == 1
    if single.any():
        with np.errstate(over="ignore"):
            steps = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bits = _mix(seeds[single][:, None] + steps[None, :])
        out[single] = np.searchsorted(_POISSON_ONE, (bits >> np.uint64(11)) * 2.0 ** -53)
    for i in np.flatnonzero(counts > 1):
        out[i] = np.random.default_rng(seeds[i]).poisson(counts[i], draws)
    return out


def _walk(pdf: pd.DataFrame, draws: int, seed: int, tp: np.ndarray, tn: np.ndarray):
    """Go down one score range in bounded batches, starting from the weighted counts
    above it: (tp, tn, pairs lost, precision sum) per replica at its lower end."""
    lost, precision = np.zeros(draws), np.zeros(draws)
    pdf = pdf.sort_values("score", ascending=False)
    step = max(1, 4_000_000 // draws)
    for start in range(0, len(pdf), step):
        rows = pdf.iloc[start:start + step]
        ids = rows["_id"].to_numpy(np.int64)
        pos = _weights(ids, rows["pos"].to_numpy(), draws, 2 * seed)
        neg = _weights(ids, rows["neg"].to_numpy(), draws, 2 * seed + 1)
        above_p, above_n = tp + np.cumsum(pos, 0), tn + np.cumsum(neg, 0)
        seen = above_p + above_n
        # a negative scored above a positive loses it a pair, one tied with it half
        lost += (pos * (above_n - neg / 2.0)).sum(0)
        precision += (pos * np.divide(above_p, seen, out=np.zeros_like(seen), where=seen > 0)).sum(0)
        tp, tn = above_p[-1], above_n[-1]
    return tp, tn, lost, precision


# Poisson(1) by a 32-bit number: as many as there are bounds at or below it.
POISSON_BOUNDS = np.floor(_POISSON_ONE[:-1] * 2.0**32).astype(np.uint64)
REMEMBERED_ENTITIES = 20_000_000  # weights that a walk remembers, over all entities; it bounds memory only


def entity_weights(entity: str, draws: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of an entity in every replica, out of the bits of MD5 sums, four replicas each.

    Replica r takes the r mod 4-th word of 8 hex digits of md5('seed:r div 4:entity'), so that
    any engine that knows MD5 can draw the same.
    """
    digests = b"".join(hashlib.md5(f"{seed}:{q}:{entity}".encode()).digest() for q in range(-(-draws // 4)))
    return np.searchsorted(POISSON_BOUNDS, np.frombuffer(digests, ">u4")[:draws], "right").astype(np.float64)


def _tied(pdf: pd.DataFrame, draws: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weighted positives and negatives (scores x replicas) down the distinct scores, some at a time.

    A score whose rows go over the end of a batch is added up until its last row is seen.
    """
    known: dict[str, np.ndarray] = {}
    pdf = pdf.sort_values("score", ascending=False)
    step = max(1, 4_000_000 // draws)
    held: tuple | None = None
    for start in range(0, len(pdf), step):
        rows = pdf.iloc[start:start + step]
        weights = np.empty((len(rows), draws))
        for i, entity in enumerate(rows["_entity"]):
            if entity not in known:
                if len(known) * draws >= REMEMBERED_ENTITIES:
                    known.clear()
                known[entity] = entity_weights(entity, draws, seed)
            weights[i] = known[entity]
        scores = rows["score"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
        pos, neg = (np.add.reduceat(weights * rows[c].to_numpy(float)[:, None], first, 0) for c in ("pos", "neg"))
        if held and held[0] == scores[0]:
            pos[0] += held[1]
            neg[0] += held[2]
        elif held:
            yield held[1][None], held[2][None]
        if len(first) > 1:
            yield pos[:-1], neg[:-1]
        held = scores[-1], pos[-1], neg[-1]
    if held:
        yield held[1][None], held[2][None]


def _walk_entities(pdf: pd.DataFrame, draws: int, seed: int, tp: np.ndarray, tn: np.ndarray):
    """`_walk` with one weight per entity and replica, for all rows of the entity."""
    return _down(_tied(pdf, draws, seed), draws, tp, tn)


def _down(tied: Iterable[tuple[np.ndarray, np.ndarray]], draws: int, tp: np.ndarray, tn: np.ndarray):
    """Go down the weighted positives and negatives of distinct scores, as `_walk` does."""
    lost, precision = np.zeros(draws), np.zeros(draws)
    for pos, neg in tied:
        above_p, above_n = tp + np.cumsum(pos, 0), tn + np.cumsum(neg, 0)
        seen = above_p + above_n
        lost += (pos * (above_n - neg / 2.0)).sum(0)
        precision += (pos * np.divide(above_p, seen, out=np.zeros_like(seen), where=seen > 0)).sum(0)
        tp, tn = above_p[-1], above_n[-1]
    return tp, tn, lost, precision


SCORES_AT_ONCE = 4096  # up to so many distinct scores of all groups keep a total per replica each
ENTITY_ROWS = 200_000  # counted rows that a task weighs


def _by_entity(counts: DataFrame, scores: DataFrame, groups: list[str], draws: int, seed: int) -> DataFrame:
    """Replicas of whole entities where distinct scores are few: rows are dealt by entity, however many share a
    score. A task draws the weights of an entity once, for all its rows, and leaves a total per score and replica;
    the totals are walked down once per group."""
    number = (F.row_number().over(Window.orderBy(*groups, "score")) - 1).alias("_at")  # SCORES_AT_ONCE rows at most
    numbered = stored(scores.select(*groups, "score", "_n", number), "numbered")
    n_scores, n_rows = numbered.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    same = _same(counts, numbered, [*groups, "score"])
    dealt = counts.join(F.broadcast(numbered), same).select("_at", "_entity", "pos", "neg")
    dealt = dealt.repartition(max(1, -(-n_rows // ENTITY_ROWS)), "_entity").sortWithinPartitions("_entity")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {c: np.zeros((n_scores, draws)) for c in ("pos", "neg")}
        for pdf in batches:
            column, entities = pd.factorize(pdf["_entity"])
            for start in range(0, len(entities), 512):
                rows = pdf[(column >= start) & (column < start + 512)]
                own = entities[start:start + 512]
                weights = np.stack([entity_weights(e, draws, seed) for e in own])
                at, line = np.unique(rows["_at"].to_numpy(), return_inverse=True)
                for c, total in totals.items():
                    table = np.zeros((len(at), len(own)))
                    np.add.at(table, (line, column[rows.index] - start), rows[c].to_numpy(float))
                    total[at] += table @ weights
        for start in range(0, n_scores, 64):
            seen = [k for k in range(start, min(start + 64, n_scores)) if totals["pos"][k].any() or totals["neg"][k].any()]
            if seen:
                yield pd.DataFrame({"_at": seen, **{c: list(total[seen]) for c, total in totals.items()}})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_at": pdf["_at"].iloc[:1], **{c: [np.sum(pdf[c].to_list(), 0)] for c in ("pos", "neg")}})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        pos, neg = (np.stack(pdf[c].to_list()) for c in ("pos", "neg"))
        tp, tn, lost, precision = _down([(pos, neg)], draws, np.zeros(draws), np.zeros(draws))
        made = {"replica": range(draws), "lost": lost, "prec": precision, "p": tp, "n": tn}
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * draws for g in groups}, **made})

    kinds = "_at long, pos array<double>, neg array<double>"
    total = dealt.mapInPandas(weigh, kinds).groupBy("_at").applyInPandas(add, kinds)
    names = ", ".join(f"{n} {t}" for n, t in scores.select(*groups).dtypes)
    rows = total.join(F.broadcast(numbered.drop("_n")), "_at").where(reduce(and_, [F.col(g).isNotNull() for g in groups]))
    summed = rows.groupBy(*groups).applyInPandas(walk, f"{names}, replica int, lost double, prec double, p double, n double")
    return _from_sums(summed, groups)


def _from_sums(summed: DataFrame, groups: list[str]) -> DataFrame:
    # draws with one class only have no metric
    return summed.where("p > 0 and n > 0").select(
        *groups, "replica",
        (1 - F.col("lost") / (F.col("p") * F.col("n"))).alias("auroc"),
        (F.col("prec") / F.col("p")).alias("average_precision"),
    )


def bootstrap_replicas(df: DataFrame, groups: list[str], y: str, score: str,
                       draws: int = fv.BOOTSTRAP_DRAWS, seed: int = fv.SEED,
                       cluster: str | None = None) -> DataFrame:
    """AUROC and average precision of every Poisson bootstrap replica per group.

    A replica gives each row a Poisson(1) weight, so equal scores together get a
    Poisson(count) weight and rows are counted per score first. Rows of one entity are not
    independent: with `cluster`, the column that names it, a replica draws one weight per entity
    (`entity_weights` of its text form, a null as the empty text), and rows are counted
    per score and entity; with few distinct scores they are dealt by entity (`_by_entity`). Else scores are cut into
    ranges, one per task; a first pass leaves one total per range and replica, a second
    pass adds up each range's share on top of the totals above it. Rows are never
    multiplied by the number of replicas in a shuffle.
    """
    if cluster:
        walk = _walk_entities
        counts = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(
            *groups, F.col(score).alias("score"), F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_entity")
        ).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
        counts = stored(counts, "entity-counts")
        scores = stored(counts.groupBy(*groups, "score").agg(F.count("*").alias("_n")), "scores")
        if scores.count() <= SCORES_AT_ONCE:
            return _by_entity(counts, scores, groups, draws, seed)
    else:
        walk = _walk
        counts = score_counts(df, groups, y, score).withColumn("_id", F.xxhash64(*groups, "score"))
    pieces = range_pieces(counts, groups, [F.col("score").desc()])
    at = [*groups, PIECE]
    kinds = ", ".join(f"{n} {t}" for n, t in pieces.select(*at).dtypes)
    zero = np.zeros(draws)

    def totals(key, pdf):
        tp, tn, _, _ = walk(pdf, draws, seed, zero, zero)
        return pd.DataFrame([(*key, tp, tn)], columns=[*at, "_tp", "_tn"])

    def shares(key, pdf, carry):
        _, _, lost, precision = walk(
            pdf, draws, seed, np.array(carry["_cp"].iloc[0]), np.array(carry["_cn"].iloc[0])
        )
        return pd.DataFrame([(*key, lost, precision)], columns=[*at, "_lost", "_prec"])

    part = stored(pieces.groupBy(*at).applyInPandas(
        totals, f"{kinds}, _tp array<double>, _tn array<double>"
    ), "replica-totals")
    # one row per (group, range, replica): as many rows as ranges times replicas
    each = part.select(*at, F.posexplode(F.arrays_zip("_tp", "_tn")).alias("replica", "_z"))
    each = each.select(*at, "replica", F.col("_z._tp").alias("tp"), F.col("_z._tn").alias("tn"))
    every = Window.partitionBy(*groups, "replica")
    before = every.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select(
        *at, "replica",
        F.coalesce(F.sum("tp").over(before), F.lit(0.0)).alias("cp"),
        F.coalesce(F.sum("tn").over(before), F.lit(0.0)).alias("cn"),
    ).groupBy(*at).agg(
        F.sort_array(F.collect_list(F.struct("replica", "cp", "cn"))).alias("_c")
    ).select(*at, F.col("_c.cp").alias("_cp"), F.col("_c.cn").alias("_cn"))
    share = pieces.groupBy(*at).cogroup(carry.groupBy(*at)).applyInPandas(
        shares, f"{kinds}, _lost array<double>, _prec array<double>"
    )
    summed = share.select(
        *groups, F.posexplode(F.arrays_zip("_lost", "_prec")).alias("replica", "_z")
    ).groupBy(*groups, "replica").agg(
        F.sum("_z._lost").alias("lost"), F.sum("_z._prec").alias("prec")
    )
    full = each.groupBy(*groups, "replica").agg(F.sum("tp").alias("p"), F.sum("tn").alias("n"))
    return _from_sums(summed.join(full, [*groups, "replica"]), groups)


def bootstrap_ci(df: DataFrame, groups: list[str], y: str, score: str,
                 draws: int = fv.BOOTSTRAP_DRAWS, seed: int = fv.SEED,
                 level: float = 0.95, cluster: str | None = None) -> DataFrame:
    """Mean and interval of both metrics over the replicas, of rows or of whole entities."""
    tail = (1 - level) / 2
    aggs = []
    for m in ("auroc", "average_precision"):
        # at most `draws` values per group
        aggs += [
            F.mean(m).alias(f"{m}_mean"),
            F.percentile(m, F.lit(tail)).alias(f"{m}_lo"),
            F.percentile(m, F.lit(1 - tail)).alias(f"{m}_hi"),
        ]
    return bootstrap_replicas(df, groups, y, score, draws, seed, cluster).groupBy(*groups).agg(
        F.count("*").alias("n_replicas"), *aggs
    )
