"""Audits of a bundle: how well can an observer tell whether a target is in a released aggregate?"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions.draws import uniform
from ..operators import aggregates as agg
from ..operators import bitmaps, classify, growth, marginals, metrics, partial, privacy, rules, sampling, synthesis
from ..sources import sinks
from ..stages import keep, scratch

PAIR_KEYS = ["target", "split", "agg_id", "pair_id", "label"]


def chosen(groups: DataFrame, config: AuditConfig) -> DataFrame:
    """The groups of a bundle that an audit uses: n_targets of its targets, and of each of these n_groups test groups, train_size
    training groups (whole pairs, the first ones, if `paired`, else any) and validation_size validation groups, half with the target.

    Asking for more than the bundle has raises. With the marginal prior only test groups matter, the others may be fewer.
    """
    if config.n_targets is not None:
        ids = groups.select("target").distinct().withColumn("_u", uniform("audit", config.seed, F.col("target"))).orderBy("_u", "target").limit(config.n_targets)
        groups = groups.join(F.broadcast(ids.select("target")), "target", "left_semi")
    wanted = {"test": config.n_groups} | ({"train": config.train_size, "validation": config.validation_size} if config.mode == "reference_prior" else {})
    picked = []
    for split, n in wanted.items():
        own = groups.where(F.col("split") == split)
        some = sampling.first_pairs(own, n // 2) if split == "train" and config.paired else sampling.subsample(own, n // 2, config.seed)
        picked.append(own.join(some.select("target", "agg_id"), ["target", "agg_id"], "left_semi").select(*PAIR_KEYS))
    out = keep(reduce(DataFrame.unionByName, picked))
    there = {(r.target, r.split): r["count"] for r in out.groupBy("target", "split").count().collect()}
    ids = {t for t, _ in there}
    short = [(t, s) for t in ids for s, n in wanted.items() if there.get((t, s), 0) < n]
    if short or config.n_targets is not None and len(ids) < config.n_targets:
        raise ValueError(f"the bundle has fewer targets or groups than asked for: {len(ids)} targets, short of {sorted(short)[:5]}")
    return out


def released(groups: DataFrame, counts: DataFrame, n_rois: int, n_epochs: int, config: AuditConfig) -> DataFrame:
    """Aggregates after the disclosure controls; pairs share their noise if the audit pairs them."""
    return privacy.release(counts, groups, PAIR_KEYS, ["pair_id"] if config.paired else ["agg_id"], n_rois, n_epochs, config.group_size, config.dp_eps, config.dp_sens, config.suppress, config.seed)


def squashed(predictions: DataFrame, config: AuditConfig) -> DataFrame:
    """Scores and thresholds through the logistic function, if the audit squashes them. What is predicted stays, and so do the AUCs."""
    return predictions.withColumns({c: metrics.sigmoid(F.col(c)) for c in ("p", "thr")}) if config.squash else predictions


def apply_rule(predictions: DataFrame, groups: DataFrame, counts: DataFrame, cells: DataFrame, config: AuditConfig) -> DataFrame:
    """On raw releases with the whole trace known, contradicted aggregates are non-members with score zero; then scores are squashed, if asked for."""
    if not config.raw or config.partial:
        return squashed(predictions, config)
    test = groups.where("split = 'test'")
    hit = rules.contradicted(test, counts, cells, config.group_size).where("contradiction").select("target", "agg_id", F.lit(True).alias("_out"))
    both = predictions.join(hit, ["target", "agg_id"], "left")
    ruled = both.select("target", "agg_id", "y", F.when(F.col("_out"), 0.0).otherwise(F.col("p")).alias("p"), F.when(F.col("_out"), 0).otherwise(F.col("pred")).alias("pred"), "thr")
    return squashed(ruled, config)


def seen_counts(counts: DataFrame, cells: DataFrame, n_epochs: int, config: AuditConfig) -> DataFrame:
    """A bundle's counts as the observer makes them: training IN groups have the known part of the target's trace in place of the whole."""
    if not config.partial:
        return counts
    known = partial.known(cells, config.partial, n_epochs, config.partial_fraction, config.top_k, config.seed)
    train = counts.where("split = 'train'")
    return counts.where("split <> 'train'").unionByName(agg.swap_traces(train, cells, known, PAIR_KEYS))


def reference_prior(groups: DataFrame, counts: DataFrame, cells: DataFrame, n_rois: int, n_epochs: int, config: AuditConfig) -> DataFrame:
    """Predictions of an observer who trains on aggregates of real reference users.

    groups and counts: a bundle; cells: the targets' traces. With a partial trace, the observer's training IN groups have
    that part of the target's trace in place of the whole; the test groups are as they are.
    """
    groups = chosen(groups, config)
    counts = counts.join(groups.select("target", "agg_id"), ["target", "agg_id"], "left_semi")
    out = keep(released(groups, seen_counts(counts, cells, n_epochs, config), n_rois, n_epochs, config))
    return apply_rule(classify.predict(classify.features(out, groups, n_epochs), config), groups, counts, cells, config)


def shares(counts: DataFrame, axis: str, n: int, keys: list[str], config: AuditConfig) -> DataFrame:
    """The observer's marginal along an axis, compressed or denoised as the controls ask for. Every place or time has a row."""
    found = marginals.marginal(counts, axis, keys)
    full = found.select(*keys).distinct().withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(found, [*keys, axis], "left").select(*keys, axis, F.coalesce("p", F.lit(0.0)).alias("p"))
    if config.log_compression:
        full = marginals.log_compressed(full, keys)
    if config.power_transform:
        power = marginals.power_exponent(full, keys, marginals.reference_variance(n, config.seed, axis)).select(*keys, "exponent")
        full = marginals.powered(full.join(power, keys), keys, F.col("exponent")).select(*keys, axis, "p")
    return full


def mean_visits(counts: DataFrame, groups: DataFrame, roi_shares: DataFrame, epoch_shares: DataFrame, adjacency: DataFrame, keys: list[str], n_rois: int, n_epochs: int, config: AuditConfig, rounds: int = 5, tolerance: float = 1e-3) -> DataFrame:
    """(keys, mean): mean visits of a member of each released aggregate.

    A raw release tells it: its sum by its size. Else, all aggregates at once, up to five times: members are synthesised
    at the present mean, released in the same way, and the mean moves by twice the difference (times k if small counts
    are suppressed) to what was released. A step to zero or below is not made, and a small one ends it.
    """
    m, k = config.group_size, config.suppress
    adjacency = adjacency if config.raw else growth.Neighbours.of(adjacency)
    seen = groups.select(*keys).distinct().join(counts.groupBy(*keys).agg(F.sum("cnt").cast("double").alias("total"), F.count("*").cast("double").alias("nnz")), keys, "left").fillna(0.0)
    now = seen.select(*keys, "total", "nnz", (F.col("total") / m).alias("mean"), F.lit(config.raw).alias("done"))
    if config.raw:
        return now.select(*keys, "mean")
    for step in range(rounds):
        now = keep(now)
        if not now.where("not done and mean > 0").limit(1).count():
            break
        open_keys = now.where("not done and mean > 0").select(*keys, "mean")
        users = synthesis.opened(_members_at(open_keys, roi_shares, epoch_shares, adjacency, keys, m, config, step))
        sim = users.groupBy(*keys, "roi", "epoch").agg(F.count("*").alias("cnt"))
        out = privacy.release(sim, open_keys, keys, keys, n_rois, n_epochs, m, config.dp_eps, config.dp_sens, k, config.seed + 1000 + step)
        got = out.groupBy(*keys).agg(F.sum("cnt").cast("double").alias("s_total"), F.count("*").cast("double").alias("s_nnz"))
        both = now.join(got, keys, "left").fillna(0.0, ["s_total", "s_nnz"])
        gap = (F.col("nnz") - F.col("s_nnz")) if not config.noisy else (F.col("total") - F.col("s_total"))
        new = F.col("mean") + 2.0 * (k if k else 1) * gap / m
        stop = F.col("done") | (F.col("mean") <= 0) | (new <= 0) | (F.abs(new - F.col("mean")) < tolerance)
        now = both.select(*keys, "total", "nnz", F.when(stop, F.col("mean")).otherwise(new).alias("mean"), stop.alias("done"))
    return keep(now).select(*keys, "mean")


def _members_at(means: DataFrame, roi_shares: DataFrame, epoch_shares: DataFrame, adjacency: DataFrame, keys: list[str], n: int, config: AuditConfig, step: int, population: DataFrame | None = None) -> DataFrame:
    """Synthetic members of each key at its own mean, a row with all cells for each."""
    rois = roi_shares.join(means, keys)
    return synthesis.visited(rois, epoch_shares, adjacency, keys, n, config.activity, config.cluster_size, config.skew, config.seed + step, population)


def marginal_prior(groups: DataFrame, counts: DataFrame, cells: DataFrame, adjacency: DataFrame, n_rois: int, n_epochs: int, config: AuditConfig, population: DataFrame | None = None) -> DataFrame:
    """Predictions of an observer who has only a release: trains on aggregates of users synthesised from it.

    With reuse_synthetic, one set of users for each target, from its first (or a random) test aggregate, serves all its
    test aggregates; else every test aggregate has its own. population(n_visits, n_users) is what prep.activity() gives for
    all users; it is needed, and used, if the observer knows the true mean of visits (true_mean), and instead of estimates.
    """
    if config.true_mean and population is None:
        raise ValueError("true_mean needs the population's numbers of visits")
    groups, adjacency = chosen(groups, config), growth.Neighbours.of(adjacency)
    counts = counts.join(groups.select("target", "agg_id"), ["target", "agg_id"], "left_semi")
    test = groups.where("split = 'test'")
    out = keep(released(test, counts.where("split = 'test'"), n_rois, n_epochs, config))
    if config.reuse_synthetic:
        order = F.col("agg_id") if config.reuse_from == "first" else F.xxhash64("agg_id")
        rank = test.where("label = 1") if config.reuse_from == "first" else test
        source = rank.groupBy("target").agg(F.min_by("agg_id", order).alias("agg_id"))
    else:
        source = test.select("target", "agg_id").distinct()
    base = out.join(source, ["target", "agg_id"], "left_semi")
    keys = ["target", "agg_id"]
    roi_shares, epoch_shares = keep(shares(base, "roi", n_rois, keys, config)), keep(shares(base, "epoch", n_epochs, keys, config))
    if config.true_mean:
        mean = population.agg((F.sum(F.col("n_visits") * F.col("n_users")) / F.sum("n_users")).alias("mean"))
        means = source.crossJoin(F.broadcast(mean))
    else:
        means = mean_visits(base, source, roi_shares, epoch_shares, adjacency, keys, n_rois, n_epochs, config)
    users = keep(_members_at(means.where("mean > 0"), roi_shares, epoch_shares, adjacency, keys, config.n_synthetic, config, 77, population))
    # groups of synthetic users with the target's known part, for each source aggregate as a "target" of its own
    known = partial.known(cells, config.partial, n_epochs, config.partial_fraction, config.top_k, config.seed)
    sources = source.withColumn("_key", F.xxhash64("target", "agg_id"))
    pool = sampling.Synthetic(sources.select(F.col("_key").alias("target")), config.n_synthetic)
    own = known.join(sources, "target").groupBy(F.col("_key").alias("target"), F.col("_key").alias("user_id")).agg(F.collect_set(F.col("roi").cast("long") * synthesis.WIDE + F.col("epoch")).alias("cells"))
    tagged = users.join(sources, keys).select(F.col("_key").alias("target"), "user_id", "cells")
    by = ["target", "user_id"]
    traces = keep(bitmaps.of_lists(tagged.unionByName(own), n_epochs, by))
    singles = sampling.groups(pool, "validation", config.group_size, config.validation_size, config.seed)
    if not config.paired:
        singles = singles.unionByName(sampling.groups(pool, "train", config.group_size, config.train_size, config.seed))
    members = keep(singles.withColumn("pair_id", F.col("agg_id")).select(*PAIR_KEYS, "user_id"))
    made = bitmaps.group_counts(members, traces, PAIR_KEYS, n_epochs, by=by)
    if config.paired:
        pairs = keep(sampling.groups_paired(pool, "train", config.group_size, config.train_size, config.seed))
        both = agg.pair_sums(pairs, traces, n_epochs, by).withColumn("agg_id", F.concat_ws("-", "pair_id", "label"))
        made, members = made.unionByName(both.select(*made.columns)), members.unionByName(sampling.members(pairs).select(*members.columns))
    made_groups = keep(members.select(*PAIR_KEYS).distinct())
    made = keep(released(made_groups, made, n_rois, n_epochs, config))
    # every test aggregate is judged by the model of its source
    of_test = (test.select("target", "split", "agg_id", "label").join(sources.select("target", "_key"), "target") if config.reuse_synthetic else test.select("target", "split", "agg_id", "label").join(sources, keys))
    names = of_test.select("_key", "target", "agg_id")
    judged = out.join(names, ["target", "agg_id"]).select(F.col("_key").alias("target"), "agg_id", "roi", "epoch", "cnt")
    rows = classify.features(made.select("target", "agg_id", "roi", "epoch", "cnt").unionByName(judged), made_groups.select("target", "split", "agg_id", "label").unionByName(of_test.select(F.col("_key").alias("target"), "split", "agg_id", "label")), n_epochs)
    found = classify.predict(rows, config).withColumnRenamed("target", "_key").join(names, ["_key", "agg_id"]).select("target", "agg_id", "y", "p", "pred", "thr")
    return apply_rule(found, groups, counts, cells, config)


def sweep(configs: Iterable[AuditConfig], groups: DataFrame, counts: DataFrame, cells: DataFrame, n_rois: int, n_epochs: int) -> DataFrame:
    """Predictions of the reference-prior audit under each configuration, with its tag: what each gives alone, from one reading of the bundle.

    The configurations take the same groups (numbers of targets and groups, pairing and seed are those of the first, or it raises). Their
    releases are one table, keyed by the configuration, and so are features; all fits of all configurations are one job.
    """
    configs = list(configs)
    same = {(c.n_targets, c.n_groups, c.train_size, c.validation_size, c.paired, c.seed, c.mode, c.group_size) for c in configs}
    if len(same) != 1 or configs[0].mode != "reference_prior":
        raise ValueError("the configurations of a sweep are reference-prior audits of the same groups")
    groups = chosen(groups, configs[0])
    counts = keep(counts.join(groups.select("target", "agg_id"), ["target", "agg_id"], "left_semi"))

    def named(df: DataFrame, i: int) -> DataFrame:
        """An aggregate's name under a configuration begins with its number."""
        return df.withColumns({"agg_id": F.concat(F.lit(f"{i}#"), "agg_id"), "target": F.xxhash64(F.lit(i), "target")})

    out = reduce(DataFrame.unionByName, (named(released(groups, seen_counts(counts, cells, n_epochs, c), n_rois, n_epochs, c), i) for i, c in enumerate(configs)))
    rows = classify.features(out, reduce(DataFrame.unionByName, (named(groups, i) for i in range(len(configs)))), n_epochs)
    fits = keep(rows.groupBy("target").applyInPandas(lambda f: classify.attack(f, configs[int(f["agg_id"].iloc[0].split("#")[0])]), classify.PREDICTIONS))
    found = fits.withColumns({"_i": F.substring_index("agg_id", "#", 1).cast("int"), "agg_id": F.expr("substr(agg_id, instr(agg_id, '#') + 1)")}).drop("target").join(groups.select("target", "agg_id"), "agg_id")
    parts = (apply_rule(found.where(F.col("_i") == i).select("target", "agg_id", "y", "p", "pred", "thr"), groups, counts, cells, c).withColumn("tag", F.lit(c.tag())) for i, c in enumerate(configs))
    return reduce(DataFrame.unionByName, parts)


def run(groups: DataFrame, counts: DataFrame, cells: DataFrame, n_rois: int, n_epochs: int, config: AuditConfig, path: str, adjacency: DataFrame | None = None, population: DataFrame | None = None, run_id: str | None = None) -> str:
    """A whole audit: its scores, predictions and settings below path/<run_id>, all at once or not at all; returns the run's id.

    The config's mode says which observer; the one with a release alone needs `adjacency`. Tables kept on the way are deleted at the end.
    """
    if config.mode == "marginal_prior" and adjacency is None:
        raise ValueError("the marginal prior needs the places' neighbours")
    spark = groups.sparkSession
    with scratch(spark):
        if config.mode == "marginal_prior":
            found = marginal_prior(groups, counts, cells, adjacency, n_rois, n_epochs, config, population)
        else:
            found = reference_prior(groups, counts, cells, n_rois, n_epochs, config)
        found = keep(found)
        return sinks.results(metrics.scores(found), found, sinks.run_meta(spark, config, run_id), path)
