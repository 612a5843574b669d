"""Scores of windows against a reference that is reduced once and can be stored."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import distance, encode, ordering

if TYPE_CHECKING:
    from tidegauge.plans.experiment import Config

KERNELS = {"mmd_rbf": distance.mmd, "energy": distance.energy, "sinkhorn": distance.sinkhorn}


def families(methods: tuple[str, ...]) -> dict[str, list[tuple[str, dict]]]:
    """Methods with their parameters by family."""
    out: dict[str, list[tuple[str, dict]]] = {}
    for m in methods:
        family, params = distance.parse_method(m)
        out.setdefault(family, []).append((m, params))
    return out


def sample_sizes(config: Config) -> dict[str, int]:
    """Rows that a family draws of a sample."""
    return {"mmd_rbf": config.max_pairs, "sinkhorn": config.max_pairs, "energy": config.energy_rows, "c2st": config.c2st_rows // 2}


@dataclass
class Prepared:
    """What scoring needs of a reference: counts of its values, bin edges, quantiles on directions, drawn samples.

    A rolling reference, which has rows for every window, keeps its rows for the directions instead of quantiles.
    """

    dim: int
    counts: DataFrame | None = None
    edges: DataFrame | None = None
    quantiles: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # by directions and grid
    samples: dict[int, DataFrame] = field(default_factory=dict)  # by size
    rows: DataFrame | None = None

    def store(self, folder: str) -> None:
        """Write a shared reference as Parquet tables under ``folder``."""
        if self.rows is not None:
            raise ValueError("a rolling reference isn't stored")
        some = self.counts or self.edges or next(iter(self.samples.values()), None)
        spark = some.sparkSession if some is not None else SparkSession.getActiveSession()
        for name in ("counts", "edges"):
            if getattr(self, name) is not None:
                getattr(self, name).write.parquet(f"{folder}/{name}")
        for most, df in self.samples.items():
            df.write.parquet(f"{folder}/sample_{most}")
        facts = {"dim": self.dim, "counts": self.counts is not None, "edges": self.edges is not None, "samples": sorted(self.samples)}
        flat = [(p, g, q.ravel().tolist()) for (p, g), q in self.quantiles.items()]
        spark.createDataFrame(flat, "projections int, grid int, q array<double>").write.parquet(f"{folder}/quantiles")
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.parquet(f"{folder}/facts")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Prepared:
        facts = json.loads(spark.read.parquet(f"{folder}/facts").first()[0])
        read = lambda name, there: spark.read.parquet(f"{folder}/{name}") if there else None
        quantiles = {(r[0], r[1]): np.array(r[2]).reshape(r[1], r[0]) for r in spark.read.parquet(f"{folder}/quantiles").collect()}
        return Prepared(facts["dim"], read("counts", facts["counts"]), read("edges", facts["edges"]), quantiles, {m: read(f"sample_{m}", True) for m in facts["samples"]})


def prepare(reference: DataFrame, methods: tuple[str, ...], config: Config) -> Prepared:
    """Reduce a reference of rows (srn, features), or of such rows for every window_index, to what ``methods`` need."""
    by, known = distance.own_keys(reference), families(methods)
    out = Prepared(encode.dimension(reference))
    if "ks" in known or "psi" in known:
        out.counts = ordering.settled(encode.value_counts(reference, by, "r"))
    if "psi" in known:
        out.edges = ordering.settled(distance.psi_edges(ordering.sample_features(out.counts, out.dim, config.psi_features, config.seed), config.psi_bins))
    if "sliced" in known and by:
        out.rows = reference
    for _, p in known.get("sliced", []) if not by else []:
        out.quantiles[p["projections"], p["grid"]] = distance.sliced_reference(reference, encode.directions(out.dim, p["projections"], config.seed), p["grid"])
    wanted = {most for f, most in sample_sizes(config).items() if f in known}
    if wanted and by:
        sizes = {r[0]: r[1] for r in reference.groupBy("window_index").count().collect()}
        out.samples = {most: ordering.settled(distance.sampled(reference, sizes, most, config.seed)) for most in wanted}
    elif wanted:
        n = reference.count()
        out.samples = {most: ordering.settled(ordering.sample_rows(reference, n, most, config.seed, "srn")) for most in wanted}
    return out


def score_windows(reference: DataFrame | Prepared, windows: DataFrame, methods: tuple[str, ...], config: Config) -> DataFrame:
    """(window_index, method, score, runtime_seconds) of every method for rows (window_index, srn, features); each family is
    computed once for all its methods and windows. ``reference`` is prepared, or rows as of ``prepare``.

    runtime_seconds is the time of the job that made a family's scores, in equal shares for its methods and windows.
    """
    out: list[DataFrame] = []
    ref = reference if isinstance(reference, Prepared) else prepare(reference, methods, config)
    known = families(methods)
    # values are counted once for both families
    long = ordering.settled(encode.value_counts(windows, ["window_index"], "c")) if {"ks", "psi"} & set(known) else None
    drawn = lambda df, most: ordering.sample_features(df, ref.dim, most, config.seed)

    def timed(make: Callable[[], DataFrame], n_methods: int = 1) -> DataFrame:
        start = time.perf_counter()
        got = ordering.settled(make())
        spent = time.perf_counter() - start
        return got.withColumn("runtime_seconds", F.lit(spent / max(1, got.count() * n_methods)))

    row = lambda df, m, c: df.select("window_index", F.lit(m).alias("method"), F.col(c).alias("score"), "runtime_seconds")
    if "ks" in known:
        ks = timed(lambda: distance.ks(drawn(ref.counts, config.ks_features), drawn(long, config.ks_features)).groupBy("window_index").agg(F.avg("ks").alias("mean_ks"), F.max("ks").alias("max_ks")), len(known["ks"]))
        out += [row(ks, m, m) for m, _ in known["ks"]]
    if "psi" in known:
        tops = tuple({p["top"] for _, p in known["psi"] if "top" in p})
        psi = timed(lambda: distance.psi_summaries(distance.psi(drawn(ref.counts, config.psi_features), drawn(long, config.psi_features), config.psi_bins, ref.edges), tops or (5,)), len(known["psi"]))
        out += [row(psi, m, f"top{p['top']}_psi" if "top" in p else m) for m, p in known["psi"]]
    for m, p in known.get("sliced", []):
        theta = encode.directions(ref.dim, p["projections"], config.seed)
        base = ref.rows if ref.rows is not None else ref.quantiles[p["projections"], p["grid"]]
        out.append(row(timed(lambda: distance.sliced_windows(base, windows, theta, p["grid"])), m, "score"))  # noqa: B023  called at once
    draws = sample_sizes(config)
    sampled = [(f, m) for f in draws for m, _ in known.get(f, [])]
    if sampled:
        sizes = {r[0]: r[1] for r in windows.groupBy("window_index").count().collect()}
        cur = {most: ordering.settled(distance.sampled(windows, sizes, most, config.seed + 1)) for most in {draws[f] for f, _ in sampled}}
        for f, m in sampled:
            most = draws[f]
            make = (lambda: distance.c2st_windows(ref.samples[most], cur[most], config.c2st_folds, config.c2st_rows, config.seed)) if f == "c2st" else (lambda: KERNELS[f](ref.samples[most], cur[most]))  # noqa: B023  called at once
            out.append(row(timed(make), m, "score"))
    return distance.union_all(out)
