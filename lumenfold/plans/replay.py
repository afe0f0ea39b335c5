"""Diagnostic documents: a stored spectrum, its analysis, and whether a pair agrees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import spectra
from lumenfold.operators import spectral

SCHEMA = "schema string, pair_id string, role string, rate double, fit_low double, fit_high double, frequencies array<double>, power array<double>, beta double"
#: Documents of any maker are read whose schema ends so.
SCHEMA_END, TOLERANCE = "-diagnostic/1", 1e-12
AGAIN = ["again_beta", "r2", "flatness", "prominence_db", "tonal_ratio", "normalized_flatness", "occupancy", "harmonic_peaks", "smooth_db", "evidence", "abrupt_evidence"]


def exportable(df: DataFrame) -> Column:
    """Whether a measurement has all that a document needs and was not compacted."""
    compacted = F.coalesce(F.col("compacted"), F.lit(False)) if "compacted" in df.columns else F.lit(False)
    return F.col("frequencies").isNotNull() & F.col("power").isNotNull() & (F.size("power") > 0) & ~compacted


def documents(df: DataFrame, maker: str = "lumenfold") -> DataFrame:
    """The exportable rows as closed-schema JSON documents."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")][1:]
    return df.where(exportable(df)).select(F.to_json(F.struct(F.lit(maker + SCHEMA_END).alias("schema"), *names), {"ignoreNullFields": "false"}).alias("document"))


def replayed(texts: DataFrame, column: str = "document") -> DataFrame:
    """Documents' spectra fitted again: pair_id, role, rate, fit range, valid, stored beta, and AGAIN (fit, tonality, adequacy)."""
    rows = texts.select(F.from_json(column, SCHEMA).alias("d")).select("d.*")
    ascending = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("frequencies") - 1)), lambda i: F.get("frequencies", i) > F.get("frequencies", i - 1))
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    positive = F.forall("power", lambda x: x > 0) & (F.get("frequencies", F.lit(0)) >= 0) & (F.col("fit_low") > 0) & (F.col("fit_high") > F.col("fit_low")) & (F.col("fit_high") < float("inf"))
    valid = F.coalesce(F.col("schema").endswith(SCHEMA_END) & (F.size("frequencies") == F.size("power")) & (F.size("power") > 1) & finite("frequencies") & finite("power") & ascending & positive, F.lit(False))
    packed = rows.withColumn("valid", valid).withColumn("samples", F.when(valid, F.concat(F.array("fit_low", "fit_high"), "frequencies", "power")))

    def again(x: np.ndarray, rate: float) -> dict:
        if len(x) < 4:
            return dict.fromkeys(AGAIN)
        n = (len(x) - 2) // 2
        freq, power, (low, high) = x[2 : 2 + n], x[2 + n :], x[:2]
        fit = spectra.power_law(freq, power, low, high)
        tone, model = spectra.tonality(freq, power, fit, low, high), spectra.adequacy(freq, power, low, high)
        out = {"again_beta": fit.beta if np.isfinite(fit.beta) else None, "r2": fit.r2, "flatness": spectra.flatness(power[spectra.in_range(freq, power, low, high)])}
        return out | {k: float((tone | model)[k]) for k in AGAIN[3:]}

    kept = ["pair_id", "role", "valid", "beta", "rate", "fit_low", "fit_high"]
    return spectral.each_signal(packed, again, ", ".join(f"{k} double" for k in AGAIN), kept).withColumn("passed", F.abs(F.col("again_beta") - F.col("beta")) <= TOLERANCE)


def compared(reports: DataFrame) -> DataFrame:
    """Pairs of reports (roles a and b): difference of beta, equality of rate and fit range, and whether they agree."""
    sides = [reports.where(F.col("role") == r).select("pair_id", F.col("again_beta").alias(f"beta_{r}"), F.col("rate").alias(f"rate_{r}"), F.struct("fit_low", "fit_high").alias(f"config_{r}")) for r in ("a", "b")]
    joined = sides[0].join(sides[1], "pair_id").withColumn("difference", F.abs(F.col("beta_a") - F.col("beta_b")))
    joined = joined.withColumn("same_rate", F.col("rate_a").eqNullSafe(F.col("rate_b"))).withColumn("same_config", F.col("config_a").eqNullSafe(F.col("config_b"))).drop("config_a", "config_b")
    return joined.withColumn("passed", (F.col("difference") <= TOLERANCE) & F.col("same_rate") & F.col("same_config"))
