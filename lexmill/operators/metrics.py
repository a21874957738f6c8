"""Training-metric rollups, schedules, estimators, run registry and sampling filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- metric rollups -----------------------------------------------------------------------


def metric_summary(history: DataFrame) -> DataFrame:
    """(metric) -> count, latest by seq, average, min, max; null and NaN values are left out."""
    good = history.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy("metric").agg(
        F.count("*").alias("count"), F.max_by("value", "seq").alias("latest"), F.avg("value").alias("average"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def finite(rows: DataFrame, col: str) -> DataFrame:
    """Rows whose value is a finite number."""
    return rows.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf")))


def weighted_loss(rows: DataFrame, loss: str = "loss", weight: str = "n") -> DataFrame:
    """One row: weighted mean loss and perplexity; infinite if there is nothing to weigh."""
    total = F.sum(weight)
    mean = F.when(total > 0, F.sum(F.col(loss) * F.col(weight)) / total).otherwise(F.lit(float("inf")))
    return rows.agg(mean.alias("loss")).withColumn("perplexity", F.exp("loss"))


def trailing_mean(value: Column, n: int, window) -> Column:
    return F.avg(value).over(window.rowsBetween(-(n - 1), 0))


def running_best(value: Column, window, smaller: bool = True) -> Column:
    best = F.min(value) if smaller else F.max(value)
    return best.over(window.rowsBetween(Window.unboundedPreceding, 0))


def improves(value: Column, window) -> Column:
    """True where the value is below all before it."""
    before = F.min(value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(value < before, F.lit(True))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def smoothed(loss: Column, smooth: Column, epsilon: float) -> Column:
    """Label-smoothed loss."""
    return loss * (1 - epsilon) + smooth * epsilon


# -- schedules ----------------------------------------------------------------------------


def learning_rate(step: Column, kind: str, base: float, warmup: int = 0, total: int = 1000, floor: float = 0.0, gamma: float = 0.95, every: int = 100) -> Column:
    """Rate at ``step``: linear warm-up, then cosine, linear, exponential, step or constant."""
    s = step.cast("double")
    share = F.least(F.lit(1.0), (s - warmup) / max(1, total - warmup))
    after = {
        "cosine": floor + (base - floor) * 0.5 * (1 + F.cos(share * math.pi)),
        "linear": base - (base - floor) * share,
        "exponential": base * F.pow(F.lit(gamma), s - warmup),
        "step": base * F.pow(F.lit(gamma), F.floor((s - warmup) / every)),
        "constant": F.lit(base),
    }[kind]
    return F.when(s < warmup, base * s / warmup).otherwise(after) if warmup else after


def format_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def parameter_count(vocab: Column, layers: Column, width: Column, block: Column) -> Column:
    """Parameters of a decoder: embeddings, positions, blocks of 12 width^2 and norms."""
    return (vocab * width + block * width + layers * (12 * width * width + 13 * width) + 2 * width).cast("long")


def memory_mb(parameters: Column, bytes_each: int = 4, copies: int = 4) -> Column:
    return parameters * bytes_each * copies / 1048576


def processing_seconds(n_lines: Column, n_files: Column, semantic: bool = False) -> Column:
    """Rough estimate: 10,000 lines/s exact, 1,000 lines/s semantic, 0.1 s a file."""
    return n_lines / 10_000 + (n_lines / 1_000 if semantic else F.lit(0.0)) + n_files * 0.1


# -- registry -----------------------------------------------------------------------------


def run_order(sort_by: str = "created_at") -> list[Column]:
    """Newest, furthest or (for ``loss``) smallest first; missing losses last; then by name."""
    return [F.coalesce(F.col("loss"), F.lit(float("inf"))).asc() if sort_by == "loss" else F.col(sort_by).desc(), F.col("name").asc()]


def list_runs(registry: DataFrame, sort_by: str = "created_at") -> DataFrame:
    """All runs in that order."""
    return registry.orderBy(*run_order(sort_by))


def best_run(registry: DataFrame, metric: str = "loss", smaller: bool = True) -> DataFrame:
    """The run with the best metric; nulls are out, ties go to the newest, then the name."""
    order = F.col(metric).asc() if smaller else F.col(metric).desc()
    return registry.where(F.col(metric).isNotNull()).orderBy(order, F.col("created_at").desc(), "name").limit(1)


def latest_run(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.col("created_at").desc(), "name").limit(1)


def runs_to_delete(registry: DataFrame, keep: int, keep_best: bool = True, metric: str = "loss") -> DataFrame:
    """All but the newest ``keep`` and, if wanted, the best one."""
    newest = registry.orderBy(F.col("created_at").desc(), "name").limit(keep).select("name")
    kept = newest.union(best_run(registry, metric).select("name")).distinct() if keep_best else newest
    return registry.join(F.broadcast(kept), "name", "left_anti")  # at most keep + 1 names


# -- sampling filters ---------------------------------------------------------------------


def top_k(logits: DataFrame, k: int, row: str = "row") -> DataFrame:
    """Logits not below the k-th largest of their row; ties at the k-th stay."""
    w = Window.partitionBy(row).orderBy(F.col("logit").desc())
    return logits.withColumn("__r", F.rank().over(w)).where(F.col("__r") <= k).drop("__r")


def probabilities(logits: DataFrame, row: str = "row") -> DataFrame:
    each = Window.partitionBy(row)
    return logits.withColumn("__e", F.exp(F.col("logit") - F.max("logit").over(each))).withColumn("p", F.col("__e") / F.sum("__e").over(each)).drop("__e")


def top_p(logits: DataFrame, p: float, row: str = "row") -> DataFrame:
    """Smallest set of likeliest tokens whose probability passes p; at least one."""
    order = Window.partitionBy(row).orderBy(F.col("logit").desc(), "token").rowsBetween(Window.unboundedPreceding, -1)
    return probabilities(logits, row).withColumn("__before", F.coalesce(F.sum("p").over(order), F.lit(0.0))).where(F.col("__before") <= p).drop("__before")


def greedy(logits: DataFrame, row: str = "row") -> DataFrame:
    """Likeliest token of each row, the smallest on ties."""
    return logits.groupBy(row).agg(F.max_by(F.struct("token", "logit"), F.struct(F.col("logit"), -F.col("token"))).alias("t")).select(row, "t.token", "t.logit")


def repetition_penalty(logits: DataFrame, generated: DataFrame, penalty: float, row: str = "row") -> DataFrame:
    """Logits of generated tokens pushed down."""
    seen = generated.select(row, "token").distinct().withColumn("__g", F.lit(True))
    pushed = F.when(F.col("__g"), F.when(F.col("logit") < 0, F.col("logit") * penalty).otherwise(F.col("logit") / penalty)).otherwise(F.col("logit"))
    return logits.join(seen, [row, "token"], "left").withColumn("logit", pushed).drop("__g")


def sample_tokens(logits: DataFrame, seed: int, row: str = "row") -> DataFrame:
    """One token of each row, drawn by its probability: largest logit plus hashed Gumbel noise."""
    digest = F.md5(F.concat_ws(":", F.col(row).cast("string"), F.col("token").cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    noisy = logits.withColumn("__z", F.col("logit") - F.log(-F.log(u)))
    return noisy.groupBy(row).agg(F.max_by("token", "__z").alias("token"))
