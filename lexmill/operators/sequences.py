"""Token windows, splits, batches, prefix sums and other ordered operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise, ship


def window_starts(n: Column, block: int, stride: int | None = None) -> Column:
    """Starts of the samples of ``n`` tokens; a stride of 0 or None means the block."""
    step = stride or block
    last = n - block
    return F.when(last >= 0, F.sequence(F.lit(0).cast(n_type := "long"), last.cast(n_type), F.lit(step).cast(n_type))).otherwise(F.array().cast("array<bigint>"))


def sample_windows(docs: DataFrame, block: int, stride: int | None = None, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, sample, input_ids, labels): overlapping windows and the same one token later.

    When the last window ends with the tokens, both its sides are one token short.
    """
    t = F.col(tokens_col)
    n = F.size(t).cast("long")
    each = docs.select(id_col, t.alias("__t"), n.alias("__n"), F.posexplode(window_starts(n, block, stride)).alias("sample", "__s"))
    end = F.least(F.col("__s") + block, F.col("__n") - 1)
    size = (end - F.col("__s")).cast("int")
    start = F.col("__s").cast("int")
    return each.select(id_col, F.col("sample").cast("long").alias("sample"), F.slice("__t", start + 1, size).alias("input_ids"), F.slice("__t", start + 2, size).alias("labels"))


def sample_counts(files: DataFrame, block: int, stride: int | None = None) -> DataFrame:
    """(file, n_tokens) with ``n_samples`` and the ``offset`` of each file's first sample."""
    step = stride or block
    count = F.greatest(F.floor((F.col("n_tokens") - block) / step) + 1, F.lit(0)).cast("long")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("n_samples", count).withColumn("offset", F.coalesce(F.sum("n_samples").over(before), F.lit(0)))


def locate_samples(indexes: DataFrame, counted: DataFrame) -> DataFrame:
    """(idx) -> file and place in it, by the range of offsets each file covers.

    The line of samples is cut into stretches as long as the mean file; indexes and files meet by
    the number of the stretch, of which all files together cover at most twice as many as there
    are files.
    """
    full = counted.where("n_samples > 0")
    width = full.agg(F.greatest(F.coalesce(F.floor(F.sum("n_samples") / F.count("*")), F.lit(1)), F.lit(1)).cast("long").alias("w")).first().w
    ranges = full.select("file", "offset", (F.col("offset") + F.col("n_samples")).alias("end"))
    ranges = ranges.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("end") - 1) / width))))
    placed = indexes.withColumn("stretch", F.floor(F.col("idx") / width)).join(ranges, "stretch")
    return placed.where((F.col("idx") >= F.col("offset")) & (F.col("idx") < F.col("end"))).select("idx", "file", (F.col("idx") - F.col("offset")).alias("local_idx"))


def adapted_block(n_tokens: Column, block: int, least: int = 16) -> Column:
    """The block size for a corpus of ``n_tokens``: a quarter of it where it is shorter than the block."""
    return F.greatest(F.lit(least), F.when(n_tokens < block, F.floor(n_tokens / 4)).otherwise(block)).cast("long")


def concatenated(rows: DataFrame, by: list[str], order: str, col: str, separator: str | None = None) -> DataFrame:
    """Per group ``by``: the texts of ``col`` joined in order, or its arrays one behind the other.

    For groups that fit a row; ``concatenated_sha256`` takes any, and a whole corpus is written by the
    text sink. Nulls are left out.
    """
    listed = rows.where(F.col(col).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("x")))).alias("__rows"))
    parts = F.transform("__rows", lambda r: r.x)
    return listed.select(*by, (F.flatten(parts) if separator is None else F.array_join(parts, separator)).alias(col))


def characters(text: str) -> bytes | None:
    """The characters of ``text`` with a blank between them; an empty text has none."""
    if not text:
        return None
    if not text.isascii():
        return " ".join(text).encode()
    out = np.full(2 * len(text) - 1, 0x20, np.uint8)
    out[::2] = np.frombuffer(text.encode(), np.uint8)
    return out.tobytes()


def concatenated_sha256(rows: DataFrame, by: list[str], order: str, col: str, kinds: dict[str, tuple[Callable[[str], bytes | None], bytes]]) -> DataFrame:
    """Per group ``by``: SHA-256 of its texts, concatenated in order, for groups of any size.

    ``kinds`` has for each column of digests what a text becomes (None: it is left out) and the
    separator. Null texts are left out; without any text the digest is null. Rows with equal
    ``order`` stand by their texts, those without it last. The rows of a group go in order through
    one task, since SHA-256 takes its bytes one after the other, and none is kept there.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, state = None, None, {}

        def ended() -> pa.RecordBatch:
            digests = [pa.array([state[k].hexdigest() if k in state else None], pa.string()) for k in kinds]
            return pa.RecordBatch.from_arrays([*group.columns, *digests], [*by, *kinds])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True))
            for at, own in enumerate(keys):
                if group is None or own != key:
                    if group is not None:
                        yield ended()
                    group, key, state = batch.select(by).slice(at, 1), own, {}
                text = batch.column(len(by))[at].as_py()
                for k, (made, separator) in kinds.items():
                    if text is not None and (part := made(text)) is not None:
                        if k in state:
                            state[k].update(separator)
                        else:
                            state[k] = hashlib.sha256()
                        state[k].update(part)
        if group is not None:
            yield ended()

    text = F.col(col).cast("string")
    placed = rows.select(*by, text.alias("__text"), F.col(order).alias("__order")).repartition(*by).sortWithinPartitions(*by, F.col("__order").asc_nulls_last(), "__text")
    schema = ", ".join([*(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by), *(f"`{k}` string" for k in kinds)])
    return placed.drop("__order").mapInArrow(run, schema)


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``rows`` with their place in the given order, from 0.

    Rows are dealt by ranges of the order and written once; a row's place is what lies in the
    ranges before plus its place in its own range, so no task orders more than a range.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(before, "__part").withColumn(name, place.cast("long")).drop("__part", "__before")


def split_sizes(n: Column, ratios: tuple[float, float, float]) -> Column:
    """Sizes that add up to n: floors, then the rest by largest fraction (earlier first on ties).

    Shares with ratio 0 get none of the rest; what is still left goes to the first.
    """
    if min(ratios) < 0 or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must be non-negative and sum to 1")
    raw = [n * F.lit(float(r)) for r in ratios]
    base = [F.floor(x).cast("long") for x in raw]
    frac = [x - b for x, b in zip(raw, base, strict=True)]
    rest = n - sum(base[1:], base[0])
    sizes = []
    for i, r in enumerate(ratios):
        rank = sum(((frac[j] > frac[i]) | ((frac[j] == frac[i]) & F.lit(j < i))).cast("long") for j in range(3) if j != i)
        sizes.append(base[i] + F.when((rank < rest) & F.lit(r > 0), 1).otherwise(0))
    left = n - sum(sizes[1:], sizes[0])
    sizes[0] = sizes[0] + left
    return F.array(*[s.cast("long") for s in sizes])


def split_rows(rows: DataFrame, id_col: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``rows`` with ``split``; sizes are exact, the assignment a hash order of the id.

    Row numbers in hash order come from counts per hash bucket and a rank inside each bucket,
    so no task orders more than a bucket.
    """
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    hashed = rows.withColumn("__h", h).withColumn("__b", F.shiftright(F.col("__h"), 52))
    counts = hashed.groupBy("__b").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = rows.agg(split_sizes(F.count("*"), ratios).alias("__sizes"))
    placed = hashed.join(F.broadcast(before), "__b").crossJoin(F.broadcast(total))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col))
    s = F.col("__sizes")
    if ratios[2] > 0:
        name = F.when(rank <= s[0], "train").when(rank <= s[0] + s[1], "val").otherwise("test")
    else:
        name = F.when(rank <= s[0] + s[2], "train").otherwise("val")
    return placed.withColumn("split", name).drop("__h", "__b", "__c", "__before", "__sizes")


def shuffled(id_col: str, seed: int) -> list[Column]:
    """An order that looks random, is the same in every run, and differs by seed."""
    return [F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed).cast("string"))), F.col(id_col)]


def batches(rows: DataFrame, order: list, size: int, drop_last: bool = False, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``batch_id`` in the given order (see ``shuffled``), within each group ``by`` if given.

    ``drop_last`` leaves out a last batch that isn't full.
    """
    if by:
        placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    else:
        placed = numbered(rows, order, "__at")
    out = placed.withColumn("batch_id", F.floor(F.col("__at") / size).cast("long"))
    if drop_last:
        total = out.groupBy(*(by or [])).agg(F.count("*").alias("__total"))
        out = out.join(total, by) if by else out.crossJoin(total)  # one row
        out = out.where((F.col("batch_id") + 1) * size <= F.col("__total")).drop("__total")
    return out.drop("__at")


def early_stopping(values: Column, patience: int, min_delta: float = 0.0) -> Column:
    """Fold over ordered values: best (moved only by more than min_delta), failures, stop index.

    The index counts from 1 and is null if the patience never ran out.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("stop"))

    def step(s, v):
        better = s.best.isNull() | (v < s.best - min_delta)
        bad = F.when(better, 0).otherwise(s.bad + 1)
        i = s.i + 1
        return F.when(s.stop.isNotNull(), s).otherwise(
            F.struct(F.when(better, v).otherwise(s.best).alias("best"), bad.alias("bad"), i.alias("i"), F.when(bad >= patience, i).alias("stop"))
        )

    return F.aggregate(values, start, step)
