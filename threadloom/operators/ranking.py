"""Exact global ranks, and labels by rank, without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of a hash that make a bucket: 4096 buckets, of 24 million rows where there are 10^11.
HASH_DIGITS = 3


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each prolonged until no column of `df` has it, so that helper columns never meet a user's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def seeded(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible pseudo-random order: the md5 of seed and keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def joined(df: DataFrame, counts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows and what `counts` says of their keys; null keys meet."""
    named = counts.select(*[F.col(k).alias(f"its {k}") if k in keys else F.col(k) for k in counts.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"its {k}"))
    return df.join(named, on, how).drop(*[f"its {k}" for k in keys])


def global_index(df: DataFrame, bucket: Column, order: list[Column], out: str = "rn", partition: list[str] | None = None, total: str = "n") -> DataFrame:
    """Row numbers (from 1) by (bucket, *order) within `partition`, and the number of rows as `total`.

    Only counts by bucket are summed in one place; rows are sorted within their bucket. The bucket must be a
    non-decreasing function of the order wanted, such as a hash's prefix or a day. Null buckets come first."""
    partition = partition or []
    b, held, before = free_names(df, "bucket", "held", "before")
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*partition, b).agg(F.count(F.lit(1)).alias(held))
    whole = Window.partitionBy(*partition)
    ahead = whole.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(held).over(ahead), F.lit(0))).withColumn(total, F.sum(held).over(whole))
    within = Window.partitionBy(*partition, b).orderBy(*order)
    ranked = joined(df, counts.drop(held), [*partition, b])
    return ranked.withColumn(out, F.col(before) + F.row_number().over(within)).drop(b, before)


def hash_index(df: DataFrame, seed: int | str, keys: list[str], out: str = "rn", total: str = "n") -> DataFrame:
    """global_index in seeded order; equal hashes follow the keys."""
    (h,) = free_names(df, "hash")
    hashed = df.withColumn(h, seeded(seed, *keys))
    return global_index(hashed, F.substring(F.col(h), 1, HASH_DIGITS), [F.col(h), *[F.col(k) for k in keys]], out, total=total).drop(h)


def labelled(df: DataFrame, levels: list[Column], order: list[Column], label: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Add `out`, label(rank, number of rows) by the exact rank in the order of (*levels, *order), sorting next to nothing.

    The label must follow the rank in steps, as shares and chunks do. A bucket, a value of the first level, whose first
    and last rank have one label is decided by its count; only rows of the others go on to the next level, and only
    what the last leaves open is sorted, within its bucket. `df` is read twice a level."""
    names = free_names(df, *[f"level{k}" for k in range(len(levels))], "held", "before", "total")
    keys, (held, before, total) = names[: len(levels)], names[len(levels) :]
    rows = df.withColumns(dict(zip(keys, levels, strict=True)))
    done, parents = [], None
    for k in range(len(levels)):
        mine = keys[: k + 1]
        counts = rows.groupBy(*([] if k == 0 else [before, total]), *mine).agg(F.count(F.lit(1)).alias(held))
        whole = Window.partitionBy(*mine[:-1])
        start = F.coalesce(F.sum(held).over(whole.orderBy(mine[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn(total, F.sum(held).over(whole)) if k == 0 else counts
        counts = counts.withColumn(before, start if k == 0 else F.col(before) + start)
        first, last = label(F.col(before) + 1, F.col(total)), label(F.col(before) + F.col(held), F.col(total))
        decided, parents = counts.where(first.eqNullSafe(last)), counts.where(~first.eqNullSafe(last)).drop(held)
        bare = rows.drop(before, total)
        done.append(joined(bare, decided.select(*mine, first.alias(out)), mine).drop(*keys))
        rows = joined(bare, parents, mine)
    rank = F.col(before) + F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    done.append(rows.withColumn(out, label(rank, F.col(total))).drop(before, total, *keys))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def hash_labelled(df: DataFrame, seed: int | str, keys: list[str], label: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """labelled in seeded order; equal hashes follow the keys."""
    (h,) = free_names(df, "hash")
    hashed = df.withColumn(h, seeded(seed, *keys))
    return labelled(hashed, [F.substring(F.col(h), 1, HASH_DIGITS)], [F.col(h), *[F.col(k) for k in keys]], label, out).drop(h)
