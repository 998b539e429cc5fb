"""Stores that are changed in place: rows by key, stages by fingerprint, and personas batch by batch.

A key store and its writer are one at a time: two writers of one store would overwrite each other's partitions. A stage
and a persona batch are published by a rename, so that readers see whole ones or none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.dedupe import first_per_key, upsert_last
from threadloom.operators.personas import Provider
from threadloom.operators.ranking import free_names, hash_index, joined
from threadloom.sources.writers import cache_name, fingerprint
from threadloom.storage import exists, fresh_path, names_in, publish, remove, stored

#: Jobs that a run of a persona store makes its batches in, at most; of fewer batches each has its own.
WAVES = 32


@dataclass
class KeyStore:
    """Rows in Parquet, dealt into `parts` folders by a hash of their keys: a write touches only folders that its keys fall in."""

    path: str
    keys: list[str]
    parts: int = 64

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.parts)).cast("int"))

    def read(self, spark: SparkSession, schema=None) -> DataFrame:
        return (spark.read.schema(schema) if schema else spark.read).parquet(self.path).drop("part")

    def upsert(self, new: DataFrame) -> int:
        """Put `new` (one row a key) in place of old rows of its keys, beside all others; the number of folders written.

        The folders touched, at most `parts`, are named to the scan, so that it reads no other; what they hold
        afterwards is written aside first, as Spark must not read what it overwrites."""
        spark = new.sparkSession
        dealt = self._dealt(new)
        touched = [r.part for r in dealt.select("part").distinct().collect()]  # at most `parts` numbers
        if not touched:
            return 0
        if exists(spark, self.path):
            old = spark.read.schema(dealt.schema).parquet(self.path).where(F.col("part").isin(touched))
            dealt = upsert_last(old, dealt, self.keys)
        path = fresh_path(spark, "upsert")
        whole = stored(dealt, path)
        whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        remove(spark, path)
        return len(touched)

    def modify(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Read the rows of `keys`, change them, and write them back: what other writers put in before is read again first."""
        held = self.read(keys.sparkSession).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        return self.upsert(change(held))


@dataclass
class Stage:
    """A stage of a pipeline: its name, the parameters that its result depends on, and how it is made from the one before."""

    name: str
    params: dict
    build: Callable[[DataFrame | None], DataFrame]


@dataclass
class StageStore:
    """Results of stages in folders named by their parameters and those of all stages before."""

    root: str
    built: list[str] = field(default_factory=list)

    def folder(self, stages: list[Stage]) -> str:
        """Of the last of the stages: the fingerprint covers each stage's name and parameters."""
        return f"{self.root}/{stages[-1].name}/{fingerprint({'stages': [[s.name, s.params] for s in stages]})}"

    def resolve(self, spark: SparkSession, stages: list[Stage]) -> DataFrame:
        """The last stage's result: the most processed one that is stored is read, and only those behind it are built and published.

        A folder counts once it is published, by a rename; where two runs build one stage, the first to publish wins."""
        have, df = 0, None
        for k in range(len(stages), 0, -1):
            if exists(spark, f"{self.folder(stages[:k])}/_SUCCESS"):
                have, df = k, spark.read.parquet(self.folder(stages[:k]))
                break
        for k in range(have, len(stages)):
            target, aside = self.folder(stages[: k + 1]), f"{self.root}/_aside/{fresh_path(spark, stages[k].name).rpartition('/')[2]}"
            stages[k].build(df).write.parquet(aside)
            if not publish(spark, aside, target):
                remove(spark, aside)
            self.built.append(stages[k].name)
            df = spark.read.parquet(target)
        return df


def processing_stages(raw: Callable[[], DataFrame], sample: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], least: int, most: int, samples: int | None, fraction: float, history: int | None = None) -> list[Stage]:
    """raw, sampled and filtered interactions as stages; the filtered one's name tells its bounds."""
    return [Stage("raw", {}, lambda _: raw()), Stage("sampled", {"fraction": fraction}, sample), Stage(f"filtered-{cache_name(least, most, samples, fraction, history)}", {"least": least, "most": most}, keep)]


@dataclass
class PersonaStore:
    """Personas made batch by batch, with the list of users that are done.

    A batch's folder holds its personas and is published by a rename once they are whole; the ids of its users are
    published after it. The list of ids decides: a user who is stored but not listed is made again, and the later
    batch's persona counts; without any list the stored users count as done."""

    path: str

    def done(self, spark: SparkSession) -> DataFrame:
        """user_id of the users that need no persona."""
        lists = [x for x in names_in(spark, f"{self.path}/ids") if x.startswith("batch=")]
        if lists or not self._batches(spark):
            return spark.read.schema("user_id string").parquet(f"{self.path}/ids") if lists else spark.createDataFrame([], "user_id string")
        return self._stored(spark).select("user_id").distinct()

    def _batches(self, spark: SparkSession) -> list[str]:
        return [x for x in names_in(spark, f"{self.path}/personas") if x.startswith("batch=")]

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("user_id string, persona string, batch long").parquet(f"{self.path}/personas")

    def personas(self, spark: SparkSession) -> DataFrame:
        """user_id and persona, the latest of each user."""
        if not self._batches(spark):
            return spark.createDataFrame([], "user_id string, persona string")
        return first_per_key(self._stored(spark), ["user_id"], [F.col("batch").desc(), F.col("persona")]).drop("batch")

    def run(self, histories: DataFrame, provider: Provider, batch: int = 1000, most: int | None = None) -> DataFrame:
        """Make the personas that are missing from `histories` (user_id, ..), `batch` users at a time; at most `most` batches.

        Of up to WAVES batches each is made by itself, of more some are made together, so that the number of jobs is
        bounded; each is still published alone. A run that ends leaves out the batches that it was making, one or a
        share of 1 / WAVES; the next run begins with what the list of ids lacks."""
        spark = histories.sparkSession
        folder = fresh_path(spark, "todo")
        rows = histories.withColumn("user_id", F.col("user_id").cast("string")).join(self.done(spark), "user_id", "left_anti")
        first = 1 + max((int(x.partition("=")[2]) for kind in ("personas", "ids") for x in names_in(spark, f"{self.path}/{kind}") if x.startswith("batch=")), default=-1)
        k, rank, total = free_names(rows, "batch", "rank", "total")

        def make(numbers: range) -> None:
            todo = dealt.where(F.col(k).between(numbers.start, numbers.stop - 1))
            made = provider(todo.drop(k)).select("user_id", "persona")
            users = todo.select("user_id", F.col(k).alias("batch"))
            made = made.withColumn("batch", F.lit(numbers.start)) if len(numbers) == 1 else joined(made, users, ["user_id"])
            aside = f"{self.path}/_aside/{numbers.start}-{folder.rpartition('-')[2]}"
            for kind, df in (("personas", made), ("ids", users)):
                df.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{aside}/{kind}")
            for b in numbers:
                for kind in ("personas", "ids"):
                    if exists(spark, f"{aside}/{kind}/batch={b}"):  # a provider may tell nothing of a batch
                        publish(spark, f"{aside}/{kind}/batch={b}", f"{self.path}/{kind}/batch={first + b}")
            remove(spark, aside)

        try:
            ranked = hash_index(stored(rows, f"{folder}/rows"), 0, ["user_id"], rank, total).withColumn(k, F.floor((F.col(rank) - 1) / batch))
            ranked = ranked if most is None else ranked.where(F.col(k) < most)
            dealt = stored(ranked.drop(rank, total).repartition(k).sortWithinPartitions(k), f"{folder}/dealt")
            n = 1 + (dealt.agg(F.max(k)).first()[0] if not dealt.isEmpty() else -1)
            size = -(-n // WAVES) or 1
            for at in range(0, n, size):
                make(range(at, min(n, at + size)))
        finally:
            remove(spark, folder)
        return self.personas(spark)
