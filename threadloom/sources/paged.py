"""A source of pages that name their successor, as a stream whose offset is the cursor.

A page is one JSON document {"items": [..], "next": cursor or null}, stored in a folder `cursor=<cursor>`; the first
page's cursor is an option. Pages are read by tasks, some each; the driver follows cursors only. What a query's
checkpoint holds is the cursor of the next page, so that a restart goes on there and reads no page twice."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from threadloom.operators.ranking import global_index

FIRST, END = "first", ""
#: Tasks that a batch is dealt to while each has at most MOST pages; of more pages, more tasks.
TASKS, MOST = 16, 64


def read_page(root: str, cursor: str) -> dict | None:
    """A page from any file system that pyarrow knows by the root's scheme; null while it is not there."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(f"{path}/cursor={cursor}", allow_not_found=True)) if x.is_file and x.base_name[0] not in "._")
    if not found:
        return None
    with system.open_input_stream(found[0]) as page:
        return json.loads(page.read())


class Pages(InputPartition):
    def __init__(self, cursors: list[str]):
        self.cursors = cursors


class PagedReader(DataSourceStreamReader):
    """Offsets are {"next": cursor}, with END behind the last page; a page that is named but not there yet is waited for.

    A batch holds at most `pagesPerBatch` pages, but the first of each run goes to the end of what is there: a run that
    takes what is available asks only once how far there is to go, and would leave out whatever lies behind."""

    def __init__(self, options: dict):
        self.root, self.first, self.most = options["path"], options.get("first", FIRST), int(options.get("pagesPerBatch", "8"))
        self.at, self.asked = self.first, False
        self.after: dict[str, str] = {}  # of the pages ahead that have been looked at

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def _walk(self, cursor: str, stop: str | None, most: int | None) -> list[str]:
        """Cursors from `cursor` on, up to `stop`, so many or what is there, and the one behind them."""
        seen = [cursor]
        while seen[-1] not in (END, stop) and (most is None or len(seen) <= most):
            if seen[-1] not in self.after:
                if (page := read_page(self.root, seen[-1])) is None:
                    break
                self.after[seen[-1]] = page.get("next") or END
            seen.append(self.after[seen[-1]])
        return seen

    def latestOffset(self) -> dict:
        most, self.asked = self.most if self.asked else None, True
        return {"next": self._walk(self.at, None, most)[-1]}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at = end["next"]
        cursors = self._walk(start["next"], end["next"], None)[:-1]
        size = min(MOST, -(-len(cursors) // TASKS)) or 1
        return [Pages(cursors[at : at + size]) for at in range(0, len(cursors), size)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for cursor in partition.cursors:
            for place, item in enumerate(read_page(self.root, cursor)["items"]):
                if item:
                    yield (cursor, place, str(item))

    def commit(self, end: dict) -> None:
        """Nothing is held for pages that are behind."""
        self.after.clear()


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "cursor string, place int, item string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedReader(self.options)


def pages(spark: SparkSession, path: str, first: str = FIRST, per_batch: int = 8) -> DataFrame:
    """A stream of (cursor, place, item) of the pages under `path`."""
    spark.dataSource.register(Paged)
    return spark.readStream.format("pages").option("path", path).option("first", first).option("pagesPerBatch", str(per_batch)).load()


def write_pages(rows: DataFrame, path: str, item: str, order: list[str], size: int, numbers: range | None = None) -> None:
    """Store `rows` as pages of `size` items in order; a page's cursor is the md5 of its number, the first one's is FIRST.

    numbers: store only pages of these numbers, so that others can follow later."""
    bucket = F.floor(F.col(order[0]) / (64 * size)) if dict(rows.dtypes)[order[0]] in ("int", "bigint") else F.substring(F.col(order[0]).cast("string"), 1, 2)
    ranked = global_index(rows, bucket, [F.col(c) for c in order], "rank", total="total")
    page = F.floor((F.col("rank") - 1) / size)
    last = F.floor((F.col("total") - 1) / size)
    cursor = lambda n: F.when(n == 0, FIRST).otherwise(F.substring(F.md5(n.cast("string")), 1, 12))
    listed = ranked.select(page.alias("page"), last.alias("last"), "rank", F.col(item).cast("string").alias("item")).groupBy("page", "last").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("held"))
    after = F.when(F.col("page") < F.col("last"), cursor(F.col("page") + 1))
    text = F.to_json(F.struct(F.transform("held", lambda x: x["item"]).alias("items"), after.alias("next")), {"ignoreNullFields": "false"})
    if numbers is not None:
        listed = listed.where(F.col("page").between(numbers.start, numbers.stop - 1))
    listed.select(text.alias("value"), cursor(F.col("page")).alias("cursor")).repartition("cursor").write.mode("append").partitionBy("cursor").text(path)
