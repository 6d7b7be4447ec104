"""What providers answer, as rows: search pages, sections, playlists, paged records.

Nothing here opens a connection; answers come as JSON text or files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.address import noise_reason
from ..functions.text import collapse, sanitize_query
from ..operators.relational import latest

c = F.col

ITEMS = "struct<items: array<struct<id: string, title: string, description: string, url: string, position: int, type: string, channels: array<string>>>, nextPageToken: string>"
#: Fixed value: the form of a channel id.
CHANNEL_ID = r"^UC[A-Za-z0-9_-]{22}$"


def search_page(answers: DataFrame, body: str = "body") -> DataFrame:
    """S11. Candidates of search answers: one row per item with an id, its rank in the answer, and whether there is a next page."""
    p = answers.withColumn("_p", F.from_json(body, ITEMS))
    rows = p.select(*[x for x in answers.columns if x != body], c("_p.nextPageToken").isNotNull().alias("has_next"), F.posexplode("_p.items").alias("_i", "_x"))
    keep = [x for x in answers.columns if x != body]
    return rows.where("_x.id IS NOT NULL").select(*keep, "has_next", (c("_i") + 1).alias("rank"), c("_x.id").alias("id"), c("_x.title").alias("title"), c("_x.url").alias("url"))


def search_request(text, country, language, count: int, offset: int) -> Column:
    """S12, T34. The parameters of a web search, within the provider's limits."""
    return F.struct(F.substring(sanitize_query(text), 1, 400).alias("q"), F.upper(F.coalesce(c(country), F.lit("ALL"))).alias("country"), F.lower(F.coalesce(c(language), F.lit("en"))).alias("search_lang"), F.lit(max(1, min(20, count))).alias("count"), F.lit(max(0, min(9, offset))).alias("offset"))


def staged(candidates: DataFrame, known: DataFrame, domains: tuple[str, ...], titles: str) -> DataFrame:
    """S12. New candidates with why one is noise, one row per url; known urls are left out."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))
    own = latest(candidates, ["url"], [F.asc("rank")]).join(known.select("url"), "url", "left_anti")
    return own.withColumn("noise", noise_reason(host, c("title"), domains, titles))


def featured(answers: DataFrame, body: str = "body", most: int = 50) -> DataFrame:
    """S13, T35. Channels of featured sections, well-formed ids once each, by section position, at most `most` of a parent."""
    keep = [x for x in answers.columns if x != body]
    p = answers.withColumn("_p", F.from_json(body, ITEMS)).select(*keep, F.explode("_p.items").alias("_s"))
    rows = p.where("_s.type = 'multipleChannels'").select(*keep, c("_s.position").alias("position"), F.posexplode("_s.channels").alias("place", "channel_id")).where(c("channel_id").rlike(CHANNEL_ID))
    once = latest(rows, [*keep, "channel_id"], [F.asc("position"), F.asc("place")])
    w = Window.partitionBy(*keep).orderBy("position", "place")
    return once.withColumn("n", F.row_number().over(w)).where(c("n") <= most)


def query_components(queries: DataFrame, columns: list[str]) -> DataFrame:
    """T30. Each query's typed components, normalised, once per type and term."""
    pairs = F.array(*[F.struct(F.lit(x).alias("type"), collapse(x).alias("term")) for x in columns])
    return queries.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.type", "p.term").where("term <> ''").distinct()


def retry_delay_ms(attempt) -> Column:
    """S16. 2^n * 100 ms, at most 2 s, for at most three retries; null after."""
    return F.when(attempt <= 3, F.least(F.lit(2000.0), 100 * F.pow(F.lit(2.0), attempt)))


def call_events(attempts: DataFrame, timeout_ms: float) -> DataFrame:
    """R20. The event that each attempt of a provider call leaves, in A04's terms."""
    status = F.when(c("elapsed_ms") > timeout_ms, "TIMEOUT").when(c("http") < 400, "SUCCESS").otherwise("ERROR")
    return attempts.select("provider", "call_id", "attempt", status.alias("status"), F.least(c("elapsed_ms"), F.lit(timeout_ms)).alias("latency_ms"), "cost")


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.at, self.most, self.quota, self.cost = options["path"], int(options.get("maxpages", "10")), int(options.get("quota", "1000")), int(options.get("pagecost", "1"))

    def partitions(self) -> list[_Page]:
        files = sorted(f for f in os.listdir(self.at) if f.endswith(".json"))
        return [_Page(os.path.join(self.at, f)) for f in files[: min(self.most, self.quota // max(1, self.cost))]]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(partition.path) as f:
            page = json.load(f)
        for i, item in enumerate(page.get("items", [])):
            yield int(page.get("page", 0)), i + 1, json.dumps(item, sort_keys=True)


class PagedRecords(DataSource):
    """S15. A structured adapter: records of numbered page files, bounded by pages and by quota, a task for each page."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "page int, place int, record string"

    def reader(self, schema) -> _PageReader:
        return _PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRecords)
