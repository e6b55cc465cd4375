"""A wiki's API as a Spark data source: ``spark.read.format("wiki")``, a row for each request.

Options: ``endpoint``, the API's address; ``requests``, a JSON list of objects of parameters; ``partitions``; ``rate`` and ``capacity`` of the
calls of all partitions together; ``agent``. Each partition has a token bucket with its share of the rate, so that the sum stays within
it however many tasks run at once. Without pruning columns a row is (request, body): the parameters and the reply as JSON. A reply that isn't
a success, or that holds an error, is the task's error. A row is one reply: nothing of a partition is kept but the one that is read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RATE, CAPACITY = 10.0, 10.0
AGENT = "foliomill"
FIXED = {"format": "json", "formatversion": "2"}


class Bucket:
    """Holds up to capacity tokens and gets rate of them a second; a call takes one, and waits for it if there is none."""

    def __init__(self, capacity: float, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.rate, self.clock, self.sleep = max(capacity, 1.0), rate, clock, sleep
        self.tokens, self.at = self.capacity, clock()

    def take(self) -> None:
        while True:
            now = self.clock()
            self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
            if self.tokens > 1 - 1e-6:  # a clock far from zero has no finer steps
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) / self.rate)


def get(endpoint: str, params: dict[str, object], agent: str = AGENT) -> str:
    """The reply to one request; parameters that are null are left out."""
    own = FIXED | {k: str(v) for k, v in params.items() if v is not None}
    request = urllib.request.Request(f"{endpoint}?{urllib.parse.urlencode(own)}", headers={"User-Agent": agent, "Accept": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=60) as reply:
            body = reply.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        raise OSError(f"the wiki answered {e.code}: {e.read().decode('utf-8', 'replace')}") from e
    found = json.loads(body)
    if isinstance(found, dict) and (error := found.get("error")):
        raise OSError(f"the wiki answered {error.get('code')}: {error.get('info')}")
    return body


class Requests(InputPartition):
    def __init__(self, requests: list[dict]):
        self.requests = requests


class WikiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.endpoint, self.requests = options["endpoint"], json.loads(options.get("requests", "[]"))
        self.n = max(1, min(int(options.get("partitions", "1")), len(self.requests)))
        self.rate, self.capacity = float(options.get("rate", RATE)) / self.n, float(options.get("capacity", CAPACITY)) / self.n
        self.agent = options.get("agent", AGENT)

    def partitions(self) -> list[Requests]:
        return [Requests(self.requests[i :: self.n]) for i in range(self.n)]

    def read(self, partition: Requests) -> Iterator[tuple[str, str]]:
        bucket = Bucket(self.capacity, self.rate)
        for params in partition.requests:
            bucket.take()
            yield json.dumps(params, sort_keys=True), get(self.endpoint, params, self.agent)


class WikiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return "request string, body string"

    def reader(self, schema) -> WikiReader:
        return WikiReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WikiSource)
