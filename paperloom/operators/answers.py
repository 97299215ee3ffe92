"""Asking services from executors: paced lanes, repeats, circuit breakers, and a table of answers so that nothing is asked twice.

A request is (source, kind, key, payload); (source, kind, key) names it. ``ask`` takes those that the table has
no good answer for, deals them by source to lanes, and sends each lane's in order, never closer than its pace.
The caller's transport, ``(source, kind, payload) -> (status, body)``, does the sending; it runs on executors.

Lanes work in waves of a bounded number of requests. Each wave's answers are appended to the table before
the next begins, so a lost executor costs one wave of a lane at most. Failures are kept with their error, and asked
again by the next run only. A source that refuses, or fails ``give_up`` times in a row, gets nothing
more in this run: what is left of it stays unasked, not failed.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

#: Requests of a lane in one wave.
WAVE = 500
ANSWER = "source string, kind string, key string, status int, body string, error string, tries int, closed boolean"


@dataclass(frozen=True)
class Policy:
    """Seconds between requests (and up to ``jitter`` more), tries of a request, seconds to wait when told to slow
    down, failures in a row that end a run, whether a refusal ends it at once, and lanes that share the pace."""

    delay: float
    jitter: tuple[float, float] = (0.0, 0.0)
    tries: int = 2
    pause: float = 5.0
    give_up: int = 20
    refusal_ends: bool = False
    lanes: int = 1


# The least seconds between requests that each service is asked with.
POLICIES = {
    "arxiv": Policy(3.0),
    "crossref": Policy(1.0),
    "semantic_scholar": Policy(0.5),
    "dblp": Policy(1.5),
    "openalex": Policy(0.1),
    "scholar": Policy(10.0, jitter=(3.0, 5.0), refusal_ends=True),
}
TOO_MANY = 429
REFUSED = "unusual traffic"


class Lane:
    """Sends one lane's requests in order; ``clock`` and ``sleep`` can be replaced in tests."""

    def __init__(self, policy: Policy, send: Callable, clock=time.monotonic, sleep=time.sleep):
        self.policy, self.send, self.clock, self.sleep = policy, send, clock, sleep
        self.last: float | None = None
        self.failures, self.closed = 0, False

    def _pace(self) -> None:
        wait = self.policy.delay * self.policy.lanes + random.uniform(*self.policy.jitter)
        if self.last is not None and (now := self.clock()) < self.last + wait:
            self.sleep(self.last + wait - now)
        self.last = self.clock()

    def ask(self, source: str, kind: str, payload: str) -> tuple[int | None, str | None, str | None, int]:
        """(status, body, error, tries); after a failure that ends the run ``closed`` is set."""
        status = error = None
        for n in range(1, self.policy.tries + 1):
            self._pace()
            try:
                status, body = self.send(source, kind, payload)
            except Exception as e:  # any fault of a transport is a failed try
                status, body, error = None, None, f"{type(e).__name__}: {e}"
            if status is not None and 200 <= status < 300 and not (self.policy.refusal_ends and REFUSED in (body or "").lower()):
                self.failures = 0
                return status, body, None, n
            error = error if status is None else f"status {status}"
            refused = status == TOO_MANY or REFUSED in (body or "").lower()
            if refused and self.policy.refusal_ends:
                self.closed = True
                return status, None, "refused", n
            if status is not None and 400 <= status < 500 and status != TOO_MANY:
                break  # the same question would get the same reply
            if n < self.policy.tries:
                self.sleep(self.policy.pause if status == TOO_MANY else min(self.policy.pause, 0.5 * 2**n))
        if status is None or status >= 500 or status == TOO_MANY:
            self.failures += 1
            self.closed = self.failures >= self.policy.give_up
        return status, None, error, n


class Answers:
    """A table of answers in a folder that driver and executors share. Good answers are those without an error."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def all(self) -> DataFrame:
        """Every answer and failure so far."""
        none = self.spark.createDataFrame([], ANSWER)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(none.schema).parquet(self.folder) if there else none

    def good(self) -> DataFrame:
        """(source, kind, key, body), one row for each answered request."""
        held = self.all().filter("error IS NULL")
        return held.groupBy("source", "kind", "key").agg(F.min("body").alias("body"))

    def add(self, answers: DataFrame) -> None:
        answers.write.mode("append").parquet(self.folder)


def ask(requests: DataFrame, answers: Answers, send: Callable, policies: dict[str, Policy] = POLICIES, *, wave: int = WAVE) -> DataFrame:
    """Ask what ``answers`` lacks of ``requests`` (source, kind, key, payload) and keep it; the good answers of all
    requests (source, kind, key, body). Requests with the same name are one. Sources without a policy are not asked."""
    named = requests.groupBy("source", "kind", "key").agg(F.min("payload").alias("payload")).filter(F.col("source").isin(*policies))
    lanes = F.create_map(*[x for s, p in policies.items() for x in (F.lit(s), F.lit(p.lanes))])
    lane = F.pmod(F.xxhash64("kind", "key"), lanes[F.col("source")])
    todo = named.join(answers.good().select("source", "kind", "key"), ["source", "kind", "key"], "left_anti").withColumn("lane", lane)
    turn = F.row_number().over(Window.partitionBy("source", "lane").orderBy("kind", "key"))
    todo = stored(todo.withColumn("wave", F.floor((turn - 1) / wave)))
    waves = todo.agg(F.max("wave")).first()[0]
    open_ = dict(policies)
    for n in range(0 if waves is None else waves + 1):
        now = todo.filter((F.col("wave") == n) & F.col("source").isin(*open_))
        count = sum(p.lanes for p in open_.values())
        dealt = now.repartition(max(1, count), "source", "lane").sortWithinPartitions("source", "lane", "kind", "key")
        got = dealt.select("source", "kind", "key", "payload", "lane").mapInArrow(_sender(send, open_), ANSWER)
        # The answers are written once; what is read of them below is the written rows.
        got = stored(got)
        answers.add(got)
        for r in got.filter("closed").select("source").distinct().collect():  # of the few sources
            open_.pop(r["source"], None)
        if not open_:
            break
    return answers.good().join(named.select("source", "kind", "key"), ["source", "kind", "key"], "left_semi")


def _sender(send: Callable, policies: dict[str, Policy]):
    def run(batches):
        lanes: dict[tuple[str, int], Lane] = {}
        for b in batches:
            out = []
            for source, kind, key, payload, lane in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = lanes.setdefault((source, lane), Lane(policies[source], send))
                if own.closed:
                    continue
                status, body, error, tries = own.ask(source, kind, payload)
                out.append((source, kind, key, status, body, error, tries, own.closed))
            if out:
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "kind", "key", "status", "body", "error", "tries", "closed"])

    return run


def unpaced(policies: dict[str, Policy] = POLICIES) -> dict[str, Policy]:
    """The policies without waiting, for services of one's own and for tests."""
    return {s: replace(p, delay=0.0, jitter=(0.0, 0.0), pause=0.0) for s, p in policies.items()}
