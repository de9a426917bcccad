"""Keyed user state folded from events, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "seq long, page string, check_id string, checked boolean"


def check_state(events: DataFrame) -> DataFrame:
    """(page, check_id) that are checked in the end. Unchecking an id unchecks it on every page.

    events: (seq, page, check_id, checked). A page's check counts if its last one is later than the id's last uncheck, so two
    aggregations with partial sums do it, and no fold.
    """
    off = events.where("not checked").groupBy("check_id").agg(F.max("seq").alias("off_seq"))
    on = events.where("checked").groupBy("page", "check_id").agg(F.max("seq").alias("on_seq"))
    return on.join(off, "check_id", "left").where("off_seq is null or on_seq > off_seq").select("page", "check_id")


def is_checked(asked: DataFrame, state: DataFrame) -> DataFrame:
    """The asked rows (.., page, check_id) with `checked`: there or, for old keys, on any page."""
    anywhere = state.select("check_id").distinct().withColumn("hit", F.lit(True))
    return asked.join(anywhere, "check_id", "left").select(*asked.columns, F.coalesce("hit", F.lit(False)).alias("checked"))


def pins(events: DataFrame) -> DataFrame:
    """(map_id, pin, x, y, label) that are left; events: (seq, map_id, pin, op in add, move, label, delete, x, y, label)."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    g = events.groupBy("map_id", "pin").agg(
        F.max(F.when(F.col("op") == "add", F.col("seq"))).alias("added"),
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"),
        F.max_by(F.struct(clamp("x").alias("x"), clamp("y").alias("y")), F.when(F.col("op").isin("add", "move"), F.col("seq"))).alias("at"),
        F.max_by("label", F.when(F.col("op").isin("add", "label"), F.col("seq"))).alias("label"),
    )
    return g.where("added is not null and (gone is null or added > gone)").select("map_id", "pin", "at.x", "at.y", "label")


class CheckProcessor(StatefulProcessor):
    """State of one check id: the pages on which it is checked. Keyed by the id, since unchecking crosses pages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page string", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for df in rows:
            for r in df.sort_values("seq").itertuples():
                if r.checked:
                    self.pages.updateValue((r.page,), (r.seq,))
                else:
                    self.pages.clear()
                out.append((key[0], r.seq, sum(1 for _ in self.pages.keys())))
        yield pd.DataFrame(out, columns=["check_id", "seq", "n_pages"])

    def close(self) -> None:
        pass


def check_stream(events: DataFrame) -> DataFrame:
    """For each event of a stream, on how many pages its check id is then checked."""
    return events.groupBy("check_id").transformWithStateInPandas(statefulProcessor=CheckProcessor(), outputStructType="check_id string, seq long, n_pages long", outputMode="Update", timeMode="None")


PIN_EVENT = "seq long, map_id string, pin string, op string, x double, y double, label string"
PIN_STATE = "added long, gone long, placed long, x double, y double, named long, label string"


class PinProcessor(StatefulProcessor):
    """Pins of one map. What a pin is follows from the latest event of each kind, so events may come in any order and in any batches; a
    deleted pin stays as a tombstone, or an older event that comes late would bring it back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pins = handle.getMapState("pins", "pin string", PIN_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen: dict[str, list] = {}
        for df in rows:
            for r in df.itertuples():
                if r.pin not in seen:
                    known = self.pins.getValue((r.pin,)) if self.pins.containsKey((r.pin,)) else None
                    seen[r.pin] = list(known) if known else [-1, -1, -1, 0.0, 0.0, -1, None]
                p = seen[r.pin]
                if r.op == "add":
                    p[0] = max(p[0], r.seq)
                elif r.op == "delete":
                    p[1] = max(p[1], r.seq)
                if r.op in ("add", "move") and r.seq > p[2]:
                    p[2:5] = r.seq, min(1.0, max(0.0, r.x)), min(1.0, max(0.0, r.y))
                if r.op in ("add", "label") and r.seq > p[5]:
                    p[5:7] = r.seq, r.label
        out = []
        for pin, p in seen.items():
            self.pins.updateValue((pin,), tuple(p))
            out.append((key[0], pin, p[3], p[4], p[6], p[0] > p[1]))
        yield pd.DataFrame(out, columns=["map_id", "pin", "x", "y", "label", "there"])

    def close(self) -> None:
        pass


def pin_stream(events: DataFrame) -> DataFrame:
    """(map_id, pin, x, y, label, there) of the pins that a batch has touched, as they are then; the last row of each pin, if it says
    that the pin is there, is the pin that pins() gives over all events."""
    out = "map_id string, pin string, x double, y double, label string, there boolean"
    return events.groupBy("map_id").transformWithStateInPandas(statefulProcessor=PinProcessor(), outputStructType=out, outputMode="Update", timeMode="None")


ANSWER_EVENT = "seq long, reader string, kind string, request long, body string"


class AnswerProcessor(StatefulProcessor):
    """The latest request of one reader, a number and a flag. An answer comes out once, and only while its request is the latest that has
    been seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "request long, answered boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        request, answered = self.latest.get() if self.latest.exists() else (-1, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.request > request:
                request, answered = r.request, False
            if r.kind == "answer" and r.request == request and not answered:
                answered = True
                out.append((key[0], request, r.body))
        self.latest.update((request, answered))
        yield pd.DataFrame(out, columns=["reader", "request", "body"])

    def close(self) -> None:
        pass


def latest_answers(events: DataFrame) -> DataFrame:
    """(reader, request, body): answers to each reader's latest request. events: kind is request or answer."""
    return events.groupBy("reader").transformWithStateInPandas(statefulProcessor=AnswerProcessor(), outputStructType="reader string, request long, body string", outputMode="Append", timeMode="None")
