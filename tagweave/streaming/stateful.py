"""Keyed state for live video: fingerprint gate, crop banks and rail cache. Tracks are in ``tracks``.

Every function takes a streaming DataFrame and returns one. State is per video, or per video and
track, and holds only what later rows can still need. Rows of one micro-batch are put in frame
order before they meet the state, so batches must arrive in frame order, as cameras deliver them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _in_order(parts: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(by, kind="stable")


# ---- fingerprint gate -----------------------------------------------------------------------

#: Bits of a fingerprint's band from which an index by bands pays.
BAND_BITS = 8


class Gate(StatefulProcessor):
    """Known fingerprints of one key, listed under each of their bands; a batch reads and writes the bands of its rows.

    Two fingerprints that differ in ``distance`` bits at most agree in one of ``distance + 1`` bands. If bands would be
    narrower than ``BAND_BITS``, agreeing in one tells little, and all are in one list.
    """

    def __init__(self, keys: list[str], order: str, distance: int, forget_after: int | None):
        self.keys, self.order, self.distance, self.forget_after = keys, order, distance, forget_after
        bands = distance + 1 if 64 // (distance + 1) >= BAND_BITS else 1
        cuts = [64 * i // bands for i in range(bands + 1)]
        self.bands = [(low, (1 << high - low) - 1) for low, high in zip(cuts, cuts[1:])] if bands > 1 else [(0, 0)]

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "band int, value bigint",
                                        "hashes array<bigint>, scores array<double>, orders array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["gate_order"])
        lists: dict[tuple, list] = {}
        changed: set[tuple] = set()
        passed = []
        for bits, score, order in zip(batch["gate_bits"].tolist(), batch["gate_score"].tolist(), batch["gate_order"].tolist()):
            if bits is None or bits != bits:
                passed.append(True)
                continue
            bits = int(bits)
            places = [(band, self._signed((bits & (1 << 64) - 1) >> low & mask)) for band, (low, mask) in enumerate(self.bands)]
            near = any([self._blocked(self._list(lists, place), bits, score, order) for place in places])
            passed.append(not near)
            if not near:
                for place in places:
                    lists[place].append((bits, score, order))
                    changed.add(place)
        newest = int(batch["gate_order"].max())
        for place in changed:
            kept = [e for e in lists[place] if self.forget_after is None or newest - e[2] <= self.forget_after]
            self.known.updateValue(place, tuple(map(list, zip(*kept))))
        yield batch.loc[passed, [*self.keys, "gate_order"]].rename(columns={"gate_order": self.order})

    def close(self) -> None:
        pass

    @staticmethod
    def _signed(value: int) -> int:
        return value - (1 << 64) if value >> 63 else value

    def _list(self, lists: dict, place: tuple) -> Known:
        if place not in lists:
            lists[place] = Known(zip(*(self.known.getValue(place) or ())))
        return lists[place]

    def _blocked(self, known: Known, bits: int, score: float, order: int) -> bool:
        hashes, scores, orders = known.columns()
        close = np.bitwise_count((hashes ^ np.int64(bits)).view(np.uint64)) <= self.distance
        if self.forget_after is not None:
            close &= order - orders <= self.forget_after
        return bool((close & (scores >= score)).any())


class Known(list):
    """(fingerprint, score, order) entries; their columns are arrays that grow with them."""

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = getattr(self, "size", 0)
        if not hasattr(self, "held") or len(self) > len(self.held[0]):
            room = max(16, 2 * len(self))
            self.held, size = tuple(np.zeros(room, k) for k in (np.int64, np.float64, np.int64)), 0
        for i in range(size, len(self)):
            for column, value in zip(self.held, self[i]):
                column[i] = value
        self.size = len(self)
        return tuple(c[:self.size] for c in self.held)


def stream_gate(crops: DataFrame, keys: list[str], order: str, bits: str, score: str, distance: int = 2,
                forget_after: int | None = None) -> DataFrame:
    """Crops that pass the near-duplicate gate: those that no known fingerprint of their key with as good a score is near.

    A fingerprint that passed is known for good, as in the batch gate; ``forget_after`` names a distance in ``order`` after
    which it no longer blocks, for streams without an end; it leaves a band's list when that is written next.
    """
    rows = crops.select(F.concat_ws("\x1f", *keys).alias("gate_key"), *keys, F.col(order).alias("gate_order"),
                        F.col(bits).cast("bigint").cast("string").alias("gate_bits"),  # a NULL would make numbers doubles
                        F.col(score).cast("double").alias("gate_score"))
    kinds = {f.name: f.dataType.simpleString() for f in crops.schema.fields}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{order} {kinds[order]}"])
    return rows.groupBy("gate_key").transformWithStateInPandas(
        Gate(keys, order, distance, forget_after), out, "append", "none")


# ---- crop banks -----------------------------------------------------------------------------

def stream_banks(crops: DataFrame, keys: list[str], order: str, score: str, bank_size: int = 10,
                 reads: int = 5, end: str = "is_end") -> DataFrame:
    """Best crops per track, held until the row that marks the end of the video arrives.

    An end row must be sent for every key. The bank never holds more than ``bank_size`` rows.
    """
    rows = crops.select(F.concat_ws("\x1f", *keys).alias("_key"), *keys, F.col(order).alias("_o"),
                        F.col(score).cast("double").alias("_s"), F.col(end).alias("_end"))
    kinds = {f.name: f.dataType.simpleString() for f in crops.schema.fields}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{order} {kinds[order]}", "rank bigint"])
    shown = min(bank_size, reads)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bank = json.loads(state.get[0]) if state.exists else []
        ended, names = False, None
        for part in parts:
            names = part[keys].iloc[0].tolist() if names is None else names
            ended = ended or bool(part["_end"].any())
            live = part[~part["_end"].astype(bool)]
            bank.extend(zip(live["_s"].tolist(), live["_o"].tolist()))
            bank = sorted(bank, key=lambda c: (-c[0], c[1]))[:bank_size]
        if not ended:
            state.update((json.dumps(bank),))
            return
        state.remove()
        yield pd.DataFrame([(*names, o, i) for i, (_s, o) in enumerate(bank[:shown], start=1)],
                           columns=[*keys, order, "rank"])

    return rows.groupBy("_key").applyInPandasWithState(
        step, out, "bank string", "append", GroupStateTimeout.NoTimeout)


# ---- rail cache -----------------------------------------------------------------------------

def stream_rail(frames: DataFrame, video: str = "video_id", order: str = "frame_index",
                score: str = "rail_score", top: str = "rail_y", refresh: int = 50,
                min_score: float = 0.08) -> DataFrame:
    """Region of interest per frame from the last good measurement of its video."""
    rows = frames.select(F.col(video).cast("bigint").alias("video_id"), F.col(order).cast("bigint").alias("frame_index"),
                         F.col(score).cast("double").alias("s"), F.col(top).cast("double").alias("y"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good_y, good_s, at = state.get if state.exists else (None, None, -1)
        batch = _in_order(parts, ["frame_index"])
        found = []
        for frame, s, y in zip(batch["frame_index"].tolist(), batch["s"].tolist(), batch["y"].tolist()):
            source = "rail_roi"
            if good_y is None or frame - at >= refresh:
                at = frame
                if s >= min_score:
                    good_y, good_s = y, s
                else:
                    source = "full_frame" if good_y is None else "cached_low_score"
            value = {"full_frame": 0.0, "cached_low_score": s}.get(source, good_s)
            found.append((key[0], frame, good_y, value, source))
        state.update((good_y, good_s, at))
        yield pd.DataFrame(found, columns=["video_id", "frame_index", "roi_y", "roi_score", "roi_source"])

    return rows.groupBy("video_id").applyInPandasWithState(
        step, "video_id bigint, frame_index bigint, roi_y double, roi_score double, roi_source string",
        "y double, s double, at bigint", "append", GroupStateTimeout.NoTimeout)


# ---- live sessions ----------------------------------------------------------------------------

def live_sessions(events: DataFrame, keys: list[str], time: str, gap: str = "15 minutes",
                  delay: str = "10 minutes") -> DataFrame:
    """Closed runs of sightings per key, by watermark and session window."""
    return (events.withWatermark(time, delay)
            .groupBy(*keys, F.session_window(time, gap).alias("w"))
            .agg(F.count("*").alias("sightings"), F.min(time).alias("first"), F.max(time).alias("last"))
            .select(*keys, "sightings", "first", "last"))
