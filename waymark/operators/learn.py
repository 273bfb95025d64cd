"""Landmark positions learned from confirmed deliveries.

Each accepted confirmation moves its landmark, and whether the next one is
accepted depends on where the landmark then is. That recurrence is sequential
per landmark; it runs over sorted rows with a constant-size state, so a hot
landmark takes time but never memory: its history is applied slice by slice.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.skew import each, salted_join
from waymark.sources.warehouse import staged

# How far and how fast a confirmation may move a landmark.
MAX_NUDGE_M = 400.0
MIN_ALPHA = 0.02
TRUSTED_ACCURACY_M = 50.0
CONFIDENCE_STEP, CONFIDENCE_CAP = 0.05, 0.97

AUDIT = (
    "landmark_id {id}, event_id long, ts timestamp_ntz, before_observations int, after_observations int, moved_m double, "
    "distance_m double, rejected string, lat double, lng double, raw_lat double, raw_lng double, confidence double, alias_added string"
)
AUDIT_COLUMNS = [c.split()[0] for c in AUDIT.split(", ")]
EVENT = ["event_id", "ts", "lat", "lng", "accuracy_m", "spelling"]
#: Events of one landmark that a task applies at a time.
SLICE_ROWS = 100_000


def distance_m(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def ema_alpha(observations: int) -> float:
    return max(MIN_ALPHA, 1.0 / (observations + 1))


def nudge(state: dict, lat: float, lng: float, accuracy_m: float | None) -> dict:
    """The state after one accepted confirmation; raw_* is the point before rounding."""
    alpha = ema_alpha(state["observations"])
    if accuracy_m is not None and accuracy_m > TRUSTED_ACCURACY_M:
        alpha *= TRUSTED_ACCURACY_M / accuracy_m
    new_lat = state["lat"] + alpha * (lat - state["lat"])
    new_lng = state["lng"] + alpha * (lng - state["lng"])
    return {
        **state,
        "lat": round(new_lat, 6),
        "lng": round(new_lng, 6),
        "raw_lat": new_lat,
        "raw_lng": new_lng,
        "observations": state["observations"] + 1,
        "confidence": min(CONFIDENCE_CAP, state["confidence"] + CONFIDENCE_STEP),
    }


def step(state: dict | None, event: dict) -> tuple[dict | None, dict]:
    """(next state, audit row) of one confirmation."""
    audit = {"event_id": event["event_id"], "ts": event["ts"], "alias_added": None}
    if state is None:
        return None, {
            **audit, "before_observations": 0, "after_observations": 0, "moved_m": 0.0, "distance_m": None,
            "rejected": "landmark not in graph", "lat": None, "lng": None, "raw_lat": None, "raw_lng": None, "confidence": None,
        }
    away = distance_m(state["lat"], state["lng"], event["lat"], event["lng"])
    after, moved, rejected = state, 0.0, None
    if away > MAX_NUDGE_M:
        rejected = "too far"
    else:
        after = nudge(state, event["lat"], event["lng"], event["accuracy_m"])
        moved = distance_m(state["lat"], state["lng"], after["raw_lat"], after["raw_lng"])
        spelling = (event.get("spelling") or "").strip()
        if spelling and spelling.casefold() not in after["known"]:
            audit["alias_added"] = spelling
            after = {**after, "known": after["known"] | {spelling.casefold()}}
    return after, {
        **audit, "before_observations": state["observations"], "after_observations": after["observations"],
        "moved_m": moved, "distance_m": away, "rejected": rejected,
        **{c: after[c] for c in ("lat", "lng", "raw_lat", "raw_lng", "confidence")},
    }


def initial_state(row) -> dict | None:
    if row["start_lat"] is None or pd.isna(row["start_lat"]):
        return None
    lat, lng = float(row["start_lat"]), float(row["start_lng"])  # numpy's floats round differently
    return {
        "lat": lat, "lng": lng, "raw_lat": lat, "raw_lng": lng,
        "observations": int(row["start_observations"]), "confidence": float(row["start_confidence"]),
        "known": frozenset(str(a).casefold() for a in row["start_names"]),
    }


def walked(state: dict | None, rows: dict[str, list]) -> tuple[dict | None, list[dict]]:
    """(state after, audit rows) of one landmark's events (the columns ``EVENT``), in the order they are given."""
    out = []
    for values in zip(*(rows[c] for c in EVENT)):
        event = dict(zip(EVENT, values))
        accuracy = event["accuracy_m"]
        event["accuracy_m"] = None if accuracy is None or accuracy != accuracy else accuracy
        state, audit = step(state, event)
        out.append(audit)
    return state, out


def shaped(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows as a table whose cells stay what they are, ids whole numbers and absent values null."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


def start_rows(landmarks: DataFrame) -> DataFrame:
    """A landmark table as the state that learning begins with."""
    return landmarks.select(
        "landmark_id",
        F.col("lat").alias("start_lat"), F.col("lng").alias("start_lng"),
        F.col("observation_count").alias("start_observations"), F.col("confidence").alias("start_confidence"),
        F.concat(F.array("canonical_name"), "aliases").alias("start_names"),
    )


_STATE = "start_lat double, start_lng double, start_raw_lat double, start_raw_lng double, start_observations int, start_confidence double, start_names array<string>"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit rows of sorted events, landmark by landmark, and after each landmark's last event the state it leaves (no event_id)."""
    current, state, rows = None, None, 0
    for batch in batches:
        out, ids = [], batch["landmark_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if not rows or ids[lo] != current:
                if rows:
                    out.append(_left(current, state))
                current, state = ids[lo].item() if hasattr(ids[lo], "item") else ids[lo], carried_state(batch.iloc[lo])
            rows += 1
            part = batch.iloc[lo:hi]
            state, audit = walked(state, {c: part[c].tolist() for c in EVENT})
            out += [{"landmark_id": current, **a} for a in audit]
        if out:
            yield shaped(out, [*AUDIT_COLUMNS, *_STATE_COLUMNS])
    if rows:
        yield shaped([_left(current, state)], [*AUDIT_COLUMNS, *_STATE_COLUMNS])


def carried_state(row) -> dict | None:
    state = initial_state(row)
    if state and not pd.isna(row["start_raw_lat"]):
        state |= {"raw_lat": float(row["start_raw_lat"]), "raw_lng": float(row["start_raw_lng"])}
    return state


def _left(landmark, state: dict | None) -> dict:
    """The state a landmark's slice leaves, as a row without an event."""
    row = {"landmark_id": landmark}
    if state:
        row |= {
            "start_lat": state["lat"], "start_lng": state["lng"], "start_raw_lat": state["raw_lat"], "start_raw_lng": state["raw_lng"],
            "start_observations": state["observations"], "start_confidence": state["confidence"], "start_names": sorted(state["known"]),
        }
    return row


_STATE_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]


def learning_audit(deliveries: DataFrame, landmarks: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One audit row per confirmation, in event order per landmark.

    deliveries: landmark_id, event_id, ts, lat, lng, accuracy_m, spelling.
    landmarks: landmark_id, canonical_name, aliases, lat, lng,
    observation_count, confidence.

    Each landmark's events are cut into slices of at most ``slice_rows``, in order. Slice after
    slice is applied, for all landmarks at once; what one hands to the next is a row per
    landmark, written: its state. So no task ever holds or walks more than a slice of any
    landmark, and a lost executor costs one slice. Events of landmarks that nobody knows need no order
    and are answered apart.
    """
    id_type = dict(deliveries.dtypes)["landmark_id"]
    known = start_rows(landmarks).withColumns({"start_raw_lat": F.lit(None).cast("double"), "start_raw_lng": F.lit(None).cast("double")})
    known = known.where(F.col("start_lat").isNotNull())
    events = deliveries.select("landmark_id", *EVENT)
    matched = staged(salted_join(events, known.select("landmark_id"), ["landmark_id"], ["event_id"], "left_semi"), "known_events")
    unknown = salted_join(events, known.select("landmark_id"), ["landmark_id"], ["event_id"], "left_anti")
    strange = unknown.select(
        "landmark_id", "event_id", "ts", F.lit(0).alias("before_observations"), F.lit(0).alias("after_observations"), F.lit(0.0).alias("moved_m"),
        F.lit("landmark not in graph").alias("rejected"),
    )
    numbered = staged(sliced(matched, "landmark_id", "ts", "event_id", slice_rows), "sliced_events")
    state, parts = known.select("landmark_id", *_STATE_COLUMNS), []
    schema = f"{AUDIT.format(id=id_type)}, {_STATE}"
    slices = numbered.agg(F.max("slice")).first()[0]
    for i in range(0 if slices is None else slices + 1):
        now = numbered.where(F.col("slice") == i).drop("slice").join(state, "landmark_id")
        done = staged(now.repartition("landmark_id").sortWithinPartitions("landmark_id", "ts", "event_id").mapInPandas(_fold, schema), "audit_slice")
        parts.append(done.where(F.col("event_id").isNotNull()).select(AUDIT_COLUMNS))
        # only landmarks that go on need their state again
        state = done.where(F.col("event_id").isNull() & F.col("start_lat").isNotNull()).select("landmark_id", *_STATE_COLUMNS)
    out = strange
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select([F.col(c).cast(t) if t else F.col(c) for c, t in ((x.split()[0], x.split()[1]) for x in AUDIT.format(id=id_type).split(", "))])


def sliced(events: DataFrame, key: str, ts: str, tie: str, size: int) -> DataFrame:
    """Adds ``slice``: the number of the part, of at most ``size`` rows, that a row of a key belongs to, in the order of ts and tie.

    A key of more than ``size`` rows is counted per hour, minute or second first, so that it is
    only ordered within those; its slices are whole such ranges as long as they fit, and a
    range that is larger is cut by the order of its rows.
    """
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    ranged = events.withColumn("_range", F.coalesce(F.floor(seconds / 60), F.lit(-1)))
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per minute
    ahead = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(key, "_range").orderBy(ts, tie)) - 1
    return ranged.join(ahead, [key, "_range"]).withColumn("slice", F.floor(place / size).cast("int")).drop("_range", "_before")


def learned_landmarks(audit: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Landmarks as they stand after all confirmations."""
    applied = audit.where(F.col("rejected").isNull())
    last = applied.groupBy("landmark_id").agg(
        F.max_by(F.struct("lat", "lng", "raw_lat", "raw_lng", "confidence", "after_observations", "ts"), F.struct("ts", "event_id")).alias("_a"),
        F.array_sort(F.collect_set("alias_added")).alias("_new"),
    )
    moved = F.col("_a").isNotNull()
    return landmarks.join(last, "landmark_id", "left").select(
        "landmark_id", "canonical_name",
        F.concat("aliases", F.coalesce("_new", F.array().cast("array<string>"))).alias("aliases"),
        F.coalesce("_a.lat", "lat").alias("lat"),
        F.coalesce("_a.lng", "lng").alias("lng"),
        geo.grid_cell(F.coalesce("_a.raw_lat", "lat"), F.coalesce("_a.raw_lng", "lng")).alias("digipin_cell"),
        F.when(moved, F.col("_a.after_observations")).otherwise(F.col("observation_count")).alias("observation_count"),
        F.when(moved, F.col("_a.confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.col("_a.ts").alias("last_seen"),
    )


def learning_events(confirmations: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per landmark a confirmed order matched.

    confirmations: order_id, event_id, ts, location (may be null), accuracy_m.
    orders: order_id, landmarks (array of matched_id, name), geo (lat, lng).
    The rider's fix counts, else the point the order was resolved to.
    """
    joined = confirmations.join(orders, "order_id")
    point = F.coalesce(
        F.when(F.col("location.lat").isNotNull(), F.col("location")), F.struct("geo.lat", "geo.lng")
    )
    placed = joined.withColumn("_p", point).where(F.col("_p.lat").isNotNull())
    matched = F.filter("landmarks", lambda l: l["matched_id"].isNotNull())
    keep = ["order_id", "event_id", "ts", "_p", "accuracy_m"]
    return each(placed, keep, matched, "matched_id", "name").select(
        F.col("matched_id").alias("landmark_id"), "order_id", "event_id", "ts",
        F.col("_p.lat").alias("lat"), F.col("_p.lng").alias("lng"), "accuracy_m", F.col("name").alias("spelling"),
    )


def route_events(events: DataFrame) -> DataFrame:
    """Adds route: learn, skipped (nothing to learn from) or ignored."""
    usable = F.col("order_id").isNotNull() & F.col("location.lat").isNotNull()
    return events.withColumn(
        "route",
        F.when(F.coalesce(F.col("detail_type") != "DeliveryConfirmed", F.lit(True)), "ignored")
        .when(usable, "learn")
        .otherwise("skipped"),
    )
