"""The asynchronous consumers as Structured Streaming jobs."""

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from waymark.operators import decide, learn, policy
from waymark.sources.warehouse import staged

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POSITION = "lat double, lng double, raw_lat double, raw_lng double, observations int, confidence double"
FIELDS = ("lat", "lng", "raw_lat", "raw_lng", "observations", "confidence")
#: How long a stream waits for rows that come out of order.
LATE = "10 minutes"


class InOrder(StatefulProcessor):
    """Applies rows by key in the order of ``ts`` and ``tie``, whatever order they come in.

    Rows are grouped by a bucket of keys, so that few calls serve many keys. They wait in list state,
    a table of bytes per batch, until the watermark has passed them; then all that are due are
    applied at once, sorted. So a stream gives what a batch over the same rows gives, in as
    many micro-batches as there are. A row that comes after the watermark has passed its
    time is late: it is dropped before it gets here and counted in the query's progress.
    A subclass keeps its own state and gives its output in ``applied``.
    """

    def __init__(self, schema: StructType, key: str, ts: str = "ts", tie: str = "event_id"):
        self.schema, self.key, self.ts, self.tie = schema, key, ts, tie
        self.arrow = to_arrow_schema(schema, timestamp_utc=False)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for batch in rows:
            if len(batch):
                self.arrived(batch)
                self.waiting.appendValue((packed(table_of(batch, self.arrow)),))
                top = millis(batch[self.ts].max())
                latest = top if latest is None else max(latest, top)
        if latest is not None:
            self.handle.registerTimer(latest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = pa.concat_tables([self.arrow.empty_table(), *(unpacked(blob) for (blob,) in self.waiting.get())]).combine_chunks()
        due = times(held, self.ts) <= now * 1000
        if due.all():
            self.waiting.clear()
        else:
            self.waiting.put([(packed(held.filter(pa.array(~due))),)])
        yield from self.applied(held.filter(pa.array(due)), now)

    def arrived(self, batch: pd.DataFrame) -> None:
        """Called with rows when they come in."""

    def applied(self, rows: pa.Table, now: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def ordered(self, codes: np.ndarray, rows: pa.Table, *first) -> np.ndarray:
        """Places of the rows key by key, each key's in order."""
        by = {"code": codes, **dict(enumerate(first)), "ts": times(rows, self.ts), "none": rows.column(self.ts).is_null().to_numpy(), "tie": rows.column(self.tie).to_pandas()}
        return pd.DataFrame(by).sort_values(["code", *range(len(first)), "none", "ts", "tie"], kind="stable").index.to_numpy()

    def close(self) -> None:
        pass


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(blob))).read_all()


def table_of(rows: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    """Rows as pandas has them (absent whole numbers make floats) as a table of the given types."""
    return pa.table([pa.Array.from_pandas(rows[f.name], safe=False).cast(f.type, safe=False) if rows[f.name].dtype != object else pa.Array.from_pandas(rows[f.name], type=f.type) for f in schema], schema=schema)


def frame_of(rows: pa.Table) -> pd.DataFrame:
    return rows.to_pandas(integer_object_nulls=True)


def times(rows: pa.Table, column: str) -> np.ndarray:
    """A column of times in microseconds; an absent time is before all others."""
    return rows.column(column).cast(pa.timestamp("us")).cast(pa.int64()).fill_null(-(2**63) // 1000).to_numpy()


def coded(first: pa.ChunkedArray, second: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys of two columns, an absent one too, and the places of both columns' keys among them."""
    every = pa.chunked_array([*first.chunks, *second.chunks], second.type).combine_chunks().dictionary_encode("encode")
    codes = every.indices.to_numpy(zero_copy_only=False)
    return every.dictionary, codes[: len(first)], codes[len(first) :]


def millis(ts) -> int:
    """A time in milliseconds, rounded up: no row is due before the watermark has reached all of it."""
    return -(-(pd.Timestamp(ts).value // 1000) // 1000)


#: Into how many buckets the keys of a stream are cut. It belongs to a stream's checkpoint; a bucket's waiting rows are one task's.
BUCKETS = 1024


def in_order(stream: DataFrame, processor: InOrder, output: str, late: str, buckets: int = BUCKETS) -> DataFrame:
    """Output of ``processor`` over a stream's rows by its key, with ``late`` as the watermark on its time."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = f"_bucket_of_{processor.key}"
    dealt = stream.withWatermark(processor.ts, late).withColumn(bucket, F.pmod(F.xxhash64(processor.key), F.lit(buckets)))
    return dealt.groupBy(bucket).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="EventTime")


class LandmarkLearner(InOrder):
    """Keeps a bucket's landmarks as value state, with the names they started with, and the spellings added since as map state.

    Rows bring the state that their landmark begins with; a landmark enters the state with its first row.
    """

    def __init__(self, schema: StructType, key: str):
        super().__init__(schema, key)
        self.shape = to_arrow_schema(StructType([schema[key], *StructType.fromDDL(f"{POSITION}, names array<string>")]))

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        kind = self.schema[self.key].dataType
        self.places = handle.getValueState("places", "rows binary")
        self.added = handle.getMapState("added", f"landmark {kind.simpleString()}, spelling string", "added boolean")

    def known(self) -> pa.Table:
        return unpacked(self.places.get()[0]) if self.places.exists() else self.shape.empty_table()

    def arrived(self, batch):
        new = batch[batch["start_lat"].notna() & batch[self.key].notna()].drop_duplicates(self.key)
        if not len(new):
            return
        places = self.known()
        held = set(places.column(self.key).to_pylist())
        rows = []
        for landmark, row in zip(table_of(new, pa.schema([self.shape.field(0)])).column(0).to_pylist(), new.to_dict("records")):
            if landmark not in held:
                state = learn.initial_state(row)
                rows.append({self.key: landmark, **{c: state[c] for c in FIELDS}, "names": sorted(state["known"])})
        if rows:
            self.places.update((packed(pa.concat_tables([places, table_of(pd.DataFrame(rows, dtype=object), self.shape)])),))

    def applied(self, rows, now):
        places = self.known()
        keys, held, codes = coded(places.column(self.key), rows.column(self.key))
        held = dict(zip(held.tolist(), places.to_pylist()))
        order = self.ordered(codes, rows)
        rows, codes = rows.take(pa.array(order)), codes[order]
        events = {c: rows.column(c).to_pylist() for c in learn.EVENT}
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)] if len(codes) else [0]
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            landmark, state = keys[int(codes[lo])].as_py(), held.get(int(codes[lo]))
            if state is not None:
                state = {**{c: state[c] for c in FIELDS}, "known": Spellings(self.added, landmark, state["names"])}
            state, audit = learn.walked(state, {c: v[lo:hi] for c, v in events.items()})
            if state is not None:
                held[int(codes[lo])].update({c: state[c] for c in FIELDS})
            out += [{self.key: landmark, **a} for a in audit]
        if held and len(codes):
            self.places.update((packed(pa.Table.from_pylist(list(held.values()), self.shape)),))
        if out:
            yield learn.shaped(out, learn.AUDIT_COLUMNS)


class Spellings:
    """The spellings of a landmark: those it started with, and those in map state, looked up and added one by one and never read as a whole."""

    def __init__(self, added, landmark, names):
        self.added, self.landmark, self.seen = added, landmark, dict.fromkeys(names, True)

    def __contains__(self, name: str) -> bool:
        if name not in self.seen:
            self.seen[name] = self.added.containsKey((self.landmark, name))
        return self.seen[name]

    def __or__(self, names) -> "Spellings":
        for name in names:
            self.added.updateValue((self.landmark, name), (True,))
            self.seen[name] = True
        return self


def learn_landmarks(deliveries: DataFrame, landmarks: DataFrame, late: str = LATE) -> DataFrame:
    """Audit rows of a delivery stream (columns as in learn.learning_audit), each once the watermark has passed its time.

    Landmarks meet the stream by a join, so that only those that have deliveries become state.
    """
    known = learn.start_rows(landmarks).where("landmark_id is not null and start_lat is not null")
    begin = F.max(F.struct(*[c for c in known.columns if c not in ("landmark_id", "start_names")])).alias("s")
    known = known.groupBy("landmark_id").agg(begin, F.flatten(F.collect_list("start_names")).alias("start_names")).select("landmark_id", "s.*", "start_names")
    rows = deliveries.select("landmark_id", *learn.EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
    processor = LandmarkLearner(rows.schema, "landmark_id")
    output = learn.AUDIT.format(id=dict(deliveries.dtypes)["landmark_id"]).replace("timestamp_ntz", "timestamp")
    found = in_order(rows.join(staged(known, "start_landmarks"), "landmark_id", "left"), processor, output, late)
    return found.withColumn("ts", F.col("ts").cast(dict(deliveries.dtypes)["ts"]))


METRICS = (
    "resolution_rate", "clarification_rate", "ambiguous_rate", "escalation_rate", "cache_hit_rate", "model_call_rate",
    "geo_from_graph_rate", "geo_from_centroid_rate", "cost_per_address",
)


def metric_windows(metrics: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Dashboard rates, cost and latency per window, stack and provider."""
    return (
        metrics.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "stack", "provider")
        .agg(
            F.count("*").alias("requests"),
            *[F.avg(c).alias(c) for c in METRICS],
            F.percentile_approx("latency_ms", F.lit(0.5), F.lit(10000)).alias("latency_p50_ms"),
            F.percentile_approx("latency_ms", F.lit(0.95), F.lit(10000)).alias("latency_p95_ms"),
        )
        .select(F.col("w.start").alias("window_start"), "stack", "provider", "requests", *METRICS, "latency_p50_ms", "latency_p95_ms")
    )


class EntryKeeper(InOrder):
    """Lets a key's row through when no entry is alive; that row is the next entry. A row that finds one does not prolong it.

    Entries that the watermark has outlived are forgotten: every row still to come is after their end.
    """

    def __init__(self, schema, key, ts, tie, life_ms: int):
        super().__init__(schema, key, ts, tie)
        self.life_us = life_ms * 1000

    def init(self, handle):
        super().init(handle)
        self.stored = handle.getValueState("stored", "entries binary")

    def applied(self, rows, now):
        kinds = pa.schema([self.arrow.field(self.key), pa.field("_at", pa.int64())])
        stored = unpacked(self.stored.get()[0]) if self.stored.exists() else kinds.empty_table()
        keys, held, codes = coded(stored.column(0), rows.column(self.key))
        last = dict(zip(held.tolist(), stored.column(1).to_pylist()))
        order, keep = self.ordered(codes, rows), []
        for code, at in zip(codes[order].tolist(), times(rows, self.ts)[order].tolist()):
            before = last.get(code)
            keep.append(before is None or at > before + self.life_us)
            if keep[-1]:
                last[code] = at
        alive = {code: at for code, at in last.items() if at + self.life_us > now * 1000}
        if alive:
            columns = [keys.take(pa.array(list(alive))), pa.array(list(alive.values()), pa.int64())]
            self.stored.update((packed(pa.table(columns, schema=kinds)),))
        else:
            self.stored.clear()
        if any(keep):
            yield frame_of(rows.take(pa.array(order[keep])))


def dedupe_resolutions(resolutions: DataFrame, ttl: str = "90 days", tie: str = "event_id", late: str = LATE) -> DataFrame:
    """The resolutions that store an entry of their ``cache_key``: as ``history.first_in_ttl``, counted from the stored entry."""
    rows = resolutions.select("cache_key", *[c for c in resolutions.columns if c != "cache_key"])
    return in_order(rows, EntryKeeper(rows.schema, "cache_key", "ts", tie, milliseconds(ttl)), rows.schema, late)


def milliseconds(interval: str) -> int:
    """Of an interval such as '6 hours'."""
    return round(pd.Timedelta(interval).total_seconds() * 1000)


class ReplyWaiter(InOrder):
    """Gives each question that no reply answers in time, when that time is over.

    A bucket has a timer at the least due time of its open questions. A reply cancels the questions that it is
    in time for; it need not be kept, for rows are applied in order and so meet every question before them.
    """

    def __init__(self, schema, key, ts, tie, wait_ms: int):
        super().__init__(schema, key, ts, tie)
        self.wait_us = wait_ms * 1000

    def init(self, handle):
        super().init(handle)
        self.open = handle.getValueState("open", "rows binary")

    def applied(self, rows, now):
        asked = unpacked(self.open.get()[0]) if self.open.exists() else self.arrow.empty_table()
        _, held, codes = coded(asked.column(self.key), rows.column(self.key))
        rows, codes = pa.concat_tables([asked, rows]).combine_chunks(), np.concatenate([held, codes])
        order = self.ordered(codes, rows, np.arange(len(codes)) >= len(held))
        rows, codes = rows.take(pa.array(order)), codes[order]
        reply, question = (rows.column(c).fill_null(False).to_numpy() for c in ("reply", "question"))
        at, n = times(rows, self.ts), len(codes)
        due = at + self.wait_us
        # the first reply after each row, if it is the same key's
        place = np.append(np.minimum.accumulate(np.where(reply, np.arange(n), n)[::-1])[::-1][1:], n)[:n]
        met = np.minimum(place, max(n - 1, 0))
        answered = (place < n) & (codes[met] == codes) & (at[met] < due)
        unmet = question & ~reply & ~answered
        rest = unmet & (due > now * 1000)
        if rest.any():
            self.handle.registerTimer(int(-(-due[rest].min() // 1000)))
            self.open.update((packed(rows.filter(pa.array(rest))),))
        else:
            self.open.clear()
        if (unmet & ~rest).any():
            yield frame_of(rows.filter(pa.array(unmet & ~rest)))


def unanswered(events: DataFrame, wait: str = "6 hours", tie: str = "event_id", late: str = LATE) -> DataFrame:
    """Questions of a stream without a reply of the same order within ``wait``, with ``due``, as ``history.unanswered``.

    events: order_id, ``tie``, ts, question and reply (booleans); other columns come along.
    """
    rows = events.select("order_id", *[c for c in events.columns if c != "order_id"])
    found = in_order(rows, ReplyWaiter(rows.schema, "order_id", "ts", tie, milliseconds(wait)), rows.schema, late)
    return found.drop("question", "reply").withColumn("due", F.col("ts") + F.expr(f"interval {wait}"))


def needs_info(resolutions: DataFrame, order_cases: DataFrame) -> DataFrame:
    """Questions that may be sent, and denials, of a resolution stream.

    order_cases: order_id, messages_sent, opted_out (a table).
    """
    asked = resolutions.where(F.col("status") == "NEEDS_INFO").join(order_cases, "order_id", "left")
    cases = asked.withColumns(
        {
            "principal": F.lit("clarifier"),
            "channel": F.lit("sms"),
            "pending": F.lit(True),
            "messages_sent": F.coalesce("messages_sent", F.lit(0)),
            "opted_out": F.coalesce("opted_out", F.lit(False)),
            "local_hour": policy.local_hour(F.col("ts")),
        }
    )
    question = decide.choose_question(F.col("asked_field"), F.col("devanagari"))
    return policy.contact_decisions(cases).select(
        "order_id", "ts", "allowed", "reason", F.when(F.col("allowed"), question["question"]).alias("question"),
    )


def upsert_sink(stream: DataFrame, target_dir: str, key: str, order: list[str], checkpoint: str, buckets: int = 16):
    """Land a stream as key merges; see ``merge_batch``."""
    merge = lambda batch, batch_id: merge_batch(batch, batch_id, target_dir, key, order, buckets)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(batch: DataFrame, batch_id: int, target_dir: str, key: str, order: list[str], buckets: int = 16) -> None:
    """Merge one micro-batch into a table of key buckets, of which it writes those only that it touches.

    A key keeps its newest row by ``order``, whichever batch it came in, so a late row never
    replaces a newer state. New bucket files stand beside the old ones until a manifest that
    names the current file of every bucket is moved into place, in one step; readers see the
    table before or after a batch, never between. A batch whose manifest is there has been
    merged: run again after a failure it changes nothing. The number of buckets is that of
    the first manifest.
    """
    spark = batch.sparkSession
    last = manifest(spark, target_dir)
    if last and last["batch"] >= batch_id:
        return
    count = last["buckets"] if last else buckets
    place = F.pmod(F.xxhash64(key), F.lit(count)).alias("_bucket")
    rows = batch.select(place, F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("_row"))
    touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
    held = last["files"] if last else {}
    old = [held[str(b)] for b in touched if str(b) in held]
    if old:
        before = spark.read.schema(batch.schema).parquet(*old)
        rows = rows.unionByName(before.select(place, F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("_row")))
    newest = F.max_by("_row", F.struct(*(F.col(f"_row.`{c}`") for c in order)))
    merged = rows.groupBy("_bucket", F.col(f"_row.`{key}`").alias("_key")).agg(newest.alias("_row")).select("_bucket", "_row.*")
    folder = f"{target_dir}/data/batch={batch_id:010d}-{uuid.uuid4().hex}"
    if touched:
        merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(folder)
    now = {"batch": batch_id, "buckets": count, "files": held | {str(b): f"{folder}/_bucket={b}" for b in touched}}
    _put(spark, f"{target_dir}/manifest/{batch_id:010d}.json", json.dumps(now))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a name of its own and move it into place."""
    fs, at = _files(spark, path)
    _, own = _files(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(own, at):
        raise OSError(f"{path} could not be moved into place")


def manifests(spark: SparkSession, target_dir: str) -> list[str]:
    """Paths of a table's manifests, oldest first."""
    fs, at = _files(spark, f"{target_dir}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return [f"{target_dir}/manifest/{n}" for n in sorted(names) if n.endswith(".json") and not n.startswith(".")]


def manifest(spark: SparkSession, target_dir: str) -> dict | None:
    """The newest manifest of a table, or None."""
    found = manifests(spark, target_dir)
    return json.loads(spark.read.text(found[-1], wholetext=True).first()[0]) if found else None


def latest_snapshot(spark: SparkSession, target_dir: str) -> DataFrame | None:
    """The table as of its newest manifest, or None."""
    last = manifest(spark, target_dir)
    return spark.read.parquet(*last["files"].values()) if last and last["files"] else None


def vacuum(spark: SparkSession, target_dir: str, keep: int = 2) -> list[str]:
    """Delete manifests before the newest ``keep`` and the bucket files that only they name; returns the files' paths."""
    found = manifests(spark, target_dir)
    if len(found) <= keep:
        return []
    read = lambda path: set(json.loads(spark.read.text(path, wholetext=True).first()[0])["files"].values())
    current = set().union(*map(read, found[-keep:]))
    old = sorted(set().union(*map(read, found[:-keep])) - current)
    for path in [*found[:-keep], *old]:  # manifests first: no reader is left with a file that goes
        fs, at = _files(spark, path)
        fs.delete(at, True)
    return old
