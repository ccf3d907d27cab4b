"""Validation of arriving files: the same column logic for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heatgrid.operators.cells import file_type

VERSION = "1"


def file_arrivals(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """(path, content) of files, without sidecars."""
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return reader.format("binaryFile").schema(schema).load(path).where(~F.col("path").endswith(".meta.json")).select("path", "content")


def _object(text: Column) -> tuple[Column, Column]:
    value = F.try_parse_json(text)
    return value, F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def geojson_errors(text: Column) -> Column:
    value, is_object = _object(text)
    kind = F.try_variant_get(value, "$.type", "string")
    missing = lambda key: F.try_variant_get(value, f"$.{key}", "variant").isNull()
    errors = F.array(F.when(kind.isNull(), "missing type"), F.when((kind == "FeatureCollection") & missing("features"), "FeatureCollection without features"), F.when((kind == "Feature") & missing("geometry"), "Feature without geometry"))
    return F.when(is_object, F.filter(errors, lambda e: e.isNotNull()))


def tiff_errors(content: Column) -> Column:
    magic = F.hex(F.substring(content, 1, 4))
    good = magic.isin("49492A00", "4D4D002A")
    return F.when(F.length(content) >= 4, F.when(good, F.array().cast("array<string>")).otherwise(F.array(F.lit("no TIFF signature"))))


def manifest_errors(text: Column) -> Column:
    """Required fields of a JSON manifest."""
    value, is_object = _object(text)
    errors = F.array(*[F.when(F.try_variant_get(value, f"$.{k}", "string").isNull(), f"missing {k}") for k in ("city.name", "city.id", "crs.working")])
    return F.when(is_object, F.filter(errors, lambda e: e.isNotNull()))


def validate(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, file_type, status, errors): ready, invalid, poisoned (unreadable) or skipped (unknown type); with the columns ``keep``."""
    text = F.decode("content", "UTF-8")
    kind = file_type(F.col("path"))
    errors = F.when(kind == "geojson", geojson_errors(text)).when(kind == "geotiff", tiff_errors(F.col("content"))).when(kind == "manifest", manifest_errors(text)).otherwise(F.array().cast("array<string>"))
    out = files.select("path", kind.alias("file_type"), errors.alias("errors"), *keep)
    status = F.when(F.col("file_type") == "unknown", "skipped").when(F.col("errors").isNull(), "poisoned").when(F.size("errors") > 0, "invalid").otherwise("ready")
    return out.select("path", "file_type", status.alias("status"), F.coalesce("errors", F.array(F.lit("unreadable"))).alias("errors"), *keep)


def sidecars(checked: DataFrame) -> DataFrame:
    return checked.select(F.col("path").alias("source_file"), "file_type", "status", "errors", F.current_timestamp().alias("processed_at"), F.lit(VERSION).alias("validator_version"))


def route(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """One stream, three tables under ``out``: ready, invalid and quarantine (poisoned). A batch is one file set, so a retry overwrites it."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for table, status in (("ready", "ready"), ("invalid", "invalid"), ("quarantine", "poisoned")):
            batch.where(F.col("status") == status).write.mode("overwrite").parquet(f"{out}/{table}/batch={number}")
        batch.unpersist()

    return sidecars(validate(files)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "attempts int, version string, deadline bigint, file_type string, errors array<string>, done boolean"
_DECIDED = "path string, file_type string, status string, errors array<string>, attempts int, decided_ms bigint"
#: a decided file's version is remembered so long, so that it counts once if it arrives again
REMEMBER_MS = 86_400_000


def with_retries(receives: DataFrame, max_receives: int = 3, visibility_s: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """Decisions (path, file_type, status, errors, attempts, decided_at) over a stream of (path, content, received_at).

    A file that can be read is decided at once. A poisoned one is out of sight for ``visibility_s`` and then received again,
    unless another version of it came first; at ``max_receives`` it is dead and goes to quarantine. The same version arriving
    again counts once. State is keyed by path and timers follow the watermark of ``received_at`` (late by ``delay``), so a
    restart goes on where it stopped and results don't depend on how arrivals fall into batches.
    """
    wait = int(visibility_s * 1000)

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, version, deadline, kind, errors, done = state.get if state.exists else (0, "", 0, "", [], True)
        out = []

        def settle(status: str, at: int) -> None:
            nonlocal done, deadline
            out.append((key[0], kind, status, list(errors), attempts, at))
            done, deadline = True, at + REMEMBER_MS

        def again(now: int) -> None:
            """The receives that fall due up to ``now``, of the version that is still poisoned."""
            nonlocal attempts, deadline
            while not done and deadline <= now:
                attempts += 1
                if attempts >= max_receives:
                    settle("quarantine", deadline)
                else:
                    deadline += wait

        columns = ("received_ms", "version", "status", "file_type", "errors")  # itertuples would make a class for each file
        rows = [] if state.hasTimedOut else sorted((r for f in frames for r in zip(*[f[c].tolist() for c in columns], strict=True)), key=lambda r: r[:2])
        for at, new, status, kind_of, found in rows:
            again(at)
            if new == version:
                continue
            attempts = 1 if done else attempts + 1
            version, kind, errors, done = new, kind_of, list(found), False
            if status != "poisoned":
                settle(status, at)
            elif attempts >= max_receives:
                settle("quarantine", at)
            else:
                deadline = at + wait
        mark = state.getCurrentWatermarkMs()
        again(mark)
        if done and deadline <= mark:
            if state.exists:
                state.remove()
        else:
            state.update((attempts, version, deadline, kind, errors, done))
            state.setTimeoutTimestamp(deadline)
        if out:
            yield pd.DataFrame(out, columns=["path", "file_type", "status", "errors", "attempts", "decided_ms"])

    seen = receives.withWatermark("received_at", delay).withColumns({"version": F.md5("content"), "received_ms": F.unix_millis("received_at")})
    checked = validate(seen, ("received_at", "version", "received_ms")).where("status <> 'skipped'")
    decided = checked.groupBy("path").applyInPandasWithState(decide, _DECIDED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.withColumn("decided_at", F.timestamp_millis("decided_ms")).drop("decided_ms")


def route_decided(decided: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Decisions of a stream to three tables under ``out``: ready, invalid and quarantine; a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for table in ("ready", "invalid", "quarantine"):
            batch.where(F.col("status") == table).write.mode("overwrite").parquet(f"{out}/{table}/batch={number}")
        batch.unpersist()

    return decided.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
