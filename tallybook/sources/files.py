"""File sources: machine traces, flows, vehicle emissions and packet captures, as event tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.keys import key_from_flow, key_from_metric, key_from_vehicle
from tallybook.functions.windows import year_ts
from tallybook.operators.batching import interleaved
from tallybook.sources.schemas import PACKET
from tallybook.sources.shared import ranged

VALUE_SCALE = 1_000_000


def listed_files(spark: SparkSession, folder: str, kind: str | None = None, glob: str = "*", max_files: int | None = None, by_size: bool = False) -> DataFrame:
    """(path, length, nth, problem) of a folder's matching files: nth by name (or by size, largest first) among those without a problem.

    kind "tsv" or "google": what files of machines are called. Problems: another suffix, no machine or metric in the
    name, or beyond max_files.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    problem = F.lit(None).cast("string")
    if kind in ("tsv", "google"):
        machine = name.rlike(r"machine_(id_)?\d") | F.lower("path").rlike(r"/machine_(id_)?\d+/[^/]*$")
        metric = F.lower("path").rlike("(cpu|mem)[^/]*(/[^/]*)?$")
        problem = F.when(~name.rlike(r"\.(tsv|txt|csv)$"), "another suffix").when(~name.endswith(".csv") & ~machine, "no machine in the name").when(~name.endswith(".csv") & ~metric, "no metric in the name")
    named = listed.withColumn("problem", problem)
    fine = ranged(named.where("problem is null"), [], [F.desc("length"), F.col("path")] if by_size else [F.col("path")])
    late = F.when(F.col("nth") >= max_files, f"beyond the first {max_files} files") if max_files is not None else F.lit(None).cast("string")
    return fine.withColumn("problem", late).unionByName(named.where("problem is not null"), allowMissingColumns=True).select("path", "length", F.col("nth").cast("long").alias("nth"), "problem")


def chosen_files(spark: SparkSession, folder: str, glob: str = "*", max_files: int | None = None, by_size: bool = False, kind: str | None = None) -> list[str]:
    """Paths of a folder's matching files, by name (or by size, largest first), the first max_files of them: a list that the reader needs on the driver."""
    return [r["path"] for r in listed_files(spark, folder, kind, glob, max_files, by_size).where("problem is null").orderBy("nth").select("path").collect()]


def file_report(spark: SparkSession, kind: str, folder: str, glob: str = "*", max_files: int | None = None, **options) -> DataFrame:
    """(path, length, events, problem) of all files that a read of this kind looks at: files left out, and files without a good line, with the reason."""
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = listed_files(spark, folder, kind, glob, max_files).withColumn("at", same(F.col("path")))
    events = read_events(spark, kind, folder, glob=glob, max_files=max_files, **options).groupBy(same(F.col("file")).alias("at")).agg(F.count("*").alias("events"))
    joined = listed.join(events, "at", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return joined.select("path", "length", "events", F.coalesce("problem", F.when(F.col("events") == 0, "no good line")).alias("problem"))


def _file(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("pos", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))


def _text(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Lines with their file and place in it."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return _file((reader.option("pathGlobFilter", glob) if glob else reader).text(paths))


def _number(s: Column, kind: str = "bigint") -> Column:
    return F.trim(s).try_cast(kind)


def machine_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(start_time, value, key, file): tab-separated lines; metric and machine come from the file's name, or else its folder's; bad lines and other files are dropped."""
    parts = F.split("value", "\t")
    rows = _text(spark, paths).select("file", "pos", _number(F.try_element_at(parts, F.lit(1))).alias("start_time"), _number(F.try_element_at(parts, F.lit(2))).alias("v"))
    names = [F.coalesce(F.try_element_at(F.split(F.lower("file"), "/"), F.lit(at)), F.lit("")) for at in (-1, -2)]
    metric = F.coalesce(*(F.when(name.contains("cpu"), 1).when(name.contains("mem"), 2) for name in names))
    machine = F.coalesce(*(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")) for name in names for pattern in (r"machine_id_(\d+)", r"machine_(\d+)"))).try_cast("bigint")
    rows = rows.withColumn("metric", metric).withColumn("machine", machine).where("start_time >= 0 and v >= 0 and metric is not null and machine is not null")
    return rows.select("start_time", F.col("v").alias("value"), key_from_metric(F.col("metric"), F.col("machine")).alias("key"), "file", "pos")


def machine_csv(spark: SparkSession, paths: str | list[str], scale: float = VALUE_SCALE) -> DataFrame:
    """(start_time, value, key, file): quoted value, machine and end time; the metric is in the header, the machine in a file's first good row."""
    lines = _text(spark, paths).withColumn("cells", F.transform(F.split("value", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    head = F.lower(F.get("cells", F.lit(0)))
    heads = lines.where(head.rlike("cpu|mem")).groupBy("file").agg(F.max(F.when(head.contains("cpu"), 1).otherwise(2)).alias("metric"))
    rows = lines.where(F.size("cells") >= 3).select("file", "pos", _number(F.get("cells", F.lit(0)), "double").alias("v"), _number(F.get("cells", F.lit(1))).alias("machine"), _number(F.get("cells", F.lit(2))).alias("start_time"))
    rows = rows.where("v >= 0 and not isnan(v) and v < double('infinity') and machine is not null and start_time is not null")
    first = rows.groupBy("file").agg(F.min_by("machine", "pos").alias("own"))
    return rows.join(heads, "file").join(first, "file").select("start_time", F.round(F.col("v") * scale).cast("long").alias("value"), key_from_metric(F.col("metric"), F.col("own")).alias("key"), "file", "pos")


def flow_text(spark: SparkSession, paths: str | list[str], on_error: str = "fail") -> DataFrame:
    """(src_ip, dst_ip, value, key, file, pos, order_key): three numbers a line, files taken in turn. Other lines fail the job, or with on_error="quarantine" carry a problem."""
    lines = _text(spark, paths).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    cells = [_number(F.try_element_at(parts, F.lit(i))) for i in (1, 2, 3)]
    fine = (F.size(parts) == 3) & cells[0].isNotNull() & cells[1].isNotNull() & cells[2].isNotNull()
    problem = F.when(~fine, F.concat(F.lit("not three numbers: "), "value"))
    rows = lines.select("file", "pos", *(c.alias(n) for c, n in zip(cells, ("src_ip", "dst_ip", "v"), strict=True)), problem.alias("problem"))
    if on_error == "fail":
        rows = rows.withColumn("v", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("long")).otherwise(F.col("v"))).drop("problem")
    rows = interleaved(rows.withColumn("block", F.col("pos.block")), "block").drop("block")
    return rows.withColumn("value", F.col("v")).withColumn("key", key_from_flow(F.col("src_ip"), F.col("dst_ip"))).drop("v")


def vehicle_csv(spark: SparkSession, paths: str | list[str], scale: float = 1.0) -> DataFrame:
    """(ts, value, key): model-year emissions; rows of fewer than 13 columns or with bad numbers are dropped; ordered by time."""
    lines = _text(spark, paths).withColumn("cells", F.transform(F.split("value", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))))
    c = [F.get("cells", F.lit(i)) for i in range(13)]
    rows = lines.where(F.size("cells") >= 13).select(
        "file", "pos", _number(c[0], "int").alias("year"), *(c[i].alias(n) for i, n in ((1, "make"), (2, "model"), (3, "vehicle"), (6, "transmission"), (7, "fuel"))),
        _number(c[4], "double").alias("engine"), _number(c[5]).alias("cylinders"), _number(c[12], "double").alias("co2"),
    ).where("year between 1970 and 2100 and engine is not null and cylinders between 0 and 255 and co2 >= 0 and not isnan(co2)")
    key = key_from_vehicle(*(F.col(n) for n in ("make", "model", "vehicle", "engine", "cylinders", "transmission", "fuel")))
    return rows.select(year_ts(F.col("year")).alias("ts"), F.round(F.col("co2") * scale).cast("long").alias("value"), key.alias("key"), "file", "pos").orderBy("ts", "file", "pos")


def ipv4_pair(link: int, frame: bytes) -> tuple[int, int] | None:
    """Source and destination of a frame's IPv4 packet; None if it has none."""
    at = {1: 14, 101: 0, 12: 0, 113: 16, 0: 4, 108: 4}.get(link)  # Ethernet, raw, raw, cooked, loopback
    if at is None:
        return None
    if link == 1:
        kind = int.from_bytes(frame[12:14], "big")
        while kind in (0x8100, 0x88A8):
            kind, at = int.from_bytes(frame[at + 2: at + 4], "big"), at + 4
        if kind != 0x0800:
            return None
    elif link == 113 and frame[14:16] != b"\x08\x00":
        return None
    if len(frame) < at + 20 or frame[at] >> 4 != 4:
        return None
    return int.from_bytes(frame[at + 12: at + 16], "big"), int.from_bytes(frame[at + 16: at + 20], "big")


def capture_magic(head: bytes) -> tuple[str, int]:
    """(byte order, parts of a second) by a capture's first bytes."""
    # fixed values: microseconds and nanoseconds, in both byte orders
    known = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
    if head[:4] not in known or len(head) < 24:
        raise ValueError("not a capture file")
    return known[head[:4]]


def packets(content: bytes, captured_length: bool = False) -> Iterator[tuple[int, int, int]]:
    """(source, destination, length) of the IPv4 packets of a capture (classic format, plain or gzip)."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    order, _ = capture_magic(content[:24])
    link, at = struct.unpack(order + "I", content[20:24])[0] & 0xFFFF, 24
    while at < len(content):
        if at + 16 > len(content):
            raise ValueError("truncated packet header")
        _, _, kept, whole = struct.unpack(order + "IIII", content[at: at + 16])
        pair = ipv4_pair(link, content[at + 16: at + 16 + kept])
        at += 16 + kept
        if pair:
            yield *pair, kept if captured_length else whole


def captures(spark: SparkSession, folder: str, captured_length: bool = False) -> DataFrame:
    """(src_ip, dst_ip, length, file, problem) of captures: a task per file; a bad file is one row with its problem."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                problem, rows = None, []
                try:
                    for p in packets(content, captured_length):
                        rows.append((*p, path, None))
                        if len(rows) == 100_000:
                            yield pd.DataFrame(rows, columns=["src_ip", "dst_ip", "length", "file", "problem"])
                            rows = []
                except (ValueError, EOFError, OSError) as e:
                    problem = str(e)
                if problem:
                    rows.append((None, None, None, path, problem))
                yield pd.DataFrame(rows, columns=["src_ip", "dst_ip", "length", "file", "problem"]).astype({"src_ip": "Int64", "dst_ip": "Int64", "length": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcap.gz}").load(folder).select("path", "content")
    return files.mapInPandas(decode, PACKET)


def capture_report(decoded: DataFrame) -> DataFrame:
    """Per capture: packets, and the problem if it broke off."""
    return decoded.groupBy("file").agg(F.count("src_ip").alias("packets"), F.max("problem").alias("problem"))


def read_events(spark: SparkSession, kind: str, paths: str | list[str], max_events: int | None = None, glob: str | None = None, max_files: int | None = None, **options) -> DataFrame:
    """(ts, key, value, file) by kind: tsv, google (csv), caida (flows), car_emission; or synthetic, from a table with these columns.

    glob, max_files: files of a folder by name, the first max_files of them; none left is an error, as files that can't
    be read are. Files without a good line give no events and are named by file_report.
    """
    if kind not in ("tsv", "google", "caida", "car_emission", "synthetic"):
        raise ValueError(f"unknown kind of source {kind!r}")
    if glob is not None or max_files is not None:
        if not isinstance(paths, str):
            raise ValueError("glob and max_files choose among the files of one folder")
        paths = chosen_files(spark, paths, glob or "*", max_files, kind=kind)
        if not paths:
            raise ValueError(f"no files of kind {kind!r} are left")
    if kind == "tsv":
        df = machine_tsv(spark, paths).withColumnRenamed("start_time", "ts").orderBy("ts", "key", "file", "value")
    elif kind == "google":
        df = machine_csv(spark, paths, **options).withColumnRenamed("start_time", "ts").orderBy("ts", "key", "file", "value")
    elif kind == "caida":
        base = options.pop("base_ts", 0)
        df = flow_text(spark, paths, **options).withColumn("ts", F.lit(base) + F.col("order_key")).orderBy("order_key")
    elif kind == "car_emission":
        df = vehicle_csv(spark, paths, **options)
    else:
        df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.select("ts", "key", "value", *(["file"] if "file" in df.columns else []))
    return df if max_events is None else df.limit(max_events)
