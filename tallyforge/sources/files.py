"""What files hold, in one pass over their lines: digest, header, number of lines, and whether quoted cells go over lines.

A file is read by blocks of BLOCK bytes, a row is a line; no row, task or buffer holds a file. A block's digest is that of its lines
in order, a file's is that of its length and its blocks' digests. Blocks are cut alike in every run, so that equal files have
equal digests wherever and with whatever they lie. A single line must be under 2 GB.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.staging import shared_dir

BLOCK = 64 << 20
_FOUND = "file string, start long, digest binary, lines long, odd long, first binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, whose lines come in order; odd: lines with an odd number of quotes."""
    at: tuple | None = None
    lines = odd = 0
    sha, first = hashlib.sha256(), b""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "digest": sha.digest(), "lines": lines, "odd": odd, "first": first}])

    for b in batches:
        for file, start, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, start) != at:
                if at is not None:
                    yield row()
                at, lines, odd, sha, first = (file, start), 0, 0, hashlib.sha256(), line
            lines += 1
            odd += line.count(b'"') % 2
            sha.update(line)
            sha.update(b"\n")
    if at is not None:
        yield row()


def inventory(spark: SparkSession, paths: str | list[str], block: int = BLOCK) -> DataFrame:
    """(file, size, digest, lines, quoted_breaks, header, copies) of every file in or below paths; hidden and empty ones are left out."""
    own = spark.newSession()  # its block size holds for this scan alone; small files share tasks
    for k, v in {"maxPartitionBytes": block, "openCostInBytes": block >> 10, "minPartitionNum": 1}.items():
        own.conf.set(f"spark.sql.files.{k}", str(v))
    uri = lambda c: F.regexp_replace(c, "^file:/+", "file:///")
    shown = lambda c: ~c.rlike(r"/\.[^/]*$")
    text = own.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths)
    place = F.col("_metadata")
    lines = text.select(uri(place["file_path"]).alias("file"), place["file_block_start"].alias("start"), F.col("value").cast("binary").alias("line"))
    found = lines.where(shown(F.col("file"))).mapInArrow(_blocks, _FOUND)
    whole = found.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("start", F.hex("digest").alias("digest")))).alias("blocks"),
        F.sum("lines").alias("lines"),
        (F.sum("odd") > 0).alias("quoted_breaks"),
        F.min_by("first", "start").cast("string").alias("header"),
    )
    sizes = own.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(uri(F.col("path")).alias("file"), F.col("length").alias("size"))
    joined = sizes.where(shown(F.col("file"))).join(whole, "file", "left")
    digest = F.sha2(F.concat_ws(":", F.col("size").cast("string"), F.concat_ws("", F.transform("blocks", lambda x: x["digest"]))), 256)
    header = F.regexp_replace("header", "^\ufeff|\r$", "")
    out = joined.select("file", "size", digest.alias("digest"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quoted_breaks", F.lit(False)).alias("quoted_breaks"), header.alias("header"))
    path = f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path).withColumn("copies", F.count("*").over(W.partitionBy("digest")))
