"""Folders of exported CSV files to canonical Parquet tables, with a manifest of what went where.

One pass over all lines gives each file's digest and header (see files); files with the same header and table are read by one
scan with that header, so that the number of scans grows with the number of export formats, not of files. Copies of
a file are left out, files that fit no table become ``needs_data`` rows. Rows that don't fit go to tables of their own, with the reason: records with a wrong number of
cells to <table>_broken, order lines without an id, a whole quantity or an amount to <table>_invalid. Equal rows of tables without a grain all stay.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import parse_day, parse_timestamp, to_finite
from tallyforge.sources import harmonise as H
from tallyforge.sources.contracts import CONTRACTS, Contract
from tallyforge.sources.files import inventory
from tallyforge.sources.staging import stored

_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
PLACE, BROKEN = ("_file", "_row"), "_broken"


def headers(files: DataFrame) -> DataFrame:
    """(file, place, column) of the first line of every CSV file of an inventory."""
    cell = lambda x: F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))
    names = F.transform(F.regexp_extract_all("header", F.lit(_CELL), F.lit(1)), cell)
    return files.where(F.col("file").rlike(r"(?i)\.csv$") & F.col("header").isNotNull()).select("file", F.posexplode(names).alias("place", "column"))


def typed(c: Column, kind: str) -> Column:
    """Text as a contract's type; what can't be read is null."""
    if kind == "string":
        return F.nullif(F.trim(c), F.lit(""))
    if kind == "date":
        return parse_day(c)
    if kind == "timestamp":
        return parse_timestamp(c)
    return to_finite(c).cast(kind)


def _scan(spark: SparkSession, paths: list[str], names: list[str], breaks: bool) -> DataFrame:
    """Cells of files with one header as text. Files with line breaks in quoted cells are read whole, one by one; others by splits."""
    raw = ", ".join([*(f"`c{i}` string" for i in range(len(names))), f"{BROKEN} string"])
    reader = spark.read.schema(raw).option("header", True).option("enforceSchema", True).option("multiLine", breaks).option("escape", '"')
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(paths)
    cells = [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]
    return df.select(*cells, BROKEN, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))


def _typed(rows: DataFrame, contract: Contract) -> DataFrame:
    kept = [c for c in rows.columns if c not in (*PLACE, BROKEN)]
    return rows.select(*(typed(F.col(c), contract.columns.get(c, "string")).alias(c) for c in kept), *PLACE)


def valid(rows: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame | None]:
    """Rows as text, as (good, bad): order lines are checked before their cells are read as numbers."""
    if contract.name != "orders" or not {"order_id", "sku_id", "quantity", "paid_amount"} <= set(rows.columns):
        return rows, None
    good, bad = H.validate_orders(rows)
    return good.select(*(F.col(c).cast("string").alias(c) if c not in PLACE else F.col(c) for c in good.columns)), bad


def merged(rows: DataFrame, contract: Contract) -> DataFrame:
    """By what there is of the contract's grain; without a grain, all rows."""
    grain = [g for g in contract.grain if g in rows.columns]
    return H.grain_merge(rows, grain) if grain else rows.drop(*PLACE)


def plan(spark: SparkSession, paths: str | list[str], overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files: file, digest, copies, kept, quoted_breaks, table_name, status; mapping of their headers; header rows)."""
    seen = inventory(spark, paths)
    first = seen.groupBy("digest").agg(F.min("file").alias("file")).select("file", F.lit(True).alias("kept"))
    rows = headers(seen)
    found = H.classify(rows.select("file", "column"), spark, overrides)
    files = seen.join(first, "file", "left").join(found, "file", "left")
    files = files.withColumns({"kept": F.coalesce("kept", F.lit(False)), "status": F.coalesce("status", F.lit("needs_data"))})
    return files, H.map_headers(rows.select("file", "column"), found, spark, overrides), rows


def build_tables(spark: SparkSession, paths: str | list[str], out: str, overrides: DataFrame | None = None) -> DataFrame:
    """Writes each table found in or below paths to out/<table>, with its _conflicts, _broken and _invalid rows beside it; the manifest comes back and lies in out/manifest.

    manifest: (file, table_name, status, digest, copies, rows: read from the file, broken, invalid, merged_rows: of its whole table).
    """
    files, mapping, rows = plan(spark, paths, overrides)
    files = stored(files, "build-files")
    kept = files.where("kept AND status = 'classified'").select("file", "quoted_breaks")
    named = rows.join(mapping, ["file", "column"]).join(kept, "file")
    header = F.array_sort(F.collect_list(F.struct("place", "canonical"))).alias("h")
    formats = named.groupBy("file", "table_name", "quoted_breaks").agg(header).groupBy("table_name", "h", "quoted_breaks").agg(F.sort_array(F.collect_list("file")).alias("files"))
    by_table = defaultdict(list)
    for r in formats.orderBy("table_name", "files").collect():  # a row for each export format
        by_table[r.table_name].append(_scan(spark, r.files, [x.canonical for x in r.h], r.quoted_breaks))
    counted = []
    for name, scans in by_table.items():
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
        counted.append(_write(spark, whole, CONTRACTS[name], out))
    none = spark.createDataFrame([], "file string, rows long, broken long, invalid long, merged_rows long")
    by_file = reduce(DataFrame.unionByName, counted, none)
    status = F.when(F.col("kept"), F.col("status")).otherwise("copy").alias("status")
    manifest = files.join(by_file, "file", "left").select("file", "table_name", status, "digest", "copies", "rows", "broken", "invalid", "merged_rows")
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def _write(spark: SparkSession, whole: DataFrame, contract: Contract, out: str) -> DataFrame:
    """Writes a table from its rows as text; counts by file."""
    whole = stored(whole, f"build-{contract.name}")
    to = lambda kind: f"{out}/{contract.name}{kind}"
    whole.where(F.col(BROKEN).isNotNull()).select(*PLACE, F.col(BROKEN).alias("record")).write.mode("overwrite").parquet(to("_broken"))
    good, bad = valid(whole.where(F.col(BROKEN).isNull()), contract)
    counts = [whole.select("_file", F.lit(1).alias("rows"), F.col(BROKEN).isNotNull().cast("int").alias("broken"), F.lit(0).alias("invalid"))]
    if bad is not None:
        bad.drop(BROKEN).write.mode("overwrite").parquet(to("_invalid"))
        counts.append(bad.select("_file", F.lit(0).alias("rows"), F.lit(0).alias("broken"), F.lit(1).alias("invalid")))
    rows = _typed(good, contract)
    merged(rows, contract).write.mode("overwrite").parquet(to(""))
    grain = [g for g in contract.grain if g in rows.columns]
    if grain:
        H.merge_conflicts(rows, grain).write.mode("overwrite").parquet(to("_conflicts"))
    total = spark.read.parquet(to("")).agg(F.count("*").alias("merged_rows"))
    sums = reduce(DataFrame.unionByName, counts).groupBy(F.regexp_replace("_file", "^file:/+", "file:///").alias("file")).agg(*(F.sum(c).alias(c) for c in ("rows", "broken", "invalid")))
    return sums.crossJoin(F.broadcast(total))  # one row
