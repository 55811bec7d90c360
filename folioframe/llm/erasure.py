"""Cascading erasure: rewrite only the files that hold a victim's rows.

`publish` writes a table in the order of its key's crc32, so that a key's rows
lie in one file or in consecutive ones, as files of equal row counts, and keeps a
manifest of each file's smallest and largest hash. `erase` joins the victims'
hashes to these zones (buckets of the hash range make it an equi-join), looks for
the exact identifiers inside the candidate files alone, and rewrites the files
where it finds some; a file that loses every row goes, others stay as they are.

A file's rows are written by one task as they come from its sort. Only file
numbers and counts, bounded by the number of files, reach the driver. Rewritten
files replace their own through Spark's dynamic partition overwrite.

Null keys hash as the empty text and match no victim. Repeated rows are rows of
their own, one victim more or less each. Ties in all columns are equal rows, so
their order doesn't show. Empty tables have no files. Very long texts are values
like any other. Columns of any name are kept; the files' own column, a part of
the path, takes a name that the table hasn't got.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.shared import cut, few, numbered, remove, written

#: Files that a table is cut into, but for the rest.
FILES = 150
#: Buckets of the range of hashes: 2 ** (32 - 24).
SHIFT = 24


def key_hash(key: Column) -> Column:
    """The unsigned crc32 of the key as text; null: of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


@dataclass
class Published:
    """A table's folder, its rows with the files' column, that column's name, and the manifest (file_no, lowest, highest, n_rows), a row for each file."""

    name: str
    at: str
    rows: DataFrame
    file: str
    zones: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != self.file]

    def read(self, files: list[int] | None = None) -> DataFrame:
        """The rows as they are now, with (file_no, path, place): of these files only, where given."""
        df = self.rows.sparkSession.read.schema(self.rows.schema).parquet(self.at)
        meta = df.metadataColumn("_metadata")
        df = df if files is None else df.where(F.col(f"`{self.file}`").isin(files))
        return df.select(F.struct(*(df[f"`{c}`"] for c in self.columns)).alias("row"), df[self.file].cast("long").alias("file_no"), meta["file_path"].alias("path"), meta["row_index"].alias("place"))


def _in_files(rows: DataFrame, file: str) -> DataFrame:
    """rows (row, file_no, place): each file's rows in one task, in their order, with the files' column last."""
    whole = rows.repartition("file_no").sortWithinPartitions("file_no", "place")
    return whole.select("row.*", F.col("file_no").cast("int").alias(file))


def publish(df: DataFrame, key: Column, name: str, at: str, files: int = FILES, columns: list[str] | None = None, staging: str | None = None) -> Published:
    """These columns of df (all, where none are named), in the order of its key's hash and then of its columns from left to right (nulls first), as files of 1 + floor(rows / files) rows in the new folder `at`."""
    columns, file = columns or df.columns, "file_no"
    while file in (c.lower() for c in columns):
        file += "_"
    staging = staging or f"{at}.sorting"
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), key_hash(key).alias("hash"))
    placed = numbered(own, ["hash", "row"], at=staging)
    span = 1 + F.floor(F.col("total") / files)
    placed = placed.select("row", "hash", F.floor(F.col("pos") / span).alias("file_no"), F.col("pos").alias("place"))
    zones = cut(placed.groupBy("file_no").agg(F.min("hash").alias("lowest"), F.max("hash").alias("highest"), F.count("*").alias("n_rows")))
    out = _in_files(placed, file)
    out.write.partitionBy(file).parquet(at)
    remove(df.sparkSession, staging)  # it holds what may have to be erased
    return Published(name, at, out, file, zones)


def candidates(published: Published, hashes: DataFrame) -> list[int]:
    """The files whose zone holds one of hashes (hash)."""
    zones = published.zones.select("file_no", "lowest", "highest", F.explode(F.sequence(F.shiftright("lowest", SHIFT), F.shiftright("highest", SHIFT))).alias("bucket"))
    asked = hashes.select("hash", F.shiftright("hash", SHIFT).alias("bucket"))
    met = asked.join(F.broadcast(zones), "bucket").where("hash between lowest and highest")  # at most files + 1 zones, in files + 256 buckets
    return sorted(r.file_no for r in met.select("file_no").distinct().collect())


def _marked(rows: DataFrame, matches: list[tuple[str, DataFrame]]) -> DataFrame:
    """rows with hit: whether one of the columns is among its own distinct, non-null values."""
    for i, (column, values) in enumerate(matches):
        held = values.select(F.col(values.columns[0]).alias(f"_v{i}"))
        rows = rows.join(few(held, held.count()), rows["row"][column] == F.col(f"_v{i}"), "left")
    hit = F.lit(False)
    for i in range(len(matches)):
        hit |= F.col(f"_v{i}").isNotNull()
    return rows.withColumn("hit", hit).drop(*(f"_v{i}" for i in range(len(matches))))


def erase(published: Published, hashes: DataFrame, matches: list[tuple[str, DataFrame]]) -> dict[int, tuple[int, bool]]:
    """Erases the rows one of whose columns holds one of its values, given the key hashes of all such rows. Returns, for each rewritten or removed file, the rows that went, and whether any are left."""
    spark = published.rows.sparkSession
    asked = candidates(published, hashes)
    if not asked:
        return {}
    found = _marked(published.read(asked).select("row", "file_no"), matches).where("hit").groupBy("file_no").agg(F.count("*").alias("n"))
    sizes = published.zones.select("file_no", "n_rows")
    erased = {r.file_no: (r.n, r.n < r.n_rows) for r in found.join(F.broadcast(sizes), "file_no").collect()}
    rewritten = [f for f, (_, left) in erased.items() if left]
    if rewritten:
        rows = _marked(published.read(rewritten).drop("path"), matches).where("not hit")
        _in_files(rows, published.file).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(published.file).parquet(published.at)
    for f, (_, left) in erased.items():
        if not left:
            remove(spark, f"{published.at}/{published.file}={f}")
    return erased


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(table_name, file_no, ids_sha256) of (table_name, file_no, id), which come in the files' order."""
    at, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"table_name": [at[0]], "file_no": [at[1]], "ids_sha256": [sha.hexdigest()]}, DIGESTS)

    for b in batches:
        tables, files, ids = (b.column(i).to_pylist() for i in range(3))
        start = 0
        while start < len(ids):
            key, end = (tables[start], files[start]), start
            while end < len(ids) and files[end] == key[1] and tables[end] == key[0]:
                end += 1
            if key != at:
                if at:
                    yield row()
                at, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(ids[start:end]).encode())
            start = end
    if at:
        yield row()


DIGESTS = pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("ids_sha256", pa.string())])


def report(spark: SparkSession, tables: list[tuple[Published, str, dict[int, tuple[int, bool]]]]) -> DataFrame:
    """A row for each file that is there now, of tables (the table, its column of amounts, what erase returned): read from the files, each one's ids in order by one task as a stream."""
    sums, ids, names, gone = None, None, [], []
    for t, amount, erased in tables:
        rows, name = t.read(), F.lit(t.name).alias("table_name")
        cents = F.coalesce(F.floor(100 * F.col("row")[amount] + 0.5), F.lit(0))
        one = rows.groupBy("file_no").agg(F.count("*").alias("n_rows"), F.sum(cents).alias("cents"), F.first("path").alias("path")).select(name, "*")
        each = rows.select(name, "file_no", F.coalesce(F.col("row")[t.columns[0]].cast("string"), F.lit("")).alias("id"), "place")
        sums, ids = (one, each) if sums is None else (sums.unionByName(one), ids.unionByName(each))
        names.append((t.name, ",".join(t.columns)))
        gone += [(t.name, f, n) for f, (n, _) in erased.items()]
    order = ["table_name", "file_no", "place"]
    digests = ids.repartition("table_name", "file_no").sortWithinPartitions(*order).drop("place").mapInArrow(_digests, "table_name string, file_no long, ids_sha256 string")
    gone = spark.createDataFrame(gone, "table_name string, file_no long, n_erased long")
    files = sums.join(F.broadcast(gone), ["table_name", "file_no"], "left").join(digests, ["table_name", "file_no"]).join(F.broadcast(spark.createDataFrame(names, "table_name string, columns string")), "table_name")
    return files.select(
        "table_name", "file_no", "n_rows", F.coalesce("n_erased", F.lit(0)).alias("n_erased"), F.coalesce("cents", F.lit(0)).alias("cents"), F.col("n_erased").isNotNull().alias("rewritten"), "ids_sha256", "columns", "path"
    )


def victim_masters(clients: DataFrame, clicks: DataFrame, modulus: int = 100) -> DataFrame:
    """(master_id): those whose crc32 the modulus divides, and the one whose clients have most clicks (ties, even at none: the smallest)."""
    pairs = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    counts = clicks.groupBy("client_id").agg(F.count("*").alias("n"))
    busiest = pairs.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy(F.col("n").desc(), "master_id").limit(1)
    chosen = pairs.where(key_hash(F.col("master_id")) % modulus == 0).select("master_id")
    return cut(chosen.unionByName(busiest.select("master_id")).distinct())


def erase_clients(clients: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, at: str, modulus: int = 100, files: int = FILES) -> DataFrame:
    """Publishes the four tables under `at` and erases the victim masters' clients, their clicks and sales, and these sales' lines. Returns the report.

    Of the clients, the victim masters' rows go; a row of the same client_id under another master, or none, stays.
    Clicks and sales go by client_id. Where a sale_id repeats, its lines stand at its smallest client_id, and go with any victim.
    """
    spark = clients.sparkSession
    owners = written(sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("_client")), f"{at}.owners")
    owned = lines.join(owners.withColumnRenamed("sale_id", "_sale"), F.col("sale_id") == F.col("_sale"), "left")
    masters = victim_masters(clients, clicks, modulus)
    theirs = clients.join(few(masters, masters.count()), "master_id", "left_semi").select("client_id").distinct()
    theirs = cut(theirs)
    ids = theirs.where("client_id is not null")
    their_sales = cut(sales.where("sale_id is not null").join(few(ids, ids.count()), "client_id", "left_semi").select("sale_id").distinct())
    hashes = theirs.select(key_hash(F.col("client_id")).alias("hash")).distinct()
    line_hashes = owners.join(few(their_sales, their_sales.count()), "sale_id").select(key_hash(F.col("_client")).alias("hash")).distinct()

    plans = [
        ("clients", clients, F.col("client_id"), "balance", hashes, [("master_id", masters)]),
        ("clicks", clicks, F.col("client_id"), "value", hashes, [("client_id", ids)]),
        ("sales", sales, F.col("client_id"), "total", hashes, [("client_id", ids)]),
        ("sale_lines", owned, F.col("_client"), "amount", line_hashes, [("sale_id", their_sales)]),
    ]
    done = []
    for name, df, key, amount, asked, matches in plans:
        columns = lines.columns if name == "sale_lines" else df.columns
        t = publish(df, key, name, f"{at}/{name}", files, columns=columns, staging=f"{at}.sorting-{name}")
        done.append((t, amount, erase(t, asked, matches)))
    remove(spark, f"{at}.owners")
    return report(spark, done)
