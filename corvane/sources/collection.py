"""A stored collection: tables that share a key, kept as a log of versions.

A version is a manifest, root/versions/<number>.json, which names the parts of each table and the delete vectors that hold for them; files are never
changed. An upsert writes the changed rows as a new part and the places (part, bucket, file, row) of the rows that they replace, so that its
bytes follow the change and not the collection. A manifest appears under its name as a whole or not at all, after all that it names is
written: a reader sees one version, whatever is upserted or compacted meanwhile, and of two writers of one version the second fails.

Rows lie in folders by a hash of their key (``buckets`` of them, fixed when a collection is made), so that finding the rows of a few keys, and
compacting what has changed most, reads those buckets alone. Several rows may share a key; a null key is a key. A table without rows is a
table; names of columns must not be those of PLACE. Counts of a write stand in its manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

BUCKETS = 64
#: A bucket is compacted when it has so many parts, or so large a share of dead rows.
PARTS, DEAD = 8, 0.2
#: So many places of dead rows at most are broadcast, of some 100 bytes each.
FEW = 1 << 18
PLACE = ("part", "bucket", "file", "row")
_PLACES = "part string, bucket int, file string, row long"


class Conflict(RuntimeError):
    """Another writer has made this version."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _hadoop(spark, f"{root}/versions")
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Of a version, of the last one if none is given."""
    version = versions(spark, root)[-1] if version is None else version
    return json.loads(spark.read.text(f"{root}/versions/{version}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, found: dict) -> dict:
    """Writes a manifest beside its place and moves it there, which fails if there is one."""
    jvm, name = spark._jvm, f"{root}/versions/{found['version']}.json"
    fs, part = _hadoop(spark, f"{root}/versions/.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
    finally:
        out.close()
    _, target = _hadoop(spark, name)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(part, False)
        if fs.exists(target):
            raise Conflict(f"version {found['version']} of {root} is there") from e
        raise
    return found


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows of each bucket of a part, from the footers of its files; at most as many numbers as there are buckets."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p) or not any(x.isDirectory() for x in fs.listStatus(p)):
        return {}
    return {str(r["bucket"]): r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()}


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, int]:
    # Large buckets become several tasks and files, small ones share a task.
    df = rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    df.write.partitionBy("bucket").parquet(path)
    return _counts(rows.sparkSession, path)


def _rows(counts: dict[str, int]) -> int:
    return sum(counts.values())


def _scan(spark: SparkSession, root: str, name: str, table: dict, buckets: set[int] | None, places: bool) -> DataFrame:
    """Rows of a table's parts, dead ones too, in one scan of all or some buckets."""
    base, schema = f"{root}/tables/{name}", ST.StructType.fromJson(table["schema"])
    full = ST.StructType([*schema.fields, ST.StructField("part", ST.StringType()), ST.StructField("bucket", ST.IntegerType())])
    paths = []
    for p in table["parts"]:
        wanted = [b for b in p["counts"] if buckets is None or int(b) in buckets]
        whole = len(wanted) == len(p["counts"]) and not p.get("cut")
        paths += [f"{base}/part={p['part']}"] if whole and wanted else [f"{base}/part={p['part']}/bucket={b}" for b in wanted]
    columns = [F.col(c) for c in schema.names]
    if places:
        columns += [F.col("part"), F.col("bucket"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    if not paths:
        empty = spark.createDataFrame([], full)
        return empty.withColumn("file", F.lit("")).withColumn("row", F.lit(0).cast("long")).select(*schema.names, *(PLACE if places else ()))
    return spark.read.schema(full).option("basePath", base).parquet(*paths).select(*columns)


def _live(spark: SparkSession, root: str, name: str, table: dict, buckets: set[int] | None = None, places: bool = False) -> DataFrame:
    """Rows that no delete vector names."""
    dead = [d for d in table["deletes"] if any(buckets is None or int(b) in buckets for b in d["counts"])]
    if not dead:
        return _scan(spark, root, name, table, buckets, places)
    gone = spark.read.schema(_PLACES).parquet(*[f"{root}/deletes/{name}/{d['part']}" for d in dead])
    if buckets is not None:
        gone = gone.filter(F.col("bucket").isin(*buckets))
    small = sum(_rows(d["counts"]) for d in dead) <= FEW
    rows = _scan(spark, root, name, table, buckets, True).join(F.broadcast(gone) if small else gone, list(PLACE), "left_anti")
    return rows.select(*ST.StructType.fromJson(table["schema"]).names, *(PLACE if places else ()))


def read(spark: SparkSession, root: str, name: str, version: int | None = None, keys: list | None = None) -> DataFrame:
    """A table as of a version; of some keys, from their buckets alone."""
    found = manifest(spark, root, version)
    table = found["tables"][name]
    if keys is None:
        return _live(spark, root, name, table)
    key = found["key"]
    kind = ST.StructType.fromJson(table["schema"])[key].dataType
    asked = spark.createDataFrame([(k,) for k in keys], ST.StructType([ST.StructField("wanted", kind)]))
    buckets = {r[0] for r in asked.select(_bucket("wanted", found["buckets"])).distinct().collect()}
    return _live(spark, root, name, table, buckets).join(F.broadcast(asked), F.col(key).eqNullSafe(F.col("wanted")), "left_semi")


def _name(version: int) -> str:
    return f"{version:06d}-{uuid.uuid4().hex[:8]}"


def _check(rows: DataFrame, dimension: int | None):
    """rows with an eye on their vectors, and what raises after they are written if one is not of that length."""
    if dimension is None or "embedding" not in rows.columns:
        return rows, lambda: None
    seen = Observation()
    watched = rows.observe(seen, F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).alias("bad"))

    def check():
        if seen.get["bad"]:
            raise ValueError(f"{seen.get['bad']} vectors are not of {dimension} numbers")

    return watched, check


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame], key: str, buckets: int = BUCKETS, dimension: int | None = None) -> dict:
    """Version 1."""
    found = {}
    for name, df in tables.items():
        part = _name(1)
        df, check = _check(df, dimension)
        counts = _write(df, f"{root}/tables/{name}/part={part}", key, buckets)
        if counts:
            check()
        found[name] = {"schema": df.schema.jsonValue(), "parts": [{"part": part, "counts": counts}], "deletes": [], "rows": _rows(counts), "read": 0, "written": _rows(counts), "deleted": 0}
    return _commit(spark, root, {"version": 1, "action": "create", "key": key, "buckets": buckets, "tables": found})


def upsert(spark: SparkSession, root: str, changed: dict[str, DataFrame], deleted: DataFrame | None = None, dimension: int | None = None) -> dict:
    """The next version: of each table, the rows of the keys in its changed rows and of the ``deleted`` keys go, and the changed rows come; tables that are
    not named lose the deleted keys alone. Nothing is visible before all of it is written."""
    last = manifest(spark, root)
    key, version, tables = last["key"], last["version"] + 1, {}
    for name, table in last["tables"].items():
        schema = ST.StructType.fromJson(table["schema"])
        rows = changed.get(name)
        keys = [df.select(F.col(key).alias("gone")) for df in (rows, deleted) if df is not None]
        part, table = _name(version), dict(table, read=0, written=0, deleted=0)
        if keys:
            gone = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
            touched = {r[0] for r in gone.select(_bucket("gone", last["buckets"])).distinct().collect()}  # at most as many as there are buckets
            met = _live(spark, root, name, table, touched, True).select(F.col(key), *PLACE)
            dead = met.join(gone, F.col(key).eqNullSafe(F.col("gone")), "left_semi").select(*PLACE)
            path = f"{root}/deletes/{name}/{part}"
            dead.hint("rebalance").write.parquet(path)
            counts = {str(r["bucket"]): r["count"] for r in spark.read.schema(_PLACES).parquet(path).groupBy("bucket").count().collect()}
            table["read"], table["deleted"] = sum(k for p in table["parts"] for b, k in p["counts"].items() if int(b) in touched), _rows(counts)
            if counts:
                table["deletes"] = [*table["deletes"], {"part": part, "counts": counts}]
        if rows is not None:
            watched, check = _check(rows.select(*schema.names), dimension)
            counts = _write(watched, f"{root}/tables/{name}/part={part}", key, last["buckets"])
            if counts:
                check()
                table["parts"] = [*table["parts"], {"part": part, "counts": counts}]
            table["written"] = _rows(counts)
        table["rows"] += table["written"] - table["deleted"]
        tables[name] = table
    return _commit(spark, root, last | {"version": version, "action": "upsert", "tables": tables})


def worn(table: dict, parts: int = PARTS, dead: float = DEAD) -> set[int]:
    """Buckets of so many parts, or with so large a share of dead rows."""
    rows, gone, n = {}, {}, {}
    for p in table["parts"]:
        for b, k in p["counts"].items():
            rows[b], n[b] = rows.get(b, 0) + k, n.get(b, 0) + 1
    for d in table["deletes"]:
        for b, k in d["counts"].items():
            gone[b] = gone.get(b, 0) + k
    return {int(b) for b in rows if n[b] >= parts or gone.get(b, 0) > dead * rows[b]}


def compact(spark: SparkSession, root: str, parts: int = PARTS, dead: float = DEAD) -> dict:
    """The next version, of the same rows: worn buckets are one part without dead rows. Others stay as they are; so do the files of older versions."""
    last = manifest(spark, root)
    version, tables = last["version"] + 1, {}
    for name, table in last["tables"].items():
        buckets, table = worn(table, parts, dead), dict(table, read=0, written=0, deleted=0)
        if buckets:
            part = _name(version)
            counts = _write(_live(spark, root, name, table, buckets), f"{root}/tables/{name}/part={part}", last["key"], last["buckets"])
            rest = lambda c: {b: k for b, k in c.items() if int(b) not in buckets}  # noqa: B023, E731  used in this turn alone
            kept = [p | {"counts": rest(p["counts"]), "cut": True} if len(rest(p["counts"])) < len(p["counts"]) else p for p in table["parts"]]
            dels = [d | {"counts": rest(d["counts"])} for d in table["deletes"]]
            table["parts"] = [p for p in [*kept, {"part": part, "counts": counts}] if p["counts"]]
            table["deletes"] = [d for d in dels if d["counts"]]
            table["written"] = _rows(counts)
        tables[name] = table
    return _commit(spark, root, last | {"version": version, "action": "compact", "tables": tables})


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes what the last ``keep`` versions do not name, older manifests first; readers of older versions, and writers at work, would lose their files."""
    numbers = versions(spark, root)
    used, gone = set(), []
    for v in numbers[-keep:]:
        for name, table in manifest(spark, root, v)["tables"].items():
            used |= {f"deletes/{name}/{d['part']}" for d in table["deletes"]}
            used |= {f"tables/{name}/part={p['part']}/bucket={b}" for p in table["parts"] for b in p["counts"]}
    old = [f"versions/{v}.json" for v in numbers[:-keep]]
    for path, deep in ((f"{root}/tables", 3), (f"{root}/deletes", 2)):
        fs, top = _hadoop(spark, path)
        level = [top] if fs.exists(top) else []
        for _ in range(deep):
            level = [x.getPath() for p in level for x in fs.listStatus(p) if x.isDirectory()]
        for p in level:
            short = "/".join(p.toString().rstrip("/").rsplit("/", deep + 1)[1:])
            old += [short] if short not in used else []
    for short in old:
        fs, p = _hadoop(spark, f"{root}/{short}")
        fs.delete(p, True)
        gone.append(short)
    return gone


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, action, name, rows, read, written, deleted): a row for each table of each version that is kept."""
    rows = []
    for v in versions(spark, root):
        m = manifest(spark, root, v)
        rows += [(v, m["action"], n, t["rows"], t["read"], t["written"], t["deleted"]) for n, t in m["tables"].items()]
    return spark.createDataFrame(rows, "version int, action string, name string, rows long, read long, written long, deleted long")


def snapshot(spark: SparkSession, root: str, target: str, names: list[str], version: int | None = None) -> dict:
    """The named tables of one version as a collection of its own, whatever is written to the first meanwhile."""
    found = manifest(spark, root, version)
    return create(spark, target, {n: read(spark, root, n, found["version"]) for n in names}, found["key"], found["buckets"])
