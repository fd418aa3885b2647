"""The lake: typed Parquet datasets under one root, each with numbered versions, which are also the ledger of its batches.

Data files have names of their own and never change. What a reader sees is the list of files of one version (versions.py); files
that a cut-off write left behind are in no version. Files that later versions dropped stay for readers of earlier ones until
``vacuum``. A folder of Parquet files without versions is read as it lies, and becomes version 0 with the first write.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelake.operators import predicates as P
from tidelake.operators.compare import compared_partitions, differences
from tidelake.operators.pages import after, page
from tidelake.operators.timeseries import keep_first
from tidelake.registry import Dataset, Registry, market
from tidelake.sources.footers import footers, may_match
from tidelake.sources.versions import Conflict, File, Versions

#: A column of rows to be written: rows of a partition that share its value get files of their own.
CUT = "__file"
#: Rows that a task which cuts its rows into files gets, about.
TASK_ROWS = 1 << 20
#: Files moved at once.
MOVERS = 8
_LEDGER = "id string, dataset string, operation string, source string, created_at timestamp_ltz, rows long, partitions array<string>, files array<string>, notes string, version long"


class Lake:
    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None):
        self.spark, self.root, self.registry = spark, root.rstrip("/"), registry or market()
        self._path_of, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    # files

    def path(self, dataset: str) -> str:
        return f"{self.root}/{self.registry[dataset].root}"

    def _fs(self, path: str):
        p = self._path_of(path)
        return p.getFileSystem(self._conf), p

    def versions(self, dataset: str) -> Versions:
        return Versions(self.spark, f"{self.root}/meta/manifest/{dataset}")

    def version(self, dataset: str) -> int:
        """The number of the dataset's last version; -1 without any."""
        return self.versions(dataset).latest()

    def _state(self, dataset: str, version: int | None = None) -> dict[str, File]:
        """The files of a version, the last one by default; without versions what the folder holds, of unknown rows."""
        own = self.versions(dataset)
        at = own.latest() if version is None else version
        if at >= 0:
            return own.state(at)
        home = self.path(dataset)
        return {f.path: f for f in (File(self._under(path, home), -1, n) for path, n in self._listed(home))}

    def files(self, dataset: str, version: int | None = None) -> list[tuple[str, int]]:
        """(path, bytes) of the Parquet files of a version, the last one by default."""
        home = self.path(dataset)
        return sorted((f"{home}/{f.path}", f.bytes) for f in self._state(dataset, version).values())

    def _under(self, file: str, home: str) -> str:
        """A file's path under the dataset's folder: its partitions and its name."""
        folder = self._folder(file, home)
        return f"{folder[1:]}/{file.rpartition('/')[2]}" if folder else file.rpartition("/")[2]

    def _listed(self, path: str) -> list[tuple[str, int]]:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        # a call a level; located statuses would have a local disk's permissions looked up by a process a file
        folders, out = [p], []
        while folders:
            level = self.spark.sparkContext._gateway.new_array(self._path_of, len(folders))
            for i, folder in enumerate(folders):
                level[i] = folder
            folders = []
            for f in fs.listStatus(level):
                if f.isDirectory():
                    folders.append(f.getPath())
                elif (name := f.getPath().toString()).endswith(".parquet"):
                    out.append((name, f.getLen()))
        return sorted(out)

    def partition_values(self, dataset: str, key: str) -> set[str]:
        return {part.split("=", 1)[1] for f, _ in self.files(dataset) for part in f.split("/") if part.startswith(f"{key}=")}

    # reading

    def read(self, dataset: str, version: int | None = None) -> DataFrame:
        """All rows of one version; what is committed later doesn't change them."""
        d = self.registry[dataset]
        files = [f for f, _ in self.files(dataset, version)]
        if not files:
            return self.spark.createDataFrame([], d.schema())
        return self.spark.read.schema(d.schema()).option("basePath", self.path(dataset)).parquet(*files)

    def scan(
        self,
        dataset: str,
        filters: list[P.Predicate] = (),
        columns: list[str] | None = None,
        partitions: dict[str, list[str]] | None = None,
        limit: int = 0,
        offset: int = 0,
        version: int | None = None,
    ) -> DataFrame:
        """Rows of a version that meet all filters, in the columns asked for (none: all fields; partitions are no fields).

        Date ranges also restrict the year and month partitions. Pages come in the order of the dataset's sort key, so
        that they follow one another without gaps; a limit of zero is none.
        """
        d = self.registry[dataset]
        for c in columns or []:
            if c not in d.names:
                raise KeyError(f"{dataset} has no field {c}")
        rows = self.read(dataset, version)
        for key, values in (partitions or {}).items():
            if key not in d.partitions:
                raise KeyError(f"{dataset} has no partition {key}")
            rows = rows.where(F.col(key).isin(list(values)) if values else F.lit(False))
        implied = P.implied_partitions(d, list(filters))
        if implied is not None:
            rows = rows.where(implied)
        rows = P.applied(rows, d, list(filters))
        order = self.order(dataset)
        if limit and offset:
            rows = page(rows, order, offset, limit)
        elif limit or offset:
            rows = rows.orderBy(*order).offset(offset) if offset else rows.orderBy(*order).limit(limit)
        return rows.select(*(columns or d.names))

    def scan_after(self, dataset: str, at: str, limit: int, filters: list[P.Predicate] = (), version: int | None = None) -> DataFrame:
        """The next ``limit`` rows of a scan behind the row that the token ``at`` tells (pages.token of the sort key); empty: the first ones."""
        d = self.registry[dataset]
        return after(self.scan(dataset, filters, version=version), self.order(dataset), at, limit).select(*d.names)

    def order(self, dataset: str) -> list[str]:
        """The columns that pages of the dataset are ordered by."""
        d = self.registry[dataset]
        return list(dict.fromkeys([*d.sorted_by, *d.primary_key]))

    def compared(self, dataset: str, left: int, right: int) -> DataFrame:
        """Each partition's rows in two versions, and whether they are the same."""
        return compared_partitions(self.read(dataset, left), self.read(dataset, right), list(self.registry[dataset].partitions))

    def changes(self, dataset: str, left: int, right: int) -> DataFrame:
        """Rows and fields that differ between two versions, by partition and primary key."""
        d = self.registry[dataset]
        return differences(self.read(dataset, left), self.read(dataset, right), list(d.primary_key), list(d.partitions))

    def cross(self, filters: list[P.Predicate] = (), columns: list[str] | None = None) -> DataFrame:
        """The daily cross-section: of each year the materialised table if there is one, else the daily bars."""
        names = columns or self.registry["daily_cross"].names
        made, years = self.partition_values("daily_cross", "year"), self.partition_values("bars_daily", "year")
        out = self.scan("daily_cross", filters, names)
        if rest := sorted(years - made):
            out = out.unionByName(self.scan("bars_daily", filters, names, {"year": rest}))
        return out

    # writing

    def partitioned(self, dataset: str, rows: DataFrame) -> DataFrame:
        """Rows in the declared types with partition columns; year and month come from the time field unless given."""
        d = self.registry[dataset]
        out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(d.schema(False)[f.name].dataType).alias(f.name) for f in d.fields], *[p for p in (*d.partitions, CUT) if p in rows.columns])
        for p, layout in (("year", "yyyy"), ("month", "MM")):
            if p in d.partitions and p not in out.columns:
                out = out.withColumn(p, F.coalesce(F.date_format(d.time_field, layout), F.lit("unknown")))
        missing = [p for p in d.partitions if p not in out.columns]
        if missing:
            raise ValueError(f"{dataset}: rows lack the partitions {missing}")
        return out

    def write(self, dataset: str, rows: DataFrame, mode: str = "append", operation: str = "import", source: str = "", notes: str = "", arranged: bool = False, base: int | None = None, once: bool = False) -> dict:
        """Writes rows sorted by the dataset's key, within files of one partition, and commits them as one version.

        ``replace`` replaces the partitions that the rows have: their files as they are when the commit is made, whoever wrote
        them. ``base`` is the version that the rows were read from; the commit is refused with a Conflict if a later one touched
        these partitions. With ``once``, nothing is committed if a version has the same notes already. The ledger gets the rows
        that the dataset gained. Only footers of new files are counted; versions know the rows of the others.
        """
        d = self.registry[dataset]
        out = self.partitioned(dataset, rows)
        if not arranged:
            # large partitions take several tasks: rows of a partition are dealt by its first key, too
            keys = [*d.partitions, *[k for k in d.sorted_by[:1] if d.partitions]]
            out = out.repartition(*keys) if keys else out
            out = out.sortWithinPartitions(*d.partitions, *d.sorted_by)
        staged = f"{self.root}/.staging/{uuid.uuid4().hex}"
        writer = out.write.option("compression", "zstd").option("maxRecordsPerFile", d.target_file_rows)
        # the folder is this write's own until all is there, so tasks may put their files there themselves
        writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer = writer.option("parquet.block.size", max(1 << 20, d.row_group_rows * 16 * len(d.fields)))
        if folders := [*d.partitions, *[c for c in (CUT,) if c in out.columns]]:
            writer = writer.partitionBy(*folders)
        home, added = self.path(dataset), []
        try:
            writer.parquet(staged)
            listed = dict(self._listed(staged))
            count = self._counted(list(listed), staged, d)
            self._begun(dataset)
            moves = {path: File(self._uncut(to), count[to], size) for path, size in listed.items() if count.get(to := self._under(path, staged))}
            added += moves.values()
            for folder in {f.folder for f in added}:
                fs, p = self._fs(f"{home}/{folder}")
                fs.mkdirs(p)
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda m: self._moved(m[0], f"{home}/{m[1].path}"), moves.items()))
            return self._commit(dataset, operation, added, mode, base, source, notes, once)
        except BaseException:
            for f in added:  # they are in no version
                fs, p = self._fs(f"{home}/{f.path}")
                fs.delete(p, False)
            raise
        finally:
            fs, p = self._fs(staged)
            fs.delete(p, True)

    def _begun(self, dataset: str) -> None:
        """Makes version 0 of what the folder holds already, before anything is moved there."""
        own = self.versions(dataset)
        if own.latest() < 0:
            d, home = self.registry[dataset], self.path(dataset)
            listed = self._listed(home)
            count = self._counted([f for f, _ in listed], home, d)
            own.put(0, self._entry(dataset, "adopt", sum(count.values()), [File(self._under(f, home), count.get(self._under(f, home), 0), n) for f, n in listed]))

    def _entry(self, dataset: str, operation: str, rows: int, added: list[File] = (), removed: list[str] = (), source: str = "", notes: str = "") -> dict:
        folders = sorted({f.folder for f in added} - {""})
        return {
            "id": uuid.uuid4().hex, "dataset": dataset, "operation": operation, "source": source, "created_at": datetime.now(timezone.utc).isoformat(), "rows": rows, "partitions": folders, "files": [f.path for f in added], "notes": notes,
            "added": [{"path": f.path, "rows": f.rows, "bytes": f.bytes} for f in added], "removed": list(removed),
        }

    def _commit(self, dataset: str, operation: str, added: list[File], mode: str, base: int | None, source: str, notes: str, once: bool) -> dict:
        """Puts the next version; where another writer was faster, what is to go is looked up again in theirs."""
        own, parts = self.versions(dataset), {f.folder for f in added}
        known = -1  # versions up to this have other notes
        while True:
            at = own.latest()
            if once:
                twin = next((e for e in own.since(known, at) if e["notes"] == notes and e["operation"] == operation), None)
                if twin is not None:
                    for f in added:
                        fs, p = self._fs(f"{self.path(dataset)}/{f.path}")
                        fs.delete(p, False)
                    return twin
                known = at
            if base is not None:
                touched = {p.rpartition("/")[0] for e in own.since(base, at) for p in [*e["files"], *e["removed"]]}
                if clash := touched & parts:
                    raise Conflict(f"{dataset}: {sorted(clash)} changed after version {base}")
            gone = [f for f in own.state(at).values() if f.folder in parts] if mode == "replace" else []
            entry = self._entry(dataset, operation, sum(f.rows for f in added) - sum(f.rows for f in gone), added, [f.path for f in gone], source, notes)
            if own.put(at + 1, entry):
                return entry

    def _folder(self, file: str, home: str) -> str:
        """A file's folder under the given one: empty, or partitions after a slash each."""
        under = "/".join(x for x in file.rpartition("/")[0].split("/") if "=" in x and x not in home.split("/"))
        return f"/{under}" if under else ""

    def _counted(self, files: list[str], home: str, d: Dataset) -> dict[str, int]:
        """Rows of each file by its path under ``home``, from footers alone: no column is read."""
        if not files:
            return {}
        rows = self.spark.read.schema(d.schema(False)).parquet(*files).groupBy(F.col("_metadata.file_path").alias("file")).count()
        return {self._under(unquote(r["file"]), home): r["count"] for r in rows.collect()}  # one row a file that comes

    def _uncut(self, path: str) -> str:
        """A file's path without the folder of its cut, which goes into the name."""
        *folders, name = path.split("/")
        return "/".join([*[x for x in folders if not x.startswith(f"{CUT}=")], "-".join([*[x.split("=", 1)[1] for x in folders if x.startswith(f"{CUT}=")], name])])

    def _moved(self, was: str, now: str) -> None:
        fs, p = self._fs(was)
        if not fs.rename(p, self._path_of(now)):
            raise OSError(f"{was} couldn't be moved to {now}")

    def vacuum(self, dataset: str, keep: int = 1, older_hours: float = 24.0) -> int:
        """Deletes data files that none of the last ``keep`` versions has and that are older than so many hours; tells how many."""
        own, home = self.versions(dataset), self.path(dataset)
        held = {path for n in own.numbers()[-keep:] for path in own.state(n)}
        if not held and own.latest() < 0:
            return 0
        fs, p = self._fs(home)
        before, gone = datetime.now(timezone.utc).timestamp() * 1000 - older_hours * 3_600_000, 0
        for path, _ in self._listed(home):
            fs, p = self._fs(path)
            if self._under(path, home) not in held and fs.getFileStatus(p).getModificationTime() <= before:
                gone += bool(fs.delete(p, False))
        return gone

    # ledger

    def log(self, dataset: str, operation: str, rows: int, source: str = "", notes: str = "") -> dict:
        """Adds a batch without files to the dataset's ledger."""
        self._begun(dataset)
        own, entry = self.versions(dataset), self._entry(dataset, operation, rows, source=source, notes=notes)
        while not own.put(own.latest() + 1, entry):
            pass
        return entry

    def ledger(self, dataset: str | None = None) -> DataFrame:
        """The batches of a dataset or of all: its versions, but for a version 0 that had nothing to adopt."""
        paths = [f"{self.root}/meta/manifest/{d.name}" for d in self.registry if dataset in (None, d.name) and self.versions(d.name).latest() >= 0]
        if not paths:
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).option("pathGlobFilter", "*.json").json(paths).where("operation <> 'adopt' or size(files) > 0")

    def labels(self, dataset: str, operation: str) -> set[str]:
        """The notes of a dataset's batches of one kind."""
        return {r.notes for r in self.ledger(dataset).where(F.col("operation") == operation).select("notes").distinct().collect()}

    def summary(self) -> DataFrame:
        """Batches, files, rows and the last time of each dataset in the ledger."""
        return self.ledger().groupBy("dataset").agg(F.count("*").alias("batches"), F.sum(F.size("files")).alias("files"), F.sum("rows").alias("rows"), F.max("created_at").alias("last_time"))

    def recent(self, n: int = 8) -> DataFrame:
        return self.ledger().orderBy(F.desc("created_at")).limit(n)

    def partition_counts(self, dataset: str) -> DataFrame:
        d = self.registry[dataset]
        return self.read(dataset).groupBy(*d.partitions).agg(F.count("*").alias("rows"))

    def health(self) -> list[dict]:
        """Files, bytes and partitions of each dataset, from listings alone."""
        out = []
        for d in self.registry:
            files = self.files(d.name)
            out.append({"dataset": d.name, "files": len(files), "bytes": sum(n for _, n in files), "partitions": len({f.rpartition("/")[0] for f, _ in files}) if d.partitions else 0})
        return out

    def disk(self) -> dict:
        """Bytes of the file system that holds the lake: all, used and left, and what the lake's datasets take."""
        fs, p = self._fs(self.root)
        at = fs.getStatus(p) if fs.exists(p) else fs.getStatus()
        return {"capacity": at.getCapacity(), "used": at.getUsed(), "remaining": at.getRemaining(), "lake": sum(h["bytes"] for h in self.health())}

    def verify(self, *datasets: str) -> DataFrame:
        """Rows by the ledger against rows in files, of these datasets or all: ok, mismatch, or no-manifest."""
        actual = None
        for d in self.registry:
            if not datasets or d.name in datasets:
                one = self.read(d.name).agg(F.lit(d.name).alias("dataset"), F.count("*").alias("actual"))
                actual = one if actual is None else actual.unionByName(one)
        said = self.summary().select("dataset", F.col("rows").alias("logged"))
        out = actual.join(said, "dataset", "left")
        status = F.when(F.col("logged").isNull(), "no-manifest").when(F.col("logged") == F.col("actual"), "ok").otherwise("mismatch")
        return out.withColumn("status", status)

    def reconcile(self, dataset: str) -> dict | None:
        """Adds a correction where the ledger and the files differ."""
        row = self.verify(dataset).first()
        diff = row.actual - (row.logged or 0)
        return self.log(dataset, "reconcile", diff, notes=f"logged {row.logged}, found {row.actual}") if diff else None

    # maintenance

    def dedupe(self, dataset: str, apply: bool = False, max_rows: int | None = None) -> DataFrame:
        """(partitions, rows, duplicates, status): rows beyond the first of each primary key; ``apply`` removes them.

        Which row is first: by the file, then the place in it. Partitions of more than ``max_rows`` rows stay as they are,
        and their status says so; without it there is no bound. Raises Conflict if another writer changed these partitions meanwhile.
        """
        d, base = self.registry[dataset], self.version(dataset)
        keys, at = [*d.partitions, *d.primary_key], None if base < 0 else base
        rows = self.read(dataset, at).select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i")) if self.files(dataset, at) else self.read(dataset, at).selectExpr("*", "'' AS __f", "0L AS __i")
        count = rows.groupBy(*keys).count().groupBy(*d.partitions).agg(F.sum("count").alias("rows"), F.sum(F.col("count") - 1).alias("duplicates"))
        large = F.lit(False) if max_rows is None else F.col("rows") > max_rows
        found = count.where("duplicates > 0").withColumn("status", F.when(large, "too large").otherwise("removed" if apply else "found"))
        if not apply:
            return found
        report = found.collect()  # one row a partition
        todo = [r for r in report if r.status == "removed"]
        if todo:
            some = self.spark.createDataFrame([tuple(r[p] for p in d.partitions) for r in todo], T.StructType([T.StructField(p, T.StringType()) for p in d.partitions])) if d.partitions else None
            part = rows.join(F.broadcast(some), list(d.partitions), "left_semi") if some is not None else rows
            # from the version that was counted: a commit between the two is a Conflict, and the caller starts again
            self.write(dataset, keep_first(part, keys, ["__f", "__i"]).drop("__f", "__i"), "replace", "dedupe", notes=f"{sum(r.duplicates for r in todo)} repeated rows removed", base=at)
        return self.spark.createDataFrame(report, found.schema)

    def cluster(self, dataset: str, rows_a_file: int = 0) -> dict:
        """Rewrites a dataset so that files of a partition hold ranges of the first sort key that don't overlap, of about so many rows.

        The ranges come from the data: rows counted by key give each key its place, and a range ends where the places pass another
        multiple of a file's rows. A key with more rows than a file is cut by the second sort key, at its values, so its files share that
        key alone. Rows with equal keys of both stay together. Counts have one row a key (and value, of large keys); rows move once, and
        a task writes many files if they are small.
        Raises Conflict if another writer changed the dataset meanwhile.
        """
        d, base = self.registry[dataset], self.version(dataset)
        size, parts = rows_a_file or d.target_file_rows, list(d.partitions)
        key, then = [*dict.fromkeys([*d.sorted_by, *d.primary_key]), None][:2]
        rows = self.read(dataset, None if base < 0 else base)

        def met(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
            return left.join(right.select(*[F.col(c).alias(f"__{c}") for c in names], *[c for c in right.columns if c not in names]), same).drop(*[f"__{c}" for c in names])

        keys = [*parts, key]
        upto = F.sum("n").over(Window.partitionBy(*parts).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
        place = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("__start", upto - F.col("n")).withColumn("__large", F.col("n") > size).drop("n")
        # a large key begins ranges of its own, the key after it another
        own = met(rows, place, keys).withColumn("__range", F.when(F.col("__large"), F.col("__start")).otherwise(F.floor(F.col("__start") / size) * size))
        own = own.withColumn("__piece", F.lit(0).cast("long"))
        if then is not None:
            large = own.where("__large")
            each = large.groupBy(*keys, then).agg(F.count("*").alias("n"))
            many = F.sum("n").over(Window.partitionBy(*keys).orderBy(then).rowsBetween(Window.unboundedPreceding, 0))
            cuts = each.withColumn("__piece", F.floor((many - F.col("n")) / size)).drop("n")
            own = own.where("NOT __large").unionByName(met(large.drop("__piece"), cuts, [*keys, then]))
        # places that a large key's pieces begin at, and ranges of others, each told from the other
        own = own.withColumn(CUT, ((F.col("__range") + F.col("__piece") * size) * 2 + F.col("__large").cast("long")).cast("long"))
        files = own.select(*parts, CUT).distinct().count()
        if not files:
            return self.log(dataset, "cluster", 0)
        tasks = min(files, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), files * size // TASK_ROWS))
        out = own.repartitionByRange(tasks, *parts, CUT).sortWithinPartitions(*parts, CUT, *[c for c in (key, then) if c], *[c for c in d.sorted_by if c not in (key, then)])
        return self.write(dataset, out.drop("__start", "__large", "__range", "__piece"), "replace", "cluster", base=None if base < 0 else base, arranged=True)

    def overlaps(self, dataset: str, version: int | None = None) -> DataFrame:
        """(partitions, files, overlapping) of a version: how many files of a partition begin before an earlier one's last first-sort-key value; from footers."""
        d = self.registry[dataset]
        key = [*d.sorted_by, *d.primary_key][0]
        each = self.footers(dataset, version).where(F.col("field") == key).groupBy(*d.partitions, "file").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        before = Window.partitionBy(*d.partitions).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
        over = F.coalesce(F.col("low") < F.max("high").over(before), F.lit(False))
        return each.withColumn("over", over).groupBy(*d.partitions).agg(F.count("*").alias("files"), F.sum(F.col("over").cast("long")).alias("overlapping"))

    def build_cross(self, years: list[str] | None = None) -> dict:
        """Materialises the daily cross-section: its columns of the daily bars, sorted by date, whole years replaced."""
        d = self.registry["daily_cross"]
        rows = self.partitioned("daily_cross", self.scan("bars_daily", columns=d.names, partitions={"year": years} if years else None))
        out = rows.repartitionByRange("year", "trade_date").sortWithinPartitions("year", *d.sorted_by)
        return self.write("daily_cross", out, "replace", "materialize", "bars_daily", arranged=True)

    def footers(self, dataset: str, version: int | None = None) -> DataFrame:
        """(partitions, file, row_group, rows, field, low, high, nulls, bytes) of a version's files, from their footers."""
        return footers(self.spark, self._file_table(dataset, version))

    def _file_table(self, dataset: str, version: int | None = None) -> DataFrame:
        """(file, partitions): a row for each file of a version."""
        d, home = self.registry[dataset], self.path(dataset)
        rows = [(f"{home}/{f.path}", *[dict(x.split("=", 1) for x in f.folder.split("/") if x).get(p) for p in d.partitions]) for f in self._state(dataset, version).values()]
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in ("file", *d.partitions)]))

    def scan_report(self, dataset: str, filters: list[P.Predicate] = (), columns: list[str] | None = None, partitions: dict[str, list[str]] | None = None, version: int | None = None) -> DataFrame:
        """What a scan reads of each file, from footers alone; nothing is scanned, and no footer reaches the driver.

        (file, row_groups, rows, bytes) of each file of the version, and (row_groups_read, rows_read, bytes_read): those that
        the partitions leave and whose statistics don't rule out that a row meets all filters; bytes of the columns asked for
        and filtered. A group without statistics of a field is read.
        """
        d = self.registry[dataset]
        files = self._file_table(dataset, version)
        kept = F.lit(True)
        for key, values in (partitions or {}).items():
            kept = kept & (F.col(key).isin(list(values)) if values else F.lit(False))
        implied = P.implied_partitions(d, list(filters))
        files = files.withColumn("kept", kept if implied is None else kept & implied)
        wanted = {*(columns or d.names), *(p.field for p in filters)}
        stats = footers(self.spark, files).withColumn("open", may_match(d, list(filters)))
        groups = stats.groupBy("file", "kept", "row_group").agg(F.first("rows").alias("rows"), F.bool_and("open").alias("open"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("field").isin(*wanted), F.col("bytes")).otherwise(0)).alias("wanted"))
        read = lambda c: F.sum(F.when(F.col("kept") & F.col("open"), c).otherwise(0))
        return groups.groupBy("file").agg(F.count("*").alias("row_groups"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), read(F.lit(1)).alias("row_groups_read"), read(F.col("rows")).alias("rows_read"), read(F.col("wanted")).alias("bytes_read"))


def reconciled_partitions(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts by partition on both sides: ok, missing (in the target), extra, or mismatch."""
    a = source.groupBy(*keys).agg(F.count("*").alias("source_rows"))
    b = target.groupBy(*keys).agg(F.count("*").alias("target_rows"))
    status: Column = F.when(F.col("target_rows").isNull(), "missing").when(F.col("source_rows").isNull(), "extra").when(F.col("source_rows") == F.col("target_rows"), "ok").otherwise("mismatch")
    return a.join(b, keys, "full_outer").withColumn("status", status)


def migrated(rows: DataFrame, dataset: Dataset, mapping: dict[str, tuple[str, float]]) -> DataFrame:
    """Rows of an older layout: ``mapping`` gives for each field its source column and a scale; NaN becomes null."""
    from tidelake.functions.dates import converted

    kinds = dict(rows.dtypes)
    out = []
    for f in dataset.fields:
        if f.name not in mapping:
            out.append(F.lit(None).cast(dataset.schema(False)[f.name].dataType).alias(f.name))
            continue
        src, scale = mapping[f.name]
        c = F.col(src)
        if f.type in ("date", "timestamp"):
            c = converted(c, kinds[src], f.type)
        elif f.type == "float64":
            c = F.when(~F.isnan(c.cast("double")), c.cast("double") * scale if scale != 1 else c.cast("double"))
        out.append(c.cast(dataset.schema(False)[f.name].dataType).alias(f.name))
    return rows.select(*out, *[p for p in dataset.partitions if p in rows.columns])


#: Columns of the older layout that have other names here, with scales.
OLD_NAMES = {
    "bars_daily": {"ts_code": "code", "trade_date": "date", "vol": "volume", "turnover_rate": "turnover", "turnover_rate_f": "turnover_free", "dv_ratio": "dv_yield"},
    "bars_1m": {"ts_code": "code", "trade_time": "datetime", "vol": "volume"},
    "adj_factor": {"ts_code": "code", "trade_date": "date", "adj_factor": "factor"},
    "corporate_actions": {"ts_code": "code", "ex_date": "date"},
}
OLD_SCALES = {("bars_1m", "amount"): 0.001}


def old_mapping(dataset: Dataset) -> dict[str, tuple[str, float]]:
    return {f.name: (OLD_NAMES[dataset.name].get(f.name, f.name), OLD_SCALES.get((dataset.name, f.name), 1.0)) for f in dataset.fields}
