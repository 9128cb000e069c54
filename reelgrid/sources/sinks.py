"""Writing tables: append, replace by source, publish as a whole, profiles with versions."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import documents
from reelgrid.functions.ordering import latest

from .shared import exists, remove, written

# Fixed value: what a preset uses where it says nothing readable.
PRESET_SETTINGS = '{"watch_history": true, "ratings": true, "reviews": true}'


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace_sources(df: DataFrame, path: str, by: str = "source") -> None:
    """Write df in place of the partitions that it has, leaving others: a reload that can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Write df beside path and swap it in when it is whole; a failed write leaves the old table."""
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm = spark.sparkContext._jvm
    new, old, gone = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, path, f"{path}.old-{uuid.uuid4().hex}"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(old)
    if had and not fs.rename(old, gone):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(gone, old)
        raise OSError(f"{staged} can't take the place of {path}")
    if had:
        fs.delete(gone, True)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def unmatched(rows: DataFrame, matched: DataFrame, key: str, path: str) -> DataFrame:
    """Rows whose key has no match, also written as JSON for another source to look up."""
    left = rows.join(matched.select(key).distinct(), key, "left_anti")
    json_lines(left, path)
    return left


def table_statistics(spark: SparkSession, name: str) -> None:
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def created(spark: SparkSession, path: str, lines: list[str]) -> bool:
    """Whether this call has made the file at path, with all lines in it; False where there was one already.

    Of several callers one is told True, and nobody finds a part of a file: on a local or
    network disk by a hard link, on HDFS by a rename that doesn't replace, elsewhere by a create
    that doesn't, which an object store has to carry out as a conditional put.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs, content = target.getFileSystem(conf), "".join(f"{x}\n" for x in lines).encode()
    scheme, aside = fs.getUri().getScheme(), f".{target.getName()}-{uuid.uuid4().hex}"
    fs.mkdirs(target.getParent())
    if scheme == "file":
        own = os.path.join(target.getParent().toUri().getPath(), aside)
        with open(own, "xb") as f:
            f.write(content)
        try:
            os.link(own, target.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    renames = scheme in ("hdfs", "viewfs")
    place = jvm.org.apache.hadoop.fs.Path(target.getParent(), aside) if renames else target
    try:
        out = fs.create(place, False)
        out.write(content)
        out.close()
        if renames:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(place, target, how)
    except Py4JJavaError:
        if renames:
            fs.delete(place, False)
        if fs.exists(target):
            return False
        raise
    return True


class States:
    """A table that grows by folders: state n is a file that lists them, made by one writer alone (see created).

    A writer reads the last state, writes a folder beside those it lists, and asks to make the
    next state; who comes second starts again. So a writer that has stalled holds nobody up and
    can't override anybody when it goes on. A folder that no state lists is never read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _file(self, n: int) -> str:
        return f"{self.path}/states/{n:012d}"

    def last(self) -> tuple[int, list[str]]:
        """The number of the last state, 0 if there is none, and its folders."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/states")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        n = max((int(x) for x in names if x.isdigit()), default=0)
        if not n:
            return 0, []
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(self._file(n)))
        try:
            return n, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def append(self, write: Callable[[str], None], n: int, folders: list[str]) -> bool:
        """Whether folders and one more, which write fills, have become state n + 1."""
        own = uuid.uuid4().hex
        write(self.paths([own])[0])
        if created(self.spark, self._file(n + 1), [*folders, own]):
            return True
        remove(self.spark, *self.paths([own]))
        return False

    def paths(self, folders: list[str]) -> list[str]:
        return [f"{self.path}/rows/folder={x}" for x in folders]


class ProfileStore:
    """Profile documents as an append-only log of versions; the current one is the latest row of a user.

    Each save is a folder of States. A saver whose state was made by another in the meantime
    compares again with what is current by then.
    """

    SCHEMA = "user_id string, profile_json string, version long, updated_at timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.states = spark, path, States(spark, path)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*self.states.paths(folders))

    def log(self) -> DataFrame:
        return self._rows(self.states.last()[1])

    def current(self) -> DataFrame:
        return latest(self.log(), ["user_id"], [F.col("version"), F.col("updated_at")])

    def save(self, profiles: DataFrame) -> DataFrame:
        """Append profiles (user_id, profile_json, version as read, null if new) whose version is still current; return those that were refused."""
        while True:
            n, folders = self.states.last()
            now = self.current().select("user_id", F.col("version").alias("_now"))
            compared = written(profiles.join(now, "user_id", "left").withColumn("_fresh", F.col("_now").isNull() | F.col("_now").eqNullSafe(F.col("version"))).drop("_now"), "compared")
            accepted, refused = (compared.filter(F.col("_fresh") == x).drop("_fresh") for x in (True, False))
            rows = accepted.select("user_id", "profile_json", (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.current_timestamp().alias("updated_at"))
            if self.states.append(rows.write.parquet, n, folders):
                return refused

    def compact(self) -> bool:
        """Put all folders of the log together into one, with all versions; False if a saver came between. Folders that were read stay for who still reads them."""
        n, folders = self.states.last()
        return len(folders) < 2 or self.states.append(self._rows(folders).write.parquet, n, [])

    def readable(self) -> tuple[DataFrame, DataFrame]:
        """Current profiles parsed, and the rows to set aside because they are no documents."""
        rows = self.current()
        good = rows.filter(documents.is_document(F.col("profile_json")))
        bad = rows.filter(~documents.is_document(F.col("profile_json")))
        return good.withColumn("profile", documents.parsed_profile(F.col("profile_json"))), bad

    def summaries(self) -> DataFrame:
        """Users with the number of what they rated, newest first."""
        good, _ = self.readable()
        return good.select("user_id", "updated_at", F.size("profile.watch_history").alias("num_watched")).orderBy(F.desc("updated_at"), "user_id")


def merged_profile(fresh, local) -> dict:
    """Columns that join two versions of a profile struct: maps with the local value first, sets united, the last 50 queries."""
    out = {}
    for field in documents.PROFILE.split(", "):
        name, kind = field.split(" ", 1)
        a, b = fresh.getField(name), local.getField(name)
        if kind.startswith("map"):
            out[name] = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
        elif name == "query_history":
            both = F.concat(a, F.array_except(b, a))
            out[name] = F.slice(both, F.greatest(F.size(both) - 49, F.lit(1)), 50)
        elif kind.startswith("array"):
            out[name] = F.array_union(a, b)
        else:
            out[name] = F.coalesce(b, a)
    return out


def activated_presets(presets: DataFrame, chosen: DataFrame) -> DataFrame:
    """presets with exactly the chosen one (user_id, name) of those users active; none where name is null."""
    rows = presets.join(chosen.select("user_id", F.col("name").alias("_name"), F.lit(True).alias("_asked")), "user_id", "left")
    active = F.when(F.col("_asked"), F.coalesce(F.col("name") == F.col("_name"), F.lit(False))).otherwise(F.col("is_active"))
    return rows.withColumn("is_active", active).select(*presets.columns)


def updated_presets(presets: DataFrame, changes: DataFrame) -> DataFrame:
    """presets with the slider and settings of changes (user_id, name, lambda_val, settings)."""
    new = changes.select("user_id", "name", F.col("lambda_val").alias("_l"), F.col("settings").alias("_s"), F.lit(True).alias("_new"))
    rows = presets.join(new, ["user_id", "name"], "left")
    return rows.withColumns({"lambda_val": F.when(F.col("_new"), F.col("_l")).otherwise(F.col("lambda_val")), "settings": F.when(F.col("_new"), F.col("_s")).otherwise(F.col("settings"))}).select(*presets.columns)


def without_presets(presets: DataFrame, gone: DataFrame) -> DataFrame:
    """presets but those in gone (user_id, name)."""
    return presets.join(gone.select("user_id", "name"), ["user_id", "name"], "left_anti").select(*presets.columns)


def listed_presets(presets: DataFrame) -> DataFrame:
    """user_id and presets: name, lambda_val, settings (the defaults where they are no document) and is_active, in the order in which they were made."""
    settings = F.when(F.coalesce(documents.is_document(F.col("settings")), F.lit(False)), F.col("settings")).otherwise(F.lit(PRESET_SETTINGS))
    row = F.struct("created_at", "name", "lambda_val", settings.alias("settings"), "is_active")
    return presets.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("presets"))


def active_presets(presets: DataFrame) -> DataFrame:
    """The active preset of each user that has one."""
    return presets.filter("is_active").groupBy("user_id").agg(F.min(F.struct("name", "lambda_val", "settings")).alias("_p")).select("user_id", "_p.*")


class Results:
    """Results of searches, kept under what was asked by whom."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def get(self, make: Callable[[], DataFrame], user: str, query: str, top: int, slider: float = 0.7, unseen: bool = True) -> DataFrame:
        """The kept result, else what make returns, which is kept then."""
        key = hashlib.sha256(repr((user, query.strip().lower(), top, slider, unseen)).encode()).hexdigest()
        if not exists(self.spark, f"{self.path}/{key}"):
            publish(make(), f"{self.path}/{key}")
        return self.spark.read.parquet(f"{self.path}/{key}")

    def forget(self) -> None:
        """Drop all: for when a profile or the catalogue has changed."""
        remove(self.spark, self.path)
