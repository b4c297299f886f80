"""A manifest of batches, or any keyed table, in versions: upserts by several writers at once lose no row.

Rows lie in Parquet folders that Spark writes and nobody changes. A version is a small file that lists them in order; a later
folder's row takes the place of an earlier one's with the same keys. A commit makes the file of the next number, which fails
if that is there already: then the newest version is read again and the change is made to that one. Readers see whole versions, and
an old one as long as it is kept.

Scale: a commit writes its own rows only. A snapshot groups the folders' rows by key once; compact() does that for good. The
driver holds the list of folders.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RETRIES, WAIT = 50, 0.02


def created(uri: str, body: bytes) -> bool:
    """Makes a file, whole or not at all, if none of that name is there; whether it did. For folders that are mounted; other stores need their own."""
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"{uri}: pass a function that makes a file only if it is absent")
    path = uri.removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        file.write(body)
    try:
        os.link(part, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(part)


@dataclass(frozen=True)
class Version:
    number: int
    folders: tuple[dict, ...]


class Manifest:
    """The table under `uri` with rows keyed by `keys`; create(uri, body) makes a file if it is absent and says whether it did."""

    def __init__(self, spark: SparkSession, uri: str, keys: list[str], create: Callable[[str, bytes], bool] = created):
        self.spark, self.uri, self.keys, self.create = spark, uri.rstrip("/"), keys, create

    def _files(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number; 0 is the empty one before any commit."""
        from pyarrow import fs

        store, path = self._files()
        found = store.get_file_info(fs.FileSelector(f"{path}/versions", allow_not_found=True))
        known = sorted(int(f.base_name[1:-5]) for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json"))
        if number is None:
            number = known[-1] if known else 0
        if number == 0:
            return Version(0, ())
        if number not in known:
            raise KeyError(f"no version {number} of {self.uri}")
        with store.open_input_file(f"{path}/versions/v{number:020d}.json") as file:
            return Version(number, tuple(json.loads(file.read())))

    def _write(self, rows: DataFrame) -> tuple[dict, int]:
        """A new folder with rows, and how many they are, in one job."""
        seen = Observation()
        name = uuid.uuid4().hex
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.uri}/data/{name}")
        return {"folder": name, "schema": rows.schema.json()}, seen.get["n"]

    def _commit(self, change: Callable[[tuple[dict, ...]], tuple[dict, ...] | None]) -> int | None:
        for turn in range(RETRIES):
            now = self.version()
            if (folders := change(now.folders)) is None:
                return None
            if self.create(f"{self.uri}/versions/v{now.number + 1:020d}.json", json.dumps(folders).encode()):
                return now.number + 1
            time.sleep(WAIT * (turn + 1))
        raise TimeoutError(f"{RETRIES} commits to {self.uri} met another one")

    def upsert(self, rows: DataFrame) -> tuple[int, int]:
        """Commits rows in place of those of the same keys: the version's number and the rows written. Of rows of one key in `rows` one stays, the greatest by all columns.

        Columns may differ from commit to commit; what a row lacks is null.
        """
        rest = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*self.keys, "_row.*") if rest else rows.distinct()
        folder, n = self._write(one.select(*rows.columns))
        return self._commit(lambda old: (*old, folder)), n

    def snapshot(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is given; None before any commit."""
        return self._rows(self.version(number).folders)

    def _rows(self, folders: tuple[dict, ...]) -> DataFrame | None:
        whole = None
        for k, f in enumerate(folders):
            rows = self.spark.read.schema(StructType.fromJson(json.loads(f["schema"]))).parquet(f"{self.uri}/data/{f['folder']}").withColumn("_load", F.lit(k))
            whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
        if whole is None or len(folders) == 1:
            return whole and whole.drop("_load")
        rest = [c for c in whole.columns if c not in (*self.keys, "_load")]
        last = whole.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(0).alias("_"), *rest), "_load").alias("_row"))
        return last.select(*[c if c in self.keys else F.col(f"_row.{c}").alias(c) for c in whole.columns if c != "_load"])

    def compact(self) -> int | None:
        """One folder in place of those of the newest version. What others commit meanwhile stays behind it; None if another one compacted."""
        old = self.version().folders
        if len(old) < 2:
            return None
        folder, _ = self._write(self._rows(old))
        return self._commit(lambda now: (folder, *now[len(old) :]) if now[: len(old)] == old else None)
