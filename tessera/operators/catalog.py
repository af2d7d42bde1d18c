"""Named datasets, snapshots and a version log over immutable Parquet files, which go when nothing names them any more."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, col, user_columns
from ..functions.storage import delete_tables, durable, fresh_path
from .deltas import MOST_CHANGED, MOST_LAYERS, Layer, layer_of, merged
from .edits import apply_cell_edits, rejected_edits
from .rowid import assign_row_id

MAX_VERSIONS = 100


@dataclass
class Dataset:
    name: str
    path: str
    source_type: str
    created_at: str
    columns: list[str]
    row_count: int = 0
    id: str = ""
    base_rows: int = 0
    layers: list[Layer] = field(default_factory=list)

    @property
    def files(self) -> list[str]:
        return [self.path, *(x.path for x in self.layers)]


@dataclass
class Catalog:
    """Datasets of a session, by id; names may repeat, but then only ids tell them apart.

    Data never changes in place.  ``materialize`` writes a new base; edits write
    the rows they change (``deltas``), until there are too many of them and a new
    base is written.  Datasets, snapshots and versions share files; a file that
    none of them names any more is deleted (with the tables that were read from
    it: store results before dropping what they come from).
    """

    spark: SparkSession
    datasets: dict[str, Dataset] = field(default_factory=dict)
    snapshots: dict[str, dict[str, Dataset]] = field(default_factory=dict)
    log: list[tuple[str, dict[str, Dataset]]] = field(default_factory=list)
    at: int = -1

    # Which dataset is meant.

    def find(self, key: str) -> Dataset:
        """The dataset with an id, or else the only one of a name."""
        if key in self.datasets:
            return self.datasets[key]
        named = [d for d in self.datasets.values() if d.name == key]
        if not named:
            raise ValueError(f"no such dataset: {key}")
        if len(named) > 1:
            raise ValueError(f"{len(named)} datasets are called {key}; use an id: {', '.join(d.id for d in named)}")
        return named[0]

    def _keep(self, dataset: Dataset) -> Dataset:
        self.datasets[dataset.id] = dataset
        return dataset

    # Files in use.

    def _states(self) -> Iterator[dict[str, Dataset]]:
        yield self.datasets
        yield from self.snapshots.values()
        yield from (held for _, held in self.log)

    def references(self) -> dict[str, int]:
        """Files and how many datasets, snapshots and versions name each."""
        out: dict[str, int] = {}
        for held in self._states():
            for d in held.values():
                for path in d.files:
                    out[path] = out.get(path, 0) + 1
        return out

    def _collect(self, before: dict[str, int]) -> list[str]:
        """Delete what was named before and isn't any more."""
        now = self.references()
        gone = [p for p in before if p not in now]
        delete_tables(self.spark, list(gone))
        return gone

    # Datasets.

    def add(self, df: DataFrame, name: str, source_type: str = "manual") -> Dataset:
        """A new dataset, whether or not there are others of its name."""
        return self._keep(self._stored(df, Dataset(name, "", source_type, "", [], id=uuid.uuid4().hex)))

    def _stored(self, df: DataFrame, like: Dataset) -> Dataset:
        rows = df if ROW_ID in df.columns else assign_row_id(df)
        path = fresh_path(self.spark, "dataset")
        rows.write.parquet(path)
        count = self.spark.read.parquet(path).count()  # from the files' footers
        return replace(like, path=path, created_at=datetime.now(UTC).isoformat(), columns=user_columns(rows), row_count=count, base_rows=count, layers=[])

    def materialize(self, df: DataFrame, name: str, source_type: str = "manual") -> DataFrame:
        """Store ``df`` (numbered, if it has no row ids) as the dataset ``name`` (a name or an id), in place of one there is."""
        before = self.references()
        known = name in self.datasets or any(d.name == name for d in self.datasets.values())
        old = self.find(name) if known else None
        new = self._keep(self._stored(df, replace(old, source_type=source_type))) if old else self.add(df, name, source_type)
        out = self.get(new.id)
        self._collect(before)
        return out

    def get(self, name: str) -> DataFrame:
        d = self.find(name)
        return merged(self.spark, Layer(d.path, d.base_rows), d.layers)

    def list(self) -> list[Dataset]:
        """Newest first."""
        return sorted(self.datasets.values(), key=lambda d: d.created_at, reverse=True)

    def rename(self, old: str, new: str) -> None:
        self._keep(replace(self.find(old), name=new))

    def drop(self, name: str) -> None:
        """Forget a dataset (if there is one); its files go unless a snapshot or version has them."""
        before = self.references()
        if name in self.datasets or any(d.name == name for d in self.datasets.values()):
            del self.datasets[self.find(name).id]
        self._collect(before)

    # Edits, which store only what they change.

    def _layered(self, d: Dataset, changed: DataFrame | None, deleted: DataFrame | None) -> DataFrame:
        before = self.references()
        schema = self.spark.read.parquet(d.path).schema
        path = fresh_path(self.spark, "layer")
        layer_of(changed, deleted, schema, self.spark).write.parquet(path)
        layers = [*d.layers, Layer(path, self.spark.read.parquet(path).count())]
        new = replace(d, layers=layers)
        if len(layers) > MOST_LAYERS or sum(x.rows for x in layers) > max(1000, MOST_CHANGED * d.base_rows):
            stored = self._stored(merged(self.spark, Layer(d.path, d.base_rows), layers), d)
            delete_tables(self.spark, [path])
            new = replace(stored, created_at=d.created_at)
        else:
            new.row_count = merged(self.spark, Layer(d.path, d.base_rows), layers).count() if deleted is not None else d.row_count
        self._keep(new)
        out = self.get(d.id)
        self._collect(before)
        return out

    def _rows(self, d: Dataset, ids: DataFrame) -> DataFrame:
        return merged(self.spark, Layer(d.path, d.base_rows), d.layers, ids)

    def edit(self, name: str, edits: DataFrame, all_or_nothing: bool = False) -> DataFrame:
        """Cell edits (``_row_id, column, value[, seq]``, see ``edits.apply_cell_edits``); only the rows they name are read and written."""
        d = self.find(name)
        kept = durable(edits, "edits")
        rows = self._rows(d, kept.select(ROW_ID).distinct())
        return self._layered(d, apply_cell_edits(rows, kept, all_or_nothing), None)

    def rejected(self, name: str, edits: DataFrame) -> DataFrame:
        """The edits that ``edit`` would not write, with the reason."""
        return rejected_edits(self._rows(self.find(name), edits.select(ROW_ID).distinct()), edits)

    def delete_rows(self, name: str, ids: DataFrame) -> DataFrame:
        """Rows deleted by id (the first column of ``ids``)."""
        d = self.find(name)
        known = self._rows(d, ids.select(ids[0]).distinct()).select(ROW_ID)
        return self._layered(d, None, known)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows added at the end, columns by name; ids follow the largest that the dataset has."""
        d = self.find(name)
        current = self.get(d.id)
        top = current.agg(F.max(ROW_ID)).first()[0] or 0
        new = assign_row_id(rows).withColumn(ROW_ID, F.col(ROW_ID) + top)
        whole = new.unionByName(current.limit(0), allowMissingColumns=True).select(*map(col, current.columns))
        out = self._layered(d, whole, None)
        self._keep(replace(self.find(d.id), row_count=d.row_count + new.count()))
        return out

    # Versions and snapshots.

    def record(self, label: str) -> None:
        """Add the present state to the log; versions after the current one are forgotten, and the oldest beyond the limit."""
        before = self.references()
        self.log = [*self.log[: self.at + 1], (label, dict(self.datasets))][-MAX_VERSIONS:]
        self.at = len(self.log) - 1
        self._collect(before)

    def jump(self, to: int) -> None:
        if not 0 <= to < len(self.log):
            raise ValueError("no such version")
        before = self.references()
        self.at, self.datasets = to, dict(self.log[to][1])
        self._collect(before)

    def undo(self) -> None:
        self.jump(self.at - 1)

    def redo(self) -> None:
        self.jump(self.at + 1)

    def snapshot(self, name: str) -> None:
        before = self.references()
        self.snapshots[name] = dict(self.datasets)
        self._collect(before)

    def restore(self, name: str, only: str | None = None) -> None:
        """All datasets as they were, or one of them (by name or id); source types as they were, too."""
        held = self.snapshots[name]
        before = self.references()
        if only is None:
            self.datasets = dict(held)
        else:
            found = [d for d in held.values() if only in (d.id, d.name)]
            if len(found) != 1:
                raise ValueError(f"no dataset {only} in snapshot {name}" if not found else f"{len(found)} datasets in snapshot {name} are called {only}")
            self._keep(found[0])
        self._collect(before)

    def rename_snapshot(self, old: str, new: str) -> None:
        self.snapshots[new] = self.snapshots.pop(old)

    def delete_snapshot(self, name: str) -> None:
        before = self.references()
        del self.snapshots[name]
        self._collect(before)

    def described(self) -> DataFrame:
        """A row per dataset: name, source type, rows and columns, newest first."""
        rows = [(d.name, d.source_type, d.row_count, len(d.columns)) for d in self.list()]
        return self.spark.createDataFrame(rows, "name string, source_type string, row_count long, col_count int")

    def save(self, path: str) -> None:
        """Write what the catalog knows (names, snapshots, versions; the tables stay where they are) to ``path``."""
        flat = lambda sets: {k: asdict(d) for k, d in sets.items()}
        state = {"datasets": flat(self.datasets), "snapshots": {k: flat(v) for k, v in self.snapshots.items()}, "log": [[label, flat(v)] for label, v in self.log], "at": self.at}
        self.spark.range(1).select(F.lit(json.dumps(state)).alias("value")).coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """A catalog as another session saved it."""
        state = json.loads(spark.read.text(path, wholetext=True).where("value != ''").first()[0])

        def sets(held: dict) -> dict[str, Dataset]:
            found = [Dataset(**{**d, "layers": [Layer(**x) for x in d.get("layers", [])]}) for d in held.values()]
            return {d.id: d for d in found}

        return cls(spark, sets(state["datasets"]), {k: sets(v) for k, v in state["snapshots"].items()}, [(label, sets(v)) for label, v in state["log"]], state["at"])
