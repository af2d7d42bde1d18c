"""The corpus pipeline: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of their input, whatever their names:
an operator's own columns (``score``, ``k1``, ``n_words`` and so on) neither
replace nor join them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, ngram_join, packing, substring_dedup
from tessera.llm.durable import delete_tables, durable, fresh_path, noted_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Row hashes broadcast at most (about 60 MB as a hash table of two longs a row); more are joined by shuffle.
MOST_BROADCAST_ROWS = 600_000
#: What the last stage of a run wrote besides its result, by run.
_held: dict[object, list[str]] = {}
#: The run in hand; stages called by themselves count as a run per application, input and thread.
_run: ContextVar[object] = ContextVar("run", default=None)


def _stage(f: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the stage before it in the same run: that one's result is stored, or this one had no input."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = _run.get() or (spark.sparkContext.applicationId, sf_dir, threading.get_ident())
        delete_tables(spark, _held.pop(run_of, []))
        with noted_tables() as paths:
            out = f(spark, docs, sf_dir)
        _held[run_of] = paths
        return out

    return run_stage


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column but the text under a name that no operator uses for itself, and these names."""
    names = {c: "text" if c == "text" else f"__d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of the documents under their own names again; what an operator added goes."""
    return out.select(*names.values()).toDF(*names)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: all that have a letter, where any language could be learned."""
    model = langid.fit(docs.where(~langid.held_out()))
    own, names = _apart(docs)
    found = langid.identify(own.select("text", *[c for c in own.columns if c != "text"]), model)
    return _back(found.where(F.col("lang_pred") != "und"), names)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit hash of the row (``k1``, ``k2``), so that only rows equal in every column share it."""
    cols = [docs[c] for c in docs.columns]
    nulls = [c.isNull() for c in cols]  # a hash passes over null values
    return docs.withColumns({"k1": F.xxhash64(*cols, *nulls), "k2": F.xxhash64(F.lit("2"), *nulls, *reversed(cols))})


def _by_key(keyed: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a table of row hashes, broadcast only if it is counted to be small; texts then stay where they are."""
    side = F.broadcast(keys) if keys.count() <= MOST_BROADCAST_ROWS else keys
    return keyed.join(side, ["k1", "k2"], how)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, null last, and of the smallest row hash among equal ids; texts without words belong to no group and stay."""
    own, names = _apart(docs)
    keyed = _keyed(own)
    doc_id = F.col(names["doc_id"])
    row = F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), "k1", "k2")
    classes = ngram_join.near_duplicate_classes(keyed.select(row.alias("row"), "text"), "row")
    members = durable(classes.select("row.k1", "row.k2", (F.col("row") != F.col("component_id")).alias("goes"), (F.col("n_shingles") > 0).alias("grouped")), "members")
    out = _by_key(keyed, durable(members.where("goes").select("k1", "k2").distinct(), "goes"), "left_anti")
    repeated = durable(members.where("grouped and not goes").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "repeated")
    if not repeated.isEmpty():
        out = _by_key(out, repeated, "left_anti").unionByName(_by_key(out, repeated, "left_semi").dropDuplicates(["k1", "k2"]))
    return _back(out, names)


@_stage
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out of the texts; documents of which nothing is left go.  ``n_chars`` follows the text."""
    own, names = _apart(docs)
    out = substring_dedup.remove_repeats(own, id_col=names["doc_id"])
    return _back(out.where("n_removed < n_words"), names).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    own, names = _apart(docs)
    return _back(mixing.mix(own, id_col=names["doc_id"], source_col=names["source"]), names)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the sequences that hold them."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  A run owns its tables, so several may be under way at once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token = _run.set(object())
    try:
        for name, stage in STAGES:
            path = fresh_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        delete_tables(spark, _held.pop(_run.get(), []))
    finally:
        _run.reset(token)
    return docs
