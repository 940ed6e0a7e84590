"""Duplicate claims (V8) and claims of several rows (V18) on the landing stream, with keyed state.

Two streams, chained by folders. The intake stream (``ingest.start`` with ``rows_path``) leaves each
micro-batch's claim keys there, complete or not at all:

    rows/batch-<n>      one row a claim row: its place and its claim_id, norm_id, loss_date
    places/batch-<n>    one row a file block and task that read it: its number, in the order of arrival
    digests/batch-<n>   one row a key: how many rows of the batch have it, and the first of them

A row's place in its batch (file name, block, position) is one number from then on, ``at``: the number of its place and the row's
own within it. So what is shuffled, kept as state and written for a row or a key are a few numbers beside the key, no file names.

The second stream (``start``) reads the digests and keeps, for every key, its rows so far and its first
row in a stateful aggregate (RocksDB state store). A key held by a third of all rows is
one digest a batch. A micro-batch gets the changed keys only, joins them with the rows of its own batches (keys
larger than a partition's share are split) and writes the rows that have an issue from now on. Each is written once:

* V8: a row is a duplicate if an earlier row has its (norm_id, loss_date). "Earlier" is the order of arrival:
  by micro-batch of the intake, then file name, then line. So a later batch never takes an issue back.
* V18: all rows of a claim_id with several rows. When the second one arrives, the first is written too. The
  number in the detail goes on growing; ``set_issues`` takes it from the latest count, and file, block and position from the places.

NULL keys are one group, as in the batch rules. If the files arrive in the order in which a batch run reads them, the
issues equal that run's.

Restarts: a batch's folder is written aside and renamed into place, and a try that finds it there leaves it, so a replayed
micro-batch of either stream adds nothing. This needs a file system whose folder rename is atomic. The
state holds one entry a distinct key, for good (folders and checkpoints of versions that kept file names in it are not read); its number of partitions is ``spark.sql.shuffle.partitions`` at the
first start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe import constants as K
from lossframe.functions.names import norm_id
from lossframe.operators.history import _exists, _fs_path
from lossframe.operators.numbering import BLOCK, BROADCAST_ROWS, POSITION
from lossframe.operators.rules import RuleConfig
from lossframe.session import STORED_CODEC, persist_table, release_shuffles, release_tables, stored_tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Kinds of keys.
DUP, CLAIM, BATCH = 1, 2, 3


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


INT, LONG, TEXT, DATE = T.IntegerType(), T.LongType(), T.StringType(), T.DateType()
ROWS = T.StructType(_fields(batch_id=LONG, source_file=TEXT, block=LONG, position=LONG, row_hash=LONG, claim_id=TEXT, norm_id=TEXT,
                            loss_date=DATE))
PLACES = T.StructType(_fields(batch_id=LONG, source_file=TEXT, block=LONG, task=LONG, place=LONG, n=LONG))
DIGESTS = T.StructType(_fields(kind=INT, k1=TEXT, loss_date=DATE, n=LONG, batch_id=LONG, at=LONG, row_hash=LONG))
HITS = T.StructType(_fields(batch_id=LONG, at=LONG, row_hash=LONG, claim_id=TEXT, kind=INT))
COUNTS = T.StructType(_fields(claim_id=TEXT, n=LONG))
KEY = ["kind", "k1", "loss_date"]
#: Bits of a position that count rows; those above are the task's (``monotonically_increasing_id``).
ROW_BITS = 33


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/batch-{batch_id:012d}"


def publish(df: DataFrame, path: str, batch_id: int) -> None:
    """Write ``df`` as the batch's folder, whole or not at all; an earlier try's folder stays as it is."""
    spark, target = df.sparkSession, _folder(path, batch_id)
    if _exists(spark, target):
        return
    aside = f"{path}/_aside-{uuid.uuid4().hex}"  # names with an underscore are not listed by readers
    release_shuffles(spark)
    df.write.option("compression", STORED_CODEC).parquet(aside)
    fs, src = _fs_path(spark, aside)
    if not fs.rename(src, _fs_path(spark, target)[1]):
        raise OSError(f"could not rename {aside} to {target}")


def _read(spark: SparkSession, path: str, schema: T.StructType, batches: list[int] | None = None) -> DataFrame:
    """The published rows of all or the given batches."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    paths = [path] if batches is None else [_folder(path, b) for b in batches]
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)


def publish_rows(std: DataFrame, path: str, batch_id: int) -> None:
    """Leave the claim keys of one landed batch: its rows, then their digests (which the second stream follows).

    ``std``: standardised claims with ``row_hash``, ``BLOCK`` and ``POSITION``.
    """
    rows = std.select(F.lit(batch_id).cast("long").alias("batch_id"), "source_file", F.col(BLOCK).alias("block"),
                      F.col(POSITION).alias("position"), "row_hash", "claim_id", norm_id(F.col("claim_id")).alias("norm_id"), "loss_date")
    publish(rows, f"{path}/rows", batch_id)
    spark = std.sparkSession
    stored = _read(spark, f"{path}/rows", ROWS, [batch_id])
    task = F.shiftright("position", ROW_BITS).alias("task")
    found = stored.groupBy("source_file", "block", task).agg(F.count(F.lit(1)).alias("n")).collect()  # file blocks, never rows
    found.sort(key=lambda r: ((r["source_file"] or "").encode(), r["block"], r["task"]))
    places = spark.createDataFrame([(batch_id, r["source_file"], r["block"], r["task"], i, r["n"]) for i, r in enumerate(found)], PLACES)
    publish(places.coalesce(1), f"{path}/places", batch_id)
    rows = _placed(stored, _read(spark, f"{path}/places", PLACES, [batch_id]))
    no_date, no_hash = F.lit(None).cast("date").alias("loss_date"), F.lit(None).cast("long").alias("row_hash")
    keys = F.array(F.struct(F.lit(DUP).alias("kind"), F.col("norm_id").alias("k1"), F.col("loss_date"), no_hash),
                   F.struct(F.lit(CLAIM).alias("kind"), F.col("claim_id").alias("k1"), no_date, F.col("row_hash")))
    digests = (rows.select("at", F.explode(keys).alias("k")).select("k.*", "at").groupBy(*KEY)
               .agg(F.count(F.lit(1)).alias("n"), F.lit(batch_id).cast("long").alias("batch_id"), F.min("at").alias("at"),
                    F.min_by("row_hash", "at").alias("row_hash")))
    own = [(BATCH, str(batch_id), None, sum(r["n"] for r in found), batch_id, 0, None)] if found else []
    publish(digests.unionByName(spark.createDataFrame(own, DIGESTS).coalesce(1)), f"{path}/digests", batch_id)


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with ``at``, their place among all rows of their batch in the order of arrival, for (source_file, block, position)."""
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    met = F.shiftright("r.position", ROW_BITS) == F.col("p.task")
    for c in ("batch_id", "source_file", "block"):
        met = met & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    at = F.shiftleft("p.place", ROW_BITS).bitwiseOR(F.col("r.position").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    return rows.alias("r").join(places.alias("p"), met).select("r.batch_id", at.alias("at"), "r.row_hash", "r.claim_id", "r.norm_id", "r.loss_date")


def _same(left: str, right: str, columns: list[str]):
    met = F.col(f"{left}.{columns[0]}").eqNullSafe(F.col(f"{right}.{columns[0]}"))
    for c in columns[1:]:
        met = met & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return met


def _meet(rows: DataFrame, keys: DataFrame, size: str, of: list[str]) -> DataFrame:
    """``rows`` (with ``KEY``, ``batch_id`` and ``at``) joined with the columns ``of`` their key.

    ``size``: how many of ``rows`` a key has. Keys above a partition's fair share are split by exact
    size; at most as many keys as partitions can be above it for each kind, so their list is small.
    """
    total = keys.agg(F.sum(size)).first()[0] or 0
    share = max(1, -(-total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(F.col(size) / F.lit(share)).cast("int")
    hot = keys.where(F.col(size) > share).select(*KEY, salts.alias("salts"))
    salted = (rows.alias("r").join(F.broadcast(hot).alias("h"), _same("r", "h", KEY), "left").select(
        "r.*", F.coalesce(F.pmod(F.xxhash64("r.batch_id", "r.at"), F.col("h.salts").cast("long")).cast("int"), F.lit(0)).alias("salt")))
    spread = keys.select(*KEY, *of, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return salted.alias("r").join(spread.alias("k"), _same("r", "k", [*KEY, "salt"])).select(
        *[f"r.{c}" for c in rows.columns], *[f"k.{c}" for c in of])


def start(spark: SparkSession, rows_path: str, out_path: str, checkpoint_location: str, cfg: RuleConfig | None = None,
          available_now: bool = True):
    """Run the keyed stream over what ``ingest.start(rows_path=...)`` leaves; ``set_issues`` reads ``out_path``."""
    cfg = cfg or RuleConfig()
    kinds = [k for k, on in ((DUP, cfg.rule_duplicates), (CLAIM, cfg.rule_multi_rows_per_claim)) if on]

    def sink(state: DataFrame, batch_id: int) -> None:
        before = set(stored_tables(spark))
        many = F.col("kind").isin(*kinds) & (F.col("n") > 1)
        changed = persist_table(state.where(many | (F.col("kind") == BATCH)), "claim-state")  # the streamed plan runs once
        batches = sorted(int(r[0]) for r in changed.where(F.col("kind") == BATCH).select("k1").collect())  # batches of the intake
        if batches:
            met = changed.where(many)
            if len(batches) > 1:  # one batch has one digest a key, and the state has its number
                own = _read(spark, f"{rows_path}/digests", DIGESTS, batches).groupBy(*KEY).agg(F.sum("n").alias("n_new"))
                met = met.drop("n_new").alias("c").join(own.alias("o"), _same("c", "o", KEY)).select("c.*", "o.n_new")
            keys = persist_table(met, "claim-changes")
            release_tables(spark, [p for p in stored_tables(spark) if p not in before and "/claim-state-" in p])
            no_date, no_id = F.lit(None).cast("date").alias("loss_date"), F.lit(None).cast("string").alias("claim_id")
            # a claim's key is its claim_id; a duplicate's is not
            each = F.array(F.struct(F.lit(DUP).alias("kind"), F.col("norm_id").alias("k1"), F.col("loss_date"), F.col("claim_id")),
                           F.struct(F.lit(CLAIM).alias("kind"), F.col("claim_id").alias("k1"), no_date, no_id))
            rows = _placed(_read(spark, f"{rows_path}/rows", ROWS, batches), _read(spark, f"{rows_path}/places", PLACES, batches))
            rows = rows.select("batch_id", "at", "row_hash", F.explode(each).alias("k")).select("batch_id", "at", "row_hash", "k.*")
            is_claim, claim_id = F.col("kind") == CLAIM, F.when(F.col("kind") == CLAIM, F.col("k1")).otherwise(F.col("claim_id")).alias("claim_id")
            first = (F.col("batch_id") == F.col("first_batch")) & (F.col("at") == F.col("first_at"))
            new = _meet(rows, keys, "n_new", ["first_batch", "first_at"]).where(is_claim | ~first)
            # the only row that the claim had before
            late = keys.where(is_claim & (F.col("n") - F.col("n_new") == 1)).select(
                F.col("first_batch").alias("batch_id"), F.col("first_at").alias("at"), F.col("first_hash").alias("row_hash"),
                F.col("k1").alias("claim_id"), "kind")
            publish(_read(spark, f"{rows_path}/places", PLACES, batches).coalesce(1), f"{out_path}/places", batch_id)
            publish(new.select("batch_id", "at", "row_hash", claim_id, "kind").unionByName(late), f"{out_path}/hits", batch_id)
            publish(keys.where(is_claim).select(F.col("k1").alias("claim_id"), "n"), f"{out_path}/counts", batch_id)
        release_tables(spark, [p for p in stored_tables(spark) if p not in before])
        release_shuffles(spark)

    digests = spark.readStream.schema(DIGESTS).option("recursiveFileLookup", True).parquet(f"{rows_path}/digests")
    keyed = digests.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.max_by("n", "batch_id").alias("n_new"), F.min("batch_id").alias("first_batch"),
        F.min_by("at", "batch_id").alias("first_at"), F.min_by("row_hash", "batch_id").alias("first_hash"))
    w = keyed.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query takes the session's settings as it starts
    try:
        return w.start()
    finally:
        spark.conf.set(PROVIDER, provider)


def set_issues(spark: SparkSession, out_path: str) -> DataFrame:
    """V8 and V18 issues so far: batch_id, source_file, block, position, row_hash, claim_id, issue, detail, rule_order."""
    hits = _read(spark, f"{out_path}/hits", HITS)
    no_date = F.lit(None).cast("date").alias("loss_date")
    latest = _read(spark, f"{out_path}/counts", COUNTS).groupBy("claim_id").agg(F.max("n").alias("n"))
    counts = persist_table(latest, "claim-counts").select(F.lit(CLAIM).alias("kind"), F.col("claim_id").alias("k1"), no_date, "n")
    row = ["batch_id", "at", "row_hash"]
    several = _meet(hits.where(F.col("kind") == CLAIM).select(*row, "kind", F.col("claim_id").alias("k1"), no_date), counts, "n", ["n"])
    dup = hits.where(F.col("kind") == DUP).select(*row, "claim_id", F.lit(K.ISSUE_DUPLICATE).alias("issue"),
                                                  F.lit(K.DETAIL_DUPLICATE).alias("detail"), F.lit(8).alias("rule_order"))
    multi = several.select(*row, F.col("k1").alias("claim_id"), F.lit(K.ISSUE_MULTI_ROWS).alias("issue"),
                           F.concat(F.lit("n="), F.col("n").cast("string")).alias("detail"), F.lit(19).alias("rule_order"))
    places = _read(spark, f"{out_path}/places", PLACES)
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    own = (F.col("i.batch_id") == F.col("p.batch_id")) & (F.shiftright("i.at", ROW_BITS) == F.col("p.place"))
    release_shuffles(spark)
    position = F.shiftleft("p.task", ROW_BITS).bitwiseOR(F.col("i.at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("position")
    return dup.unionByName(multi).alias("i").join(places.alias("p"), own).select(
        "i.batch_id", "p.source_file", "p.block", position, "i.row_hash", "i.claim_id", "i.issue", "i.detail", "i.rule_order")
