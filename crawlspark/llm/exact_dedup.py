"""Exact dedup by deterministic block naming.

Texts are lower-cased (A-Z only), cut into blocks of a fixed number of bytes, and
the sorted blocks get integer names: equal blocks one name, different blocks
different ones. Adjacent names are then named again in pairs, level by level,
until each document has one name. Names compare contents, never hashes, so two
documents have the same (number of blocks, name) exactly when their texts are equal.

Scale: a map task names its own equal blocks first, so a block that a third of all
documents hold is shuffled once per 16 MB segment. Contents are shuffled once;
every level after the first moves only integers of documents that still have
several names. Nothing is collected but the largest number of blocks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, load, text_slices, to_bytes

_SCHEMA = "code long, block binary, rid long, doc_id long, codes array<long>, sha binary"
_ARROW = pa.schema([("code", pa.int64()), ("block", pa.binary()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int64())), ("sha", pa.binary())])


def _cut(block_bytes: int, segment_bytes: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 40
        known: dict[bytes, int] = {}
        held = next_code = next_row = 0
        for batch in text_slices(batches, 1):
            blocks, docs = ([], []), ([], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1))):
                text = text.lower()  # of bytes: A-Z only
                codes = []
                for i in range(0, max(1, len(text)), block_bytes):
                    block = text[i : i + block_bytes]
                    code = known.get(block)
                    if code is None:
                        code = known[block] = base + next_code
                        next_code += 1
                        held += len(block)
                        blocks[0].append(code)
                        blocks[1].append(block)
                    codes.append(code)
                for out, x in zip(docs, (base + next_row, doc_id, codes, hashlib.sha256(text).digest())):
                    out.append(x)
                next_row += 1
            n, m = len(blocks[0]), len(docs[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks[0] + [None] * m, pa.int64()),
                    pa.array(blocks[1] + [None] * m, pa.binary()),
                    pa.array([None] * n + docs[0], pa.int64()),
                    pa.array([None] * n + docs[1], pa.int64()),
                    pa.array([None] * n + docs[2], pa.list_(pa.int64())),
                    pa.array([None] * n + docs[3], pa.binary()),
                ],
                schema=_ARROW,
            )
            if held > segment_bytes:
                known, held = {}, 0

    return run


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, segment_bytes: int = 16 << 20, work: Workspace | None = None) -> DataFrame:
    """One row per input row: rid (unique), doc_id, sha (of the normalised text), n_blocks, name.

    Null text is empty text; an empty text is one empty block. Null and repeated
    ids are kept, each row for itself. Other columns are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "blocks")
    cut = work.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(block_bytes, segment_bytes), _SCHEMA), "cut")
    # the window sorts the blocks; a name is the least code that its block has anywhere
    names = work.save(cut.where("code is not null").select("code", F.min("code").over(W.partitionBy("block")).alias("name")), "names")
    rows = cut.where("rid is not null").select("rid", "doc_id", "sha", "codes")
    named = rows.select("rid", F.posexplode("codes").alias("pos", "code")).join(names, "code").groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    left = work.save(named.withColumn("n_blocks", F.size("names")), "level0")
    done = [left.where("n_blocks = 1").select("rid", "n_blocks", F.col("names")[0].alias("name"))]
    longest = left.agg(F.max("n_blocks")).first()[0] or 0
    level = 0
    left = left.where("n_blocks > 1")
    while longest > 1:
        level += 1
        pairs = left.select("rid", "n_blocks", F.posexplode(F.expr("transform(sequence(0, size(names) - 1, 2), i -> struct(names[i] as a, get(names, i + 1) as b))")).alias("pos", "p")).select("rid", "n_blocks", "pos", "p.a", "p.b")
        # written before use: the ids hold for every later reader
        named = work.save(pairs.select("a", "b").distinct().withColumn("name", F.monotonically_increasing_id()), f"pairs{level}").select(F.col("a").alias("x"), F.col("b").alias("y"), "name")
        left = work.save(
            pairs.join(named, (F.col("a") == F.col("x")) & F.col("b").eqNullSafe(F.col("y"))).groupBy("rid", "n_blocks").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")),
            f"level{level}",
        )
        done.append(left.where("size(names) = 1").select("rid", "n_blocks", F.col("names")[0].alias("name")))
        left = left.where("size(names) > 1")
        longest = (longest + 1) // 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return rows.select("rid", "doc_id", "sha").join(out, "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of rows with equal normalised text, the one with the largest id stays.

    Of repeated rows with one id a single row stays. An id that is null ranks below
    every other. Null text equals empty text; texts of any length are compared whole. An
    empty table gives no rows. Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    named = work.save(block_names(docs, id_col, text_col, block_bytes, work=work), "named")
    groups = work.save(named.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")), "groups")
    out = named.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
