"""WARC fixity audit: Merkle trees over records and key ranges, compared from the root down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import cut

#: A node has up to 2**SHIFT children: records with neighbouring keys, or neighbouring ranges.
SHIFT = 4
#: Stands for a null key, so that such records come first.
NO_KEY = -(1 << 63)


def warc_record(url: Column, body: Column) -> Column:
    """A response record as text: header, blank line, body, two line ends. Nulls are empty."""
    content = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"),
        content, F.lit("\r\n\r\n"),
    )


def record_hashes(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row per key: ``id``, ``hash``, ``bytes``, ``records``.

    Records that share a key, null keys too, count as one entry; its digest is made of
    their number and of sums and extremes of their hashes, so it needs no list of them
    and no order among them.
    """
    record = warc_record(F.col(url), F.col(body))
    each = pages.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("id"), record.alias("record")).select(
        "id", F.octet_length("record").cast("bigint").alias("bytes"), F.sha2("record", 256).alias("hash")
    )
    wide = "decimal(38,0)"
    parts = [F.sum(F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast(wide)).cast("string") for i in range(4)]
    several = F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.min("hash"), F.max("hash"), *parts), 256)
    return each.groupBy("id").agg(
        F.when(F.count("*") == 1, F.min("hash")).otherwise(several).alias("hash"),
        F.sum("bytes").alias("bytes"), F.count("*").alias("records"),
    )


def _parents(nodes: DataFrame, top: bool) -> DataFrame:
    parent = F.lit(0).cast("bigint") if top else F.shiftright("id", SHIFT)
    child = F.struct("id", "hash", "bytes")
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["id"].cast("string"), c["hash"], c["bytes"].cast("string"))), "|"
    )
    return nodes.groupBy(parent.alias("id")).agg(
        F.sha2(text, 256).alias("hash"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records")
    )


@dataclass
class Tree:
    """``levels[0]`` holds the records, the last level the root; ``id`` is the key shifted by ``SHIFT`` bits a level."""

    levels: list[DataFrame]

    @property
    def root(self) -> str | None:
        found = self.levels[-1].first()
        return found["hash"] if found else None


def depth_for(*replicas: DataFrame) -> int:
    """Levels above the records, so that the lowest and highest key of all replicas meet."""
    low, high = 0, 0
    for records in replicas:
        a, b = records.agg(F.min("id"), F.max("id")).first()
        if a is not None:
            low, high = min(low, a), max(high, b)
    n = 0
    while low >> (SHIFT * n) != high >> (SHIFT * n) and n < 64 // SHIFT:
        n += 1
    return n + 1


def merkle_tree(records: DataFrame, depth: int) -> Tree:
    """The tree over ``record_hashes``. A level is up to 2**SHIFT times smaller than the one below it and written once."""
    levels = [cut(records)]
    for level in range(depth):
        levels.append(cut(_parents(levels[-1], level == depth - 1)))
    return Tree(levels)


def damaged_keys(primary: Tree, replica: Tree) -> DataFrame:
    """``id``, ``status`` of records that differ: changed, missing (in the replica) or extra.

    Only children of nodes that differ are compared, level by level; equal roots end it.
    """
    a, b = primary.levels, replica.levels
    bad = None
    for level in range(len(a) - 1, -1, -1):
        left, right = a[level].select("id", F.col("hash").alias("a")), b[level].select("id", F.col("hash").alias("b"))
        if bad is not None:
            up = F.lit(0).cast("bigint") if level == len(a) - 2 else F.shiftright("id", SHIFT)
            parents = bad.select(F.col("id").alias("up"))
            left = left.withColumn("up", up).join(parents, "up", "left_semi").select("id", "a")
            right = right.withColumn("up", up).join(parents, "up", "left_semi").select("id", "b")
        # Written, since both trees' next level asks for it.
        bad = cut(left.join(right, "id", "full").filter(~F.col("a").eqNullSafe(F.col("b"))))
        if level and bad.isEmpty():
            bad = bad.limit(0)
            break
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return bad.select("id", status.alias("status"))


def with_offsets(tree: Tree) -> DataFrame:
    """Records with the byte offset of each in the archive, in order of key.

    A node starts where its parent does, after the siblings before it, so no window
    holds more than the children of one node.
    """
    starts = tree.levels[-1].select("id", F.lit(0).cast("bigint").alias("start"))
    for level in range(len(tree.levels) - 2, -1, -1):
        up = F.lit(0).cast("bigint") if level == len(tree.levels) - 2 else F.shiftright("id", SHIFT)
        before = Window.partitionBy("up").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            tree.levels[level].withColumn("up", up)
            .withColumn("ahead", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
            .join(starts.select(F.col("id").alias("up"), "start"), "up")
            .select("id", "hash", "bytes", "records", (F.col("start") + F.col("ahead")).alias("start"))
        )
    return starts


def fixity_audit(pages: DataFrame, replica: DataFrame, **columns) -> DataFrame:
    """Every record of ``pages`` with offset, length, hash and status, and the replica's extra ones.

    ``status`` is intact, changed, missing or extra. Extra records have no offset, length
    or hash. A null key is kept as null; records that repeat a key are one entry with their
    summed length. Two empty archives give no rows; null URLs and bodies are empty; bodies
    of any length are hashed whole. Columns beside key, URL and body are not read.
    """
    left, right = record_hashes(pages, **columns), record_hashes(replica, **columns)
    depth = depth_for(left, right)
    primary, other = merkle_tree(left, depth), merkle_tree(right, depth)
    bad = damaged_keys(primary, other)
    rows = with_offsets(primary).join(bad, "id", "full")
    return rows.select(
        F.when(F.col("id") != NO_KEY, F.col("id")).alias("page_id"),
        F.col("start").alias("offset"),
        F.col("bytes").alias("length"),
        F.col("hash").alias("record_sha256"),
        F.coalesce("status", F.lit("intact")).alias("status"),
    )
