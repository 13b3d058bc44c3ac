"""Prefix trie of conversations: nodes by running hashes, subtree totals by depth bands."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.llm.common import written

#: Height of a band: a node is summed into at most so many ancestors. RUN turns of a conversation are hashed by one task, a power of BAND.
BAND, RUN = 4, 4096


def placed(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, a, b, bytes): each turn's place in its conversation from 1, the digest of role and text, the UTF-8 bytes of the text.

    Turns are in the order of turn (null first), equal ones in that of their digests. Null role and text count as empty. Rows without a
    conversation belong to none and are left out. Rows are dealt by ranges of the order, so that a conversation of any length is numbered
    by many tasks; all later steps carry digests instead of texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("d"), F.octet_length(text).cast("long").alias("bytes"))
    half = [F.conv(F.substring("d", at, 15), 16, 10).cast("long").alias(n) for n, at in (("a", 1), ("b", 16))]
    dealt = rows.select("conv_id", "turn", *half, "bytes").repartitionByRange("conv_id", "turn", "a", "b")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "turns")
    runs = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = runs.select("conv_id", "part", (F.sum("n").over(W.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before")).where("before > 0")
    # only the first conversation of a partition can have begun in an earlier one, so there is at most one row for each partition
    numbered = dealt.withColumn("k", F.row_number().over(W.partitionBy("conv_id", "part").orderBy("turn", "a", "b")))
    numbered = numbered.join(F.broadcast(before), ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("place"), "a", "b", "bytes")


def rebuilt(places: DataFrame, family: int = 5, cycle: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: each takes its first h turns from the first of its family, then goes on with its own after h.

    h is the CRC32 of the decimal id modulo cycle; a family is family ids in a row. Returns the turns as placed() does, and (conv_id,
    turns) for every conversation, also those without any.
    """
    sizes = places.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % cycle
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(first, "base", "left")
    plan = written(plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "plan")
    own = places.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    openings = places.where(F.col("place") < cycle).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "h"), "base").where("place <= h")
    columns = ["conv_id", "place", "a", "b", "bytes"]
    turns = own.select(*columns).unionByName(openings.select(*columns))
    return turns, plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def _xor(c: str, w: W) -> Column:
    return F.bit_xor(c).over(w)


def keyed(turns: DataFrame, conversations: DataFrame, band: int = BAND) -> DataFrame:
    """(conv_id, place, bytes, last, k1, k2, p1, p2, up): the node that a conversation has reached at each place, from the root at 0.

    A turn and its place have 128 pseudo-random bits, and a node is the exclusive or of those of its turns. That needs no order, so the
    parts of a long conversation are hashed each by itself and put together from their totals. p1 and p2 are the parent's, up is the
    node's ancestors in its band, topmost first, itself last; a band is the places from a multiple of band on.
    """
    z1, z2 = F.xxhash64("place", "a", "b"), F.xxhash64("b", "a", "place")
    steps = turns.select("conv_id", "place", "bytes", z1.alias("z1"), z2.alias("z2"))
    zero = F.lit(0).cast("long")
    steps = steps.unionByName(conversations.select("conv_id", zero.alias("place"), zero.alias("bytes"), zero.alias("z1"), zero.alias("z2")))
    steps = steps.withColumns({"run": F.expr(f"place div {RUN}"), "band": F.expr(f"place div {band}")})
    w = W.partitionBy("conv_id", "run").orderBy("place")
    inside = steps.withColumns({"k1": _xor("z1", w), "k2": _xor("z2", w)})
    up = F.collect_list(F.struct("k1", "k2")).over(W.partitionBy("conv_id", "run", "band").orderBy("place"))  # at most band of them
    inside = written(inside.withColumn("up", up), "steps")
    ends = inside.where(F.col("place") % RUN == RUN - 1).withColumn("run", F.col("run") + 1)
    w = W.partitionBy("conv_id").orderBy("run")  # a row for each whole run of a conversation
    before = ends.select("conv_id", "run", _xor("k1", w).alias("b1"), _xor("k2", w).alias("b2"))
    whole = inside.join(before, ["conv_id", "run"], "left").join(conversations, "conv_id")
    b1, b2 = F.coalesce("b1", zero), F.coalesce("b2", zero)
    up = F.transform("up", lambda x: F.struct(x["k1"].bitwiseXOR(b1).alias("k1"), x["k2"].bitwiseXOR(b2).alias("k2")))
    k1, k2 = F.col("k1").bitwiseXOR(b1), F.col("k2").bitwiseXOR(b2)
    p1, p2 = (F.when(F.col("place") > 0, k.bitwiseXOR(F.col(z))) for k, z in ((k1, "z1"), (k2, "z2")))  # the root has no parent
    return whole.select("conv_id", "place", "bytes", (F.col("place") == F.col("turns")).alias("last"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), up.alias("up"))


def subtree_sums(nodes: DataFrame, steps: DataFrame, values: list[str], deepest: int, band: int = BAND, level: int = 0) -> DataFrame:
    """(k1, k2, *values): the sums of values over each node's subtree, itself included.

    nodes has k1, k2, place, p1, p2, up and values; steps has the rows of keyed(). Every node adds to its ancestors in its band. The tops
    of the bands then make a tree that is band times less deep; its sums come by the same steps, and each top's sum is added to the nodes
    of the band above that it hangs from. So there are as many rounds as the logarithm of the depth, and a node is multiplied by band at most.
    """
    sums = [F.sum(v).alias(v) for v in values]
    inside = nodes.select(F.explode("up").alias("x"), *values).groupBy("x.k1", "x.k2").agg(*sums)
    if deepest < band:
        return inside
    inside = written(inside, "band")
    height = band ** (level + 1)
    tops = nodes.where(F.col("place") % height == 0).select("k1", "k2", "place", "p1", "p2")
    over = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("up").alias("hangs"))
    # the parent of a top's parent is the top of that parent's band
    higher = tops.join(over, ["p1", "p2"], "left").select("k1", "k2", "place", F.col("hangs")[0]["k1"].alias("p1"), F.col("hangs")[0]["k2"].alias("p2"), "hangs")
    rows = steps.where(F.col("place") % height == 0).select("conv_id", "place", "k1", "k2").withColumn("band", F.expr(f"place div {height * band}"))
    chain = F.collect_list(F.struct("k1", "k2")).over(W.partitionBy("conv_id", "band").orderBy("place"))
    chains = rows.withColumn("up", chain).groupBy("k1", "k2").agg(F.first("up").alias("up"))  # equal for all conversations of a node
    higher = written(higher.join(chains, ["k1", "k2"]).join(inside, ["k1", "k2"]), "tops")
    totals = written(subtree_sums(higher, steps, values, deepest // band, band, level + 1), "totals")
    hung = higher.where("hangs is not null").select("k1", "k2", "hangs").join(totals, ["k1", "k2"]).select(F.explode("hangs").alias("x"), *values)
    return inside.unionByName(hung.select("x.k1", "x.k2", *values)).groupBy("k1", "k2").agg(*sums)


def listed_hashes(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of members (k1, k2, conv_id): the hash of each node's decimal ids, ascending, comma-joined.

    Ids are joined by ranges in many tasks, so that a node with most of all ids comes as a few long texts. A hash can only be taken from
    the first to the last of them; one task does that text by text, holding one at a time.
    """
    dealt = members.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").withColumn("part", F.spark_partition_id())
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = dealt.groupBy("k1", "k2", "part").agg(ids.alias("ids"))

    def run(batches):
        at, h = None, None
        for rows in batches:
            done = []
            for k1, k2, ids in zip(rows["k1"], rows["k2"], rows["ids"], strict=True):
                if at != (k1, k2):
                    if at is not None:
                        done.append((*at, h.hexdigest()))
                    at, h = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["k1", "k2", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, h.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids").mapInPandas(run, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the prefix trie of conversations: one for each distinct sequence of their first turns, and a root.

    turns are as placed() gives them; conversations (conv_id, turns) lists all, also those without turns, which are members of the root.
    Returns k1, k2 (the node), conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of a
    node's last text times its members but one, over its subtree), ends_sha256 (of the members that end there; of nothing if none do).
    No conversations give no rows. Conversations with the same turns meet in the same nodes; no group of rows is held by one task but a
    band of one conversation.
    """
    if RUN % band:
        raise ValueError(f"a band must divide {RUN}")
    steps = written(keyed(turns, conversations, band), "keyed")
    nodes = steps.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.min("place").alias("place"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("up").alias("up"))
    nodes = written(nodes, "nodes")
    deepest = nodes.agg(F.max("place").alias("d")).first()["d"] or 0
    children = nodes.where("place > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = whole.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    valued = written(valued, "valued")
    sums = subtree_sums(valued, steps, ["n_leaves", "saved_tokens"], deepest, band)
    over = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = valued.drop("n_leaves", "saved_tokens", "up", "bytes").join(sums, ["k1", "k2"]).join(listed_hashes(steps.where("last")), ["k1", "k2"], "left")
    out = out.join(over, ["p1", "p2"], "left")
    return out.select("k1", "k2", "conv_id", F.col("place").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
