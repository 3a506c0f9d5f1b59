"""Conversations as a trie of their prefixes, known by chained digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, stage, table

#: Conversations in blocks of ``BLOCK`` ids share openers: up to ``OPENERS`` - 1 turns of the block's first one.
BLOCK, OPENERS = 100, 6
#: Ids a piece of a node's list of ends holds.
PIECE = 512
ROOT = bytes(32)
PATHS = "conv_id long, depth int, digest binary, parent binary, chars long, last boolean"


def _turns(messages: DataFrame) -> DataFrame:
    """(conv_id, n, sha, chars): turns numbered from 0 within a conversation, null turns first, equal turn numbers by digest. Texts end here."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # The role's length sets it apart from the text.
    sha = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = messages.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "sha")
    return rows.withColumn("n", F.row_number().over(order) - 1).select("conv_id", "n", "sha", "chars")


def rebuilt(messages: DataFrame) -> DataFrame:
    """(conv_id, part, n, sha, chars): part 0 are turns taken from the first conversation of the block, part 1 own turns, in the order of (part, n).

    A row of part -1 stands for every conversation, also one left without turns.
    """
    turns = stage(_turns(messages), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENERS
    first = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("n") < OPENERS - 1))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("n", "sha", "chars"))).alias("head"))
    every = turns.where("n = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), taken.cast("int").alias("taken"))
    opened = every.join(heads, "base", "left").select(
        "conv_id", F.explode(F.concat(
            F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("sha"), F.lit(0).cast("long").alias("chars"))),
            F.coalesce(F.transform(F.slice("head", F.lit(1), F.col("taken")), lambda t: F.struct(F.lit(0).alias("part"), t["n"].alias("n"), t["sha"].alias("sha"), t["chars"].alias("chars"))), F.array()),
        )).alias("t")).select("conv_id", "t.*")
    own = turns.where(F.col("n") >= taken).select("conv_id", F.lit(1).alias("part"), "n", "sha", "chars")
    return opened.unionByName(own)


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of every prefix from that of the prefix before it, over sorted rows as they come: memory holds one batch."""
    names = ["conv_id", "depth", "digest", "parent", "chars"]
    conv, depth, digest, held = None, 0, ROOT, []
    for pdf in batches:
        out, last = held, [False] * len(held)
        for c, sha, chars in zip(pdf["conv_id"].tolist(), pdf["sha"], pdf["chars"].tolist()):
            if sha is None:
                if out:
                    last[-1] = True
                conv, depth, digest, parent = c, 0, ROOT, None
            else:
                depth, parent, digest = depth + 1, digest, hashlib.sha256(digest + sha).digest()
            out.append((conv, depth, digest, parent, chars))
            last.append(False)
        # Whether the last row ends its conversation is known with the next batch.
        if out:
            held = out[-1:]
            yield pd.DataFrame(out[:-1], columns=names).assign(last=last[:-1])
    if held:
        yield pd.DataFrame(held, columns=names).assign(last=True)


def prefix_paths(messages: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation, from the empty one: (conv_id, depth, digest, parent, chars, last). One row per turn, 32 bytes a digest."""
    return rebuilt(messages).repartition("conv_id").sortWithinPartitions("conv_id", "part", "n").mapInPandas(_chain, PATHS)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one digest, ``PIECE`` at most, as text."""
    for pdf in batches:
        out, held, ids = [], None, []
        for digest, conv in zip(pdf["digest"], pdf["conv_id"].tolist()):
            if digest != held or len(ids) == PIECE:
                if ids:
                    out.append((held, ids[0], ",".join(map(str, ids))))
                held, ids = digest, []
            ids.append(conv)
        if ids:
            out.append((held, ids[0], ",".join(map(str, ids))))
        yield pd.DataFrame(out, columns=["digest", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each digest, comma-joined, piece by piece."""
    held, state = None, None
    for pdf in batches:
        out = []
        for digest, ids in zip(pdf["digest"], pdf["ids"]):
            if digest != held:
                if state is not None:
                    out.append((held, state.hexdigest()))
                held, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["digest", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(held, state.hexdigest())], columns=["digest", "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of nodes where conversations end.

    Ids are sorted over the cluster by (digest, id), so those of a common node spread over partitions; only their pieces meet, as a sorted stream
    in constant memory, since a hash of one text can be taken in its order only.
    """
    ends = paths.where("last").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = ends.mapInPandas(_pieces, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInPandas(_hashed, "digest binary, ends_sha256 string")


def prefix_trie(messages: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c starts with up to crc32(c) mod 6 first turns of conversation c - c % 100, its own turns after as many follow. Nodes are
    groups of equal (depth, digest), a digest being the SHA-256 of the one before it and of the turn.

    Sums over subtrees: every leaf stands for the path to it, taken from its smallest member. A node's own figure is given to one of the leaves below it
    and summed along that leaf's path from its end; each leaf's sums are then exploded to all its ancestors and grouped there. So the rows exploded are
    at most those of the paths, also where one conversation is very deep, and a common node is combined before the shuffle.

    Rows without a conv_id belong to no conversation and are left out. Null turns come first, equal turns and repeated rows in the order of their
    digests, each a turn of its own; null role and text equal empty ones; other columns are ignored. An empty table has no node. A chain of digests
    is sequential: a conversation passes one task, as a sorted stream of 32-byte digests.
    """
    key = ["depth", "digest"]
    paths = stage(prefix_paths(messages), "paths")
    nodes = stage(paths.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("chars").alias("chars")), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # A conversation ends in one leaf at most, so smallest members of leaves differ.
    leaves = nodes.where("n_children = 0").select("conv_id")
    ways = stage(paths.join(leaves, "conv_id", "left_semi").select("conv_id", *key), "ways")
    below = stage(ways.groupBy(*key).agg(F.count("*").alias("n_leaves"), F.min("conv_id").alias("owner")), "below")
    own = below.join(nodes, key).select(F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = ways.join(own, ["conv_id", "depth"], "left").withColumn("sum", F.sum(F.coalesce("own", F.lit(0).cast("long"))).over(upward))
    saved = sums.groupBy(*key).agg(F.sum("sum").alias("saved_tokens"))
    figures = stage(nodes.join(below.drop("owner"), key).join(saved, key).join(_ends(paths), "digest", "left"), "figures")
    parents = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    placed = attach(figures.where("depth > 0"), parents, "parent", "size", max(nodes.count(), 1)).drop("size")
    top = figures.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    long = lambda c: F.col(c).cast("long").alias(c)
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return placed.unionByName(top).select(
        *map(long, ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal conv_id: eight rounds of the reflected polynomial for each digit.
_ROUNDS = "list_reduce(list_prepend(xor(c, d), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
_DIGITS = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"


SQL = f"""
WITH raw AS (SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, CAST(length(coalesce(text, '')) AS BIGINT) AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, sha, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) - 1 AS n FROM raw),
ids AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_DIGITS}), lambda c, d: {_ROUNDS}), 4294967295) % {OPENERS} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
full_turns AS (SELECT i.conv_id, 0 AS part, t.n, t.sha, t.chars FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % {BLOCK} AND t.n < i.h
  UNION ALL SELECT t.conv_id, 1, t.n, t.sha, t.chars FROM turns t JOIN ids i ON i.conv_id = t.conv_id WHERE t.n >= i.h),
lists AS (SELECT i.conv_id, coalesce(list(f.sha ORDER BY part, n) FILTER (f.sha IS NOT NULL), []) AS shas, coalesce(list(f.chars ORDER BY part, n) FILTER (f.sha IS NOT NULL), []) AS lens
  FROM ids i LEFT JOIN full_turns f ON f.conv_id = i.conv_id GROUP BY i.conv_id),
paths AS (SELECT conv_id, d AS depth, sha256(array_to_string(shas[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(shas[1:d - 1], ',')) END AS up,
  CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS chars, d = len(shas) AS last FROM (SELECT *, unnest(range(len(shas) + 1)) AS d FROM lists)),
nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(up) AS up, max(chars) AS chars,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM paths GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, k)),
sums AS (SELECT p.depth, p.k, count_if(t.n_children = 0) AS n_leaves, sum((t.n_convs - 1) * t.chars) AS saved
  FROM told t JOIN paths p ON p.conv_id = t.conv_id AND p.depth <= t.depth GROUP BY p.depth, p.k)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, t.n_convs, CAST(t.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s ON s.depth = t.depth AND s.k = t.k LEFT JOIN nodes p ON p.depth = t.depth - 1 AND p.k = t.up
"""
