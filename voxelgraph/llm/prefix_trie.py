"""The prefix trie of rebuilt conversations, family by family.

A family is the conversations with one base id (c - c % FAMILY). The base conversation and the others are brought together by that
id as one sorted stream, the base first: each conversation is rebuilt from its base's first turns and its own later ones, and the
family's small trie is built. Only these combined nodes are shuffled on: merged by key, they give each node its members over all
families; sent back to the families, they are summed up each family's tree, and the families' sums are added.

A node's key is a chained SHA-256 (16 bytes) of its turns, so texts are read once and never move. Values summed over a subtree are
counted in the family that holds the node's smallest conversation, so each node counts once, and no pass goes level by level.

A family's stream holds FLUSH nodes at most (what it flushes is merged with the rest by key) and, on the way up, one open node for
each of its conversations, so neither long conversations nor large families must fit a task. Nodes that many families share (the
root, a common first turn) are combined before they move; the fewer than HOT keys with more than 1 / HOT of all family nodes
are joined by broadcast. The list of conversations that end at a node is hashed as a stream, in order, never held.

Edge cases: turns are ordered by turn, null first, ties by the digest of role and text (so rows that repeat follow each other); null
role or text is empty; rows without a conv_id belong to no conversation and are left out; a conversation whose base is absent
keeps only its own later turns, one that has none ends at the root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.storage import durable, release

#: Conversations of a family; turns taken from the base are fewer than SHARED.
FAMILY, SHARED = 20, 4

#: Nodes a family's stream holds at most.
FLUSH = 200_000

#: A key with more than 1 / HOT of the family nodes, and LEAST at least, is hot.
HOT, LEAST = 1000, 50

ROOT = b"\0" * 16

NODES = "base long, key binary, parent binary, depth long, words long, n long, conv_id long, inner boolean, ends string"
SUMS = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns(conversations: DataFrame) -> DataFrame:
    """base, other, conv_id, turn, digest, words of each turn. Texts end here."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(c.alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    return rows.select(base.alias("base"), (F.col("conv_id") != base).alias("other"), "conv_id", "turn", "digest", "words")


def from_base(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


class Family:
    """The nodes of one family, built turn by turn. Rows for NODES gather in out."""

    def __init__(self, base: int, out: list[tuple], flush: int):
        self.base, self.out, self.limit = base, out, flush
        self.shared: list[tuple[bytes, int]] = []  # the base's first turns
        self.nodes: dict[bytes, list] = {}  # key: parent, depth, words, members, smallest member, whether it has children
        self.ends: dict[bytes, list[int]] = {}  # one entry for each conversation
        self.who = None

    def begin(self, conv_id: int) -> None:
        self.finish()
        self.who, self.skip, self.seen = conv_id, from_base(conv_id), 0
        self.key, self.depth = ROOT, 0
        self._count(None, 0)
        if conv_id != self.base:
            for digest, words in self.shared[: self.skip]:
                self._step(digest, words)

    def turn(self, digest: bytes, words: int) -> None:
        self.seen += 1
        if self.who == self.base:
            if self.seen < SHARED:
                self.shared.append((digest, words))
            self._step(digest, words)
        elif self.seen > self.skip:
            self._step(digest, words)

    def _step(self, digest: bytes, words: int) -> None:
        parent = self.key
        self.nodes[parent][5] = True
        self.key, self.depth = hashlib.sha256(parent + digest).digest()[:16], self.depth + 1
        self._count(parent, words)
        if len(self.nodes) >= self.limit:
            last = self.nodes[self.key]
            self.flush()
            self.nodes[self.key] = [*last[:3], 0, *last[4:]]  # its children are still to come

    def _count(self, parent: bytes | None, words: int) -> None:
        node = self.nodes.get(self.key)
        if node is None:
            self.nodes[self.key] = [parent, self.depth, words, 1, self.who, False]
        else:
            node[3] += 1
            node[4] = min(node[4], self.who)

    def flush(self) -> None:
        for key, (parent, depth, words, n, low, inner) in self.nodes.items():
            self.out.append((self.base, key, parent, depth, words, n, low, inner, None))
        self.nodes = {}

    def finish(self) -> None:
        if self.who is not None:
            self.ends.setdefault(self.key, []).append(self.who)
            self.who = None

    def close(self) -> None:
        self.finish()
        self.flush()
        for key, who in self.ends.items():
            self.out.append((self.base, key, None, None, None, None, None, None, ",".join(map(str, sorted(who)))))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def family_nodes(rows: DataFrame, flush: int = FLUSH) -> DataFrame:
    """NODES of every family, from turns(). A node may come in parts; rows with ends say which of the family's conversations end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, family, out = _arrow(NODES), None, []
        for batch in batches:
            for base, conv_id, digest, words in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "digest", "words"))):
                if family is None or family.base != base:
                    if family:
                        family.close()
                    family = Family(base, out, flush)
                if family.who != conv_id:
                    family.begin(conv_id)
                family.turn(digest, words)
                if len(out) >= 20_000:
                    yield _batch(out, schema)
                    out.clear()
        if family:
            family.close()
            yield _batch(out, schema)

    order = ["base", "other", "conv_id", F.asc_nulls_first("turn"), "digest"]
    return rows.repartition("base").sortWithinPartitions(*order).mapInArrow(run, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """key, n_convs, smallest, childless, parts: each node over all families."""
    return nodes.where("ends is null").groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("smallest"), (~F.max("inner")).alias("childless"), F.count(F.lit(1)).alias("parts"))


def ends_digests(nodes: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ids of the conversations that end at a node. Families are ranges of ids, so their lists follow each
    other in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, state, out = _arrow("key binary, ends_sha256 string"), None, None, []
        for batch in batches:
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key == at:
                    state.update(b"," + ends.encode())
                    continue
                if at is not None:
                    out.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ends.encode())
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out.clear()
        if at is not None:
            yield _batch([*out, (at, state.hexdigest())], schema)

    lists = nodes.where("ends is not null").select("key", "base", "ends")
    return lists.repartition("key").sortWithinPartitions("key", "base").mapInArrow(run, "key binary, ends_sha256 string")


def with_totals(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Each family node beside its totals. totals: merged(), a written table."""
    rows = nodes.where("ends is null").select("base", "key", "parent", "depth", "words")
    every = totals.agg(F.sum("parts")).first()[0] or 0
    hot = totals.where((F.col("parts") >= LEAST) & (F.col("parts") * HOT > every)).drop("parts")  # fewer than HOT rows
    cold = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(totals.drop("parts"), "key")
    return rows.join(F.broadcast(hot), "key").unionByName(cold)


def climbed(rows: DataFrame) -> DataFrame:
    """SUMS: each family's nodes, deepest first, with what the family adds to them. Nodes of other families come along only where this one
    adds something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, family, last, pending = _arrow(SUMS), [], None, None, {}
        names = ("base", "key", "parent", "depth", "words", "n_convs", "smallest", "childless")
        for batch in batches:
            for base, key, parent, depth, words, n, low, childless in zip(*(batch.column(c).to_pylist() for c in names)):
                if base != family:
                    family, pending, last = base, {}, None
                if key == last:  # another part of the same node
                    continue
                last = key
                leaves, saved, children, waiting = pending.pop(key, (0, 0, 0, ()))
                own = low - _remainder(low) == base
                if own:
                    leaves, saved = leaves + childless, saved + (n - 1) * words
                for child in waiting:
                    out.append((*child[:3], low, *child[3:]))
                here = (key, low, depth, n, children, leaves, saved) if own or leaves or saved or children else None
                if parent is None:
                    out.append((*here[:3], None, *here[3:])) if here else None
                else:
                    to = pending.setdefault(parent, [0, 0, 0, []])
                    to[0], to[1], to[2] = to[0] + leaves, to[1] + saved, to[2] + own
                    if here:
                        to[3].append(here)
            if len(out) >= 20_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    order = ["base", F.desc("depth"), "key"]
    return rows.repartition("base").sortWithinPartitions(*order).mapInArrow(run, SUMS)


def _remainder(c: int) -> int:
    """c % FAMILY with the sign of c, as SQL has it."""
    return c % FAMILY if c >= 0 else -(-c % FAMILY)


def prefix_trie(conversations: DataFrame, flush: int = FLUSH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of the trie."""
    nodes = durable(family_nodes(turns(conversations), flush))
    totals = durable(merged(nodes))
    sums = durable(climbed(with_totals(nodes, totals)))
    release(totals)
    more = {"conv_id": F.max, "depth": F.max, "parent_conv_id": F.max, "n_convs": F.max, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum}
    rows = sums.withColumn("ends_sha256", F.lit(None).cast("string")).unionByName(ends_digests(nodes), allowMissingColumns=True)
    none = hashlib.sha256(b"").hexdigest()
    out = rows.groupBy("key").agg(*[f(c).alias(c) for c, f in more.items()], F.coalesce(F.max("ends_sha256"), F.lit(none)).alias("ends_sha256"))
    return out.drop("key")
