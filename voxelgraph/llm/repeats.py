"""Repeated passages by winnowed anchors, at the grain of words (substring dedup) or lines (line dedup).

A window is `length` consecutive items (words or lines) of one document. Winnowing takes from every window the item gram with the
smallest hash as its anchor, so a passage that repeats always shares one. The windows that one anchor stands for are its extent.

1. Seeds: every anchor's gram and extent hash with document and place. Seeds with equal extents are joined, the document with the
   smallest id first: each later one gives a pair of places, whose windows are alike. Most copied text is settled so, by one row
   for many windows.
2. Where one anchor has several extents (the ends of passages), each extent's first document gives its single windows, from every
   place where it has the extent, joined likewise. The first documents suffice: the smallest id that has a window is also the
   smallest that has the extent around it.
3. Pairs on one diagonal are chained to matches. The first document's items there, and PAD items on either side, go to the later
   document, where both are compared item by item and the match is extended both ways. Only runs of equal items that hold a whole
   window are maximal repeats and removed: hashes propose, texts decide.

Text that repeats itself has the same seed at even distances. Such places make one seed with a step (a stretch), so that a
text of one word over and over has as many matches as its period has items, not one a diagonal.

A key with more than 1 / HOT of the rows (found on a sample of the documents, which steers how rows are dealt and nothing else) is
settled by broadcast or salted: fewer than HOT keys can be so frequent. No group of copies is gathered or expanded into pairs.

Edge cases: a null text counts as empty; null ids count as the largest id, 2**63 - 1; rows that repeat a doc_id are never removed
because of each other; among documents with one passage the smallest id keeps it, within a document the first place (ties in
both are the same text in the same row); a document shorter than a window keeps everything; an empty table gives an empty result.
Only the id, the text and the columns in `carry` are read, and these get names of their own, so no column can clash. Very long
texts: a task holds some 10 bytes for each byte of the longest text, and windows are made in runs of CHUNK items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.llm.text import Texts, U, grams, inside, item_hashes, kept_texts, mix, owners, scan, signed, space_table
from voxelgraph.storage import durable, release

LAST = (1 << 63) - 1

#: A key with more than 1 / HOT of the rows is hot.
HOT = 1000

#: One document in SAMPLE shows which keys are hot; a key must be there LEAST times.
SAMPLE, LEAST = 64, 50

#: Places of one extent at even distances in a text that make a stretch.
STRETCH = 8

#: Items whose windows are made at a time; items that travel together in a block.
CHUNK, BLOCK = 1 << 20, 64


def word_items(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.words(space_table())


def line_items(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.lines()


@dataclass(frozen=True)
class Grain:
    """What an item is and which runs of items count. alone: an item of so many characters is a window by itself (0: none is).
    wordy: a window counts only if it has a word."""

    items: Callable
    glue: str
    length: int
    gram: int
    alone: int = 0
    wordy: bool = False

    def worded(self, t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which items have a word, where that matters."""
        if not self.wordy:
            return np.ones(len(start), bool)
        solid = np.concatenate([[0], np.cumsum(~space_table()[t.data])])
        return solid[end] > solid[start]

    def long(self, t: Texts, start: np.ndarray, end: np.ndarray, worded: np.ndarray) -> np.ndarray:
        """Which items are windows by themselves."""
        if not self.alone:
            return np.zeros(len(start), bool)
        chars = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
        return worded & (chars[end] - chars[start] >= self.alone)


def any_in(flags: np.ndarray, length: int) -> np.ndarray:
    """For each run of `length` places: whether a flag is set there."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[length:] > total[:-length]


def windows(h: np.ndarray, first: np.ndarray, worded: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window inside one text that counts: where it begins, its hash, its anchor's hash and place (the leftmost smallest)."""
    ok = inside(first, length)
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(ok & any_in(worded, length))
    g, n = grams(h, gram, seed=11), len(h) - length + 1
    low, place = g[:n].copy(), np.arange(n)
    for j in range(1, length - gram + 1):
        less = g[j : j + n] < low
        low[less], place[less] = g[j : j + n][less], np.flatnonzero(less) + j
    return at, grams(h, length, seed=23)[at], low[at], place[at]


def chunks(t: Texts, grain: Grain) -> Iterator[tuple]:
    """windows() of a run of texts, in chunks, with the text and the place in it where each begins: own, pos, whole, low, new (the first
    window of an extent)."""
    start, end, first = grain.items(t)
    worded, h = grain.worded(t, start, end), item_hashes(t, start, end)
    for a in range(0, max(1, len(h) - grain.length + 1), CHUNK):
        b = min(len(h), a + CHUNK + grain.length - 1)
        at, whole, low, place = windows(h[a:b], np.clip(first, a, b) - a, worded[a:b], grain.length, grain.gram)
        own = np.searchsorted(first, at + a, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(at) != 1) | (own[1:] != own[:-1])
        yield own, at + a - first[own], whole, low, new


def stretched(own: np.ndarray, g: np.ndarray, x: np.ndarray, pos: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which seeds to keep, and the step and number of places of each: text that repeats itself has the same seed at even distances, of
    which the first stands for all."""
    keep, step, n = np.ones(len(x), bool), np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    if len(x) < STRETCH:
        return keep, step, n
    _, which, many = np.unique(x, return_inverse=True, return_counts=True)
    idx = np.flatnonzero(many[which] >= STRETCH)
    order = idx[np.lexsort((pos[idx], span[idx], g[idx], x[idx], own[idx]))]
    if not len(order):
        return keep, step, n
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (own, g, x, span)])
    d = np.diff(pos[order], prepend=0)
    new = ~same
    new[1:] |= same[1:] & same[:-1] & (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    first, size = begin[size >= STRETCH], size[size >= STRETCH]
    step[order[first]], n[order[first]] = d[first + 1], size
    which = np.repeat(first, size - 1)
    keep[order[which + 1 + np.arange(len(which)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)]] = False
    return keep, step, n


def _rows(rid: np.ndarray, own: np.ndarray, g: np.ndarray, x: np.ndarray, pos: np.ndarray, span: np.ndarray) -> tuple:
    """Columns of SEEDS."""
    keep, step, n = stretched(own, g, x, pos, span)
    return tuple(c[keep] for c in (signed(g), signed(x), rid[own], pos, span, step, n))


SEEDS = "g long, x long, rid long, pos int, span int, step int, n int"


def _seeds(rows: DataFrame, grain: Grain) -> DataFrame:
    """SEEDS: anchor and extent of each seed, its document, the extent's first item, how many items it has, and its stretch."""

    def make():
        def work(part, t):
            rid, out = np.asarray(part.column("_rid"), np.int64), []
            for own, pos, whole, low, new in chunks(t, grain):
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(new)))
                # The first and the last window cover the extent: it has no more windows than a window has items.
                x = mix(whole[begin] * U(0xBF58476D1CE4E5B9) + whole[begin + size - 1] * U(0xD6E8FEB86659FD93) + size.astype(U))
                out.append(_rows(rid, own[begin], low[begin], x, pos[begin], size + grain.length - 1))
            if grain.alone:
                start, end, first = grain.items(t)
                at = np.flatnonzero(grain.long(t, start, end, grain.worded(t, start, end)))
                h, own = item_hashes(t, start[at], end[at]), owners(first)[at]
                out.append(_rows(rid, own, mix(h + U(3)), mix(h + U(5)), at - first[own], np.ones(len(at), np.int64)))
            return [np.concatenate(c) for c in zip(*out)]

        return work

    return scan(rows, make, SEEDS)


def _singles(rows: DataFrame, grain: Grain) -> DataFrame:
    """SEEDS of each single window of the extents that column _open lists."""

    def make():
        def work(part, t):
            rid, lists, out = np.asarray(part.column("_rid"), np.int64), part.column("_open"), []
            whose = np.repeat(np.arange(t.n), np.asarray(lists.value_lengths().fill_null(0), np.int64))
            flat = lists.flatten()
            pos, span, step, n = (np.asarray(flat.field(c), np.int64) for c in ("pos", "span", "step", "n"))
            each = np.repeat(np.arange(len(n)), n)  # every place of a stretch
            whose, span, pos = whose[each], span[each], pos[each] + step[each] * (np.arange(len(each)) - (np.cumsum(n) - n)[each])
            first = grain.items(t)[2]
            edge = np.zeros(first[-1] + 1, np.int64)
            np.add.at(edge, np.minimum(first[whose] + pos, first[-1]), 1)
            np.add.at(edge, np.minimum(first[whose] + pos + span - grain.length + 1, first[-1]), -1)
            wanted = np.cumsum(edge) > 0
            for own, pos, whole, low, _ in chunks(t, grain):
                hit = wanted[first[own] + pos]
                out.append(_rows(rid, own[hit], low[hit], whole[hit], pos[hit], np.full(hit.sum(), grain.length)))
            return [np.concatenate(c) for c in zip(*out)]

        return work

    return scan(rows, make, SEEDS)


FOUND = "rid long, pos int, span int, step int, n int, low long, at int"


def _joined(seeds: DataFrame, length: int) -> DataFrame:
    """FOUND: each seed beside the first document with the same g and x and its place there, where that has a smaller
    id; and with low null the first document's seeds of each x whose g has others, every place of them. Rows come in runs of equal keys:
    only a run's first row is held, and the first document's seeds of a g's first x until another comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # the first row of the run of equal g and x
        deal, runs, held = None, 0, []  # the last deal, its runs so far, its first document's seeds while there is one run
        for batch in batches:
            if not batch.num_rows:
                continue
            k, g, x, rid, pos, span, step, n = (np.asarray(batch.column(c), np.int64) for c in ("_k", "g", "x", "rid", "pos", "span", "step", "n"))
            many = np.asarray(batch.column("_many"))
            new = np.ones(len(k), bool)
            new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
            new[0] = lead is None or (lead[0], lead[1]) != (g[0], x[0])
            whose = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            low, at = rid[np.maximum(whose, 0)], pos[np.maximum(whose, 0)]
            if lead is not None:
                low[whose < 0], at[whose < 0] = lead[2], lead[3]
            lead = (g[-1], x[-1], low[-1], at[-1])
            out = [[c[rid > low] for c in (rid, pos, span, step, n, low, at)]]
            turn = np.concatenate([[deal != k[0]], k[1:] != k[:-1]])
            group = np.cumsum(turn) - turn[0]
            count = np.bincount(group, new).astype(np.int64)
            if turn[0]:
                held = []
            else:
                count[0] += runs
            open_, mine = many | (count[group] > 1), (rid == low) & (span >= length)
            if count[0] > 1:
                out += [[*rows, None, None] for rows in held]
            if count[0] > 1 or group[-1]:
                held = []
            out.append([*(c[mine & open_] for c in (rid, pos, span, step, n)), None, None])
            waits = mine & ~open_ & (group == group[-1])
            held += [[c[waits] for c in (rid, pos, span, step, n)]] if waits.any() else []
            deal, runs = k[-1], count[-1]
            for r, p, s, t, m, a, b in out:
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(r), *(pa.array(c, pa.int32()) for c in (p, s, t, m)), pa.nulls(len(r), pa.int64()) if a is None else pa.array(a), pa.nulls(len(r), pa.int32()) if b is None else pa.array(b, pa.int32())], names=["rid", "pos", "span", "step", "n", "low", "at"])

    return seeds.select("_k", "g", "x", "rid", "pos", "span", "step", "n", "_many").sortWithinPartitions("_k", "g", "x", "rid", "pos").mapInArrow(run, FOUND)


def _hot(sample: DataFrame, total: int, *keys: str) -> DataFrame:
    return durable(sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= LEAST) & (F.col("_n") * HOT > total)).drop("_n"))


def settled(seeds: DataFrame, length: int, opens: bool = True) -> DataFrame:
    """_joined() of seeds (a written table), with hot keys dealt out. opens: whether rows with low null are wanted."""
    sample = seeds.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0)
    total = sample.count()
    hot = _hot(sample, total, "g", "x")  # fewer than HOT rows, as below
    marked = seeds.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), ["g", "x"], "left").where("_hot is null")
    if opens:  # an anchor with very many extents is dealt by extent too: all of them have others
        wide = _hot(sample, total, "g").withColumn("_many", F.lit(True))
        marked = marked.join(F.broadcast(wide), "g", "left").withColumn("_many", F.col("_many").isNotNull())
        marked = marked.withColumn("_k", F.when(F.col("_many"), F.xxhash64("g", "x")).otherwise(F.col("g")))
    else:
        marked = marked.withColumn("_many", F.lit(False)).withColumn("_k", F.xxhash64("g", "x"))
    out = _joined(marked.repartition("_k"), length if opens else LAST)  # no extent has LAST items
    if hot.isEmpty():
        return out
    # A very frequent extent: its first seed, combined before it moves, comes back by broadcast. Of a x with several g all are
    # taken: an extent that is told twice proposes its matches twice, and no more.
    frequent = F.col("x").isin([r.x for r in hot.select("x").distinct().collect()])  # fewer than HOT
    first = durable(seeds.where(frequent).groupBy("g", "x").agg(F.min(F.struct("rid", "pos")).alias("_f")))
    later, open_ = F.col("rid") > F.col("_f.rid"), F.lit(opens) & (F.col("rid") == F.col("_f.rid")) & (F.col("span") >= length)
    again = seeds.join(F.broadcast(first), ["g", "x"]).where(later | open_)
    return out.unionByName(again.select("rid", "pos", "span", "step", "n", F.when(later, F.col("_f.rid")).alias("low"), F.when(later, F.col("_f.pos")).alias("at")))


def matches(rows: DataFrame, grain: Grain) -> DataFrame:
    """rid, low, diag, start, end, step, n: items start to end of a document, proposed to repeat those `diag` places before in document low;
    in a stretch (n > 1) so do those that begin step, 2 step, ... later."""
    seeds = durable(_seeds(rows, grain))
    found = durable(settled(seeds, grain.length))
    release(seeds)
    opens = found.where("low is null").groupBy("rid").agg(F.collect_list(F.struct("pos", "span", "step", "n")).alias("_open"))
    singles = durable(_singles(rows.join(opens, rows._rid == opens.rid).select("_rid", "text", "_open"), grain))
    pairs = found.where("low is not null").unionByName(settled(singles, grain.length, opens=False))
    d = pairs.select("rid", "low", "step", "n", (F.col("pos") - F.col("at")).alias("diag"), F.col("pos").alias("start"), (F.col("pos") + F.col("span")).alias("end"))
    w = Window.partitionBy("rid", "low", "diag", "step", "n").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = durable(d.groupBy("rid", "low", "diag", "step", "n", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run"))
    release(found, singles)
    return out


def _pieces(rows: DataFrame, grain: Grain) -> DataFrame:
    """low, tag, block, items: the items of those blocks of a document that column _blocks lists. tag: rows that repeat an id differ in it."""

    def make():
        glue = grain.glue.encode()

        def work(part, t):
            start, end, first = grain.items(t)
            raw, out = t.data.tobytes(), ([], [], [], [])
            for i, (rid, tag, blocks) in enumerate(zip(*[part.column(c).to_pylist() for c in ("_rid", "_tag", "_blocks")])):
                for b in blocks:
                    a, z = first[i] + b * BLOCK, min(first[i] + (b + 1) * BLOCK, first[i + 1])
                    if a < z:
                        for to, v in zip(out, (rid, tag, b, glue.join([raw[p:q] for p, q in zip(start[a:z].tolist(), end[a:z].tolist())]).decode())):
                            to.append(v)
            return *out[:3], pa.array(out[3], pa.string())

        return work

    return scan(rows.withColumn("_tag", F.xxhash64("text")), make, "low long, tag long, block int, items string")


def sources(rows: DataFrame, found: DataFrame, grain: Grain) -> DataFrame:
    """rid, _from: for each document the items of first documents that its matches propose, with PAD items on either side: a list
    of low, tag, diag, at (the document's place that the first item stands against), items, and the step and n of a stretch."""
    pad = F.when(F.col("n") == 1, max(1, grain.length - 1)).otherwise(0)  # a stretch needs no more: each of its windows is proposed
    lo, hi = F.greatest(F.lit(0), F.col("start") - F.col("diag") - pad), F.col("end") - F.col("diag") + pad
    needs = found.select("rid", "low", "diag", "step", "n", lo.alias("lo"), hi.alias("hi")).select("*", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK).cast("int"), F.floor((F.col("hi") - 1) / BLOCK).cast("int"))).alias("block"))
    asked = durable(needs.groupBy("low", "block").agg(F.count(F.lit(1)).alias("many")))
    total = asked.agg(F.sum("many")).first()[0] or 0
    hot = asked.where((F.col("many") >= LEAST) & (F.col("many") * HOT > total)).select("low", "block", F.ceil(F.col("many") * HOT / F.lit(max(1, total))).cast("int").alias("salts"))
    lists = asked.groupBy("low").agg(F.collect_list("block").alias("_blocks"))  # as many as the document has blocks, at most
    pieces = _pieces(rows.join(lists, rows._rid == lists.low).select("_rid", "text", "_blocks"), grain)
    salted = lambda df, salt: df.join(F.broadcast(hot), ["low", "block"], "left").withColumn("_salt", salt).drop("salts")
    pieces = salted(pieces, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    needs = salted(needs, F.pmod(F.xxhash64("rid", "diag"), F.coalesce("salts", F.lit(1))).cast("int"))
    both = needs.join(pieces, ["low", "block", "_salt"])
    a = F.greatest("lo", F.col("block") * BLOCK)
    width = F.least("hi", (F.col("block") + 1) * BLOCK) - a
    cut = F.array_join(F.slice(F.split("items", grain.glue), (a - F.col("block") * BLOCK + 1).cast("int"), width.cast("int")), grain.glue)
    out = both.select("rid", "low", "tag", "diag", "step", "n", (a + F.col("diag")).cast("int").alias("at"), cut.alias("items"))
    out = durable(out.groupBy("rid").agg(F.collect_list(F.struct("low", "tag", "diag", "at", "items", "step", "n")).alias("_from")))
    release(asked)
    return out


def kept_runs(eq: np.ndarray, worded: np.ndarray, long: np.ndarray, length: int) -> np.ndarray:
    """Which items the windows cover that lie wholly within equal items."""
    out = eq & long
    if len(eq) >= length:
        total = np.concatenate([[0], np.cumsum(eq)])
        whole = (total[length:] - total[:-length] == length) & any_in(worded, length)
        edge = np.zeros(len(eq) + 1, np.int64)
        edge[: len(whole)] += whole
        edge[length:] -= whole
        out |= np.cumsum(edge[:-1]) > 0
    return out


def _extended(own: list[bytes], found: list[dict], worded: np.ndarray, long: np.ndarray, grain: Grain) -> np.ndarray:
    """Which items of a document are in maximal repeats. found: what sources() lists for it."""
    out, equal, places, key, reach = np.zeros(len(own), bool), [], [], None, 0
    stretches = []  # step, n, place and items of each
    for m in sorted(found, key=lambda m: (m["low"], m["tag"], m["diag"], m.get("step", 0), m.get("n", 1), m["at"])):
        if m.get("n", 1) > 1:
            theirs, here = m["items"].split(grain.glue), (m["low"], m["tag"], m["diag"], m["step"], m["n"])
            if here == key and m["at"] == reach:
                stretches[-1][3].extend(theirs)
            else:
                stretches.append((m["step"], m["n"], m["at"], theirs))
            key, reach = here, m["at"] + len(theirs)
            continue
        at, theirs = m["at"], m["items"].split(grain.glue)
        if at < 0:
            at, theirs = 0, theirs[-at:]
        theirs = theirs[: max(0, len(own) - at)]
        here = (m["low"], m["tag"], m["diag"])
        if here == key and at < reach:  # blocks that overlap: what is there already has been compared
            theirs, at = theirs[reach - at :], reach
        if not theirs:
            continue
        if here != key or at > reach:  # no run goes on across a gap
            equal.append(False)
            places.append(0)
        key, reach = here, at + len(theirs)
        equal += [a == b for a, b in zip(own[at:reach], theirs)]
        places += range(at, reach)
    place = np.array(places, np.int64)
    out[place[kept_runs(np.array(equal, bool), worded[place], long[place], grain.length)]] = True
    for step, n, first, theirs in stretches:
        span, whole = len(theirs), None
        for p in range(first, first + n * step, step):
            here = slice(p, p + span)
            if own[here] == theirs:  # the items are those of the place before, and so are their flags
                whole = kept_runs(np.ones(span, bool), worded[here], long[here], grain.length) if whole is None else whole
                out[here] |= whole
            else:
                out[here] |= kept_runs(np.array([a == b for a, b in zip(own[here], theirs)], bool), worded[here], long[here], grain.length)
    return out


def _within(t: Texts, grain: Grain, start: np.ndarray, end: np.ndarray, first: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which items are covered by windows that began earlier in the same text. Texts are compared, hashes only propose."""
    out, raw = np.zeros(len(start), bool), t.data.tobytes()

    def later(key, own, at, span):
        order = np.lexsort((at, key, own))
        key, own, at = key[order], own[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
        for p, q in zip(at[~new].tolist(), lead[~new].tolist()):  # items of a window lie side by side in the text
            if raw[start[p] : end[p + span - 1]] == raw[start[q] : end[q + span - 1]]:
                out[p : p + span] = True

    for own, pos, whole, _, _ in chunks(t, grain):
        later(whole, own, first[own] + pos, grain.length)
    at = np.flatnonzero(long)
    later(item_hashes(t, start[at], end[at]), owners(first)[at], at, 1)
    return out


def remove_repeats(docs: DataFrame, grain: Grain, within: bool, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_items, n_removed, kept_text (what stays, joined by the grain's glue) and the columns in carry (under _0, _1, ...) for every
    row. within: a window that began earlier in the same text goes too (for items that the glue parts in the text, as lines)."""
    more = tuple(f"_{i}" for i in range(len(carry)))
    own_id = F.col(id_col).cast("long")
    rows = docs.select(own_id.alias("_doc"), F.coalesce(own_id, F.lit(LAST)).alias("_rid"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(m) for c, m in zip(carry, more)])
    bare = rows.select("_rid", "text")
    proposed = matches(bare, grain)
    told = sources(bare, proposed, grain)
    release(proposed)
    beside = rows.join(told, rows._rid == told.rid, "left").select("_doc", "text", "_from", *more)

    def make():
        def work(part, t):
            start, end, first = grain.items(t)
            worded = grain.worded(t, start, end)
            long = grain.long(t, start, end, worded)
            drop = _within(t, grain, start, end, first, long) if within else np.zeros(len(start), bool)
            for n in np.flatnonzero(np.asarray(part.column("_from").is_valid())).tolist():
                i, j = first[n], first[n + 1]
                raw, base = t.data[t.off[n] : t.off[n + 1]].tobytes(), t.off[n]
                own = [raw[a:b].decode() for a, b in zip((start[i:j] - base).tolist(), (end[i:j] - base).tolist())]
                drop[i:j] |= _extended(own, part.column("_from")[n].as_py(), worded[i:j], long[i:j], grain)
            removed = np.concatenate([[0], np.cumsum(drop)])
            return part.column("_doc"), np.diff(first), removed[first[1:]] - removed[first[:-1]], kept_texts(t, start, end, first, ~drop, grain.glue)

        return work

    return scan(beside, make, "doc_id long, n_items long, n_removed long, kept_text string", carry=more)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 13, gram: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each word covered by a window of `words` words that also begins in a document
    with a smaller id is removed; kept words are joined by one space. Windows are judged on the input."""
    return remove_repeats(docs, Grain(word_items, " ", words, gram), False, id_col, text).withColumnRenamed("n_items", "n_words")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lines: int = 2, alone: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: of runs of `lines` or more lines with a word among each `lines` of them, and of single
    lines of `alone` characters or more, that occur several times, the first (by doc_id, then place) stays and later ones are
    deleted. carry: as in remove_repeats. Lines are compared whole; an empty text has one empty line."""
    return remove_repeats(docs, Grain(line_items, "\n", lines, 1, alone, True), True, id_col, text, carry).withColumnRenamed("n_items", "n_lines")
