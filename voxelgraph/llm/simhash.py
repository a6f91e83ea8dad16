"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints within d = 2 bits are found over s = 2 segments of 32 bits: one of the segments then differs by at most one bit.
Each distinct fingerprint is indexed under every segment with one bit left out (its one-wildcard variants); fingerprints that
share a variant are compared in full. A variant shared by more than FULL fingerprints isn't compared pairwise: its members go
to a second index whose variants leave out any two of the 64 bits. Members of such a variant agree in the other 62, so all of
them link and a star suffices; no link is lost and no group is expanded into its pairs.

Edge cases: a null or empty text, or one without words, has fingerprint zero, which links like any other; null ids never
become a component's id unless it has no other; repeated rows share a fingerprint; an empty table gives an empty result; other
columns of the input are not read.

Very long texts: fingerprints() takes some 100 bytes for each word of the longest text, a sketch some 200. Ties have no say:
fingerprints depend on the text alone, and a component's id is its smallest.

similar_documents() uses the same variants on longer signatures to find candidates, and links documents whose sets of word
shingles have a Jaccard similarity of at least `least`, computed from the texts. PRINTS fingerprints of a document's set of words
make one string of bits, cut into SEGMENTS; each is indexed under every segment with one bit left out, and documents that share
one are candidates if the whole strings are close. A pair whose every segment differs by two bits or more is missed: recall is
measured in the tests and the README. Keys of 22 bits and more hold few strangers, so the work grows with the documents; members of
crowded keys are joined by few pairs first, and only those still apart meet again. Sketches of minimum hashes rule out pairs that
can't be alike before their texts are compared; they lose a pair just at `least` with probability 0.00001.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgraph.llm.components import components
from voxelgraph.llm.text import Texts, U, grams, inside, item_hashes, mix, multipliers, owners, scan, signed, space_table
from voxelgraph.storage import durable, release

#: A variant with more fingerprints than this goes to the exact two-bit index: beyond it, pairs cost more than that index.
FULL = 64

LAST = (1 << 63) - 1


def _shingles(t: Texts, digest: Callable, words: tuple[np.ndarray, np.ndarray, np.ndarray], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle, and how many each text has; a text of fewer words has one."""
    start, end, first = words
    size = end - start
    raw = t.data.tobytes()
    joined = b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])
    begin = np.cumsum(size + 1) - size - 1
    stop = begin + size
    per = np.diff(first)
    count = np.where(per >= shingle, per - shingle + 1, np.minimum(per, 1))
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = np.minimum(at + shingle, np.repeat(first[1:], count)) - 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin[at].tolist(), stop[last].tolist())), U, len(at)), count


def _majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each text, the bits set in over half of its hashes."""
    out = np.zeros(len(count), U)
    some = np.flatnonzero(count)
    if len(some):
        begins = (np.cumsum(count) - count)[some]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > count[some, None], axis=1, bitorder="little").view(U).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp: bit set if set in over half of the XXH64 (seed 42) of the word shingles, repeats included."""

    def make():
        import xxhash

        digest, blanks = xxhash.xxh64_intdigest, space_table()

        def work(part, t):
            t.lower()
            h, count = _shingles(t, digest, t.words(blanks), shingle)
            return part.column("_doc"), signed(_majority(h, count))

        return work

    return scan(docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text).cast("string").alias("text")), make, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """key, fp: a key for each segment and wildcard place: 1 bit segment, 5 bits place, 32 bits of the segment without that bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(32, dtype=U)
        clear = ~(U(1) << place) & U(0xFFFFFFFF)
        for batch in batches:
            fp = np.asarray(batch.column(0), np.int64).view(U)
            for at in range(0, len(fp), 8192):
                f = fp[at : at + 8192]
                key = [((U(s) << U(37)) | (place << U(32)))[None, :] | (((f >> U(32 * s)) & U(0xFFFFFFFF))[:, None] & clear) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key, axis=1).ravel().view(np.int64)), pa.array(np.repeat(f, 64).view(np.int64))], names=["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def _compared(variants: DataFrame, bits: int, full: int) -> DataFrame:
    """a, b: linked fingerprints that share a variant; a = b marks a member of an overfull variant. Rows come sorted by key, so
    only one variant of at most full members is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key, fp):
            cut = np.flatnonzero(np.diff(key)) + 1
            begin, n = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(key)]]))
            size, start = np.repeat(n, n), np.repeat(begin, n)
            over, found = size > full, []
            found.append((fp[over], fp[over]))
            small = np.flatnonzero((size > 1) & ~over)
            for step in range(1, full):
                small = small[small + step < (start + size)[small]]
                if not len(small):
                    break
                a, b = fp[small], fp[small + step]
                d = a ^ b
                ok = np.bitwise_count(d) <= bits
                # A pair shares up to 64 variants: report it where it is first met.
                k, d = key[small].view(U), d
                seg, place = k >> U(37), (k >> U(32)) & U(31)
                low, high = d & U(0xFFFFFFFF), d >> U(32)
                bit = lambda x: np.bitwise_count((x & (~x + U(1))) - U(1)) * (x > 0)
                low_ok = np.bitwise_count(low) <= 1
                ok &= np.where(low_ok, (seg == 0) & (place == bit(low)), (seg == 1) & (place == bit(high)))
                found.append((a[ok], b[ok]))
            return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

        key, fp, gone = np.zeros(0, np.int64), np.zeros(0, U), None
        for batch in batches:
            k, f = np.asarray(batch.column("key"), np.int64), np.asarray(batch.column("fp"), np.int64).view(U)
            if gone is not None:  # the rest of an overfull variant already given out
                rest = int(np.searchsorted(k, gone, side="right"))
                if rest:
                    yield _edges(f[:rest], f[:rest])
                k, f = k[rest:], f[rest:]
                gone = gone if not len(k) else None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            at = int(np.searchsorted(key, key[-1]))
            if len(key) - at > full:
                gone, at = key[-1], len(key)
            if at:
                yield _edges(*pairs(key[:at], fp[:at]))
            key, fp = key[at:], fp[at:]
        if len(key):
            yield _edges(*pairs(key, fp))

    keyed = variants.repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(run, "a long, b long")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _two_bit(fps: DataFrame) -> DataFrame:
    """a, b: stars over the variants without any two bits; fingerprints that share one are within two bits of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(64, 1)
        clear, place = ~((U(1) << i.astype(U)) | (U(1) << j.astype(U))), (i * 64 + j).astype(np.int32)
        for batch in batches:
            fp = np.asarray(batch.column(0), np.int64).view(U)
            for at in range(0, len(fp), 256):
                f = fp[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(place, len(f))), pa.array((f[:, None] & clear).ravel().view(np.int64)), pa.array(np.repeat(f, len(i)).view(np.int64))], names=["place", "rest", "fp"])

    keyed = fps.mapInArrow(run, "place int, rest long, fp long")
    groups = keyed.groupBy("place", "rest").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # four members at most
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, bits: int = 2, full: int = FULL) -> DataFrame:
    """a, b: links enough to join all fingerprints within two bits. fps: one long column, distinct."""
    if bits > 2:
        raise ValueError("two segments guarantee links up to two bits")
    found = durable(_compared(_variants(fps), bits, full))
    crowded = found.where("a = b").select("a").distinct()
    return found.where("a <> b").unionByName(_two_bit(crowded))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, full: int = FULL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for every row."""
    rows = durable(fingerprints(docs, id_col, text, shingle))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), 2, full))
    whole = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    named = durable(whole.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: similar_documents(): fingerprints of 64 bits, segments they are cut into together, bits in which two may differ in the first
#: fingerprint and in all, and members of a key that are compared in place.
PRINTS, SEGMENTS, NEAR, NEAR_ALL, CROWD = 4, 11, 16, 44, 16

#: Words of 64 bits in the sketch of a set of shingles: a bit of each of as many minimum hashes.
MINIMA = 8


def _sets(t: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the word shingles of each text in turn, and where each text's begin; a text of fewer words has one."""
    start, end, first = t.words(space_table())
    h, own, per = item_hashes(t, start, end), owners(first), np.diff(first)
    found = [(grams(h, words)[inside(first, words)], own[: max(0, len(h) - words + 1)][inside(first, words)])]
    for k in range(1, words):
        few = np.flatnonzero(per == k)
        found.append((grams(h, k, seed=7 + k)[first[few]], few))
    return _distinct(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), t.n)


def _distinct(x: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((x, own))
    x, own = x[order], own[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (own[1:] != own[:-1])
    return x[new], np.searchsorted(own[new], np.arange(n + 1))


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of each text's run."""
    total = np.zeros(len(x) + 1, U)
    np.cumsum(x, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]


def _sketches(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """doc_id, node, size, fp0, fp1, ...: a hash of the set of shingles of `words` words, how many they are, and fingerprints of the set
    of words: bit set if set in over half of its members' hashes. Edits move few of a text's words but `words` times as many of
    its shingles, so documents alike in shingles differ in few bits."""

    def make():
        def work(part, t):
            t.lower()
            x, begin = _sets(t, words)
            size = np.diff(begin)
            node = mix(_sums(mix(x), begin) + size.astype(U))
            start, end, first = t.words(space_table())
            w, at = _distinct(item_hashes(t, start, end), owners(first), t.n)
            prints = [_majority(mix(w ^ mix(np.full(1, k + 1, U))), np.diff(at)) for k in range(PRINTS)]
            return part.column("_doc"), signed(node), size, *[signed(f) for f in prints]

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text).cast("string").alias("text"))
    return scan(rows, make, "doc_id long, node long, size long, " + ", ".join(f"fp{k} long" for k in range(PRINTS)))


def _cuts() -> list[int]:
    """Where the segments of the string of bits begin, and the end."""
    return np.linspace(0, 64 * PRINTS, SEGMENTS + 1).round().astype(int).tolist()


def _keys(prints: DataFrame, carry: list[str]) -> DataFrame:
    """key and the columns in carry (long) for each wildcard place: key >> 32 is the place, the rest its segment without that bit."""
    fps = [f"fp{k}" for k in range(PRINTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = np.stack([np.asarray(part.column(f), np.int64) for f in fps], axis=1)
                bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").astype(U)
                keys = []
                for a, b in zip(cuts, cuts[1:]):
                    one = U(1) << np.arange(b - a, dtype=U)
                    segment = (bits[:, a:b] * one).sum(1, dtype=U)[:, None]
                    keys.append((np.arange(a, b, dtype=U) << U(32)) | (segment & ~one))
                key = np.concatenate(keys, axis=1)
                each = [np.repeat(np.asarray(part.column(c), np.int64), key.shape[1]) for c in carry]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), *map(pa.array, each)], names=["key", *carry])

    return prints.select(*dict.fromkeys([*fps, *carry])).mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in carry))


def _met(keys: DataFrame, least: float) -> DataFrame:
    """a, b, d: nodes that share a key with at most CROWD others, whose sizes allow a similarity of `least` and whose first
    fingerprints are d <= NEAR bits apart; of a crowded key each with those among the CROWD before it, and (a = b) all its members. Rows
    come by key and size; what is held are the last CROWD of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0  # the last rows of the key that is open, and how many it had before them
        for batch in batches:
            key, size, fp, node = (np.asarray(batch.column(c), np.int64) for c in ("key", "size", "fp0", "node"))
            if not len(key):
                continue
            old = 0
            if held is not None:
                old = len(held[0])
                key, size, fp, node = (np.concatenate(c) for c in zip(held, (key, size, fp, node)))
            new = np.concatenate([[True], key[1:] != key[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            place = np.arange(len(key)) - begin + np.where(begin == 0, before, 0)
            f, found, left = fp.view(U), [], np.arange(max(old, 1), len(key))
            for step in range(1, CROWD + 1):
                left = left[left - step >= begin[left]]
                left = left[size[left - step] >= least * size[left] - 1e-9]
                if not len(left):
                    break
                d = np.bitwise_count(f[left] ^ f[left - step]).astype(np.int64)
                ok = d <= NEAR
                found.append((node[left[ok]], node[left[ok] - step], d[ok]))
            fresh = np.arange(len(key)) >= old
            over = np.flatnonzero((place >= CROWD) & fresh)
            first = over[place[over] == CROWD]
            over = np.concatenate([over, (first[:, None] - np.arange(1, CROWD + 1)).ravel()])
            found.append((node[over], node[over], np.zeros(len(over), np.int64)))
            a, b, d = (np.concatenate(c) for c in zip(*found))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], names=["a", "b", "d"])
            tail = max(begin[-1], len(key) - CROWD)
            held, before = [c[tail:] for c in (key, size, fp, node)], int(place[tail])

    return keys.repartition("key").sortWithinPartitions("key", "size").mapInArrow(run, "a long, b long, d long")


def _first_shared(x: list[Column]) -> Column:
    """The first wildcard place that two strings of bits share, from the exclusive or of their words."""
    places, cuts = [], _cuts()
    for a, b in zip(cuts, cuts[1:]):
        w, at = divmod(a, 64)
        segment = F.shiftrightunsigned(x[w], at) if at else x[w]
        if at + b - a > 64:
            segment = segment.bitwiseOR(F.shiftleft(x[w + 1], 64 - at))
        segment = segment.bitwiseAND(F.lit((1 << (b - a)) - 1))
        places.append(F.when(F.bit_count(segment) <= 1, F.lit(a) + F.when(segment == 0, 0).otherwise(F.bit_count(segment - 1))))
    return F.coalesce(*places)


def _minima(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MINIMA words for each text: one bit of each minimum of its shingles under a different multiplier. Two texts differ in a bit
    with probability (1 - their Jaccard similarity) / 2. A text without shingles has zeros."""
    some = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, MINIMA), U)
    low = mix(x).astype(np.uint32)
    for k, m in enumerate(multipliers(64 * MINIMA, 23)):
        least = np.minimum.reduceat((low ^ np.uint32(m >> U(32))) * np.uint32(m & U(0xFFFFFFFF)), begin[some]) if len(some) else np.zeros(0, np.uint32)
        out[some, k >> 6] |= (mix(least.astype(U) + m) & U(1)) << U(k & 63)
    return out


def _reach(least: float) -> int:
    """Bits of the sketch in which two sets as alike as `least` differ at most, but for one pair in 100,000 of those exactly so."""
    bits, p = 64 * MINIMA, (1 - least) / 2
    return int(np.ceil(bits * p + 4.5 * np.sqrt(bits * p * (1 - p))))


def _apart(keys: DataFrame, crowd: DataFrame, least: float) -> DataFrame:
    """a, b, d: close nodes with different labels that share a key, each pair once. In a key, members of the most frequent label meet all
    others, but not each other: what remains of a group of copies that has been joined costs nothing more. Sizes and sketches rule
    out the pairs that aren't alike before they are made. keys: key, node, label; crowd: node, size, fingerprints, sketch."""
    most = keys.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.expr("max_by(label, struct(n, label))").alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    fps, marks = [f"fp{k}" for k in range(PRINTS)], [f"s{k}" for k in range(MINIMA)]
    alive = keys.join(most.select("key", "most"), "key").join(crowd.select("node", "size", *fps, *marks), "node")
    few = alive.where("label <> most").select("key", F.col("node").alias("m"), F.col("label").alias("l"), "most", F.col("size").alias("z"), *[F.col(c).alias(f"x{c}") for c in (*fps, *marks)])
    x = [F.col(f"x{f}").bitwiseXOR(F.col(f)) for f in fps]
    d = sum((F.bit_count(w) for w in x[1:]), F.bit_count(x[0]))
    far = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(c))) for c in marks), F.lit(0))
    sizes = F.least("z", "size") >= least * F.greatest("z", "size") - 1e-9
    once = (F.col("label") == F.col("most")) | (F.col("m") < F.col("node"))
    pairs = few.join(alive.drop("most"), "key").where((F.col("l") != F.col("label")) & once & sizes & (d <= NEAR_ALL) & (far <= _reach(least)) & (_first_shared(x) == F.shiftrightunsigned("key", 32)))
    return pairs.select(F.least("m", "node").alias("a"), F.greatest("m", "node").alias("b"), d.cast("long").alias("d"))


def _alike(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """a, b: those pairs whose sets of shingles are alike enough. texts: node, text."""
    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "text"), "b").select("a", "b", "left", "text")

    def make():
        def work(part, t):
            (x, i), (y, j) = _sets(t.lower(), words), _sets(Texts(part.column("left"), t.powers).lower(), words)
            common = np.array([len(np.intersect1d(x[i[n] : i[n + 1]], y[j[n] : j[n + 1]], assume_unique=True)) for n in range(t.n)], np.int64)
            ok = common >= least * (np.diff(i) + np.diff(j) - common) - 1e-9
            return np.asarray(part.column("a"), np.int64)[ok], np.asarray(part.column("b"), np.int64)[ok]

        return work

    return scan(both, make, "a long, b long")


def _noded(texts: DataFrame, words: int) -> DataFrame:
    """node, text for every row of texts (text)."""

    def make():
        def work(part, t):
            x, begin = _sets(t.lower(), words)
            return (signed(mix(_sums(mix(x), begin) + np.diff(begin).astype(U))),)

        return work

    return scan(texts, make, "node long", carry=("text",))


def _marked(texts: DataFrame, words: int) -> DataFrame:
    """node, s0, s1, ... for every row of texts (text): the sketch of its shingles."""

    def make():
        def work(part, t):
            x, begin = _sets(t.lower(), words)
            return signed(mix(_sums(mix(x), begin) + np.diff(begin).astype(U))), *signed(np.ascontiguousarray(_minima(x, begin).T))

        return work

    return scan(texts, make, "node long, " + ", ".join(f"s{k} long" for k in range(MINIMA)))


def _similar(docs: DataFrame, id_col: str, text: str, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, node of every row; node, component_id of every node."""
    rows = durable(_sketches(docs, id_col, text, words))
    nodes = durable(rows.groupBy("node").agg(F.min("doc_id").alias("low")))
    fps, marks = [f"fp{k}" for k in range(PRINTS)], [f"s{k}" for k in range(MINIMA)]
    prints = durable(rows.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), *[F.first(f).alias(f) for f in fps]))  # one set, one size; of its texts' words one
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.col(text).cast("string").alias("text"))

    def of(some: DataFrame, work: Callable) -> DataFrame:
        """What work makes of the texts of some nodes (node), one row each."""
        need = some.join(nodes, "node")
        ids = need.select(F.coalesce("low", F.lit(LAST)).alias("_low")).distinct()
        there = source.join(ids, F.col("_id") == F.col("_low"), "left_semi").select("text")
        return durable(work(there, words).join(need, "node", "left_semi").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are alike by their texts."""
        pairs = durable(pairs)
        if pairs.isEmpty():
            return pairs
        there = of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), _noded)
        out = durable(_alike(pairs, there, words, least))
        release(pairs, there)
        return out

    def close(found: DataFrame) -> DataFrame:
        """Of pairs found by the first fingerprint, those close in all and in their sketches."""
        one, two = (met_nodes.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}{c}") for c in (*fps, *marks)]) for n in ("a", "b"))
        apart = lambda names: sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in names), F.lit(0))
        both = found.join(one, "a").join(two, "b")
        return both.where((apart(fps) <= NEAR_ALL) & (apart(marks) <= _reach(least))).select("a", "b", "d")

    def linked(found: DataFrame, links: DataFrame | None) -> DataFrame:
        """links and those that found adds. Most join by two pairs for each node, its smallest and its nearest neighbour; of the
        other pairs only those are compared whose ends are still apart. So a group of copies costs pairs in proportion."""
        both = found.select(F.col("a").alias("x"), F.col("b").alias("y"), "d").unionByName(found.select(F.col("b").alias("x"), F.col("a").alias("y"), "d"))
        two = both.groupBy("x").agg(F.array(F.min("y"), F.expr("min_by(y, struct(d, y))")).alias("_two")).select("x", F.explode("_two").alias("y"))
        one = verified(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        links = one if links is None else links.unionByName(one)
        root = durable(components(links))
        rest = found.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        return links.unionByName(verified(rest.select("a", "b")))

    met = durable(_met(_keys(prints, ["size", "fp0", "node"]), least).groupBy("a", "b").agg(F.min("d").alias("d")))
    met_nodes = of(met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), _marked)
    met_nodes = durable(prints.join(met_nodes.select("node", *marks), "node"))
    links = linked(durable(close(met.where("a <> b"))), None)
    # Members of crowded keys: what is still apart there meets once more.
    crowd = met_nodes.join(met.where("a = b").select(F.col("a").alias("node")), "node", "left_semi")
    crowd = durable(crowd.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    if not crowd.isEmpty():
        keyed = durable(_keys(crowd, ["node", "label"]))
        again = durable(_apart(keyed, crowd, least))
        release(keyed, crowd)
        links = linked(again, links)
    release(met, met_nodes)
    whole = nodes.join(components(links), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    ids = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "node"), durable(whole.join(ids, "root").select("node", "component_id"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id for every row: groups of documents linked by a Jaccard similarity of at least `least` between their sets
    of `words`-word shingles, among the pairs that share a deletion variant (see the module's text)."""
    rows, named = _similar(docs, id_col, text, words, least)
    return rows.join(named, "node").select("doc_id", "component_id")


def first_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """component_id: the smallest id of each group of similar_documents()."""
    return _similar(docs, id_col, text, words, least)[1].select("component_id").distinct()
