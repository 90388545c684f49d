"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its word shingles (five words; a text with fewer is one shingle),
weighted by how often they occur. Two documents are linked if their weighted Jaccard similarity
(sum of smaller over sum of larger weights) is at least 0.8; classes are the connected components.

1. Documents with the same words are one node; texts without words are one node if they are equal.
2. Sketch. Every element owns the region weight x time, into which darts are thrown by a hash: a
   Poisson process of rate 1 on each unit of weight. A document keeps the darts below its weights that
   come before ``darts / total weight``; each dart has a coordinate, and the earliest dart of a coordinate is the
   document's value there. So the work follows the number of darts, not elements times coordinates.
   If a coordinate stays empty, the time is doubled for that document.
3. Bands of equal values make buckets. Every member is compared with its bucket's leader (no pairs within
   a bucket), first with the leader it has most in common with, then with those of other classes.
4. What leaders cannot settle: members of buckets that still hold several classes are compared exactly
   by a prefix join. Elements are ordered from rare to frequent; two similar sets share an element among
   the first W - ceil(0.8 W) + 1. Only pairs from different classes are formed.
Each comparison is the exact similarity of whole texts.

A null text is a class of its own. Repeated rows are copies. Ties for the kept row go to the smallest id
(null last), then to the first row. An empty table gives no rows. The input is read more than once and must
give its rows in the same order, as files and tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.llm.common import batch, ints, ragged, release, utf8_texts, with_rows
from restock.llm.decontaminate import split_words
from restock.session import cut_lineage, drop_staged

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
COORDINATES = BANDS * ROWS
SKETCH_BITS = 18
PARITY_WORDS = 4
CACHE_WORDS = 200_000
SEEN_TEXTS = 500_000
FILTER_BITS = 25

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[bytes], hashes: Hashes, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and their counts."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix((out + h[k : len(h) - n + 1 + k]) * _P1)
    return np.unique(out, return_counts=True)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for non-empty weighted sets (positive weights)."""
    totals = np.array([w.sum() for _, w in sets], np.float64)
    out = np.zeros((len(sets), k), np.uint64)
    todo = np.arange(len(sets))
    horizon = (k * np.log(k) + 2 * k) / totals if k > 1 else 8.0 / totals
    while len(todo):
        units = [np.ceil(sets[i][1]).astype(np.int64) for i in todo]
        run, layer = ragged(np.concatenate(units))
        element = np.concatenate([sets[i][0] for i in todo])[run]
        room = np.concatenate([sets[i][1] for i in todo])[run] - layer  # weight of this unit that is covered
        owner = np.repeat(np.arange(len(todo)), [u.sum() for u in units])
        seed = _mix(element + _P1 * layer.astype(np.uint64))
        limit = horizon[todo][owner]
        time = np.zeros(len(seed))
        darts, times, cells = [], [], []
        throw = 0
        while len(seed):
            throw += 1
            u = _mix(seed + np.uint64(int(_P1) * throw & (1 << 64) - 1))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            alive = np.flatnonzero(time < limit)
            seed, time, limit, owner, room = seed[alive], time[alive], limit[alive], owner[alive], room[alive]
            dart = _mix(u[alive] ^ _P3)
            hit = np.arange(len(dart))
            if len(room) and room.min() < 1:  # a dart above a partly covered unit misses
                hit = np.flatnonzero((_mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < room)
            darts.append(dart[hit])
            times.append(time[hit])
            cells.append(owner[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
        dart, time, cell = np.concatenate(darts), np.concatenate(times), np.concatenate(cells)
        order = np.argsort(-time, kind="stable")
        found = np.zeros(len(todo) * k, np.uint64)
        found[cell[order]] = dart[order]  # of equal cells the last, that is the earliest dart, stays
        filled = np.zeros(len(todo) * k, bool)
        filled[cell] = True
        full = filled.reshape(-1, k).all(1)
        out[todo[full]] = found.reshape(-1, k)[full]
        todo = todo[~full]
        horizon[todo] *= 2
    return out


def bands(signatures: np.ndarray, count: int = BANDS) -> np.ndarray:
    rows = signatures.reshape(len(signatures), count, -1)
    key = np.zeros(rows.shape[:2], np.uint64)
    for r in range(rows.shape[2]):
        key = _mix((key + rows[:, :, r]) * _P1)
    return key.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of sorted distinct elements with weights."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    same = a[at] == b
    low = np.minimum(wa[at[same]], wb[same]).sum()
    return float(low) / float(wa.sum() + wb.sum() - low)


_SKETCHES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.binary()), ("total", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _node(text: bytes | None, row: int, words: list[bytes]) -> bytes:
    if text is None:
        return xxhash.xxh3_128_digest(b"null %d" % row)
    return xxhash.xxh3_128_digest(b"w " + b" ".join(words)) if words else xxhash.xxh3_128_digest(b"t " + text)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    hashes, seen = Hashes(), set()
    for b in batches:
        for lo in range(0, b.num_rows, 400):
            part = b.slice(lo, 400)
            if len(hashes) > CACHE_WORDS:
                hashes.clear()
            if len(seen) > SEEN_TEXTS:  # a text seen again is sketched again, no more
                seen.clear()
            nodes, totals, sets, place = [], [], [], {}
            for k, (row, text, null) in enumerate(zip(part.column(0).to_pylist(), utf8_texts(part.column(2)), part.column(2).is_null().to_pylist())):
                words = split_words(text)
                node = _node(None if null else text, row, words)
                nodes.append(node)
                totals.append(max(1, len(words) - WORDS + 1) if words else 0)
                if words and node not in seen:
                    seen.add(node)
                    place[k] = len(sets)
                    sets.append(shingles(words, hashes))
            found = bands(dart_signatures(sets)).tolist() if sets else []
            keys = [found[place[k]] if k in place else None for k in range(len(nodes))]
            yield batch(_SKETCHES, (part.column(0), part.column(1), nodes, totals, keys))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary()), ("weights", pa.binary())])
    for b in batches:
        for lo in range(0, b.num_rows, 400):
            part = b.slice(lo, 400)
            if len(hashes) > CACHE_WORDS:
                hashes.clear()
            sets = [shingles(split_words(_unpack(t)), hashes) for t in part.column(1)]
            yield batch(schema, (part.column(0), [h.tobytes() for h, _ in sets], [w.astype("<i4").tobytes() for _, w in sets]))


def _unpack(packed: pa.Scalar) -> bytes:
    return zstandard.decompress(packed.as_buffer())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities of pairs of texts; pairs of one leader ``a`` come one after another, so its set is made once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    release()
    hashes, leader, of_leader = Hashes(), None, None
    for b in batches:
        found = []
        for a, ta, tb in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
            if len(hashes) > CACHE_WORDS:
                hashes.clear()
            if of_leader is None or a != leader:
                leader, of_leader = a, shingles(split_words(_unpack(ta)), hashes)
            found.append(similarity(*of_leader, *shingles(split_words(_unpack(tb)), hashes)))
        yield batch(schema, (b.column(0), b.column(1), found))


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The exact similarity of each pair (a, b) of nodes. Packed texts are sent, a tenth of their shingles' bytes."""
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("tb"))
    joined = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(_compare, "a long, b long, similarity double")


def marked_rows(rows: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with the hash bits of all ``row`` values set; its size does not grow."""
    place = F.pmod(F.xxhash64("row"), F.lit(1 << FILTER_BITS))
    words = rows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(row), {1 << FILTER_BITS}) & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def texts_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed text) of the ``wanted`` rows, and of the few others whose hash bit is set too.

    No join, so no text is shuffled for it; what is not wanted meets no pair.
    """
    sent = source.sparkSession.sparkContext.broadcast(marked_rows(wanted))
    schema = pa.schema([("node", pa.int64()), ("packed", pa.binary())])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            place = ints(b.column(1))
            keep = np.flatnonzero(sent.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1))
            for low in range(0, len(keep), 1000):
                at = pa.array(keep[low : low + 1000])
                yield batch(schema, (b.column(0).take(at), [pack(t) for t in utf8_texts(b.column(2).take(at))]))

    placed = source.select("row", F.pmod(F.xxhash64("row"), F.lit(1 << FILTER_BITS)).alias("place"), "text")
    return placed.mapInArrow(some, "node long, packed binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by alternating large and small stars.

    Every round is a pair of aggregations over the links, written to the shared folder; stars of any
    size are summed up before they are shuffled.
    """
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        superseded, edges = edges, cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct())
        drop_staged(links.sparkSession, superseded)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links (a, b): components of the few classes that the links join."""
    left = _labelled(links.select(F.col("a").alias("node"), "b"), labels).select(F.col("label").alias("a"), F.col("b").alias("node"))
    ends = _labelled(left, labels).select("a", F.col("label").alias("b"))
    up = cut_lineage(components(ends))
    moved = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
    alone = up.join(labels.select("node"), "node", "left_anti")
    return cut_lineage(moved.select("node", F.coalesce("root", "label").alias("label")).union(alone.select("node", "label")))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        for h in b.column(0):
            counts += np.bincount((np.frombuffer(h.as_buffer(), "<u8") >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["cell", "n"])


def prefix_pairs(sets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes with different labels that share a prefix element.

    Complete for similarities of ``least`` or more under any order of the elements; a table of
    2^SKETCH_BITS counts makes it from rare to frequent. At the first element that two sets share, what
    comes from there on in the shorter rest bounds their overlap; pairs whose bound is below the overlap that
    ``least`` asks for are not formed. So texts that share a frequent passage do not meet unless
    the passage is nearly all of them. Parities of the element counts in PARITY_WORDS x 64 cells bound the
    difference from below in the same way: each cell whose parity differs holds an element of one set only.
    """
    spark = sets.sparkSession
    cells = sets.select("hashes").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(counts)
    named = sets.schema["node"].dataType
    kind = pa.binary() if named.simpleString() == "binary" else pa.int64()
    schema = pa.schema(
        [("element", pa.int64()), ("node", kind), ("label", kind), ("total", pa.int64()), ("rest", pa.int64())]
        + [(f"p{k}", pa.int64()) for k in range(PARITY_WORDS)]
    )
    parities = [f"p{k}" for k in range(PARITY_WORDS)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, label, h, w in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                run, layer = ragged(np.frombuffer(w.as_buffer(), "<i4"))
                h = np.frombuffer(h.as_buffer(), "<u8")[run]
                rank = sent.value[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                element = _mix(h + _P1 * layer.astype(np.uint64)).view(np.int64)
                n = len(h)
                first = np.lexsort((element, rank))[: n - int(np.ceil(least * n - 1e-9)) + 1]
                k = len(first)
                odd = np.bincount(element & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
                words = np.packbits(odd.astype(np.uint8)).view(np.int64)
                yield batch(schema, (
                    element[first], [node.as_py()] * k, [label.as_py()] * k, [n] * k, n - np.arange(k), *([w] * k for w in words.tolist()),
                ))

    joined = sets.join(labels, "node").select("node", "label", "hashes", "weights")
    postings = cut_lineage(joined.mapInArrow(prefixes, f"element long, node {named.simpleString()}, label {named.simpleString()}, total long, rest long, " + ", ".join(f"{p} long" for p in parities)))
    by_label = postings.groupBy("element", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("element").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1")
    posted = postings.join(mixed.select("element", "major").hint("merge"), "element")
    # a large class meets the others of its element; its own members do not meet each other
    minor = posted.where("label <> major").select(
        "element",
        F.col("node").alias("o_node"),
        F.col("label").alias("o_label"),
        F.col("total").alias("o_total"),
        F.col("rest").alias("o_rest"),
        *(F.col(p).alias(f"o_{p}") for p in parities),
    )
    differing = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"o_{p}"))) for p in parities[1:]), F.bit_count(F.col("p0").bitwiseXOR(F.col("o_p0"))))
    most = F.lit((1 - least) / (1 + least)) * (F.col("total") + F.col("o_total")) + 1e-6
    overlap = F.lit(least / (1 + least)) * (F.col("total") + F.col("o_total")) - 1e-6
    return (
        posted.join(minor.hint("merge"), "element")
        .where((F.col("label") != F.col("o_label")) & ((F.col("label") == F.col("major")) | (F.col("node") < F.col("o_node"))))
        .where((F.least("rest", "o_rest") >= overlap) & (differing <= most))
        .select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))
        .distinct()
    )


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))


# Joins of tables that grow with the documents are sort-merge joins at every size (hint "merge"): plans do not change with
# the data, and the shuffle grows in proportion.


def classes(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, doc_id, class_id (smallest id of the class), class_size, kept."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    ddl = "row long, doc_id long, node binary, total long, bands array<long>"
    rows = cut_lineage(source.mapInArrow(_sketch, ddl))
    # a node is a text, known by the smallest row that holds it
    nodes = cut_lineage(
        rows.groupBy("node").agg(F.min("row").alias("row"), F.max("total").alias("total"), F.first("bands", ignorenulls=True).alias("bands"))
    )
    members = nodes.select(F.col("row").alias("node"), "total", F.posexplode("bands").alias("band", "key"))
    buckets = (
        members.groupBy("band", "key")
        .agg(F.count("*").alias("n"), F.min(F.struct("node", "total")).alias("leader"))
        .where("n > 1")
        .select("band", "key", "n", F.col("leader.node").alias("leader"), F.col("leader.total").alias("leader_total"))
    )
    shared = cut_lineage(members.join(buckets.hint("merge"), ["band", "key"]))  # members of buckets that hold two nodes or more
    ratio = F.least("total", "leader_total") >= F.lit(least - 1e-9) * F.greatest("total", "leader_total")
    led = cut_lineage(
        shared.where((F.col("node") != F.col("leader")) & ratio)
        .groupBy(F.col("leader").alias("a"), F.col("node").alias("b"))
        .agg(F.count("*").alias("shared"))
    )
    involved = shared.select("node").distinct()
    texts = cut_lineage(texts_of(source, involved.select(F.col("node").alias("row"))))
    first = led.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    compared = cut_lineage(compare(first, texts))
    similar = F.col("similarity") >= least
    labels = cut_lineage(components(compared.where(similar)))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of different classes that are not compared yet."""
        side = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
        return (
            pairs.select("a", "b")
            .join(compared.select("a", "b"), ["a", "b"], "left_anti")
            .join(side("a"), "a", "left")
            .join(side("b"), "b", "left")
            .where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
            .select("a", "b")
        )

    more = cut_lineage(compare(apart(led), texts))
    compared = compared.union(more)
    labels = merged(labels, more.where(similar))
    mixed = (
        _labelled(shared.where("n > 2"), labels)
        .groupBy("band", "key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low <> high")
        .select("band", "key")
    )
    open_nodes = cut_lineage(shared.join(mixed, ["band", "key"], "left_semi").select("node").distinct())
    open_sets = cut_lineage(
        texts.join(open_nodes, "node", "left_semi").mapInArrow(_shingle_rows, "node long, hashes binary, weights binary")
    )
    rest = cut_lineage(apart(prefix_pairs(open_sets, _labelled(open_nodes, labels), least)))
    labels = merged(labels, cut_lineage(compare(rest, texts)).where(similar))

    held = rows.select(F.col("row").alias("of"), "doc_id", "node").join(nodes.select("node", "row").hint("merge"), "node")
    labelled = cut_lineage(
        _labelled(held.select("of", "doc_id", F.col("row").alias("node")), labels).select(F.col("of").alias("row"), "doc_id", "label")
    )
    for done in (rows, nodes, shared, led, texts, open_nodes, open_sets):
        drop_staged(docs.sparkSession, done)
    groups = labelled.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first"), F.count("*").alias("class_size")
    )
    return labelled.join(groups.hint("merge"), "label").select(
        "row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept")
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class."""
    numbered, row = with_rows(docs)
    kept = cut_lineage(classes(docs, **options).where("kept").select(F.col("row").alias(row)))
    return numbered.join(kept, row, "left_semi").drop(row)
