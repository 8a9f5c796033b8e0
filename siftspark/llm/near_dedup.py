"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words split at ASCII white space; with fewer words
the whole sequence is the one shingle). Documents with equal sets form a class, found by 128 bits of a cryptographic digest of
the whole sorted set, and from there on a class counts once. Each class has a sketch of ``BINS`` coordinates: in round i < BINS every shingle is thrown into
one bin with a hashed value, and from round BINS on all go to bin i - BINS, so that every coordinate fills after 2 * BINS
rounds at most; a coordinate keeps the least (round, value). Coordinates agree with probability equal to the Jaccard
similarity and concentrate like independent ones. ``BINS / ROWS`` bands of ROWS coordinates make the candidates: at 0.75 a
pair shares no band with probability (1 - 0.75^4)^32 < 6e-6.

Candidates in a bucket are first compared with the bucket's hubs: its ``HUBS`` classes that share buckets with most others, so
that the text which near copies were made from is likely among them. Verified links join into components (least label with
pointer jumping, distributed, every step written to the shared folder). Only classes that share a bucket and are still in
different components are then compared with each other. Two exact bounds keep that from growing with the square of a group: sizes,
and in crowded buckets the shingles of a class that any class of another component has at all, as no intersection is larger.
A longer sketch must agree well enough too (``FAR_BITS``). Links are confirmed on the full shingle sets, recounted from the
texts; sketches never decide. A group of m copies so costs about HUBS * m comparisons.

Defined results: null, empty or blank text has an empty set and is linked with nothing; repeated rows are copies of each
other; rows that repeat a doc_id with other text are nodes of their own; component_id is the least doc_id reachable
(null only where every member's is null) and kept says whether doc_id equals it; an empty table gives no rows; extra columns
are ignored (``near_dedup`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ascii_lower_bytes, durable, named, numbered, ship_package, spread_join

WORDS, BINS, ROWS = 5, 128, 4
#: Classes of a bucket that all its members are compared with, and members from which a bucket is crowded (another way to the
#: same pairs, not a cap).
HUBS, CROWDED = 3, 16
#: Groups that the partners of one class are dealt to.
SALTS = 64
#: In the second stage classes are told apart by the last bits of LONG coordinates. Two sets of similarity 0.75 differ in 128 of 1024
#: bits on average, with a standard deviation of 10.6; in more than FAR_BITS with a probability of about 1e-6.
LONG, FAR_BITS = 1024, 181
#: Link where 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SKETCHES = "doc_id long, text_hash long, n_shingles long, cls binary, bands array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64()))])
_ROWS_OUT = 2000
_ROW = ["__nd_id", "__nd_null", "__nd_hash"]


def shingle_set(text: str | None) -> set[bytes]:
    words = ascii_lower_bytes(text or "").split()
    if len(words) < WORDS:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The coordinates of a non-empty set of 64-bit hashes; bins is a power of two. Earlier rounds win, so rounds may go in blocks."""
    out = np.full(bins, _EMPTY, np.uint64)
    step = max(1, -(-6 * bins // len(hashes)))
    for i in range(0, 2 * bins, step):
        rounds = np.arange(i, min(i + step, 2 * bins))
        seeds = _mix((rounds + 1).astype(np.uint64) * _GOLD)
        thrown = _mix(hashes[None, :] ^ seeds[:, None])
        at = np.where(rounds[:, None] < bins, (thrown & np.uint64(bins - 1)).astype(np.int64), rounds[:, None] - bins)
        np.minimum.at(out, at.ravel(), (rounds.astype(np.uint64)[:, None] << np.uint64(52) | thrown >> np.uint64(12)).ravel())
        if (out != _EMPTY).all():
            break
    return out


_BAND_SEEDS = _mix(np.arange(1000, 1000 + BINS // ROWS, dtype=np.uint64) * _GOLD)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    key = _BAND_SEEDS.copy()
    for column in coordinates.reshape(-1, ROWS).T:
        key = _mix(key ^ column) * _GOLD
    return _mix(key).view(np.int64)


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_OUT):
            part, rows = batch.slice(at, _ROWS_OUT), []
            for doc, text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                own = shingle_set(text.as_py())
                if not own:
                    rows.append((doc, text_hash, 0, None, None))
                    continue
                hashes = np.sort(np.fromiter(map(digest, own), np.uint64, len(own)))
                rows.append((doc, text_hash, len(own), sha256(b"\n".join(sorted(own))).digest()[:16], band_keys(sketch(hashes))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, side, id, text: a's own text (side 0), then the texts to hold against it. Keeps the pairs whose full sets are similar enough."""
    mine: set[bytes] = set()
    for batch in batches:
        links: list[tuple[bytes, bytes]] = []
        for a, side, b, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            own = shingle_set(text.as_py())
            if not side.as_py():
                mine = own
                continue
            both = len(mine & own)
            if both and 100 * both >= SIMILARITY * (len(mine) + len(own) - both):
                links.append((a.as_py(), b.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))


def _near_length() -> Column:
    """What two sets of these sizes need to reach the similarity at all."""
    return 100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")


def _tokenizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cls, root, text; a row for each shingle."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for cls, root, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            own = np.fromiter(map(digest, shingle_set(text.as_py())), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([cls.as_py()] * len(own), pa.int64()), pa.array([root.as_py()] * len(own), pa.int64()), pa.array(own)], names=["c", "r", "token"])


def _near_cross() -> Column:
    """No intersection is larger than what either has in common with other components at all."""
    most = F.least("cross_a", "cross_b")
    return 100 * most >= SIMILARITY * (F.col("n_a") + F.col("n_b") - most)


def _near_bits() -> Column:
    return sum((F.bit_count(F.col(f"x{k}_a").bitwiseXOR(F.col(f"x{k}_b"))) for k in range(LONG // 64)), F.lit(0)) <= FAR_BITS


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cls, text; the last bits of a long sketch in LONG / 64 columns."""
    digest = xxhash.xxh3_64_intdigest
    names = [f"x{k}" for k in range(LONG // 64)]
    for batch in batches:
        rows = [np.packbits((sketch(np.fromiter(map(digest, shingle_set(t.as_py())), np.uint64), LONG) & np.uint64(1)).astype(np.uint8)).view(np.int64) for t in batch.column(1)]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.stack(rows).T.copy())], names=["cls", *names])


def class_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls, text of the wanted classes: the text of each one's least document."""
    where = classes.join(wanted, "cls", "left_semi").select("cls", "rep.doc_id", "rep.text_hash")
    keyed = where.select("cls", F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("no_id"), "text_hash")
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("no_id"), "text_hash", "text").join(keyed, ["d", "no_id", "text_hash"])
    return durable(texts.groupBy("cls").agg(F.first("text").alias("text")), "near-texts")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links. Each text is fetched for the classes in pairs alone.

    A hub's text goes once to each of at most SALTS groups of its partners, so its pairs don't meet in one task.
    """
    texts = class_texts(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), classes, docs)
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    text_of = lambda x: texts.select(F.col("cls").alias(x), "text")
    first = salted.select("a", "salt").distinct().join(text_of("a"), "a").select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), "text")
    others = salted.join(text_of("b"), "b").select("a", "salt", F.lit(1).alias("side"), "b", "text")
    dealt = first.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return dealt.select("a", "side", "b", "text").mapInArrow(_verifier, "a binary, b binary").distinct()


def crossing(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """cls, cross: how many shingles of each class in crowd (cls, root) some class of another root in crowd has too."""
    rows = crowd.join(texts, "cls").select(F.xxhash64("cls").alias("c"), F.xxhash64("root").alias("r"), "text")
    tokens = rows.mapInArrow(_tokenizer, "c long, r long, token long")
    shared = tokens.groupBy("token").agg(F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high").select("token")
    # A filter of the tokens, so a semi-join: nothing of shared is wanted, and no row can come out twice.
    counts = tokens.join(shared, "token", "left_semi").groupBy("c").agg(F.count("*").alias("cross"))
    return crowd.join(counts, F.xxhash64("cls") == F.col("c"), "left").select("cls", F.coalesce("cross", F.lit(0)).alias("cross"))


def components(links: DataFrame) -> DataFrame:
    """(cls, root) for every class in links: root is the least class that can be reached."""
    # A class that links to several hubs ties them all to the least: about an edge a class is left to pass labels along.
    tied = spread_join(links, links.groupBy("b").agg(F.min("a").alias("m")), "b").select("a", "b", F.least("b", "m").alias("m"))
    forest = durable(tied.select("b", "m").union(tied.select("a", "m")).toDF("src", "dst").where("src <> dst").distinct(), "near-forest")
    edges = durable(forest.union(forest.select("dst", "src")), "near-edges")
    labels = durable(edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("cls"), F.least("src", "m").alias("root")), "near-labels")
    while True:
        # A hub is the neighbour of many and, soon, the root of many: both lookups are by hot keys.
        near = spread_join(edges, labels.withColumnRenamed("cls", "dst"), "dst").groupBy("src").agg(F.min("root").alias("m"))
        stepped = durable(labels.join(near, F.col("cls") == F.col("src")).select("cls", F.least("root", "m").alias("next"), F.col("root").alias("was")), "near-steps")
        jumped = spread_join(stepped, labels.toDF("next", "far"), "next")
        after = durable(jumped.select("cls", F.least("next", "far").alias("root"), "was"), "near-labels")
        if after.where(F.col("root") != F.col("was")).isEmpty():
            return after.select("cls", "root")
        labels = after.select("cls", "root")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row."""
    ship_package(docs.sparkSession)
    rows = _prepared(docs, id_col, text_col)
    sketches = durable(rows.mapInArrow(_sketcher, SKETCHES), "near-sketches")
    classes = durable(
        sketches.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "near-classes",
    )
    banded = classes.select(F.explode("bands").alias("key"), "cls", "n")
    crowds = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = durable(banded.join(crowds, "key"), "near-members")
    weights = members.groupBy("cls").agg(F.sum("c").alias("w"))
    central = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("w"), "cls"))
    placed = members.join(weights, "cls").select("key", "cls", "n", "w").withColumn("place", central).where(F.col("place") <= HUBS)
    hubs = durable(placed.groupBy("key").agg(F.collect_list(F.struct(F.col("cls").alias("a"), F.col("n").alias("n_a"))).alias("hubs")), "near-hubs")
    met = spread_join(members.select("key", F.col("cls").alias("b"), F.col("n").alias("n_b"), "c"), hubs, "key", rows_of_key="c")
    stars = met.select("b", "n_b", F.inline("hubs")).where((F.col("a") != F.col("b")) & _near_length())
    stars = durable(stars.select("a", "b").distinct(), "near-stars")
    links = durable(verify(stars, classes, rows), "near-links")
    labels = components(links)

    # Buckets whose members are not all in one component: compare across components what hasn't been compared.
    placed = members.join(labels, "cls", "left").select("key", "cls", "n", "c", F.coalesce("root", "cls").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("key")
    rest = durable(placed.join(mixed, "key"), "near-rest")
    texts = class_texts(rest.select("cls").distinct(), classes, rows)
    bits = durable(texts.mapInArrow(_bits, "cls binary, " + ", ".join(f"x{k} long" for k in range(LONG // 64))), "near-bits")
    crowd = durable(rest.where(F.col("c") >= CROWDED).select("cls", "root").distinct(), "near-crowd")
    bound = durable(crossing(crowd, texts), "near-bound")
    # The bound was counted among the classes of crowded buckets, so it says something about pairs of a crowded bucket alone.
    cross = F.when(F.col("c") >= CROWDED, F.coalesce("cross", "n")).otherwise(F.col("n"))
    near = rest.join(bound, "cls", "left").withColumn("cross", cross).where(F.col("cross") * 100 >= SIMILARITY * F.col("n")).join(bits, "cls").join(classes.select("cls", "bands"), "cls")
    side = lambda x: near.select("key", F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in near.columns if c not in ("key", "cls", "c")])
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _near_length() & _near_cross() & _near_bits()
    # A pair that shares several buckets comes from the least of them alone.
    once = F.col("key") == F.array_min(F.array_intersect("bands_a", "bands_b"))
    across = side("a").join(side("b"), "key").where(apart & once).select("a", "b")
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likely = durable(across.join(tested, ["a", "b"], "left_anti"), "near-across")
    more = durable(verify(likely, classes, rows), "near-links")
    if not more.isEmpty():
        labels = components(links.union(more))

    # Only classes with a link have a component to look up; the others' least document is their own.
    roots = durable(classes.select("cls", "rep").join(labels, "cls"), "near-roots")
    least = durable(roots.groupBy("root").agg(F.min("rep").alias("rep")).select("root", F.col("rep.doc_id").alias("component_id")), "near-least")
    linked = spread_join(roots, least, "root").select("cls", "component_id")
    alone = classes.select("cls", F.col("rep.doc_id").alias("component_id")).join(labels, "cls", "left_anti")
    of_class = durable(linked.union(alone), "near-component")
    out = spread_join(sketches.select("doc_id", "text_hash", "n_shingles", "cls"), of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: of each group the one with the least doc_id.

    Of rows that repeat the doc_id and the text that stays, one stays (whichever; they differ in other columns at most).
    """
    found = near_components(docs, id_col, text_col)
    own = numbered(docs)
    doc, text = (F.col(own.columns[docs.columns.index(c)]) for c in (id_col, text_col))
    # Rows with an empty set have no group: each is its own and stays, repeated or not.
    told = found.select(F.coalesce("doc_id", F.lit(0)).alias("__nd_id"), F.col("doc_id").isNull().alias("__nd_null"), F.col("text_hash").alias("__nd_hash"), (F.col("n_shingles") > 0).alias("set"), "kept")
    gone = told.where(~F.col("kept")).select("__nd_id", "__nd_null", "__nd_hash").distinct()
    again = told.where(F.col("kept") & F.col("set")).groupBy("__nd_id", "__nd_null", "__nd_hash").count().where("count > 1").drop("count")
    keyed = own.withColumns({"__nd_id": F.coalesce(doc.cast("long"), F.lit(0)), "__nd_null": doc.cast("long").isNull(), "__nd_hash": F.xxhash64(F.coalesce(text, F.lit("")))})
    rest = keyed.join(gone, _ROW, "left_anti")
    single = rest.join(again, _ROW, "left_anti")
    # A row of each repeated one: a partial aggregation, so repeats that a third of all rows are don't meet in one task.
    firsts = rest.join(again, _ROW, "left_semi").groupBy(*_ROW).agg(F.first(F.struct(*own.columns)).alias("r")).select("r.*")
    return single.select(*own.columns).union(firsts).select(*named(docs.columns))


def near_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return near_components(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")
