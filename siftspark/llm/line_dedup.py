"""Line dedup over levelled sorted runs of line hashes (native: DataFrame operations alone).

Lines are hashed once into a staged table. It is taken in batches by falling doc_id, cut at quantiles of the ids. Each batch
is aggregated to one row a key, merge-joined against the runs that exist, and adds its own run: keys that no run owns yet
(the anti side) enter with their owner, the largest doc_id that holds them; keys that a run owns add their count alone. When
a level holds ``fanout`` runs, they are merged into one run of the next level. In the end the few keys found in
``min_docs`` documents or more are matched with the staged lines, and every document drops those lines it doesn't own.

A run is a Parquet table in the shared folder, dealt by key and sorted by key in each partition. All steps pre-aggregate
before they shuffle, so a line that a third of all documents hold is one row a task; when lines are matched in the end, the
rows of such a key stay where they are. The text itself moves once, by document. Keys are 128 bits of hash.

Defined results: null or empty text is one empty line; a document is a doc_id, so rows that repeat one count once and all rows
with the largest doc_id keep the line; rows with a null doc_id are together one document, below all others; a line that
a document repeats counts once; an empty table gives no rows; other columns pass through whatever their names (but ``line_dedup``
replaces columns that have the names of its three results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, ascii_lower, drop_path, durable, named, new_scratch, numbered, spread_join

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 3
_LOWEST = -(1 << 63)
_KEY = ["__ld_h1", "__ld_h2"]
_RESULTS = ["__ld_n_lines", "__ld_n_dropped", "__ld_kept"]


def line_keys(text: Column) -> Column:
    """The key of each line in order: stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias(_KEY[0]), F.xxhash64(F.lit(97), key, F.lit(3)).alias(_KEY[1])]


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class LineRuns:
    """The levels of sorted runs in one shared folder. ``levels[k]`` lists the paths of level k."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.root, self.levels, self._n = spark, fanout, new_scratch(spark, "line-runs"), [], 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.root}/level{level}-run{self._n}"
        self._n += 1
        rows.repartition(*_KEY).sortWithinPartitions(*_KEY).write.parquet(path)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(path)

    def read(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, batch: DataFrame) -> None:
        """batch: a row for each key and document with __ld_doc. Adds one run and compacts full levels."""
        keys = batch.groupBy(*_KEY).agg(F.count("*").alias("__ld_n"), F.max("__ld_doc").alias("__ld_owner"))
        runs = self.read()
        if runs is not None:
            owned = runs.where(F.col("__ld_owner").isNotNull()).select(*_KEY, F.lit(True).alias("__ld_seen"))
            joined = keys.join(owned.hint("merge"), _KEY, "left")
            keys = joined.select(*_KEY, "__ld_n", F.when(F.col("__ld_seen").isNull(), F.col("__ld_owner")).alias("__ld_owner"))
        self._write(keys, 0)
        self._compact()

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.sum("__ld_n").alias("__ld_n"), F.max("__ld_owner").alias("__ld_owner"))

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self.merged(self.spark.read.parquet(*old)), level + 1)
                for p in old:
                    drop_path(self.spark, p)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys with their owner that min_docs documents or more hold, as a written table."""
        return durable(self.merged(self.read()).where(F.col("__ld_n") >= min_docs).select(*_KEY, "__ld_owner"), "line-frequent")


def stage_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """A written row for each distinct long key of each document, in folders by batch; later batches hold lower ids."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("__ld_doc"), F.col(text_col).alias("__ld_text"))
    shares = [1 - k / batches for k in range(1, batches)]
    cuts = ids.where(F.col("__ld_doc") != _LOWEST).agg(F.percentile_approx("__ld_doc", shares, 1000)).first()[0] if shares else []
    batch = sum((F.when(F.col("__ld_doc") <= c, 1).otherwise(0) for c in cuts or []), F.lit(0))
    lines = (
        ids.select("__ld_doc", _row_hash(F.col("__ld_text")).alias("__ld_row"), F.posexplode(line_keys(F.col("__ld_text"))).alias("__ld_pos", "__ld_key"))
        .where(F.length("__ld_key") >= min_chars)
        .select("__ld_doc", "__ld_row", "__ld_pos", *_hashes(F.col("__ld_key")), batch.alias("__ld_batch"))
    )
    path = new_scratch(spark, "line-stage")
    lines.write.partitionBy("__ld_batch").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(__ld_doc, __ld_row, __ld_drop): the line numbers that each document loses; documents that lose none have no row."""
    staged = stage_lines(docs, id_col, text_col, min_chars, batches)
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        own = staged.where(F.col("__ld_batch") == b)
        # A document's repeated line counts once; partial aggregation does most of it before the rows move.
        runs.add(own.select(*_KEY, "__ld_doc").distinct())
    hits = spread_join(staged, runs.frequent(min_docs), _KEY).where(F.col("__ld_doc") != F.col("__ld_owner"))
    return hits.groupBy("__ld_doc", "__ld_row").agg(F.collect_set("__ld_pos").alias("__ld_drop"))


def _dedup(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """The columns of docs by number, and the three results."""
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    own = numbered(docs)
    doc, text = (F.col(own.columns[docs.columns.index(c)]) for c in (id_col, text_col))
    mine = own.withColumns({"__ld_doc": F.coalesce(doc.cast("long"), F.lit(_LOWEST)), "__ld_row": _row_hash(text)})
    out = mine.join(drops, ["__ld_doc", "__ld_row"], "left").withColumn("__ld_lines", F.split(F.coalesce(text, F.lit("")), "\n", -1))
    kept = F.when(F.col("__ld_drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_drop")), lambda i: F.get(F.col("__ld_lines"), i)), "\n")
    )
    return out.select(
        *own.columns,
        F.size("__ld_lines").cast("long").alias("__ld_n_lines"),
        F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long").alias("__ld_n_dropped"),
        kept.alias("__ld_kept"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All columns of docs, and __ld_n_lines, __ld_n_dropped and __ld_kept (the text without the dropped lines)."""
    rest = docs.drop(*_RESULTS)
    return _dedup(rest, id_col, text_col, min_chars, min_docs, batches, fanout).select(*named(rest.columns), *_RESULTS)


def line_dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with its own columns, its text replaced by the kept lines; a null text stays null."""
    out = _dedup(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    text = f"__own_{docs.columns.index(text_col)}"
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col("__ld_kept"))).select(*named(docs.columns))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    out = line_dedup(docs.select(id_col, text_col), id_col, text_col, **options)
    return out.select(F.col(id_col).alias("doc_id"), F.col("__ld_n_lines").alias("n_lines"), F.col("__ld_n_dropped").alias("n_dropped"), F.sha2(F.col("__ld_kept").cast("binary"), 256).alias("kept_sha256"))


