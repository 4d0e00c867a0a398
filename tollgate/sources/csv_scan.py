"""Line-numbered CSV scan (A1-A7) on Spark's text source, numbered late.

Spark's ``csv`` source drops blank lines (record numbers would shift) and does
not expose ordinals, so the scan is built from the text source:

1. ``first_lines`` reads the beginning of each file, a large one in a task of its
   own, small ones whole and many in a task; headers are split and normalised in Spark and give each file the positions of the
   wanted columns, a row per file that is broadcast.
2. The text is read once.  Every row carries its *place*: file, split (where
   the split begins) and a number that grows along the split.  Cells, rules and
   whatever else the caller keeps are worked out in the same pass and cached,
   without a shuffle, so rows stay in input order within their split.
3. The split table (a row per split: first place, lines, ...) is prefix-summed
   per file.  ``numbered`` joins it to the rows that need a line number, which
   usually are the few that leave: rejections and ids.
4. A file with a line of odd quotes may hold records of several lines.  Only
   such files are read again: each split reports the parity of its quotes, a
   prefix over the splits of the file gives the state that a split opens in,
   and lines are put together to records inside their split.  Only records
   that cross a split move, after a size check, so an unterminated quote can
   never gather a file into one task.  They are numbered as a split of their
   own, between that in which they begin and the next one.
5. Cells are parsed positionally: a plain split for lines without a quote,
   ``from_csv`` for the others.  Files with quotes are parsed apart, so that all
   other files stay within generated code.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Callable, Iterator, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.functions.text import JS_WS, JS_WS_CHARS, js_trim
from tollgate.operators.running import running_sums
from tollgate.session import scratch_path

# Required student columns (in reporting order), size limits and
# messages of the reference reader.
REQUIRED_COLUMNS = ("name", "email", "enrollment_date", "course_id", "score")
DEFAULT_MAX_ROW_BYTES = 64 * 1024
MIN_MAX_ROW_BYTES = 256
ROW_TOO_LARGE = "Row exceeds the maximum size"
REPORTED_LINES = 20  # oversized lines named by the error, the first ones
HEADER_MISSING = "CSV header is missing required columns: "
MAX_BROADCAST_FILES = 100_000  # files whose column positions (a row of integers each) are broadcast

LAYOUT_CHANGED = "The input's splits changed between numbering and reading its lines"


class InvalidCsvHeaderError(ValueError):
    def __init__(self, missing: Sequence[str]):
        self.missing = list(missing)
        super().__init__(HEADER_MISSING + ", ".join(missing))


class RowTooLargeError(ValueError):
    def __init__(self, line_numbers: Sequence[int]):
        self.line_numbers = list(line_numbers)
        super().__init__(ROW_TOO_LARGE)


def blank_record(record: Column) -> Column:
    """A5: only empty cells (white space, quoted or not).  Linear string scans, no regex.

    A cell is empty if it is white space, or quotes around nothing else.  Most records hold
    something besides white space, commas and quotes, which one ``translate`` shows; of the others
    quoted white space is dropped, then quotes that make up a cell, and no quote may be left.  All
    of it stays within generated code.
    """
    quoted = F.regexp_replace(record, f'"{JS_WS}+"', '""')
    apart = F.concat(F.lit(","), F.replace(quoted, F.lit(","), F.lit(",,")), F.lit(","))  # each cell between commas of its own
    rest = F.translate(F.replace(apart, F.lit(',"",'), F.lit(",,")), JS_WS_CHARS + ",", "")
    return F.when(F.translate(record, JS_WS_CHARS + ',"', "") != "", F.lit(False)).otherwise(rest == "")


def split_outside_quotes(line: Column) -> Column:
    """The cells of a header line: split at commas outside double quotes, in one pass.

    Between quotes the parts alternate outside / inside; commas of outside parts become a mark
    that no text holds.
    """
    mark = "\x00\x01\x00"
    parts = F.transform(F.split(line, '"'), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(mark))).otherwise(p))
    return F.split(F.array_join(parts, '"'), mark)


def normalize_header(c: Column) -> Column:
    """A3: unquote a quoted cell, strip a BOM, trim (JavaScript whitespace), lowercase."""
    unquoted = F.when(c.rlike(r'^".*"\z'), F.replace(F.regexp_extract(c, r'^"(.*)"\z', 1), F.lit('""'), F.lit('"'))) \
        .otherwise(c)
    return F.lower(js_trim(F.regexp_replace(unquoted, "^\ufeff", "")))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Physical lines, as they are but for the line feed, with their file and split."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("lineSep", "\n").text(paths)
    lines = raw.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("file_size"),
    )
    lines._tollgate_paths = paths  # type: ignore[attr-defined]
    return lines


def without_cr(record: Column) -> Column:
    """A record without the CR of its line end (CRLF files); a suffix test, not a regex per line."""
    return F.when(record.endswith("\r"), F.substring(record, F.lit(1), F.length(record) - 1)).otherwise(record)


def _quotes(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))).cast("bigint")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as a plan is made and started."""
    saved = {n: spark.conf.get(n) for n in values}
    try:
        for n, v in values.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in saved.items():
            spark.conf.set(n, v)


#: Text is planned with a task for each file, whatever its size (up to 1 TiB).
ONE_SPLIT_PER_FILE = {"spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40)}
#: Generated methods beyond 8,000 bytes are never compiled to machine code; the parse and all rules
#: in one stage make such a method, and run in half the time as separate projections.
COMPILED_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


SMALL_FILE = 4 << 20  # bytes of a file that is read whole for its first line, many of them in a task
SHUFFLE_BYTES = 4 << 20  # of a micro-batch's lines for each shuffle partition


def sized_settings(spark: SparkSession, size: int) -> dict[str, str]:
    """Settings for plans over cached lines of so many bytes: a shuffle partition for each ``SHUFFLE_BYTES``.

    Lines for one partition are put in one: none of their plans shuffles or collects a table to
    broadcast it, so each action on them is one job, and there is nothing to adapt.
    """
    few = {"spark.sql.shuffle.partitions": str(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHUFFLE_BYTES))))}
    return few | ({"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"} if size <= SHUFFLE_BYTES else {})


def first_lines(spark: SparkSession, paths: str | Sequence[str], lines: DataFrame) -> DataFrame:
    """file_path, first line (text), file_size of each file, and whether its beginning has quotes.

    Files of at most ``SMALL_FILE`` bytes are read whole, many in a task and without Python.  Of a
    larger one (of ``lines``) a task of its own reads one Arrow batch, no more.
    """

    def first(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if b.num_rows:
                quoted = pc.any(pc.match_substring(b.column(1), '"')).as_py()
                yield pa.RecordBatch.from_arrays([*b.slice(0, 1).columns, pa.array([bool(quoted)])], names=[*b.schema.names, "quoted"])
                return

    out = scratch_path(spark, "first-lines")
    text = F.substring_index(F.col("value"), "\n", 1)
    text = F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)  # as the line reader has it
    whole = spark.read.text(paths, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
    whole.where((F.col("file_size") > 0) & (F.col("file_size") <= SMALL_FILE)).select(
        "file_path", text.cast("binary").alias("text"), "file_size", F.col("value").contains('"').alias("quoted")).write.parquet(out)
    with settings(spark, ONE_SPLIT_PER_FILE):
        begin = lines.where((F.col("file_size") > SMALL_FILE) & (F.col("block_start") == 0))
        begin.select("file_path", F.col("value").cast("binary").alias("text"), "file_size").mapInArrow(
            first, "file_path string, text binary, file_size bigint, quoted boolean").write.mode("append").parquet(out)
    found = spark.read.schema("file_path string, text binary, file_size bigint, quoted boolean").parquet(out)
    return found.select("file_path", F.col("text").cast("string").alias("text"), "file_size", "quoted")


def header_cells(first: DataFrame, by: str = "file_seq", also: Sequence[str] = ()) -> DataFrame:
    """file_seq, position and normalised name of every header cell, from file_seq and the header's text."""
    return first.select(by, *also, F.posexplode(split_outside_quotes(without_cr(F.col("text")))).alias("position", "_raw")) \
        .select(by, *also, F.col("position").cast("int"), normalize_header(F.col("_raw")).alias("header"))


def column_positions(header: DataFrame, columns: Sequence[str], required: Sequence[str], by: str = "file_seq",
                     also: Sequence[str] = ()) -> DataFrame:
    """Per file the position of each wanted column (the last duplicate wins), its width and what it lacks.

    ``also``: columns that are the same for all cells of a file.
    """
    wanted = F.array(*[F.lit(c) for c in required])
    return header.groupBy(by).agg(
        *[F.max(c).alias(c) for c in also],
        *[F.max(F.when(F.col("header") == c, F.col("position"))).alias(f"_i_{c}") for c in columns],
        (F.max("position") + 1).alias("_width"),
        F.array_except(wanted, F.collect_set("header")).alias("_missing"),
    )


def _in_place(rows: DataFrame, small: DataFrame, on: str, n_files: int) -> DataFrame:
    """``rows`` joined with a row per file, rows staying in order within their split."""
    if n_files <= MAX_BROADCAST_FILES:
        return rows.join(F.broadcast(small), on)
    # more files than are broadcast: the join shuffles, so splits are put together and sorted again
    return rows.join(small, on).repartition("file_seq", "split").sortWithinPartitions("file_seq", "split", "at")


def _parsed(records: DataFrame, positions: DataFrame, columns: Sequence[str], width: int, limit: int, n_files: int, quoted: bool) -> DataFrame:
    """The wanted columns of records (file_seq, split, at, record, record_bytes, quotes).

    Each file's header decides the position of a column.  Short records give NULL for missing
    cells, extra cells are ignored, blank records are flagged: they keep their number but are not
    processed.
    """
    # a line without a quote splits at its commas; the empty cell is NULL as from_csv has it
    cells = F.split(F.col("record"), ",", -1)
    if quoted:  # takes the rows out of generated code, so only files with quotes are parsed so
        schema = ", ".join(f"_c{i} string" for i in range(width))  # the widest header fixes the positions
        options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxColumns": str(max(20_480, limit + 2))}
        parsed = F.from_csv(F.col("record"), schema, options)
        cells = F.when(F.col("record").contains('"'), F.array(*[parsed[f"_c{i}"] for i in range(width)])).otherwise(cells)
    rows = _in_place(records, positions, "file_seq", n_files).withColumn("_cells", cells)
    cell = lambda c: F.try_element_at("_cells", F.col(f"_i_{c}") + 1)
    return rows.select(
        "file_seq", "split", "at", "record", "record_bytes", "quotes",
        F.coalesce(blank_record(F.col("record")), F.lit(False)).alias("is_blank"),
        *[F.when(cell(c) != "", cell(c)).alias(c) for c in columns])


def _record_bytes(record: Column) -> Column:
    return F.octet_length(record).cast("bigint")


Keep = Callable[[DataFrame], DataFrame]


@dataclass
class CsvScan:
    rows: DataFrame             # file_seq, split, at, is_header, is_blank, record_bytes and what the caller keeps; cached
    splits: DataFrame           # file_seq, split, first, lines, lines_before, max_bytes, valid, valid_before; cached
    files: DataFrame            # file_seq, file_path, file_size, missing: a row per file
    header: DataFrame           # file_seq, position, header (normalised), one row per header cell
    n_files: int
    multiline: bool
    width: int = 1              # cells in the widest header
    lines: int = 0              # records read, headers and blank ones included
    limit: int = DEFAULT_MAX_ROW_BYTES  # bytes of a record
    cached: list = field(default_factory=list)
    listing: list = field(default_factory=list)  # (file_seq, file_path, file_size) of ``files``
    suspect: bool = True        # whether there may be ``failures`` (by the limit of the scan)
    n_data: int | None = None   # rows that are neither a header nor blank, where that was counted
    few: bool = False           # all lines are in one partition, and few
    placed: bool = False        # the cached rows have their ``line_number``
    settings: dict = field(default_factory=dict)  # for plans over these rows

    def numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` (file_seq, split, at, ...) with their ``line_number`` (the header is 1)."""
        offsets = self.splits.select("file_seq", "split", F.col("first").alias("_first"), F.col("lines_before").alias("_before"))
        return rows.join(offsets, ["file_seq", "split"]).withColumn(
            "line_number", (F.col("at") - F.col("_first") + F.col("_before") + 1).cast("bigint")).drop("_first", "_before")

    @property
    def records(self) -> DataFrame:
        """file_seq, file_path, line_number, record, record_bytes (of a scan that keeps records)."""
        named = self.files.select("file_seq", "file_path")
        return self.numbered(self.rows).join(named, "file_seq").select("file_seq", "file_path", "line_number", "record", "record_bytes")

    def data(self) -> DataFrame:
        """Rows that are neither a header nor blank."""
        return self.rows.where(~F.col("is_header") & ~F.col("is_blank"))

    def file_offsets(self) -> DataFrame:
        """Lines before each file, over all files in their order."""
        per_file = self.splits.groupBy("file_seq").agg(F.sum("lines").alias("_lines")).withColumn("_order", F.col("file_seq").cast("bigint"))
        if self.n_files == 1:
            return per_file.select("file_seq", F.lit(0).cast("bigint").alias("_earlier"))
        through = running_sums(per_file, "_order", ["_lines"], max_order=self.n_files)
        return through.select("file_seq", (F.col("_lines_through") - F.col("_lines")).alias("_earlier"))

    def with_ordinal(self, rows: DataFrame) -> DataFrame:
        """``rows`` (file_seq, line_number) with their position over all files, ``ordinal``."""
        return rows.join(self.file_offsets(), "file_seq").withColumn("ordinal", F.col("_earlier") + F.col("line_number")).drop("_earlier")

    def failures(self, max_row_bytes: int | None = None) -> DataFrame:
        """file_seq, file_path and reason of files that can't be imported; a row per bad file."""
        size = self.splits.groupBy("file_seq").agg(F.max("max_bytes").alias("_big"))
        limit = self.limit if max_row_bytes is None else max_row_bytes
        reason = F.when(F.size("missing") > 0, F.concat(F.lit(HEADER_MISSING), F.array_join("missing", ", "))) \
            .when(F.col("_big") > limit, F.lit(ROW_TOO_LARGE))
        bad = self.files.join(size, "file_seq").select("file_seq", "file_path", reason.alias("reason"))
        return bad.where(F.col("reason").isNotNull())

    def without(self, file_seqs: list[int]) -> "CsvScan":
        """The same scan without some of its files."""
        left = ~F.col("file_seq").isin(file_seqs)
        if not file_seqs:
            return replace(self, cached=[])
        listing = [f for f in self.listing if f[0] not in set(file_seqs)]
        return replace(self, rows=self.rows.where(left), splits=self.splits.where(left), files=self.files.where(left), cached=[],
                       listing=listing, n_data=None)

    def with_path(self, rows: DataFrame) -> DataFrame:
        """``rows`` (file_seq, ...) with their ``file_path``."""
        named = self.files.select("file_seq", "file_path")
        return rows.join(F.broadcast(named) if self.n_files <= MAX_BROADCAST_FILES else named, "file_seq")

    def release(self) -> None:
        for c in [*self.cached, self.splits]:
            c.unpersist()


def _split_table(rows: DataFrame) -> DataFrame:
    """A row per split, with the sums of the splits before it in its file."""
    ok = (F.col("is_valid") & ~F.col("is_blank")) if "is_valid" in rows.columns else F.lit(False)
    ok = F.coalesce(ok, F.lit(False)).cast("bigint")
    splits = rows.groupBy("file_seq", "split").agg(
        F.min("at").alias("first"), F.count("*").cast("bigint").alias("lines"), F.max("record_bytes").alias("max_bytes"),
        F.sum(F.col("quotes") % 2).cast("bigint").alias("odd"), F.max("quotes").alias("quotes"), F.sum((~F.col("is_blank")).cast("bigint")).alias("filled"),
        F.sum(ok).alias("_ok"), F.min_by(ok, "at").alias("_first_ok"), F.min_by(F.col("is_blank"), "at").alias("_first_blank"))
    # the first line of a file is its header, whatever the rules make of it
    begins = F.row_number().over(Window.partitionBy("file_seq").orderBy("split")) == 1
    before = Window.partitionBy("file_seq").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file_seq", "split", "first", "lines", "max_bytes", "odd", "quotes", begins.alias("begins"),
        (F.col("filled") - F.when(begins & ~F.col("_first_blank"), 1).otherwise(0)).alias("data"),
        (F.col("_ok") - F.when(begins, F.col("_first_ok")).otherwise(0)).alias("valid"))
    sums = {"lines": "lines_before", "valid": "valid_before", "data": "data_before"}
    return splits.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in sums.items()])


# ---- records of several lines ------------------------------------------------

_FRAGMENT = "file_seq int, block_start bigint, kind int, at bigint, record binary, record_bytes bigint, cr boolean"
WHOLE, HEAD, TAIL = 0, 1, 2  # a record inside its split; the open end of a split; what belongs to a record of an earlier split


def _assemble(limit: int):
    """Lines of splits, in order, to records inside the splits and fragments of those that cross them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [c.split()[0] for c in _FRAGMENT.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches):
        key, left, inside, tail, at = None, 0, False, False, 0
        held, size, cr, out, out_bytes = [], -1, False, [], 0

        def close(kind):
            nonlocal held, size, at, out_bytes
            text = b"\n".join(held) if held is not None else None
            out.append((*key, kind, at if kind != TAIL else -1, text, size, cr))
            out_bytes += len(text or b"")
            at += kind != TAIL
            held, size = [], -1

        def ready():
            nonlocal out, out_bytes
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out, out_bytes = [], 0
            return batch

        def finish():
            if left:
                raise ValueError(LAYOUT_CHANGED)
            if size >= 0:
                close(TAIL if tail else HEAD)

        for b in batches:
            if not b.num_rows:
                continue
            seq, start = b.column(0).to_numpy(), b.column(1).to_numpy()
            values = b.column(4).to_pylist()
            odd = (pc.count_substring(b.column(4), '"').to_numpy() % 2 == 1).tolist()
            bounds = np.flatnonzero(np.r_[True, (seq[1:] != seq[:-1]) | (start[1:] != start[:-1])]).tolist() + [b.num_rows]
            for i, j in zip(bounds, bounds[1:]):
                if (int(seq[i]), int(start[i])) != key:
                    if key is not None:
                        finish()
                    key, left, at = (int(seq[i]), int(start[i])), b.column(3)[i].as_py(), 0
                    inside = tail = b.column(2)[i].as_py()
                left -= j - i
                for value, flips in zip(values[i:j], odd[i:j]):
                    size += 1 + len(value)
                    cr = value.endswith(b"\r")
                    if held is not None:
                        held.append(value)
                        if size > limit + 1:
                            held = None  # beyond the limit only the size is kept
                    inside ^= flips
                    if not inside:
                        close(TAIL if tail else WHOLE)
                        tail = False
                if out_bytes > 4 << 20 or len(out) > 50_000:
                    yield ready()
        if key is not None:
            finish()
        if out:
            yield ready()

    return run


def _quoted_records(lines: DataFrame, files: DataFrame, n_files: int, limit: int) -> tuple[DataFrame, list]:
    """(records of files with quoted line feeds: file_seq, split, at, record, record_bytes, odd; what is cached)."""
    named = lines.join(F.broadcast(files), "file_path") if n_files <= MAX_BROADCAST_FILES else lines.join(files, "file_path")
    named = named.withColumn("at", F.monotonically_increasing_id()) if n_files <= MAX_BROADCAST_FILES else named.repartition(
        "file_seq", "block_start").sortWithinPartitions("file_seq", "block_start", "at")
    parity = named.groupBy("file_seq", "block_start").agg(
        F.sum(_quotes(F.col("value")) % 2).alias("_odd"), F.count("*").alias("n"))
    before = Window.partitionBy("file_seq").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    opens = parity.select("file_seq", "block_start", "n", (F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2 == 1).alias("open"))
    states = scratch_path(lines.sparkSession, "split-states")
    opens.write.parquet(states)
    opens = lines.sparkSession.read.schema("file_seq int, block_start bigint, n bigint, open boolean").parquet(states)
    # a row per split of these files; should the second scan be split otherwise, the job fails
    opened = named.join(F.broadcast(opens), ["file_seq", "block_start"], "left").select(
        "file_seq", "block_start",
        F.when(F.col("n").isNull(), F.raise_error(F.lit(LAYOUT_CHANGED)).cast("boolean")).otherwise(F.col("open")).alias("open"),
        "n", F.col("value").cast("binary").alias("value"))
    pieces = opened.mapInArrow(_assemble(limit), _FRAGMENT).persist(StorageLevel.MEMORY_AND_DISK)
    text = F.col("record").cast("string")
    whole = pieces.where(F.col("kind") == WHOLE).select(
        "file_seq", (F.col("block_start") * 2).alias("split"), "at", without_cr(text).alias("record"),
        (F.col("record_bytes") - F.col("cr").cast("bigint")).alias("record_bytes"))
    # records over several splits: a head and the fragments up to the next one, in file order
    order = Window.partitionBy("file_seq").orderBy("block_start", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    moved = pieces.where(F.col("kind") != WHOLE).withColumn("_record", F.sum((F.col("kind") == HEAD).cast("int")).over(order))
    position = F.struct("block_start", -F.col("kind"))
    sizes = moved.groupBy("file_seq", "_record").agg(
        (F.sum("record_bytes") + F.count("*") - 1 - F.max_by(F.col("cr").cast("bigint"), position)).alias("record_bytes"),
        F.min("block_start").alias("_begin"))
    small = moved.join(sizes.where(F.col("record_bytes") <= limit).select("file_seq", "_record"), ["file_seq", "_record"])
    texts = small.groupBy("file_seq", "_record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("block_start", (-F.col("kind")).alias("_k"), text.alias("t")))), lambda p: p["t"]), "\n").alias("_text"))
    crossing = sizes.join(texts, ["file_seq", "_record"], "left").select(
        "file_seq", (F.col("_begin") * 2 + 1).alias("split"), F.lit(0).cast("bigint").alias("at"), without_cr(F.col("_text")).alias("record"),
        "record_bytes")
    return whole.unionByName(crossing).withColumn("quotes", F.lit(0).cast("bigint")), [pieces]


def local_rows(spark: SparkSession, rows: list[tuple], types: dict[str, str]) -> DataFrame:
    """A few rows of the driver as a local relation: no job reads it."""
    import pyarrow as pa

    kinds = [pa.list_(pa.string()) if t == "list" else pa.type_for_alias(t) for t in types.values()]
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(types)))


# ---- the scan ----------------------------------------------------------------


def scan_lines(
    lines: DataFrame,
    required: Sequence[str] = REQUIRED_COLUMNS,
    max_row_bytes: int | None = DEFAULT_MAX_ROW_BYTES,  # None: the default
    check_header: bool = True,
    check_size: bool = True,
    columns: Sequence[str] | None = None,
    keep: Keep | None = None,
) -> CsvScan:
    """Read, parse and keep the records of one or more CSV files.

    ``keep`` turns the parsed rows (``columns``, by default none, beside the record and its place)
    into those that are cached: a projection.  By default the record's text is kept.  Lines of
    ``read_lines`` are read once, files whose first quote comes late once more, and files with
    quoted line feeds twice more; any other frame of such lines (a micro-batch) is cached and read
    from there.
    """
    if max_row_bytes is not None and max_row_bytes < MIN_MAX_ROW_BYTES:
        raise ValueError(f"max_row_bytes must be at least {MIN_MAX_ROW_BYTES}")
    spark, limit = lines.sparkSession, DEFAULT_MAX_ROW_BYTES if max_row_bytes is None else max_row_bytes
    columns = list(columns or ())
    keep = keep or (lambda rows: rows)
    paths = getattr(lines, "_tollgate_paths", None)
    if paths is not None:
        heads = first_lines(spark, paths, lines)
        return _scan_found(lines, heads, _found(heads, columns, required), required, limit, check_header, check_size, columns, keep, [], False)
    lines = lines.withColumn("_m", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    parts = lines.rdd.getNumPartitions()
    with settings(spark, sized_settings(spark, 0) if parts <= FEW_PARTS else {}):
        some = lines.coalesce(1) if parts == 1 else lines  # a single partition is known to be one
        # sums of fixed width only, so that no line is sorted; the text of the first lines is fetched by its number
        heads = some.where(F.col("block_start") == 0).groupBy("file_path").agg(
            F.min("_m").alias("_m"), F.max("file_size").alias("file_size"), F.max(F.col("value").contains('"')).alias("quoted"))
        heads = F.broadcast(heads) if parts <= FEW_PARTS else heads
        heads = some.select("_m", F.col("value").alias("text")).join(heads, "_m").drop("_m")
        found = _found(heads, columns, required)
    size = sum(r["file_size"] or 0 for r in found)
    cached, rows = [lines], lines.drop("_m")
    sized = sized_settings(spark, size)
    with settings(spark, sized):
        few = size <= SHUFFLE_BYTES
        rows = rows.coalesce(1) if few else rows
        scan = _scan_found(rows, heads, found, required, limit, check_header, check_size, columns, keep, cached, few)
    return replace(scan, settings=sized)


FEW_PARTS = 8  # partitions of lines whose heads aren't spread


def _found(heads: DataFrame, columns: Sequence[str], required: Sequence[str]) -> list:
    """A row per file, in path order: its name, size and column positions.

    The driver holds names and sizes as well for Spark's own file index.  The text of the headers
    stays in Spark.
    """
    facts = ["file_size", "quoted"]
    cells = header_cells(heads, "file_path", facts)
    return sorted(column_positions(cells, columns, required, "file_path", facts).collect(), key=lambda r: r["file_path"])


def _scan_found(lines: DataFrame, heads: DataFrame, found: list, required: Sequence[str], limit: int, check_header: bool, check_size: bool,
                columns: list, keep: Keep, cached: list, few: bool) -> CsvScan:
    """``scan_lines`` of files whose names, sizes and columns are found."""
    spark = lines.sparkSession
    names, n_files = [r["file_path"] for r in found], len(found)
    files = local_rows(spark, [(r["file_path"], k, r["file_size"]) for k, r in enumerate(found)],
                   {"file_path": "string", "file_seq": "int32", "file_size": "int64"})
    header = header_cells(heads.join(files.select("file_path", "file_seq"), "file_path"))
    width = max([r["_width"] for r in found], default=1)
    missing = next((r["_missing"] for r in found if r["_missing"]), None)
    at_columns = [f"_i_{c}" for c in columns]
    positions = local_rows(spark, [(k, *[r[c] for c in at_columns], r["_width"], list(r["_missing"])) for k, r in enumerate(found)],
                       {"file_seq": "int32", **{c: "int32" for c in at_columns}, "_width": "int32", "_missing": "list"})

    def plain(some: DataFrame) -> DataFrame:
        base = some.withColumn("at", F.monotonically_increasing_id()).withColumn("split", F.col("block_start") * 2)
        record = without_cr(F.col("value"))
        return _in_place(base, files.select("file_path", "file_seq"), "file_path", n_files).select(
            "file_seq", "split", "at", record.alias("record"), _record_bytes(record).alias("record_bytes"), _quotes(F.col("value")).alias("quotes"))

    def parsed(some: DataFrame, quoted: bool) -> DataFrame:
        with settings(spark, COMPILED_METHODS):  # a cached plan keeps the settings that it was persisted with
            rows = keep(_parsed(plain(some), positions, columns, width, limit, n_files, quoted)).persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(rows)
        return rows

    def of(numbers: list[int]) -> DataFrame:
        return lines.where(F.col("file_path").isin([names[k] for k in numbers]))

    def without(rows: DataFrame, numbers: list[int]) -> DataFrame:
        return rows.where(~F.col("file_seq").isin(numbers)) if numbers else rows

    quoted = [k for k, r in enumerate(found) if r["quoted"]]
    listing = [(k, r["file_path"], r["file_size"]) for k, r in enumerate(found)]
    described = local_rows(spark, [(*f, list(r["_missing"])) for f, r in zip(listing, found)],
                           {"file_seq": "int32", "file_path": "string", "file_size": "int64", "missing": "list"})
    if few:
        # lines of one partition are numbered by a window over each file when they are parsed, all in one way
        rows = keep(_parsed(plain(lines), positions, columns, width, limit, n_files, bool(quoted)))
        number = F.row_number().over(Window.partitionBy("file_seq").orderBy("split", "at")).cast("bigint")
        rows = rows.withColumn("line_number", number).withColumn("is_header", F.col("line_number") == 1)
        with settings(spark, COMPILED_METHODS):
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        data = ~F.col("is_header") & ~F.col("is_blank")
        total = rows.agg(F.count("*").alias("lines"), F.sum(data.cast("bigint")).alias("data"), F.max("record_bytes").alias("big"),
                         F.max("quotes").alias("quotes"), F.max(F.col("quotes") % 2).alias("odd")).first()
        if not total["odd"] and (quoted or not total["quotes"]) and not check_header and not check_size:
            return CsvScan(rows.drop("quotes"), _split_table(rows), described, header, n_files, False, width, total["lines"], limit, [*cached, rows],
                           listing, missing is not None or (total["big"] or 0) > limit, int(total["data"] or 0), True, True)
        rows.unpersist()  # records of several lines, or quotes that come late
    # files whose beginning has quotes are parsed apart, so that they don't slow the others; each is read once
    if len(quoted) == n_files:
        rows = parsed(lines, bool(quoted))
    elif quoted:
        rows = parsed(lines.where(~F.col("file_path").isin([names[k] for k in quoted])), False).unionByName(parsed(of(quoted), True))
    else:
        rows = parsed(lines, False)
    splits = _split_table(rows).persist(StorageLevel.MEMORY_AND_DISK)
    with settings(spark, COMPILED_METHODS):  # this starts the one pass over the text
        total = splits.agg(F.sum("lines").alias("lines"), F.sum("data").alias("data"), F.max("max_bytes").alias("big"), F.max("quotes").alias("quotes")).first()
    marked = splits.where(F.col("quotes") > 0).groupBy("file_seq").agg(F.sum("odd").alias("odd")).collect() if total["quotes"] else []
    odd = sorted(r["file_seq"] for r in marked if r["odd"])
    late = sorted(r["file_seq"] for r in marked if not r["odd"] and r["file_seq"] not in set(quoted))
    if late:  # quotes further on than the beginning: these files are parsed again, when the splits are counted
        rows = without(rows, late).unionByName(parsed(of(late), True))
    if odd:
        # files with quoted line feeds: read again, put together inside their splits
        again = of(odd)
        records, pieces = _quoted_records(again, files.select("file_path", "file_seq"), n_files, limit)
        begin = records.groupBy("file_seq").agg(F.min_by("record", F.struct("split", "at")).alias("text"))
        of_odd = header_cells(begin.select("file_seq", F.coalesce("text", F.lit("")).alias("text")))
        header = without(header, odd).unionByName(of_odd)
        positions = column_positions(header, columns, required)
        # one row back: the widest header and the first file (if any) missing required columns
        info = positions.agg(F.max("_width").alias("width"), F.min_by(F.col("_missing"), F.when(F.size("_missing") > 0, F.col("file_seq"))).alias("missing")).first()
        width, missing = int(info["width"] or 1), info["missing"]
        with settings(spark, COMPILED_METHODS):
            put = keep(_parsed(records, positions, columns, width, limit, n_files, True)).persist(StorageLevel.MEMORY_AND_DISK)
        cached += [put, *pieces]
        rows = without(rows, odd).unionByName(put)
    if odd or late:
        splits.unpersist()
        splits = _split_table(rows).persist(StorageLevel.MEMORY_AND_DISK)
        total = splits.agg(F.sum("lines").alias("lines"), F.sum("data").alias("data"), F.max("max_bytes").alias("big")).first()
    if check_header and missing:
        raise InvalidCsvHeaderError(missing)
    # a row per file: where its header lies
    begins = splits.where("begins").select("file_seq", F.col("split").alias("_s"), F.col("first").alias("_a"))
    if n_files <= MAX_BROADCAST_FILES:  # fetched once, not in each plan over the rows
        begins = local_rows(spark, [tuple(r) for r in begins.collect()], {"file_seq": "int32", "_s": "int64", "_a": "int64"})
    rows = _in_place(rows, begins, "file_seq", n_files).withColumn(
        "is_header", (F.col("split") == F.col("_s")) & (F.col("at") == F.col("_a"))).drop("_s", "_a", "quotes")
    if odd:
        described = files.join(positions.select("file_seq", F.col("_missing").alias("missing")), "file_seq", "left").select(
            "file_seq", "file_path", "file_size", F.coalesce("missing", F.array(*[F.lit(c) for c in required])).alias("missing"))
    scan = CsvScan(rows, splits, described, header, n_files, bool(odd), width, int(total["lines"] or 0), limit, cached, listing,
                   bool(odd) or missing is not None or (total["big"] or 0) > limit, int(total["data"] or 0), few)
    if check_size and (total["big"] or 0) > limit:
        over = scan.numbered(rows.where(F.col("record_bytes") > limit).select("file_seq", "split", "at"))
        first = over.orderBy("file_seq", "line_number").select("line_number").limit(REPORTED_LINES).collect()
        scan.release()
        raise RowTooLargeError([r[0] for r in first])
    return scan


def scan_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] = REQUIRED_COLUMNS,
    max_row_bytes: int | None = DEFAULT_MAX_ROW_BYTES,
    keep_blank: bool = False,
) -> DataFrame:
    """Read CSV file(s) into ``file_seq, file_path, line_number, record_bytes, is_blank, <columns...>``."""
    scan = scan_lines(read_lines(spark, paths), columns, max_row_bytes, columns=columns, keep=lambda rows: rows.drop("record"))
    rows = scan.rows.where(~F.col("is_header")) if keep_blank else scan.data()
    named = scan.files.select("file_seq", "file_path")
    return scan.numbered(rows).join(named, "file_seq").select("file_seq", "file_path", "line_number", "record_bytes", "is_blank", *columns)
