"""Finding input files and reading many CSV files with differing headers as one table.

Files are read as lines, and headers are rows like any other: each file's first line reaches the file's other
lines by a join with one row per scanned piece (``_heads``), so a plan is the same however many headers there are and no
file is opened by the driver. That row also holds what the pieces before it say about a line: how many lines
precede it, and whether a quoted cell is open, so a cell with line breaks is read right where a file is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratlens.functions.columns import finite, lenient_double
from stratlens.operators.ordered import cuts_before
from stratlens.schemas import NA_TOKENS

BOM = "\ufeff"
FILE_ROWS = 1 << 40  # row_id leaves this many numbers to each file of an owner
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
CELL = f',({_QUOTED}"(?=,|\\z)|[^,]*+)'
OPEN = f'^(?:(?:{_QUOTED}"[^,"]*+|[^",][^,]*+|),)*+{_QUOTED}\\z'  # read from outside quotes, the last cell stays open
WHOLE, DAY = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*\d{4}-\d{2}-\d{2}\s*$"


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def escape_glob(text: str) -> str:
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in text)


def glob(spark: SparkSession, pattern: str, folders: bool = False) -> list[str]:
    """Files (or folders) matching a pattern, in name order; none if there are none."""
    hadoop, fs = _filesystem(spark, pattern)
    found = fs.globStatus(hadoop)
    return sorted(status.getPath().toString() for status in found or [] if status.isDirectory() == folders)


def matching(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The patterns that match something."""
    return [pattern for pattern in patterns if glob(spark, pattern)]


def is_dir(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _filesystem(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory()


def qualified(spark: SparkSession, root: str) -> str:
    """The full path of ``root`` without scheme and host."""
    hadoop, fs = _filesystem(spark, root)
    return fs.makeQualified(hadoop).toUri().getPath().rstrip("/")


def relative(spark: SparkSession, root: str, path: str) -> str:
    """The part of a listed path below ``root``."""
    base = qualified(spark, root)
    full = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    return full[len(base) + 1 :]


def _run_folder(spark: SparkSession, path: str, run: str) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{path}/run_id={escape(run)}"


def run_folder_files(spark: SparkSession, path: str, run: str) -> set[str]:
    """Names of the data files of one run of a dataset foldered by run."""
    hadoop, fs = _filesystem(spark, _run_folder(spark, path, run))
    return {status.getPath().getName() for status in fs.listStatus(hadoop)} if fs.exists(hadoop) else set()


def remove_folder(spark: SparkSession, path: str, run: str) -> None:
    hadoop, fs = _filesystem(spark, _run_folder(spark, path, run))
    fs.delete(hadoop, True)


def path_part(from_end: int) -> Column:
    """Name found ``from_end`` levels above the end of a scanned row's file path."""
    # Scans report paths percent-encoded, except for plus signs.
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.element_at(F.split(F.url_decode(encoded), "/"), -1 - from_end)


def _cells(line: Column) -> Column:
    """The cells of a CSV record, quotes removed."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    quoted = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(c.rlike('(?s)^".*"$'), quoted(c)).otherwise(c))


def _names(line: Column) -> Column:
    """Header cells; repeats get ``.1``, ``.2`` and blanks ``Unnamed: <place>``."""
    cells = F.transform(_cells(line), lambda c, i: F.when(c == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(c))

    def numbered(name: Column, i: Column, all_names: Column) -> Column:
        earlier = F.size(F.filter(F.slice(all_names, F.lit(1), i), lambda other: other == name))
        return F.when(earlier > 0, F.concat(name, F.lit("."), earlier.cast("string"))).otherwise(name)

    return F.transform(cells, lambda name, i: numbered(name, i, cells))


def place_of(*names: str) -> Column:
    """Place in a header (column ``names``, from 0) of the first of these columns that it has, else NULL."""
    found = [F.nullif(F.array_position("names", F.lit(name)), F.lit(0)) for name in names]
    return (F.coalesce(*found) - 1).cast("int")


def last_place() -> Column:
    return F.size("names") - 1


def _lines(spark: SparkSession, paths: Sequence[str], owner: str, owner_of: Column) -> DataFrame:
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(list(paths)).select(
        owner_of.alias(owner), F.url_decode(encoded).alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), "value", (odd % 2 == 1).alias("odd"),
    )


def _heads(lines: DataFrame, owner: str, choose: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """One row per scanned piece of a file: its header, the lines before it and where quotes are open.

    Only lines with an odd number of quotes can open or close a cell. One that would leave a cell open when read from
    outside turns the state over, any other one leaves no cell open. ``marks`` holds a piece's odd lines with the
    state behind each, absolute (``fixed``) after the first line of the second kind, else as a change of the state
    before the piece.
    """
    mark = F.struct("line", F.col("value").rlike(OPEN).alias("turns"))
    pieces = lines.groupBy(owner, "path", "start").agg(
        F.min("line").alias("base"), F.count("*").alias("n"), F.min_by("value", "line").alias("head"),
        F.collect_list(F.when(F.col("odd"), mark)).alias("odd"),
    )
    inside = Window.partitionBy(owner, "path", "start").orderBy("mark.line").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(F.coalesce(F.col("mark.turns").cast("int"), F.lit(0))).over(inside)
    counted = pieces.select("*", F.explode_outer("odd").alias("mark")).withColumn("turned", turns)
    since = F.last(F.when(~F.col("mark.turns"), F.col("turned")), True).over(inside)
    state = F.struct(
        F.col("mark.line").alias("line"), ((F.col("turned") - F.coalesce("since", F.lit(0))) % 2).cast("int").alias("state"),
        F.col("since").isNotNull().alias("fixed"),
    )
    pieces = counted.withColumn("since", since).groupBy(owner, "path", "start").agg(
        *[F.first(c).alias(c) for c in ("base", "n", "head")],
        F.array_sort(F.collect_list(F.when(F.col("mark").isNotNull(), state))).alias("marks"),
    )
    file = Window.partitionBy(owner, "path").orderBy("start")
    past, upto = file.rowsBetween(Window.unboundedPreceding, -1), file.rowsBetween(Window.unboundedPreceding, 0)
    last = F.get("marks", F.size("marks") - 1)
    placed = pieces.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(past), F.lit(0)), "marks_before": F.coalesce(F.sum(F.size("marks")).over(past), F.lit(0)),
            "head": F.first("head").over(upto), "change": F.coalesce(last["state"], F.lit(0)), "fixed": F.coalesce(last["fixed"], F.lit(False)),
        }
    ).withColumn("changes", F.sum("change").over(upto))
    placed = placed.withColumn("set", F.last(F.when(F.col("fixed"), F.col("changes") - F.col("change")), True).over(upto))
    placed = placed.withColumn("after", ((F.col("changes") - F.coalesce("set", F.lit(0))) % 2).cast("int"))
    whole = file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumns({"entry": F.coalesce(F.lag("after").over(file), F.lit(0)), "unclosed": F.last("after").over(whole) == 1})
    placed = placed.withColumn("names", _names(F.replace("head", F.lit(BOM), F.lit(""))))
    chosen = choose(placed) if choose else placed
    number = F.dense_rank().over(Window.partitionBy(owner).orderBy("path")) - 1
    return chosen.withColumn("file", number.cast("bigint")).drop("head", "n", "change", "changes", "fixed", "set", "after")


def read_records(
    spark: SparkSession,
    paths: Sequence[str],
    owner: str,
    owner_of: Column,
    places: Mapping[str, Column] | None = None,
    choose: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The records of CSV files: ``owner, path, row_id, names, at, cells``, cells as text, missing-value words NULL.

    ``paths`` are glob patterns that match something. ``places`` names places in a header by expressions over the
    column ``names`` (and windows over ``owner``), worked out once per file and carried as the struct ``at``. ``choose`` may drop
    files by ``owner`` and ``path``. ``row_id`` is the line number, plus a multiple of ``FILE_ROWS`` by the file's place among its
    owner's, so it does not depend on how files are cut or listed.

    A quoted cell may hold commas, doubled quotes and line breaks, headers no line breaks. Blank lines are
    skipped. A record with more cells than its header and a file that ends inside quotes fail the read; missing
    cells are NULL.
    """
    lines = _lines(spark, paths, owner, owner_of)
    heads = _heads(lines, owner, choose)
    at = F.struct(F.lit(0).alias("_"), *[place.alias(name) for name, place in (places or {}).items()])
    heads = heads.withColumn("at", at).drop(owner)
    k = cuts_before(F.col("marks.line"), F.col("line") - 1)
    mark = F.get("marks", F.col("k") - 1)
    state = F.when(F.col("k") == 0, F.col("entry")).when(mark["fixed"], mark["state"]).otherwise((F.col("entry") + mark["state"]) % 2)
    never_closed = F.raise_error(F.concat(F.lit("a quoted cell is not closed in "), F.col("path"))).cast("boolean")
    placed = lines.join(heads, ["path", "start"]).where(F.when(F.col("unclosed"), never_closed).otherwise(F.lit(True)))
    placed = placed.withColumn("k", F.when(F.size("marks") == 0, 0).otherwise(k)).withColumn("inside", state == 1)
    placed = placed.withColumns(
        {
            "opens": ~F.col("inside") & F.col("odd") & F.col("value").rlike(OPEN),
            "row_id": F.col("file") * FILE_ROWS + F.col("before") + F.col("line") - F.col("base"),
        }
    )
    part = F.col("inside") | F.col("opens")
    single = (F.col("row_id") % FILE_ROWS > 0) & ~part & (F.trim("value") != "")
    columns = [owner, "path", "row_id", "names", "at", "value"]
    # Spark may work out what readers ask of a record, casts too, before this condition holds: any other line has no value then.
    alone = placed.where(single).withColumn("value", F.when(single, F.col("value"))).select(*columns)
    placed = placed.where(F.col("row_id") % FILE_ROWS > 0)
    opener = F.col("marks_before") + F.col("k") + F.col("opens").cast("int")
    joined = placed.where(part).groupBy(owner, "path", opener.alias("opener")).agg(
        F.min("row_id").alias("row_id"), F.first("names").alias("names"), F.first("at").alias("at"),
        F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("parts"),
    )
    joined = joined.withColumn("value", F.array_join(F.col("parts.value"), "\n")).select(*columns)
    records = alone.unionByName(joined).withColumn("cells", _cells(F.col("value"))).drop("value")
    too_many = F.raise_error(F.concat(F.lit("more cells than the header has in "), F.col("path"))).cast("boolean")
    records = records.where(F.when(F.size("cells") > F.size("names"), too_many).otherwise(F.lit(True)))
    words = F.array(*[F.lit(token) for token in NA_TOKENS])
    return records.withColumn("cells", F.transform("cells", lambda c: F.when(~F.array_contains(words, c), c)))


def cell(place: str) -> Column:
    """A record's cell at one of its named places."""
    return F.get("cells", F.col("at")[place])


def read_wide(records: DataFrame, owner: str) -> DataFrame:
    """Records whose headers are data (a column per series): one row per record and cell."""
    pairs = F.transform("names", lambda name, i: F.struct(i.alias("place"), name.alias("name"), F.get("cells", i).alias("cell")))
    return records.select(owner, "path", "row_id", F.inline(pairs))


def _others(places: Sequence[str]) -> Column:
    """Cells outside the named places, with their column names."""
    pairs = F.transform("names", lambda name, i: F.struct(name.alias("name"), i.alias("place"), F.get("cells", i).alias("cell")))
    return F.filter(pairs, lambda pair: ~F.array_contains(_taken(places), pair["place"]))


def _taken(places: Sequence[str]) -> Column:
    return F.array(F.lit(-1), *[F.coalesce(F.col("at")[name], F.lit(-1)) for name in places])


def other_columns(records: DataFrame, places: Sequence[str]) -> list[Column]:
    """The columns besides the named places, each with the narrowest type that all its cells have.

    Types are bigint, double, date, else text; a column without cells is text. Like any inference of a schema it runs one
    job over the files; only names and types reach the driver.
    """
    cells = records.select(F.inline(_others(places)))
    is_date = F.col("cell").rlike(DAY) & F.trim("cell").try_cast("date").isNotNull()
    tests = {"bigint": F.col("cell").rlike(WHOLE), "double": lenient_double("cell").isNotNull(), "date": is_date}
    found = cells.groupBy("name").agg(
        F.min("place").alias("place"), *[F.bool_and(F.when(F.col("cell").isNotNull(), test)).alias(kind) for kind, test in tests.items()]
    )
    columns = []
    for row in found.orderBy("place", "name").collect():
        kind = next((kind for kind in tests if row[kind]), "string")
        place = place_of(row["name"])
        named = F.when(~F.array_contains(_taken(places), place), F.get("cells", place))
        value = named if kind == "string" else F.trim(named).cast(kind)
        columns.append((finite(value) if kind == "double" else value).alias(row["name"]))
    return columns
