"""Projections, filters, searches, lookups and pages (P*, O*, A9)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.clock import hours_before
from parley.functions.values import blank, pair_key
from parley.schemas import LENGTHS
from parley.sources.tables import shared_dir

# Fixed value: the accepted form of a time typed in by hand.
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"


def all_of(predicates: Iterable[Column]) -> Column:
    """AND of predicates; true when there are none."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def select_cols(df: DataFrame, spec: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Columns to keep, optionally under new names: `{new name: column}`."""
    if isinstance(spec, Mapping):
        return df.select(*[F.col(source).alias(name) for name, source in spec.items()])
    return df.select(*spec)


def filter_eq(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows where every named column equals its value."""
    return df.where(all_of(F.col(c) == F.lit(v) for c, v in values.items()))


def filter_in(df: DataFrame, col: str, keys: DataFrame | Sequence[object]) -> DataFrame:
    """Rows whose `col` is one of `keys`: a few literals, or the first column of a table."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias(col))
        return df.join(wanted, col, "left_semi")
    return df.where(F.col(col).isin(*keys))


def contains_text(
    column: Column, text: str, collation: str = "UTF8_LCASE", escape: bool = True
) -> Column:
    """Substring test under a collation.

    With `escape=False`, `%` and `_` in the text are wildcards. The default
    collation is compared in lower case, which the scan's own expressions do
    much faster than collated LIKE. LIKE does not take accent-insensitive
    collations, so those always search for the literal text.
    """
    kind = collation.upper()
    if kind == "UTF8_LCASE":
        if escape:
            return F.contains(F.lower(column), F.lower(F.lit(text)))
        return column.ilike("%" + text + "%")
    if kind == "UTF8_BINARY":
        return F.contains(column, F.lit(text)) if escape else column.like("%" + text + "%")
    return F.contains(F.collate(column, collation), F.collate(F.lit(text), collation))


def search_contains(
    df: DataFrame,
    texts: Mapping[str, str | None],
    collation: str = "UTF8_LCASE",
    escape: bool = True,
) -> DataFrame:
    """Rows whose columns contain the given texts; empty texts do not filter."""
    return df.where(
        all_of(
            contains_text(F.col(c), t, collation, escape) for c, t in texts.items() if t
        )
    )


def apply_filters(
    df: DataFrame,
    params: Mapping[str, object],
    like: Sequence[str] = ("nickname", "remark"),
    equal: Sequence[str] = ("wxid", "id", "account_id", "is_active"),
    collation: str = "UTF8_LCASE",
    escape: bool = True,
) -> DataFrame:
    """Optional filters of the listings: an empty input adds no predicate (P5).

    `is_active="0"` does filter: it is text, and not empty.
    """
    given = {k: v for k, v in params.items() if v is not None and v != ""}
    predicates = [
        contains_text(F.col(c), str(given[c]), collation, escape) for c in like if c in given
    ]
    for c in equal:
        if c in given:
            kind = df.schema[c].dataType
            # An input that does not fit the column's type matches no row.
            value = F.lit(str(given[c])).try_cast(kind)
            column = F.col(c)
            if kind.typeName() == "string":
                column, value = F.collate(column, collation), F.collate(value, collation)
            predicates.append(column == value)
    return df.where(all_of(predicates))


def since(df: DataFrame, col: str, as_of, hours: int) -> DataFrame:
    """Rows from `hours` before `as_of` on."""
    return df.where(F.col(col) >= hours_before(as_of, hours))


def between_parties(messages: DataFrame, a: str, b: str) -> DataFrame:
    """Messages of one conversation, both directions."""
    sent = (F.col("from_user") == a) & (F.col("to_user") == b)
    received = (F.col("from_user") == b) & (F.col("to_user") == a)
    return messages.where(sent | received)


def with_pair_key(messages: DataFrame) -> DataFrame:
    """Messages that have both parties, with the key of their conversation."""
    both = messages.where(F.col("from_user").isNotNull() & F.col("to_user").isNotNull())
    return both.select("*", *pair_key(F.col("from_user"), F.col("to_user")))


def involving(messages: DataFrame, party: str) -> DataFrame:
    """Messages sent or received by one party."""
    return messages.where((F.col("from_user") == party) | (F.col("to_user") == party))


def by_party(messages: DataFrame) -> DataFrame:
    """Each message once per party, in column `party`: the join form of P12."""
    ends = F.array_distinct(F.array_compact(F.array("from_user", "to_user")))
    return messages.withColumn("party", F.explode(ends))


def name_conflicts(candidates: DataFrame, admins: DataFrame) -> DataFrame:
    """Candidates whose username is taken by another id, whatever its case.

    Lowest and highest id per username decide it, so a name shared by very many
    rows costs one row and no pairs are built.
    """
    holders = admins.groupBy(F.lower("username").alias("_name")).agg(
        F.min("id").alias("_lowest"), F.max("id").alias("_highest")
    )
    taken = (F.col("_lowest") != F.col("id")) | (F.col("_highest") != F.col("id"))
    asked = candidates.withColumn("_name", F.lower("username"))
    return asked.join(holders, "_name").where(taken).select(*candidates.columns)


def lookup_one(df: DataFrame, values: Mapping[str, object], order: Sequence[str] = ("id",)) -> DataFrame:
    """The first matching row, lowest `order` first."""
    return filter_eq(df, values).orderBy(*order).limit(1)


# Pages that begin within so many rows are taken as the first rows of each task; later ones by rank.
SHALLOW_ROWS = 10_000
# Columns of a ranked listing: the range a row is in, and its place over all ranges.
RANGE, PLACE = "_range", "_place"


def paginate(
    df: DataFrame,
    order: Sequence[Column | str],
    page: int = 1,
    size: int = 10,
    shallow_rows: int = SHALLOW_ROWS,
) -> DataFrame:
    """One page in a total order, with the row count and the page count.

    A page that ends within the first `shallow_rows` rows is cut from the first rows of each task. For a
    later one that would put all rows before it in one place; it is read by rank (`write_ranked`).
    """
    if page * size > shallow_rows:
        path = shared_dir(df.sparkSession, "ranked")
        write_ranked(df, order, path)
        return ranked_page(df.sparkSession, path, page, size)
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    counted = rows.withColumn("total_rows", df.agg(F.count(F.lit(1))).scalar())
    return counted.withColumn("total_pages", F.ceil(F.col("total_rows") / size).cast("long"))


def write_ranked(
    df: DataFrame, order: Sequence[Column | str], path: str, partitions: int | None = None
) -> None:
    """Write `df` to `path` as a listing whose pages can be read alone.

    Rows are dealt by ranges of `order`, a total order, and each range is a folder of rows sorted by their
    place. No task holds more than a range. Pages of one written listing fit together, whatever is
    added to the table meanwhile.
    """
    dealt = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    )
    # A number of the range in the upper bits, of the row in it in the lower 33.
    placed = dealt.sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    ranged = placed.withColumn(RANGE, F.shiftright(PLACE, 33))
    ranged.sortWithinPartitions(RANGE, PLACE).write.partitionBy(RANGE).parquet(path)
    _range_counts(ranged.sparkSession, path).coalesce(1).write.parquet(f"{path}-counts")
    ranged.limit(0).drop(RANGE).write.parquet(f"{path}-schema")


def _range_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each range, from the folder names and file footers alone."""
    stored = spark.read.schema(f"{RANGE} long").parquet(path)
    return stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_rows"))


def ranked_page(spark: SparkSession, path: str, page: int = 1, size: int = 10) -> DataFrame:
    """One page of a listing of `write_ranked`, with the row count and the page count.

    The counts of the ranges, one row for each, tell where the page begins and ends. Only those folders are
    read, and in them only stretches of places the page can hold.
    """
    counts = spark.read.parquet(f"{path}-counts").orderBy(RANGE).collect()
    total = sum(r._rows for r in counts)
    first, last = (page - 1) * size, min(page * size, total) - 1

    def place_of(rank: int) -> tuple[int, int]:
        for r in counts:
            if rank < r._rows:
                return r[RANGE], (r[RANGE] << 33) + rank
            rank -= r._rows
        return -1, -1

    schema = spark.read.parquet(f"{path}-schema").schema
    stored = spark.read.schema(schema.add(RANGE, "long")).parquet(path)
    if first < 0 or first > last:
        found = stored.where(F.lit(False))
    else:
        (low, begin), (high, end) = place_of(first), place_of(last)
        found = stored.where(F.col(RANGE).between(low, high) & F.col(PLACE).between(begin, end))
    return found.orderBy(PLACE).drop(PLACE, RANGE).withColumns(
        {
            "total_rows": F.lit(total).cast("long"),
            "total_pages": F.lit(-(-total // size)).cast("long"),
        }
    )


def ranked_rows(spark: SparkSession, path: str, size: int = 10) -> DataFrame:
    """All rows of a listing of `write_ranked` with `rank` (from 1), `page` and `page_row` (from 1)."""
    schema = spark.read.parquet(f"{path}-schema").schema
    stored = spark.read.schema(schema.add(RANGE, "long")).parquet(path)
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.read.parquet(f"{path}-counts").select(
        RANGE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    place = F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each range, so the side is small at every size.
    ranked = stored.join(F.broadcast(offsets), RANGE).withColumn("rank", F.col("_offset") + place + 1)
    return ranked.withColumns(
        {
            "page": F.floor((F.col("rank") - 1) / size) + 1,
            "page_row": F.pmod(F.col("rank") - 1, F.lit(size)) + 1,
        }
    ).drop(PLACE, RANGE, "_offset")


def check_lengths(df: DataFrame, table: str) -> DataFrame:
    """Add `errors`: the texts longer than their column in `table` holds."""
    checks = [
        F.when(F.length(c) > limit, F.lit(f"{c} is longer than {limit}"))
        for c, limit in LENGTHS[table].items()
        if c in df.columns
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def validate_rows(
    df: DataFrame, required: Sequence[str] = (), times: Sequence[str] = ("start_time",)
) -> DataFrame:
    """Add `errors`: the required columns that are empty and the times badly written."""
    checks = [
        F.when(blank(F.col(c).cast("string")), F.lit(f"{c} is required")) for c in required
    ] + [
        F.when(
            ~blank(F.col(c)) & ~F.col(c).rlike(TIME_PATTERN), F.lit(f"{c} has no valid format")
        )
        for c in times
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))
