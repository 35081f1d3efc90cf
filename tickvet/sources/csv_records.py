"""CSV files of any number and size to the normalized tables, by record.

Files are read in splits of lines, so that neither a file nor its header map passes one task whole. Quotes that a split
holds, added up over the splits before it, tell whether it begins inside a quoted field; so every line is known to begin a
record or to continue one, and records are numbered by prefix sums over splits. Only records of several lines are grouped.

Fields may be quoted, and then hold commas, line breaks and doubled quotes. Line breaks of any kind become \\n. A quote
inside an unquoted field counts as a quote, as RFC 4180 has none there; U+001F is dropped. Lines of blanks between
records are skipped. A header is a file's first record; names are trimmed and lower-cased; where two names mean one
column the last value that is not empty counts, and where one name repeats its first column counts.

A file that can't be read has an error and no rows: no header, no rows, columns missing, a quote never closed, or more
than a tenth of its records with another number of fields than the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickvet.functions import normal_timestamp, to_ms
from tickvet.operators.tables import DIVIDENDS, SPLITS, MarketTables
from tickvet.shared import written

# Names under which a column may come, by the name it gets.
ALIASES = {
    "timestamp": ("date", "timestamp", "time", "datetime"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "v", "vol"),
}
REQUIRED = ("timestamp", "open", "high", "low", "close")
MOST_RAGGED = 0.1
BREAK = "\x1f"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, split, at (order in the split), value, quotes, and for a split that begins outside (0) or inside (1) a quoted
    field: in0, in1 (is this line a continuation), n0, n1 (records begun up to this line)."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    raw = raw.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = raw.withColumn("inside", (F.sum("quotes").over(upto) - F.col("quotes")) % 2 == 1)
    blank = F.trim("value") == ""
    begun = lambda inside: F.count_if(~inside & ~blank).over(upto)
    return raw.select("file", "split", "at", "value", "quotes", F.col("inside").alias("in0"), (~F.col("inside")).alias("in1"), begun(F.col("inside")).alias("n0"), begun(~F.col("inside")).alias("n1"))


def splits_of(numbered: DataFrame) -> DataFrame:
    """file, split, from_inside (it begins inside a quoted field), before (records begun in earlier splits), open_end (a quote of the file is never closed)."""
    s = numbered.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("from_inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    s = s.withColumn("begun", F.when(F.col("from_inside"), F.col("n1")).otherwise(F.col("n0")))
    return s.select("file", "split", "from_inside", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("before"), (F.sum("quotes").over(whole) % 2 == 1).alias("open_end"))


def records(numbered: DataFrame, splits: DataFrame) -> DataFrame:
    """file, split (where it begins), record (from 1), value: whole records of files whose quotes are all closed."""
    got = numbered.join(splits.filter("NOT open_end"), ["file", "split"])
    pick = lambda name: F.when(F.col("from_inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    got = got.select("file", "split", "at", "value", (F.col("before") + pick("n")).alias("record"), pick("in").alias("goes_on"), (F.col("quotes") % 2 == 1).alias("odd"))
    got = got.filter(F.col("goes_on") | (F.trim("value") != ""))
    single = got.filter("NOT goes_on AND NOT odd").select("file", "split", "record", "value")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "\n")
    several = got.filter("goes_on OR odd").groupBy("file", "record").agg(F.min("split").alias("split"), text.alias("value"))
    return single.unionByName(several)


def cells(record: Column) -> Column:
    """Fields of a record. Pieces between quotes alternate outside and inside; an empty one outside, between two others, is a doubled quote."""
    pieces = F.split(F.translate(record, BREAK, ""), '"')
    outside = lambda p, i: F.when((p == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit('"')).otherwise(F.translate(p, ",", BREAK))
    return F.split(F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).otherwise(outside(p, i))), ""), BREAK)


def _headers(found: DataFrame) -> DataFrame:
    """file, width, names, places (known column to its places), missing."""
    names = F.transform(cells(F.translate("value", "\ufeff", "")), lambda x: F.lower(F.trim(x)))
    h = found.filter("record = 1").select("file", names.alias("names"))
    place = lambda known: F.array_sort(F.filter(F.array(*(F.array_position("names", n) for n in known)), lambda i: i > 0))
    h = h.select("file", "names", F.size("names").alias("width"), *(place(known).alias(f"at_{k}") for k, known in ALIASES.items()))
    missing = F.filter(F.array(*(F.when(F.size(f"at_{k}") == 0, F.lit(k)) for k in REQUIRED)), lambda x: x.isNotNull())
    return h.withColumn("missing", missing)


def _errors(splits: DataFrame, headers: DataFrame, rows: DataFrame) -> DataFrame:
    """file, error (null for a good file)."""
    files = splits.groupBy("file").agg(F.bool_or("open_end").alias("open_end"))
    counts = rows.groupBy("file").agg(F.count("*").alias("total"), F.count_if("ragged").alias("bad"))
    first = Window.partitionBy("file").orderBy("record")
    # Only each file's first three come together.
    told = rows.filter("ragged").select("file", "record").withColumn("r", F.row_number().over(first)).filter("r <= 3")
    told = told.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.col("record") - 1)), ", ").alias("first"))
    all_ = files.join(headers.select("file", "names", "missing"), "file", "left").join(counts, "file", "left").join(told, "file", "left")
    total = F.coalesce("total", F.lit(0))
    return all_.select("file", F.when(F.col("open_end"), "a quote is never closed").when(F.col("names").isNull(), "the file has no header")
        .when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", "), F.lit("; found: "), F.array_join("names", ", ")))
        .when(total == 0, "the file has no rows")
        .when(F.col("bad") > MOST_RAGGED * total, F.concat(F.col("bad").cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows have a different number of fields, first rows "), F.col("first"))).alias("error"))


def read_csv_files(spark: SparkSession, paths: str | list[str], symbol: Column | None = None, source: str = "csv", dataset_id: Column | None = None) -> tuple[MarketTables, DataFrame]:
    """(tables, errors): a dataset for each file that can be read, and (dataset_id, error) of the others.

    symbol and dataset_id are expressions over `file`, the file's path; by default UNKNOWN and the path. An entirely empty
    file yields no lines, so it is in neither.
    """
    id_ = F.col("file") if dataset_id is None else dataset_id
    # Splits are dealt by the cluster's size at the time, so lines are numbered once.
    numbered = written(lines(spark, paths))
    splits = written(splits_of(numbered))
    found = records(numbered, splits)
    headers = written(_headers(records(numbered, splits.filter("before = 0"))))
    by_split = splits.select("file", "split").join(headers, "file")
    values = cells(F.col("value"))
    rows = written(found.filter("record > 1").join(by_split, ["file", "split"]).withColumn("cells", values).select("file", "record", (F.size("cells") != F.col("width")).alias("ragged"), *(_last(k).alias(k) for k in ALIASES)))
    state = written(_errors(splits, headers, rows).withColumn("dataset_id", id_))
    good = state.filter("error IS NULL").select("file", "dataset_id")
    ts = normal_timestamp(F.col("timestamp"))
    # A file may hold most rows: bars that belong to bad files are taken out, few as these are, not good ones joined in.
    kept = rows.join(state.filter("error IS NOT NULL").select("file"), "file", "left_anti")
    bars = kept.select(id_.alias("dataset_id"), (F.col("record") - 2).cast("int").alias("seq"), ts.alias("ts_raw"), to_ms(ts).alias("t"), *(F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), F.lit(None).cast("double").alias("adj_factor"))
    null = lambda t: F.lit(None).cast(t)
    numbers = ("market_cap", "shares_outstanding", "eps", "pe", "dividend_yield", "payout_ratio")
    named = F.lit("UNKNOWN") if symbol is None else F.coalesce(symbol, F.lit("UNKNOWN"))
    datasets = good.select("dataset_id", named.alias("symbol"), F.lit(source).alias("source"), *(null("string").alias(c) for c in ("exchange", "currency", "isin")), *(null("double").alias(c) for c in numbers))
    errors = state.filter("error IS NOT NULL").select("dataset_id", "error")
    return MarketTables(datasets, bars, spark.createDataFrame([], DIVIDENDS), spark.createDataFrame([], SPLITS)), errors


def _last(name: str) -> Column:
    """The last value that is not empty among the column's places; null if there is none."""
    got = F.filter(F.transform(f"at_{name}", lambda i: F.trim(F.get("cells", i.cast("int") - 1))), lambda x: x != "")
    return F.get(got, F.size(got) - 1)
