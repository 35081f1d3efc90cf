"""Structural validation of dataset texts by path, over VARIANT values.

A typed parse makes every fault null. Here a text is parsed once to a VARIANT and each field is looked at by its path, so that a missing
key, a null, a wrong type, an unknown name and an unreadable date are told apart. Plausibility is the rules' job: a negative price is
valid structure.

A text is an object with `bars`, or a bare array of bars. All elements of its arrays become rows of one scan, whatever they are.
Keys that are not known are ignored. An object with a repeated key is no JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickvet.functions import normal_timestamp, to_ms

CURRENCY = "^[A-Z]{3}$"
#: Of each part of a dataset: fields in order, what they must be, and whether they must be there.
FIELDS = {
    "": (("symbol", "text", True), ("exchange", "string", False), ("currency", "currency", False), ("source", "text", True)),
    "identifiers": (("isin", "string", False), ("cusip", "string", False), ("figi", "string", False)),
    "bars": (("timestamp", "time", True), ("open", "number", True), ("high", "number", True), ("low", "number", True), ("close", "number", True), ("volume", "number", False), ("adjustmentFactor", "positive", False)),
    "dividends": (("exDate", "date", True), ("payDate", "date", False), ("amount", "number", True), ("currency", "currency", False), ("type", "kind", False)),
    "splits": (("exDate", "date", True), ("numerator", "positive", True), ("denominator", "positive", True)),
    "fundamentals": tuple((f, "number", False) for f in ("marketCap", "sharesOutstanding", "eps", "pe", "dividendYield", "payoutRatio")),
}
PARTS = list(FIELDS)
ARRAYS = {"bars": True, "dividends": False, "splits": False}  # and whether the array must be there
KINDS = ("regular", "special")
EXPECTED = {"text": "string", "string": "string", "currency": "string", "time": "string", "date": "string", "kind": "string", "number": "number", "positive": "number"}


def type_of(v: Column) -> Column:
    """missing, null, boolean, number, string, array or object."""
    is_array = F.try_variant_get(v, "$", "array<variant>").isNotNull()
    name = F.schema_of_variant(F.when(~is_array, v))
    plain = F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.startswith("OBJECT"), "object").otherwise("number")
    return F.when(v.isNull(), "missing").when(is_array, "array").otherwise(plain)


def _fault(v: Column, kind: str, required: bool) -> Column:
    """struct(code, expected, received) if the value at a path is not what it must be, else null."""
    got = type_of(v)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    told = lambda code, expected, received: F.struct(F.lit(code).alias("code"), F.lit(expected).alias("expected"), received.alias("received"))
    right = got == EXPECTED[kind]
    if kind == "time":
        right = right | (got == "number")  # compact dates and epoch seconds; ingest writes them as dates
    out = F.when(got == "missing", told("missing", EXPECTED[kind], got) if required else F.lit(None)).when(~right, told("type", EXPECTED[kind], got))
    if kind == "text":
        out = out.when(text == "", told("empty", "text", F.lit("''")))
    elif kind == "currency":
        out = out.when(~text.rlike(CURRENCY), told("format", "three capital letters", text))
    elif kind in ("time", "date"):
        day = normal_timestamp(text) if kind == "time" else text
        out = out.when(to_ms(day).isNull(), told("format", "date", text))
    elif kind == "kind":
        out = out.when(~text.isin(*KINDS), told("enum", " or ".join(KINDS), text))
    elif kind == "positive":
        out = out.when(~(number > 0), told("range", "above 0", number.cast("string")))
    return out


def _issues(part: str, v: Column) -> Column:
    """Faults of one object of a part as an array of structs; an element that is no object is one fault."""
    fields = [F.struct(F.lit(i).alias("field_at"), F.lit(f).alias("field"), _fault(F.try_variant_get(v, f"$.{f}", "variant"), kind, required).alias("fault")) for i, (f, kind, required) in enumerate(FIELDS[part])]
    got = type_of(v)
    whole = F.struct(F.lit(-1).alias("field_at"), F.lit("").alias("field"), F.struct(F.lit("type").alias("code"), F.lit("object").alias("expected"), got.alias("received")).alias("fault"))
    absent = F.lit(part in ("identifiers", "fundamentals")) & (got == "missing")
    return F.when(absent, F.array().cast("array<struct<field_at:int,field:string,fault:struct<code:string,expected:string,received:string>>>")).when(got == "object", F.filter(F.array(*fields), lambda x: x["fault"].isNotNull())).otherwise(F.array(whole))


def issues(texts: DataFrame, symbol: str | None = None, source: str | None = None) -> DataFrame:
    """dataset_id, place (order of a dataset's issues), path, code, expected, received of every fault of texts (dataset_id, text).

    code: json, missing, type, empty, format, enum or range. symbol and source stand for such keys that a text lacks. A null text is
    no JSON; a text without faults gives no rows.
    """
    bare = F.ltrim("text").startswith("[")
    named = F.when(bare, F.concat(F.lit('{"bars":'), F.col("text"), F.lit("}"))).otherwise(F.col("text"))
    parsed = texts.select("dataset_id", F.try_parse_json(named).alias("v"))
    at = lambda path: F.try_variant_get("v", path, "variant")
    row = lambda part, i, v: F.struct(F.lit(PARTS.index(part)).alias("part"), i.alias("i"), v.alias("x"))
    one = F.lit(-1)
    sections = [F.array(row("", one, F.col("v"))), *(F.array(row(p, one, at(f"$.{p}"))) for p in ("identifiers", "fundamentals"))]
    none = F.try_variant_get(F.parse_json(F.lit("[]")), "$", "array<variant>")
    elements = lambda p: F.transform(F.coalesce(F.try_variant_get("v", f"$.{p}", "array<variant>"), none), lambda x, i: row(p, i, x))
    sections += [elements(p) for p in ARRAYS]
    # The arrays themselves: there, and arrays.
    wrong = [F.when((type_of(at(f"$.{p}")) != "array") & ((type_of(at(f"$.{p}")) != "missing") | F.lit(must)), F.struct(F.lit(PARTS.index(p)).alias("part"), F.lit(-2).alias("i"), at(f"$.{p}").alias("x"))) for p, must in ARRAYS.items()]
    is_object = type_of(F.col("v")) == "object"
    rows = parsed.withColumn("root", F.when(F.col("v").isNull(), "text").when(~is_object, type_of(F.col("v"))))
    listed = F.when(F.col("root").isNotNull(), F.array(row("", F.lit(-3), F.col("v")))).otherwise(F.concat(*sections, F.array_compact(F.array(*wrong))))
    seen = rows.select("dataset_id", "root", F.explode(listed).alias("y")).select("dataset_id", "root", "y.*")
    fault = lambda code, expected, received: F.array(F.struct(F.lit(-1).alias("field_at"), F.lit("").alias("field"), F.struct(code.alias("code"), F.lit(expected).alias("expected"), received.alias("received")).alias("fault")))
    got = type_of(F.col("x"))
    found = F.when(F.col("i") == -3, fault(F.when(F.col("root") == "text", "json").otherwise("type"), "object", F.col("root")))
    found = found.when(F.col("i") == -2, fault(F.when(got == "missing", "missing").otherwise("type"), "array", got))
    for p in PARTS:
        found = found.when(F.col("part") == PARTS.index(p), _issues(p, F.col("x")))
    defaults = F.lit(False)
    for name, given in (("symbol", symbol), ("source", source)):
        if given:
            defaults = defaults | ((F.col("part") == 0) & (F.col("z.field") == name) & (F.col("z.fault.received").isin("missing", "null")))
    out = seen.select("dataset_id", "part", "i", F.explode(found).alias("z")).filter(~defaults)
    name = F.element_at(F.array(*map(F.lit, PARTS)), F.col("part") + 1)
    path = F.concat_ws(".", F.when(name != "", name), F.when(F.col("i") >= 0, F.col("i").cast("string")), F.when(F.col("z.field") != "", F.col("z.field")))
    order = Window.partitionBy("dataset_id").orderBy("part", "i", "z.field_at")
    return out.select("dataset_id", (F.row_number().over(order) - 1).alias("place"), F.when(path == "", "(root)").otherwise(path).alias("path"), "z.fault.code", "z.fault.expected", "z.fault.received")


def findings(found: DataFrame, most: int = 20) -> DataFrame:
    """SCHEMA_INVALID findings of issues: critical, at most `most` a dataset; the first counts them all where there are more."""
    many = F.count("*").over(Window.partitionBy("dataset_id"))
    some = found.withColumn("n", many).filter(F.col("place") < most)
    told = F.concat(F.lit('structure not valid at "'), "path", F.lit('": expected '), "expected", F.lit(", received "), F.coalesce("received", F.lit("null")))
    return some.select(
        "dataset_id",
        F.lit("SCHEMA_INVALID").alias("rule"),
        F.lit("critical").alias("severity"),
        F.lit(None).cast("string").alias("where_date"),
        F.lit(None).cast("double").alias("value"),
        F.to_json(F.struct("path", "code", "expected", "received")).alias("evidence"),
        F.when((F.col("place") == 0) & (F.col("n") > most), F.col("n")).otherwise(1).cast("long").alias("occurrences"),
        F.lit("block").alias("action"),
        F.lit("validity").alias("dimension"),
        told.alias("explanation"),
        F.lit(0).alias("severity_rank"),
        F.col("place").cast("int").alias("rule_rank"),
    )
