"""JSON state columns and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def load_json(
    df: DataFrame, text: str, schema: T.StructType | T.ArrayType, default: Column, name: str
) -> DataFrame:
    """Add column ``name``: the JSON in ``text``, or ``default`` when missing, empty or unreadable.

    The text ``null`` is a value and stays null. Text that parses but does not fit
    the schema also gives ``default``. The text is parsed once, in a step of its own.
    """
    raw = F.col(text)
    bare = F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    is_null_text = bare == "null"
    # Texts decided without parsing are kept from the parser. The value is wrapped in an
    # object, so that one rule serves objects and arrays: a wrong type or a cut-off text
    # makes the whole record corrupt. An array must open and close as one, since the
    # parser would take a lone object for an array of one.
    shape = r"(?s)^\[.*\]$" if isinstance(schema, T.ArrayType) else r"(?s)^\{.*\}$"
    to_parse = F.when((bare != "") & ~is_null_text & bare.rlike(shape), F.concat(F.lit('{"v":'), bare, F.lit("}")))
    wide = T.StructType([T.StructField("v", schema), T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(to_parse, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # A text that goes on after its value would give the wrapping object more keys.
    alone = F.coalesce(F.size(F.json_object_keys(to_parse)) == 1, F.lit(False))
    broken = ~alone | F.col("_parsed").isNull() | F.col(f"_parsed.{CORRUPT}").isNotNull() | F.col("_parsed.v").isNull()
    result = F.when(is_null_text, F.lit(None)).when(broken, default).otherwise(F.col("_parsed.v"))
    return df.withColumn("_parsed", parsed).withColumn(name, result).drop("_parsed")


def json_text(df: DataFrame, *columns: str) -> Column:
    """One JSON object per row from the named columns (all by default); nulls are kept."""
    return F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})


def save_json(df: DataFrame, path: str) -> None:
    """Replace the JSON state at ``path``, one object per line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
