"""Loading of delimited records, with the lines that can't be loaded kept apart (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FIELDS = ("name", "comment", "sequence", "quality", "tid", "num_duplicates")
#: Explicit schema of a line; the raw text of what the parser rejects (by count or cast) stays in `corrupt`.
SCHEMA = "name string, comment string, sequence string, quality string, tid string, num_duplicates int, corrupt string"
#: Lines with more commas or quotes than this never reach the permissive parser, whose columns are limited, and the JVM's pattern, which recurs.
MOST_COMMAS, MOST_QUOTES = 2000, 400
#: A line in which every quoted field is closed and followed by a comma, and no other field holds a quote.
_QUOTED = r"""\A(?:"(?:[^"]++|"")*+"|[^",]*+)(?:,(?:"(?:[^"]++|"")*+"|[^",]*+))*+\z"""

# a field: quoted, in which a doubled quote is one quote, or without any quote
_FIELD = re.compile(r'"((?:[^"]|"")*)"|([^",]*)', re.S)


def split_line(line: str) -> list[str] | None:
    """The fields of a line, or None if its quoting is broken."""
    fields, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        fields.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if at == len(line):
            return fields
        if line[at] != ",":
            return None
        at += 1


@F.pandas_udf(ArrayType(StringType()))
def _reparse(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in lines:
        yield batch.map(lambda x: None if x is None else split_line(x))


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def classify(raw: DataFrame, line: str = "line") -> DataFrame:
    """raw plus the struct `record` of the six fields and `reason`, null where the line can be loaded.

    The lines, quoted fields included, are read permissively under SCHEMA
    inside the JVM, after a check of the quoting that names the first reason.
    What that parser rejects (a wrong count of fields or a number that can't
    be cast), and the few lines it can't be trusted with (carriage returns,
    NUL, very many commas or quotes), are classified again by an exact
    reading. Then the first reason that holds is named: quoting, columns,
    name, sequence, quality. One carriage return at the end of a line is not
    part of it. A null line counts as an empty one. Rows equal to others
    stay; extra columns of raw are kept, but `record` and `reason` are
    replaced.
    """
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\r\z", "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(MOST_COMMAS + 10)}

    def many(x: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))

    # each explode of a single element keeps what it computes from being inlined, and so computed, again
    kept = raw.drop("record", "reason").select("*", F.explode(F.array(F.struct(text.alias("t"), many(",").alias("commas"), many('"').alias("quotes")))).alias("__l"))
    t, quotes = F.col("__l.t"), F.col("__l.quotes")
    odd = t.rlike(r"[\r\x00]") | (F.col("__l.commas") > MOST_COMMAS) | (quotes > MOST_QUOTES)
    broken = F.when(odd | (quotes == 0), False).otherwise(~t.rlike(_QUOTED))
    checked = kept.select("*", F.explode(F.array(F.struct(odd.alias("odd"), broken.alias("broken")))).alias("__c"))
    csv = F.from_csv(F.when(~F.col("__c.odd") & ~F.col("__c.broken"), t), SCHEMA, options)
    read = checked.select("*", F.explode(F.array(csv)).alias("__r"))
    # the parser takes an empty line for a record of nulls, so the count of commas is looked at too
    rejected = F.col("__r").isNull() | F.col("__r.corrupt").isNotNull() | ((quotes == 0) & (F.col("__l.commas") != len(FIELDS) - 1))
    suspect = F.col("__c.odd") | (~F.col("__c.broken") & rejected)
    plain = F.array(*(F.coalesce(F.col(f"__r.{f}").cast("string"), F.lit("")) for f in FIELDS))
    again = read.withColumn("__again", suspect).withColumn("__fields", _reparse(F.when(F.col("__again"), t)))
    parts = again.select("*", F.explode(F.array(F.when(F.col("__again"), F.col("__fields")).when(~F.col("__c.broken"), plain))).alias("__parts"))
    name, sequence, quality = (F.col("__parts")[i] for i in (0, 2, 3))
    reason = (
        F.when(F.col("__parts").isNull(), "quoting")
        .when(F.size("__parts") != len(FIELDS), "columns")
        .when(~_matches(name, r"\A[!-=?A-~][!-~]*\z"), "name")
        .when(~_matches(sequence, r"\A[ACGTUNRYKMSWBDHVacgtunrykmswbdhv-]+\z"), "sequence")
        .when((quality != "") & ((F.length(quality) != F.length(sequence)) | ~_matches(quality, r"\A[!-~]*\z")), "quality")
    )
    out = parts.withColumn("reason", reason)
    record = F.struct(*(F.col("__parts")[i].alias(f) for i, f in enumerate(FIELDS[:5])), F.expr("try_cast(trim(__parts[5]) AS int)").alias("num_duplicates"))
    return out.withColumn("record", F.when(F.col("reason").isNull(), record)).drop("__l", "__c", "__r", "__again", "__fields", "__parts")


def loaded(raw: DataFrame) -> DataFrame:
    """(line_id, batch, the six fields): the lines that can be loaded.

    An empty comment, quality or tid stays empty; a num_duplicates that is no
    integer is null.
    """
    return classify(raw).where(F.col("reason").isNull()).select("line_id", "batch", "record.*")


def found(raw: DataFrame) -> DataFrame:
    """(line_id, reason): the lines that can't be loaded, distinct."""
    return classify(raw).where(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def schema() -> StructType:
    """Schema of loaded()'s six fields."""
    return StructType([StructField(f, StringType()) for f in FIELDS[:5]]).add("num_duplicates", "int")
