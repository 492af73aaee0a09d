"""Whether files still hold the symbols that were indexed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a signature that must still stand there.
SIGNATURE_PREFIX = 32


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def source_states(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, state of symbols against files (path, content) as they are now: fresh, changed or missing.

    A symbol is fresh where its bytes still begin on its line and, decorators aside, with its signature (its first 32
    characters, white space collapsed); a module where it still ends with the file; a symbol without a signature where
    its name is still in it.  A null content is a missing file."""
    s = symbols.select("id", "path", "name", "kind", "start_line", "start_byte", "end_byte", "signature")
    s = s.join(files.select("path", "content"), "path", "left")
    size = F.octet_length("content")
    before = F.substr("content", F.lit(1), F.col("start_byte")).cast("string")
    line = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    span = F.make_valid_utf8(F.substr("content", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")).cast("string"))
    body = F.regexp_replace(span, r"\A(?:[^\S\n]*@[^\n]*(?:\n|\z))+", "")
    signature = F.coalesce("signature", F.lit(""))
    same = (
        F.when((F.col("start_byte") > F.col("end_byte")) | (F.col("end_byte") > size) | (line != F.col("start_line")), F.lit(False))
        .when(F.col("kind") == "module", F.col("end_byte") == size)
        .when(signature == "", F.contains(span, F.col("name")))
        .otherwise(F.startswith(_words(body), F.substring(_words(signature), 1, SIGNATURE_PREFIX)))
    )
    state = F.when(F.col("content").isNull(), F.lit("missing")).when(same, F.lit("fresh")).otherwise(F.lit("changed"))
    return s.select("id", state.alias("state"))
