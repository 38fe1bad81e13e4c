"""Names and descriptions of queries, from the line that begins with >."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word, up to four parts behind bars, a blank and a description.
QUERY_LINE = r"^>\w+((?:\|([^| ]*))?(?:\|([^| ]+))?(?:\|([^| ]+))?(?:\|([^| ]+))?) ([^\n]+)\n?"


def query_defline(text: Column) -> Column:
    """(id, descr, seq) of a query's text. With a description the id is the second part behind bars or, without one, all that stands behind the
    word, which is nothing without bars; otherwise the line up to its first blank. Text without such a line is all sequence, by the name of query."""
    known = text.rlike(QUERY_LINE)
    second = F.regexp_extract(text, QUERY_LINE, 3)
    head = F.substring_index(text, "\n", 1)
    name = F.when(second != "", second).otherwise(F.regexp_extract(text, QUERY_LINE, 1))
    line = text.startswith(">")
    rest = F.when(F.contains(text, F.lit("\n")), text.substr(F.length(head) + 2, F.length(text))).otherwise("")
    return F.struct(
        F.when(~line, "query").when(known, name).otherwise(F.regexp_extract(head, "^>([^ ]*)", 1)).alias("id"),
        F.when(~line, "").when(known, F.regexp_extract(text, QUERY_LINE, 6)).otherwise(F.regexp_extract(head, "^>[^ ]* (.*)$", 1)).alias("descr"),
        F.when(~line, text).when(known, F.regexp_replace(text, QUERY_LINE, "")).otherwise(rest).alias("seq"),
    )
