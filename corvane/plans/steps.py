"""Plans as JSON text, read into rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import unfenced

SCHEMA = "steps array<struct<agent:string,instruction:string>>"


def plan_of(text: Column, question: Column) -> Column:
    """The steps of a plan; text that isn't JSON is one retrieval step; valid JSON without steps has none."""
    bare = unfenced(text)
    one = F.array(F.struct(F.lit("retrieval").alias("agent"), question.alias("instruction")))
    none = F.slice(one, F.lit(1), F.lit(0))
    return F.when(F.try_parse_json(bare).isNull(), one).otherwise(F.coalesce(F.from_json(bare, SCHEMA)["steps"], none))
