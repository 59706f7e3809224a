"""Training rows from saved chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T

#: The wording of a saved selection prompt and of its answer, as patterns: fixed values.
FORMATS = {
    "query": r"(?is)\nUser Query:\s*(.*?)\n\nOutput format:",
    "title": r"(?is)\nTitle:\s*(.*?)\nAbstract:",
    "abstract": r"(?is)\nAbstract:\s*(.*?)\n\nUser Query:",
    "decision": r"(?i)^\s*(?:Decision:\s*)?(True|False)\b",
}


def shortened(text: Column, most: int) -> Column:
    """White space as single spaces, and no more than `most` characters, of which the last three are dots where some went."""
    plain = T.normalize_space(text)
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 3)), F.lit("...")))


def parsed_chats(chats: DataFrame, most: int = 1200) -> DataFrame:
    """The chats with query, title, document (title, and the abstract up to `most` characters) and label (1 or 0).

    chats: user and assistant, the first two messages. Rows without a decision, a query or a title go; nulls are empty.
    """
    found = {name: F.trim(F.regexp_extract(F.coalesce("assistant" if name == "decision" else "user", F.lit("")), pattern, 1)) for name, pattern in FORMATS.items()}
    rows = chats.withColumns({f"_{name}": x for name, x in found.items()}).where("_decision <> '' and _query <> '' and _title <> ''")
    body = F.when(F.col("_abstract") != "", F.concat(F.lit("\nAbstract: "), shortened(F.col("_abstract"), most))).otherwise("")
    rows = rows.withColumns({"query": F.col("_query"), "title": F.col("_title"), "document": F.concat(F.lit("Title: "), "_title", body), "label": (F.lower("_decision") == "true").cast("int")})
    return rows.drop(*(f"_{name}" for name in FORMATS))
