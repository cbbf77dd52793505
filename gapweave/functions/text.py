"""Text as the analysis sees it: lines by line feed, offsets in bytes, columns in UTF-16 units, white space of the language."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The language's white space beyond ASCII, and its line ends.
WHITE = "\\t\\u000B\\f \\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000\\uFEFF\\n\\r\\u2028\\u2029"


def is_blank(c) -> Column:
    return F.col(c).rlike(f"^[{WHITE}]*$") if isinstance(c, str) else c.rlike(f"^[{WHITE}]*$")


def trimmed(c: str) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def utf16_length(c) -> Column:
    """Characters beyond the basic plane count twice."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), start (byte offset), line_text; a final line feed yields an empty last line."""
    exploded = files.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_i", "line_text"))
    w = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line_text") + 1).over(w), F.lit(0))
    return exploded.select(key, (F.col("_i") + 1).alias("line"), before.cast("long").alias("start"), "line_text")


def osa_distance(a: str, b: str) -> int:
    """Edits of one character or one swap of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]
