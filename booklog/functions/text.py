"""Text helpers built only from JVM-side column functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points that count as white space around a field, as a character
# class of a regular expression.
WHITE_SPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# Any other character than printable ASCII; a single range keeps the search fast.
UNUSUAL = "[^ -~]"


def strip(text: Column) -> Column:
    """Text without Unicode white space at either end."""
    edges = F.lit(f"^{WHITE_SPACE}+|{WHITE_SPACE}+$")
    return F.when(text.rlike(UNUSUAL), F.regexp_replace(text, edges, F.lit(""))).otherwise(
        F.trim(text)
    )


def split_stripped(line: Column, limit: int) -> Column:
    """Comma-separated fields that need no more than a plain trim.

    Stripping each field of a set of characters would cost more than all other parsing. One
    search per line finds the lines that could need it; only they are cleaned around their
    commas and ends before the split.
    """
    edges = F.lit(f"{WHITE_SPACE}+(?=,|$)|(?<=^|,){WHITE_SPACE}+")
    clean = F.when(line.rlike(UNUSUAL), F.regexp_replace(line, edges, F.lit(""))).otherwise(line)
    return F.split(clean, ",", limit)


def evaluate_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Append a column that is computed exactly once per row.

    Catalyst pushes filters below projections by copying the projected expression into the
    filter, where it is computed again for every mention. It never does so below a
    generator. A one-element ``explode`` therefore keeps a costly expression (split, regex,
    JSON decode) single, while staying inside whole-stage code generation.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))
