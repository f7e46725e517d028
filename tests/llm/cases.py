"""Small documents with the awkward cases that every operator has to take."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(40_000))
BODY = " ".join(f"alpha{i} beta{i} gamma" for i in range(40))

ROWS = [
    (1, BODY),
    (2, BODY),  # a copy
    (3, BODY.replace("alpha7 ", "omega ")),  # nearly a copy
    (4, None),
    (5, ""),
    (6, "   \n\t \n"),
    (7, "One line that stands twice.\nOne line that stands twice.\nshort\nLicensed under the Apache License, Version 2.0."),
    (8, "one LINE that stands twice.  \nAnother line of text here.\nReleased under the MIT License."),
    (9, "é ß 漢字 \x00 <|endoftext|> don't\r\nRIFF and %PDF- and GIF89a BM"),
    (10, LONG),
    (10, LONG),  # a repeated row
    (None, "a row without an id, and with a line that stands alone"),
    (None, None),
]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        # names that the operators use themselves
        *(T.StructField(n, T.StringType()) for n in ("id", "ord", "mark", "body", "node", "score", "n_words", "kept", "component", "shard", "slot", "pos", "line", "label", "g")),
    ]
)


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["x"] * (len(SCHEMA) - 2)) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dict(df, key="doc_id"):
    """Rows by key; the first of equal keys."""
    out = {}
    for r in df.collect():
        out.setdefault(r[key], r.asDict())
    return out
