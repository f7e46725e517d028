"""Difference of two snapshots of a table, where rows may have changed their key.

Rows are narrowed to their key and a short form of each compared column in the
scan, so texts are not shuffled. Bloom filters of each snapshot's keys tell the
rows whose key surely isn't in the other one from candidates; a join by key
resolves the candidates; what is left unpaired pairs by content: the i-th
smallest earlier key of a content with its i-th smallest later key, ranked in
windows over ranges of (content, key).

A filter is blocked by words of 64 bits: a key sets BITS_SET bits of one word,
and words are rows of a table, so filters grow with the keys and are neither
broadcast nor held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyq.llm.common import Shelf, stored
from surveyq.operators.scans import ranked

#: Bits of a filter for each key, and how many of them a key sets.
BITS_A_KEY, BITS_SET = 16, 4


def short_form(column: Column) -> Column:
    """A string that is equal for equal values: the value while it is short, else its SHA-256; null stays null."""
    text = column.cast("string")
    return F.when(F.length(text) <= 48, F.concat(F.lit("="), text)).otherwise(F.concat(F.lit("#"), F.sha2(text.cast("binary"), 256)))


def _mask(hashed: Column) -> Column:
    """The bits that a key sets in its word: BITS_SET places of 6 bits of its hash."""
    out = None
    for k in range(BITS_SET):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(63).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def key_filter(keys: DataFrame, key: str, place: str, words: int) -> DataFrame:
    """(word, bits): the Bloom filter of (key, place), a row for each word that has bits."""
    h = F.xxhash64(key, place)
    return keys.select(F.pmod(h, F.lit(words)).alias("word"), _mask(F.xxhash64(h)).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def with_filter(rows: DataFrame, filtered: DataFrame, key: str, place: str, words: int, name: str) -> DataFrame:
    """rows with `name`: whether the filter says that their key may be there. Rows are dealt by word, which is made of the key."""
    h = F.xxhash64(key, place)
    table = filtered.select("word", "bits")
    return (
        rows.withColumn("word", F.pmod(h, F.lit(words))).join(table, "word", "left")
        .withColumn(name, F.coalesce(F.col("bits").bitwiseAND(_mask(F.xxhash64(h))) == _mask(F.xxhash64(h)), F.lit(False))).drop("bits")
    )


def _narrow(df: DataFrame, key: str, content: Sequence[str], compared: Sequence[str], carry: dict[str, Column]) -> DataFrame:
    """(k, c0.., carry..): key, short forms of content and of the other compared columns."""
    forms = [short_form(F.col(c)).alias(f"c{i}") for i, c in enumerate(_all(content, compared))]
    return df.select(F.col(key).alias("k"), *forms, *(c.alias(f"x{i}") for i, c in enumerate(carry.values())))


def _all(content: Sequence[str], compared: Sequence[str]) -> list[str]:
    return [*content, *(c for c in compared if c not in content)]


def _placed(shelf: Shelf, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place: 1 where keys are unique, else the row's place among the rows of its key, by content."""
    if rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows.withColumn("place", F.lit(1).cast("long"))
    return ranked(rows, ["k"], order, "place")


def _by_content(met: DataFrame, side: str, content: list[str]) -> DataFrame:
    """Rows of one side with their rank within their content by key.

    Content is told by two 64-bit hashes here, as sorting by ranges sends a sample
    of its keys to the driver; rows pair only where their whole content agrees.
    """
    rows = met.select(*(c for c in met.columns if c.startswith(f"{side}_")))
    forms = [f"{side}_{c}" for c in content]
    hashed = rows.withColumns({"group_a": F.xxhash64(*forms), "group_b": F.xxhash64(F.lit(1), *forms)})
    return ranked(hashed, ["group_a", "group_b"], [f"{side}_k", f"{side}_place"], f"{side}_rank").drop("group_a", "group_b")


def snapshot_difference(
    earlier: DataFrame, later: DataFrame, key: str, content: Sequence[str], compared: Sequence[str] = (), carry: dict[str, Column] | None = None
) -> DataFrame:
    """(key, old_key, op, changed, carried): each pair of rows or unpaired row of two snapshots.

    Equal keys pair (op same, or update if a compared column differs); then
    rows with equal content columns pair in order of their keys (rekey); the
    rest is insert or delete. key is the later row's, else the earlier one's;
    old_key the earlier row's or null; changed the compared columns that
    differ, comma-joined in the given order (compared defaults to content),
    empty for unpaired rows. carry names expressions over a later row, null for deletes.

    Nulls equal only nulls, in keys as in columns. Of several rows with one key
    the i-th by columns pairs with the other snapshot's i-th, and what is left of them
    pairs by content like others. Empty tables give only inserts or deletes; other columns are not read.
    """
    carry = carry or {}
    compared = list(compared) or list(content)
    every = _all(content, compared)
    forms, extra, shared = [f"c{i}" for i in range(len(every))], [f"x{i}" for i in range(len(carry))], [f"c{i}" for i in range(len(content))]
    with Shelf(earlier.sparkSession) as shelf:
        old = shelf.stored(_narrow(earlier, key, content, compared, {}), "earlier")
        new = shelf.stored(_narrow(later, key, content, compared, carry), "later")
        words = max(1, max(old.count(), new.count()) * BITS_A_KEY // 64)
        old, new = _placed(shelf, old, forms), _placed(shelf, new, forms)
        side = lambda df, s, *more: df.select(*(F.col(c).alias(f"{s}_{c}") for c in ("k", "place", *forms, *more)))
        o = with_filter(side(old, "o"), key_filter(new, "k", "place", words), "o_k", "o_place", words, "o_maybe").withColumnRenamed("word", "o_word")
        n = with_filter(side(new, "n", *extra), key_filter(old, "k", "place", words), "n_k", "n_place", words, "n_maybe").withColumnRenamed("word", "n_word")
        # by word, which follows from key and place: candidates stay where the filters found them
        same_key = (F.col("o_word") == F.col("n_word")) & F.col("o_k").eqNullSafe(F.col("n_k")) & (F.col("o_place") == F.col("n_place")) & F.col("o_maybe") & F.col("n_maybe")
        met = shelf.stored(o.join(n, same_key, "full").drop("o_word", "n_word"), "met")
        paired = met.where("o_place IS NOT NULL AND n_place IS NOT NULL")
        # content windows: the rank of a row among the unpaired ones of its content
        left, right = (_by_content(met.where(f"{other}_place IS NULL"), s, shared) for s, other in (("o", "n"), ("n", "o")))
        same_content = F.col("o_rank") == F.col("n_rank")
        for c in shared:
            same_content &= F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
        moved = left.join(right, same_content, "full")
        by_key, by_content = F.lit("k").alias("by"), F.lit("c").alias("by")
        pairs = paired.select("*", by_key).unionByName(moved.drop("o_rank", "n_rank").select("*", by_content))
        differs = [F.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), F.lit(c)) for c in compared for f in (f"c{every.index(c)}",)]
        changed = F.concat_ws(",", *differs)
        there, gone = F.col("n_place").isNotNull(), F.col("o_place").isNull()
        op = (
            F.when(~there, "delete").when(gone, "insert").when(F.col("by") == "c", "rekey").when(changed == "", "same").otherwise("update")
        )
        out = pairs.select(
            F.when(there, F.col("n_k")).otherwise(F.col("o_k")).alias("key"), F.col("o_k").alias("old_key"), op.alias("op"),
            F.when(there & ~gone, changed).otherwise(F.lit("")).alias("changed"), *(F.col(f"n_{x}").alias(name) for x, name in zip(extra, carry)),
        )
        return stored(out, "difference")


def later_snapshot(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A later snapshot of documents (key, text, lang, source): crc32 of the decimal key modulo 16 drops, changes, rekeys or copies a row."""
    kind = F.crc32(F.col(key).cast("string").cast("binary")) % 16
    case = F.coalesce(kind, F.lit(15))
    away = -1 - F.col(key)
    text = F.when(case == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    lang = F.when(case == 2, F.col("source")).otherwise(F.col("lang"))
    source = F.when(case == 2, F.col("lang")).when(case == 4, None).otherwise(F.col("source"))
    keys = F.when(case.isin(3, 4), F.array(away)).when(case == 5, F.array(F.col(key), away)).otherwise(F.array(key))
    return docs.where(case != 0).select(F.explode(keys).alias(key), text.alias("text"), lang.alias("lang"), source.alias("source"))


def row_sha256(*columns: str) -> Column:
    """SHA-256 of the columns joined by line feeds, null as ~."""
    lines = [F.coalesce(F.col(c), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\n", *lines).cast("binary"), 256)


def compare_documents(docs: DataFrame) -> DataFrame:
    """documents against later_snapshot(documents), with the digest of the later row."""
    mine = docs.select("doc_id", "text", "lang", "source")
    return snapshot_difference(mine, later_snapshot(mine), "doc_id", ["text"], ["text", "lang", "source"], {"row_sha256": row_sha256("text", "lang", "source")})

