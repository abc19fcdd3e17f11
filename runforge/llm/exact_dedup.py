"""Exact dedup: two-pass Bloom filtering with DataFrame functions only.

Texts are equal when they are identical without their ASCII white space.

Pass one hashes every text and sets one bit of a Bloom filter for it. The filter
is a table of 64-bit words with a row count each; a word of which more rows than
bits are set holds a hash that may be repeated. Only those words go into the
second filter, one bit a word, 64 of them in a row. Pass two probes the second
filter with each row. Rows it does not know are unique and pass straight through.
The others, all true copies and about one unique row in ``bits_per_row``, shuffle
and are grouped exactly by SHA-256.

The filter grows with the rows (``bits_per_row`` bits each, 1/64 of that in the
second), so it stays a table: its join is broadcast only when Spark measures it
under its broadcast threshold, and else shuffles digests, never texts. A group of
copies of any size is reduced within each task before it shuffles; the join that
tells its members the outcome has one small row a group on the other side, so that
adaptive execution splits a hot group over tasks.

Cases: a null text is an empty one; texts of white space alone are equal to it. Of
equal texts the one with the most code points stays, then the smallest id, null ids
last. Rows with the same id and an equal text are one document: all have the same
result, and :func:`drop_copies` keeps one row of them. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import prepare, whole_text
from runforge.session import materialize

#: The characters that do not count: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _n, _sha): code points of the whole text, digest of the normalised one."""
    text = whole_text(text_col)
    return df.select(F.col(id_col), F.length(text).alias("_n"), F.sha2(normalised(text), 256).alias("_sha"))


def _hash(sha: Column) -> Column:
    """63 bits of the digest as the filter's hash."""
    return F.xxhash64(sha).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def second_filter(digest: DataFrame, bits_per_row: int) -> DataFrame:
    """(_block, _bits): which words of the first filter may hold a repeated hash."""
    words = F.greatest(F.ceil(F.count(F.lit(1)) * bits_per_row / 64), F.lit(1)).cast("long")
    size = digest.agg(words.alias("m")).first()["m"]
    first = (digest.select(F.pmod(_hash(F.col("_sha")), F.lit(size)).alias("_word"),
                           F.pmod(F.floor(_hash(F.col("_sha")) / size).cast("long"), F.lit(64)).cast("int").alias("_bit"))
             .groupBy("_word")
             .agg(F.count(F.lit(1)).alias("_rows"), F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_set"))
             .where(F.col("_rows") > F.bit_count("_set")))
    second = (first.groupBy(F.floor(F.col("_word") / 64).cast("long").alias("_block"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(_word % 64 as int))")).alias("_bits")))
    return second.withColumn("_size", F.lit(size))


def probed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that have ``_sha``, with ``_maybe``: whether the second filter knows the hash."""
    size = known.select("_size").first()
    if size is None:
        return rows.withColumn("_maybe", F.lit(False))
    word = F.pmod(_hash(F.col("_sha")), F.lit(size["_size"]))
    return (rows.withColumn("_word", word).withColumn("_block", F.floor(F.col("_word") / 64).cast("long"))
            .join(known.drop("_size"), "_block", "left")
            .withColumn("_maybe", F.coalesce(F.expr("(shiftright(_bits, cast(_word % 64 as int)) & 1L) = 1L"), F.lit(False)))
            .drop("_word", "_block", "_bits"))


def _copies(digest: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    rows = probed(digest, known)
    out = [F.col(id_col), F.col("keep_id"), F.col("group_size"), F.col("keep_id").eqNullSafe(F.col(id_col)).alias("kept"),
           F.col("_sha").alias("text_sha256")]
    straight = (rows.where(~F.col("_maybe")).withColumn("keep_id", F.col(id_col))
                .withColumn("group_size", F.lit(1).cast("long")))
    maybe = rows.where("_maybe").select(id_col, "_n", "_sha")
    first = F.struct((-F.col("_n")).alias("n"), F.col(id_col).isNull().alias("null_id"), F.col(id_col).alias("id"))
    # a stored table, so that the join has an exchange on either side and a hot group is split
    groups = materialize(maybe.groupBy("_sha").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("group_size"))
                         .where("group_size > 1"), "copies")
    members = (maybe.join(groups, "_sha", "left")
               .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("_first.id")))
               .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))))
    return straight.select(*out).unionByName(members.select(*out))


def _filtered(df: DataFrame, bits_per_row: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    prepare(df.sparkSession)
    digest = materialize(digests(df, id_col, text_col), "digests")
    return digest, materialize(second_filter(digest, bits_per_row), "bloom")


def exact_copies(df: DataFrame, bits_per_row: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    return _copies(*_filtered(df, bits_per_row, id_col, text_col), id_col)


def drop_copies(df: DataFrame, bits_per_row: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``; unique rows do not shuffle."""
    digest, known = _filtered(df, bits_per_row, id_col, text_col)
    # one row a document that has copies; with the id in the key a hot group spreads over all tasks
    found = materialize(_copies(digest, known, id_col).where("group_size > 1")
                        .groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_same")).agg(F.max("kept").alias("_kept")),
                        "copies")
    own = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_doc"),
                    F.sha2(normalised(whole_text(text_col)), 256).alias("_sha"))
    rows = probed(own, known)
    member = (F.col("_sha") == F.col("_same")) & F.col("_doc").eqNullSafe(F.col("_id"))
    stay = (rows.where("_maybe").join(found, member, "left").where("_kept is null or _kept")
            .dropDuplicates(["_doc", "_sha"]))
    return rows.where(~F.col("_maybe")).select("_row.*").unionByName(stay.select("_row.*"))
