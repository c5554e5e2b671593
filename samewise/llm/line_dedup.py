"""Corpus-wide line dedup with DataFrame operations only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lowered.
Keys of at least MIN_CHARS code points found under at least MIN_DOCS document ids
lose all their lines but those of the largest id.

Only hashes of keys travel, with id and position, range-partitioned by hash (equal
ranges, as hashes are even: nothing is sampled) with a secondary sort by document
(largest first) and position, so that first occurrences stream by.  A frequent
line is salted by document: every salt finds
its own first occurrences, passes on the lines of its two largest documents and
how many documents it has seen; a second pass over these decides.  No task ever
holds all places of a line.  What stays folds into keep bitmaps of 64 lines to
a word, sent only for words with a dropped line; the texts are joined with their
bitmaps once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 64
_STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(stripped: Column) -> Column:
    """The key of a line without white space at its ends; as long as that in code points."""
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))


def _places(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, tag, pos) of every line whose key is long enough; tag tells texts under one id apart."""
    tagged = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
    tagged = tagged.where(F.char_length("line") >= min_chars).withColumn("line", F.trim("line", F.lit(_STRIPPED)))
    tagged = tagged.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return tagged.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "id", "tag", "pos")


def _ranges(parts: int, *by: str) -> Column:
    """The range, of ``parts`` equal ones, that a hash of the columns falls into: hashes are even, so no sample is needed to cut them."""
    lead = F.shiftrightunsigned(F.xxhash64(*by), 33)  # 31 bits
    return F.expr("0").cast("int") if parts < 2 else (F.floor(lead * F.lit(parts) / F.lit(float(1 << 31)))).cast("int")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, tag, keep): for each text that loses lines, map of word to the bits of its lines that stay.

    Bit p % 64 of word p div 64 stands for line p; all lines of a word that is not in the map stay.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    newest = F.col("id").desc_nulls_last()
    places = _places(docs, id_col, text_col, min_chars).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    places = places.withColumn("range", _ranges(parts, "h1", "h2", "salt"))
    dealt = places.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "h1", "h2", "salt", newest, "pos")
    local = Window.partitionBy("range", "h1", "h2", "salt").orderBy(newest)
    ranked = dealt.withColumn("rank", F.dense_rank().over(local))
    sure = ranked.where(F.col("rank") > min_docs).select("id", "tag", "pos")
    # at most SALTS * min_docs documents of a line come to the second pass
    few = ranked.where(F.col("rank") <= min_docs).select("h1", "h2", "id", "tag", "pos").withColumn("range", _ranges(parts, "h1", "h2"))
    few = few.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "h1", "h2", newest, "pos")
    whole = Window.partitionBy("range", "h1", "h2")
    few = few.withColumn("place", F.dense_rank().over(whole.orderBy(newest))).withColumn("held", F.max("place").over(whole))
    decided = few.where((F.col("held") >= min_docs) & (F.col("place") > 1)).select("id", "tag", "pos")
    words = sure.union(decided).groupBy("id", "tag", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("id", "tag").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _marked(docs: DataFrame, columns: list[str], id_col: str, text_col: str, **options) -> DataFrame:
    """(row, lines, kept): the named columns as a struct, a text's lines, and those that stay."""
    found = keep_bitmaps(docs, id_col, text_col, **options)
    base = docs.select(F.struct(*columns).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_tag"))
    joined = base.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tag") == F.col("tag")), "left")
    split = joined.select("row", "text", lines(F.col("text")).alias("lines"), "keep")
    stays = F.expr("filter(lines, (x, i) -> shiftright(coalesce(try_element_at(keep, cast(i div 64 as int)), -1L), i % 64) & 1L = 1)")
    return split.withColumn("kept", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(stays))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) for every row of docs.

    Documents are told apart by id: rows that share one count once, and all of
    those with the largest id keep their lines.  A null id is the smallest.  Null and empty texts have
    one empty line.  A very long text is split in its own row; what travels of it is a hash for
    each line.  An empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = _marked(docs, [id_col], id_col, text_col, **options)
    n = F.size("lines").cast("long")
    return rows.select(F.col(f"row.{id_col}").alias(id_col), n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with repeated lines taken out of the texts, all columns as they were; texts that lose none, null ones too, stay as they are.

    A column n_chars follows the text.  Other columns may have any name.  Nulls, repeated rows,
    very long texts and empty tables: as in ``dedup_report``.
    """
    rows = _marked(docs, docs.columns, id_col, text_col, **options)
    changed = F.size("kept") < F.size("lines")
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(F.col(f"row.{text_col}"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(changed, F.char_length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"row.{c}").alias(c))
    return rows.select(*out)


ORACLE = """
with split as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents
), line as (
    select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line
), frequent as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
    select keyed.doc_id, pos, line, coalesce(keeper <> keyed.doc_id, false) as dropped from keyed left join frequent using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""
