"""Removing lines that an earlier line equals or nearly equals, with DataFrame operations only.

Lines are what lies between line feeds; lines without a word stay and make nothing go. Order is by doc_id, then by
number within the text. A line goes if an earlier line equals it, or is within one edit (a character replaced, put in
or taken out) where both have MIN_CHARS characters at least. Judged on the input: that the earlier line goes as well
does not matter.

1. Equal lines become one row with the first place (a sum by hash, 96 bits and the length).
2. Two lines within one edit share the first or the last h(m) characters, m the shorter length, as the edit is in one
   place. Each line has four such keys, for m as its own length and as one less; lines that share none with another
   are out of the search. This loses no pair.
3. The rest emit their deletion neighbourhood: hashes of the part that the key does not cover, whole and with each
   single character deleted. Lines of length m that agree without character i differ in that character at most; a line
   of length m + 1 that agrees with a whole one has one character more. So of a group of equal variants only the first
   place matters, and no pairs are made.
4. The line and the earliest line found for it are read again, and the edit distance is verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._tables import cut

MIN_CHARS, FILTER_BITS = 20, 1 << 25
_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))
    return split.where(F.col("line").rlike(_WORD))


def _unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: Spark judges what is made of written rows by the size of their
    files, and exploded or repetitive rows are many times that, more than a driver holds."""
    return df.hint("merge")


def _half(m: F.Column) -> F.Column:
    return (8 * F.floor((m - 1) / 16)).cast("int")


def _keys() -> list[F.Column]:
    size = F.char_length("line")
    out = []
    for longer in (0, 1):
        m = size - longer
        h = _half(m)
        for side, part in ((0, F.substring("line", F.lit(1), h)), (1, F.substring("line", size - h + 1, h))):
            out.append(F.when(m >= MIN_CHARS, F.xxhash64(F.lit(side), m, part)))
    return out


def _variants(found: DataFrame) -> DataFrame:
    """key, part, drop (the deleted place, or -1 where lengths differ), whole, place: the deletion neighbourhoods."""
    size = F.char_length("line")
    m = size - F.when(F.col("which") >= 2, 1).otherwise(0)
    h = _half(m)
    rest = F.when(F.col("which") % 2 == 0, F.substring("line", h + 1, size - h)).otherwise(F.substring("line", F.lit(1), size - h))
    same = F.col("which") < 2
    base = found.select("key", "place", same.alias("same"), rest.alias("rest"))
    each = base.select("key", "place", "same", "rest", F.explode(F.sequence(F.when(F.col("same"), -1).otherwise(0), F.char_length("rest") - 1)).alias("i"))
    part = F.when(F.col("i") < 0, F.col("rest")).otherwise(F.concat(F.substring("rest", F.lit(1), F.col("i")), F.substring("rest", F.col("i") + 2, F.char_length("rest"))))
    return each.select("key", F.xxhash64(part).alias("part"), F.when(F.col("same"), F.col("i")).otherwise(-1).alias("drop"), (F.col("i") < 0).alias("whole"), "place")


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id may be in ids: a bitmap of FILTER_BITS bits at most, whatever the number of ids.

    It keeps most other texts out of the shuffle of the exact join behind it; when it fills up, it lets them through.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bucket, bit = F.floor(slot / 32768), F.pmod(slot, F.lit(32768))
    bits = ids.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    found = docs.join(F.broadcast(bits), bucket == F.col("__bucket"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*docs.columns)


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, number, hash of the lines with words that stay. docs: doc_id, text, no nulls."""
    lines = _lines(docs)
    k = _keys()
    named = lines.select(F.xxhash64("line").alias("hash"), F.hash("line").alias("check"), F.char_length("line").alias("size"), F.struct("doc_id", "number").alias("place"), *(x.alias(f"k{i}") for i, x in enumerate(k)))
    firsts = cut(named.groupBy("hash", "check", "size").agg(F.min("place").alias("place"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4))), "lines")
    keyed = firsts.select("place", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("which", "key")).where("key is not null")
    # A key counts where two lines have it, one of them at least as the shorter or equal one.
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("which").alias("least")).where("n > 1 and least < 2").select("key")
    wanted = cut(keyed.join(_unsent(shared), "key").select("place.doc_id", "place.number", "which", "key"), "line-keys")
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("number", "which", "key")).alias("own"))
    joined = _among(docs, wanted.select("doc_id")).join(_unsent(per_doc), "doc_id").select("doc_id", F.split("text", "\n", -1).alias("lines"), F.explode("own").alias("own"))
    texts = joined.select(F.struct("doc_id", F.col("own.number").alias("number")).alias("place"), "own.which", "own.key", F.get("lines", F.col("own.number")).alias("line")).where("line is not null")
    texts = cut(texts, "line-texts")
    variants = _variants(texts)
    groups = variants.groupBy("key", "part", "drop").agg(F.min("place").alias("first"), F.min(F.when(F.col("whole"), F.col("place"))).alias("first_whole"), F.min(F.when(~F.col("whole"), F.col("place"))).alias("first_cut"), F.count(F.lit(1)).alias("n")).where("n > 1")
    earlier = F.when(F.col("drop") >= 0, F.col("first")).when(F.col("whole"), F.col("first_cut")).otherwise(F.col("first_whole"))
    hits = variants.join(_unsent(groups), ["key", "part", "drop"]).select("place", earlier.alias("earlier")).where("earlier < place")
    best = hits.groupBy("place").agg(F.min("earlier").alias("earlier"))
    known = texts.groupBy("place").agg(F.first("line").alias("line"))
    own = best.join(_unsent(known), "place")
    other = known.select(F.col("place").alias("earlier"), F.col("line").alias("other"))
    near = own.join(_unsent(other), "earlier").where(F.levenshtein("line", "other", 1).between(0, 1))
    gone = near.select(F.xxhash64("line").alias("hash"), F.hash("line").alias("check"), F.char_length("line").alias("size"))
    return firsts.join(_unsent(gone), ["hash", "check", "size"], "left_anti").select("place.doc_id", "place.number", "hash")


def _tag(number: F.Column, line_hash: F.Column) -> F.Column:
    return F.concat_ws(":", number.cast("string"), line_hash.cast("string"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text replaced by the lines that stay, joined by line feeds, and __n_lines and __n_removed.

    A null text stays null. Rows without a doc_id stay whole and make nothing go. Rows that share a doc_id share its
    places: of their equal or near lines at one number none is earlier. Other columns are passed on as they are.
    """
    named = docs.where("doc_id is not null and text is not null")
    kept = kept_lines(named.select("doc_id", "text"))
    per_doc = kept.groupBy(F.col("doc_id").alias("__doc_id")).agg(F.collect_list(_tag(F.col("number"), F.col("hash"))).alias("__kept"))
    marked = named.join(_unsent(per_doc), F.col("doc_id") == F.col("__doc_id"), "left").withColumn("__lines", F.split("text", "\n", -1))
    tags = F.transform("__lines", lambda x, i: _tag(i, F.xxhash64(x)))
    blank = F.filter(F.transform("__lines", lambda x, i: F.when(~x.rlike(_WORD), _tag(i, F.xxhash64(x)))), lambda x: x.isNotNull())
    # Set operations on arrays hash strings: linear in the number of lines.
    stay = F.array_intersect(tags, F.concat(F.coalesce("__kept", F.array().cast("array<string>")), blank))
    text = F.array_join(F.transform("__stay", lambda t: F.get("__lines", F.substring_index(t, ":", 1).cast("int"))), "\n")
    n = F.size("__lines").cast("long")
    out = marked.withColumn("__stay", stay).select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), n.alias("__n_lines"), (n - F.size("__stay")).alias("__n_removed"))
    rest = docs.where("doc_id is null or text is null")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    rest = rest.select(*docs.columns, F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(lines).alias("__n_lines"), F.lit(0).cast("long").alias("__n_removed"))
    return out.unionByName(rest)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays, null as empty)."""
    out = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Another way to the same lines: pairs by the shared half, compared character by character.
_CLEAN_SQL = r"""
line_rows AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS number, unnest(string_split(text, chr(10))) AS line FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
worded AS (
  SELECT * FROM line_rows WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS (
  SELECT line, min((doc_id, number)) AS place, length(line) AS size FROM worded GROUP BY line),
long_lines AS (
  SELECT *, m, 8 * CAST(floor((m - 1) / 16) AS BIGINT) AS h FROM (SELECT *, unnest([size, size - 1]) AS m FROM firsts) WHERE m >= 20),
halves AS (
  SELECT *, 0 AS side, substr(line, 1, h) AS part FROM long_lines
  UNION ALL SELECT *, 1 AS side, substr(line, size - h + 1, h) AS part FROM long_lines),
pairs AS (
  SELECT DISTINCT a.line AS line, b.line AS earlier FROM halves a JOIN halves b
    ON a.m = b.m AND a.side = b.side AND a.part = b.part AND b.place < a.place),
near AS (
  SELECT DISTINCT line FROM pairs WHERE
    (length(line) = length(earlier) AND len(list_filter(range(1, length(line) + 1), lambda i: substr(line, 1, i - 1) = substr(earlier, 1, i - 1) AND substr(line, i + 1) = substr(earlier, i + 1))) > 0)
    OR (length(line) = length(earlier) + 1 AND len(list_filter(range(1, length(line) + 1), lambda i: substr(line, 1, i - 1) || substr(line, i + 1) = earlier)) > 0)
    OR (length(earlier) = length(line) + 1 AND len(list_filter(range(1, length(earlier) + 1), lambda i: substr(earlier, 1, i - 1) || substr(earlier, i + 1) = line)) > 0)),
stays AS (
  SELECT r.doc_id, r.number, r.line FROM line_rows r LEFT JOIN firsts f ON r.line = f.line
  WHERE f.line IS NULL OR ((r.doc_id, r.number) = f.place AND NOT EXISTS (SELECT 1 FROM near n WHERE n.line = r.line))),
clean_texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY number) AS kept, count(*) AS n_kept FROM stays GROUP BY doc_id)
"""
ORACLE_SQL = (
    "WITH "
    + _CLEAN_SQL.format(docs="documents")
    + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       CASE WHEN d.text IS NULL OR d.doc_id IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(c.n_kept, 0) END AS n_removed,
       sha256(CASE WHEN d.doc_id IS NULL THEN coalesce(d.text, '') ELSE coalesce(c.kept, '') END) AS kept_sha256
FROM documents d LEFT JOIN clean_texts c ON d.doc_id = c.doc_id
"""
)
