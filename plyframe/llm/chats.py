"""Chat formatting after collapsing cumulative snapshots. DataFrame functions only.

A log often holds one conversation several times, each snapshot a few turns longer. Turns are
numbered, and a rolling 128-bit hash (exclusive or of the hashes of position, role and text) stands
for every prefix. A conversation whose whole hash is a proper prefix of another goes, by anti-join;
of equal ones the least id stays. What is left is rendered.

A conversation may be very long: turns are handled in chunks of CHUNK turn numbers, and where many turns have
one number or none, these are dealt by their hash, which is their order. A window sees one chunk, chunks are combined
from one row each, and so is a rendered conversation. Texts are shuffled once, by conversation and chunk, and for survivors only are they
gathered; everything before uses hashes. Prefixes and whole conversations are pre-aggregated by
their hash before they are joined, so copies and common first turns are one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.llm.common import cut, table

CHUNK = 1024
#: Marks of the rendered form; inside roles and texts a mark's angle bracket is escaped.
START, END = "<|im_start|>", "<|im_end|>"


def render(role: Column, text: Column) -> Column:
    """One turn; null role and text are empty, and marks within them can't act as marks."""

    def inert(c: Column) -> Column:
        for mark in (START, END):
            c = F.replace(c, F.lit(mark), F.lit("&lt;" + mark[1:]))
        return c

    role, text = (inert(F.coalesce(c.cast("string"), F.lit(""))) for c in (role, text))
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def turns(chats: DataFrame) -> DataFrame:
    """``(conv_id, turn, a, b)``: rows that repeat a turn wholly are one; a and b hash role and text."""
    role, text = F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))
    return (
        chats.where("conv_id is not null")
        .select("conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"))
        .groupBy("conv_id", "turn", "a", "b")
        .agg(F.lit(1).alias("_"))
        .drop("_")
    )


def low() -> Column:
    """The first turn number of a chunk; turns without a number come before all."""
    return F.coalesce(F.floor(F.col("turn") / CHUNK) * CHUNK, F.lit(-(2**62)))


def crowded(rows: DataFrame) -> DataFrame | None:
    """``(conv_id, turn, parts)``: into how many parts the turns of one number go, for those of chunks of over 2 * CHUNK turns."""
    full = cut(rows.groupBy("conv_id", low().alias("low")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * CHUNK).drop("n"))
    if full.isEmpty():
        return None
    among = rows.withColumn("low", low()).join(full, ["conv_id", "low"])
    return cut(among.groupBy("conv_id", "turn").agg(F.ceil(F.count("*") / CHUNK).alias("parts")))


def dealt(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``rows(conv_id, turn, a)`` with their chunk; chunks are in the order of turns and, of one turn, of ``a``."""
    if parts is None:
        return rows.withColumn("chunk", F.struct(low().alias("low"), F.lit(0).cast("bigint").alias("nth")))
    own = parts.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parts")
    joined = rows.join(own, (F.col("conv_id") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    nth = F.floor((F.shiftright("a", 1) + F.lit(2**62)) / F.lit(float(2**63)) * F.col("parts"))
    first = F.when(F.col("parts").isNotNull(), F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**62)))).otherwise(low())
    return joined.withColumn("chunk", F.struct(first.alias("low"), F.coalesce(nth, F.lit(0)).cast("bigint").alias("nth"))).drop("_conv", "_turn", "parts")


def prefixes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix of every turn, ``(conv_id, position, a, b, last)``, and ``(conv_id, chunk, part, n_turns)``."""
    counts = cut(rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")))
    conv = Window.partitionBy("conv_id").orderBy("chunk")
    whole = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = cut(counts.select("conv_id", "chunk", (F.row_number().over(conv) - 1).alias("part"), (F.sum("n").over(conv) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("n_turns")))
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "a", "b")
    placed = rows.withColumn("k", F.row_number().over(order)).join(parts, ["conv_id", "chunk"]).withColumn("position", F.col("before") + F.col("k"))
    hashed = placed.select("conv_id", "chunk", "position", "n_turns", F.xxhash64("position", "a", "b").alias("a"), F.xxhash64("b", "a", "position").alias("b"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    hashed = hashed.withColumn("a", F.bit_xor("a").over(upto)).withColumn("b", F.bit_xor("b").over(upto)).withColumn("last", F.lead("position").over(Window.partitionBy("conv_id", "chunk").orderBy("position")).isNull())
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = hashed.where("last").select("conv_id", "chunk", F.coalesce(F.bit_xor("a").over(earlier), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("b").over(earlier), F.lit(0)).alias("cb"))
    rolled = hashed.join(carried, ["conv_id", "chunk"]).select("conv_id", "position", F.col("a").bitwiseXOR(F.col("ca")).alias("a"), F.col("b").bitwiseXOR(F.col("cb")).alias("b"), (F.col("position") == F.col("n_turns")).alias("last"))
    return rolled, parts.select("conv_id", "chunk", "part", "n_turns")


def maximal(rolled: DataFrame) -> DataFrame:
    """``(conv_id, n_copies)`` of conversations that are no proper prefix of another, a row for equal ones."""
    ends = rolled.where("last").groupBy("position", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = rolled.where("not last").select("position", "a", "b").distinct()
    return ends.join(inner, ["position", "a", "b"], "left_anti").select("conv_id", "n_copies")


def formatted(chats: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies, text)``: rendered maximal conversations, one row each.

    Turns are ordered by number (null first), ties by a hash of role and text; rows that repeat a
    turn wholly count once. Rows without conv_id belong to no conversation. n_copies
    tells how many conversations were equal. No conversation gives no row.
    """
    chats = chats.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = cut(turns(chats))
    crowd = crowded(rows)
    rolled, parts = prefixes(dealt(rows, crowd))
    kept = cut(parts.join(maximal(cut(rolled)), "conv_id"))
    role, text = F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))
    said = dealt(chats.where("conv_id is not null").withColumn("a", F.xxhash64(F.lit(1), role, text)), crowd).join(kept, ["conv_id", "chunk"])
    one = F.struct("turn", "a", F.xxhash64(F.lit(2), text, role).alias("b"), render(F.col("role"), F.col("text")).alias("text"))
    gathered = said.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_set(one)).alias("turns"))
    pieces = gathered.select("conv_id", "n_turns", "n_copies", F.struct("part", F.concat_ws("", "turns.text").alias("text")).alias("piece"))
    whole = pieces.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select("conv_id", "n_turns", "n_copies", F.concat_ws("", "pieces.text").alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, chr(1)) AS role, coalesce(text, chr(1)) AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST) AS said,
         string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '&lt;|im_start|>'), '<|im_end|>', '&lt;|im_end|>') || chr(10)
                    || replace(replace(text, '<|im_start|>', '&lt;|im_start|>'), '<|im_end|>', '&lt;|im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST) AS text
  FROM t GROUP BY conv_id),
inner_prefixes AS (SELECT DISTINCT list_slice(said, 1, n) AS said FROM (SELECT said, unnest(range(1, len(said))) AS n FROM c))
SELECT min(conv_id) AS conv_id, any_value(len(said))::BIGINT AS n_turns, count(*)::BIGINT AS n_copies, any_value(replace(text, chr(1), '')) AS text
FROM c WHERE said NOT IN (SELECT said FROM inner_prefixes) GROUP BY said
"""
