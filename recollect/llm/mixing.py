"""Operator 4: mixing sources to target weights, with DataFrame functions only.

Tokens are aggregated by source, targets are the water-filling of the budget over the sources' weights under each
source's cap, and every document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is
the rate's fraction. The per-source table has one row a source; the only unpartitioned windows run over that table.

Defined results: null text has size 0; a null source is a source of its own, last in order; repeated rows get the same
copies; a null doc_id is hashed as the text 'null'; an empty table gives no rows; other columns pass through ``mix``, but
for ones named like its own (mix_size, mix_source_size, mix_target, mix_copies), which it replaces; ``emit`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_prefix, saved, small, table, without

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, seed: str = SEED) -> Column:
    """Number in [0, 1) from 52 bits of md5(seed and id); the same in each run and engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """mix_source, source_size, target of each source, from rows (mix_source, mix_size)."""
    per = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    whole = W.partitionBy(F.lit(1))
    order = W.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    # sources by the level at which their cap binds: those before the first whose cap isn't reached are full
    by = W.orderBy((F.col("most") / F.col("w")).asc(), F.col("mix_source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    per = per.withColumn("all", F.sum("source_size").over(whole))
    per = per.withColumn("level", (F.lit(share) * F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(after))
    free = F.col("level") * F.col("w") <= F.col("most")
    # the water level is that of the first uncapped source in this order
    first = F.min(F.when(free, F.struct((F.col("most") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(whole)
    per = per.withColumn("water", first["level"])
    return per.select("mix_source", "source_size", F.when(F.col("water").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("w") * F.col("water"), F.col("most").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, own: str = "mix_") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (times that the mix takes the document); own: their prefix."""
    docs = without(docs, *(own + n for n in ("size", "source_size", "target", "copies")))
    sized = docs.withColumn(own + "size", size_of(F.col("text")))
    goal = targets(sized.select(F.col("source").alias("mix_source"), F.col(own + "size").alias("mix_size")), weights, share, cap)
    # a row a source, without texts: saved and counted, so that the documents stay where they are
    goal = small(saved(goal.select(F.col("mix_source").alias(own + "source"), F.col("source_size").alias(own + "source_size"), F.col("target").alias(own + "target"))), 64 + F.coalesce(F.octet_length(own + "source"), F.lit(0)))
    joined = sized.join(goal, sized["source"].eqNullSafe(goal[own + "source"]), "left").drop(own + "source")
    whole, target = F.col(own + "source_size"), F.col(own + "target")
    rate = F.when(whole > 0, target / whole).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(own + "copies", copies.cast("long"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of docs."""
    own = free_prefix(docs, "mix_")
    mixed = mix(docs, own=own, **options).filter(F.col(own + "copies") > 0)
    return mixed.withColumn(own + "copy", F.explode(F.sequence(F.lit(1), F.col(own + "copies").cast("int")))).select(*[f"`{c}`" for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def mixing_sql(documents: str = "documents", columns: str | None = None) -> str:
    """DuckDB SQL of op4_mixing, or with columns of the emitted copies."""
    sized = f"""sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS mix_size FROM {documents}),
per AS (SELECT source AS s, sum(mix_size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY s ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS most FROM per),
leveled AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, s ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER (ORDER BY most::DOUBLE / w, s ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
water AS (SELECT min_by(level, most::DOUBLE / w) AS water FROM leveled WHERE level * w <= most),
goal AS (SELECT s, source_size, CASE WHEN water IS NULL THEN most::DOUBLE ELSE least(w * water, most::DOUBLE) END AS target FROM leveled CROSS JOIN water),
rated AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d LEFT JOIN goal g ON d.source IS NOT DISTINCT FROM g.s),
mixed AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)"""
    if columns:
        return f"WITH {sized} SELECT {columns} FROM mixed CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE k <= copies"
    return f"WITH {sized} SELECT doc_id, mix_size AS size, source_size, target, copies * mix_size AS taken FROM mixed"


QUERIES = {"op4_mixing": op4_mixing}
SQL = {"op4_mixing": mixing_sql()}
