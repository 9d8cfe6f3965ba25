"""Mixing sources to target shares of all tokens.

Tokens are summed per source; the repetition rate of a source is its target tokens divided by its own. Every document
is emitted floor(rate) times, and once more with the probability of the rest, decided by a hash of its id and a seed,
so that the mix is the same however the rows lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm import tokens
from skillweave.session import materialise

#: Most sources of a plan, which is collected and broadcast.
MOST_SOURCES = 100_000


def repetition_rates(sized: DataFrame, plan: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, own_tokens, rate) of every source of the plan.

    Without `total_tokens` the mix is the largest in which all shares hold under the repeat caps. With it, a source
    that would need more repeats than its cap falls short of its share. A source without tokens has rate 0 and takes
    no part in setting the total. Repeated plan rows of a source count as one (the largest share).
    """
    own = sized.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"))
    wanted = plan.select(tokens.source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    wanted = wanted.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(own, "source", "left").withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0))).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a plan has {MOST_SOURCES} sources at most")
    able = lambda r: r.own_tokens > 0 and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0
    total = total_tokens if total_tokens is not None else min((r.max_repeats * r.own_tokens / r.target_share for r in rows if able(r)), default=0.0)
    rates = [(r.source, r.target_share, r.max_repeats, r.own_tokens, min(float(r.max_repeats), r.target_share * total / r.own_tokens) if able(r) else 0.0) for r in rows]
    return sized.sparkSession.createDataFrame(rates, "source string, target_share double, max_repeats bigint, own_tokens bigint, rate double")


def mix(documents: DataFrame, plan: DataFrame, *, seed: int = 42, total_tokens: int | None = None, path: str = tokens.VOCABULARY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(mix, report): the mix as (doc_id, source, copy, n_tokens), one row per use of a document; the report per source.

    report: source, target_share, max_repeats, rate, own_tokens, n_documents, n_copies, mixed_tokens, share, most_copies.
    Documents of no source of the plan, or without tokens, are not used. Repeated documents (same id twice) are drawn
    alike. Empty tables give an empty mix, and a report of zeros for the plan's sources. Sizes are of whole texts.
    """
    sized = materialise(tokens.token_counts(documents, doc_id=doc_id, text=text, source=source, path=path).where("n_tokens > 0"), "sizes")
    rates = repetition_rates(sized, plan, total_tokens)
    # A uniform number of the document: 53 bits of its hash.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")), 11) / F.lit(float(2**53))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    used = sized.join(F.broadcast(rates), "source").withColumn("copies", copies.cast("int"))
    mixed = used.where("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens")
    sums = used.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    whole = sums.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = (
        rates.join(sums, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", "max_repeats", "rate", "own_tokens",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_documents", "n_copies", "mixed_tokens", "most_copies")],
            F.coalesce(F.col("mixed_tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)).alias("share"),
        )
    )
    return mixed, report
