"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source has a target number of words.  All targets together are cut into blocks of equal
length, and the sources get whole blocks by highest quotients.  A source's quota is divided
over its shards by the same rule, and a shard takes its quota in a seeded selection: its
documents in a seeded order form a ring, and the shard takes its blocks one after the other
from a seeded start, going round once more when the quota exceeds its words.
Everything is DataFrame expressions; the only windows are over the sources and over one shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrylens.llm.common import broadcast_if_small
from quarrylens.operators.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST_REPEATS = 2
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 16
SEED = 20


def _hash(*parts: Column) -> Column:
    """32 bits of the MD5 of the parts joined by colons: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): one row per source.

    The weights repeat over the sources in code point order, null last.  Shares above
    ``most`` times a source are cut there, and the rest is shared again by weight: with the
    sources sorted by room per weight, the full ones come first; the level of the others is that
    of the first source it does not fill, the highest among those not filled.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    named = sizes.withColumn("_rank", F.row_number().over(every) - 1).withColumn("_weight", weight)
    room = named.withColumn("_room", (most * F.col("source_size")).cast("double"))
    by_room = W.orderBy(F.col("_room") / F.col("_weight"), F.col("_rank"))
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    total = share * F.sum("source_size").over(whole)
    left = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("_room").over(before), F.lit(0.0))) / left
    levelled = room.withColumn("_level", level)
    fits = F.col("_level") * F.col("_weight") <= F.col("_room")
    final = F.max(F.when(fits, F.col("_level"))).over(whole)
    share_out = F.least(F.col("_room"), F.coalesce(final * F.col("_weight"), F.col("_room")))
    return levelled.select("source", "_rank", "source_size", share_out.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, tie: str, most: str) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` whole seats by highest quotients votes / (2 s - 1).

    With the exact share q = votes * seats / all votes, a party's seats lie within half its part
    of the number of parties of q; the seats below that range are certain, and only those inside
    are ranked, about two per party.  No party gets more than ``most``; ties go by ``tie``.
    """
    whole = W.partitionBy(F.lit(0))
    total = F.sum(votes).over(whole)
    part = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    exact = part * seats
    reach = part * F.count(F.lit(1)).over(whole) / 2 + 1
    sure = F.least(F.greatest(F.floor(exact - reach), F.lit(0)), F.col(most)).cast("bigint")
    top = F.least(F.ceil(exact + reach), F.col(most)).cast("bigint")
    ranged = parties.withColumn("_sure", sure).withColumn("_top", top).withColumn("_seats", seats)
    open_seats = F.col("_seats") - F.sum("_sure").over(whole)
    ranged = ranged.withColumn("_open", open_seats)
    seat = F.explode(F.when(F.col("_top") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_top"))))
    asked = ranged.withColumn("_seat", seat).withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") - 1))
    order = W.orderBy(F.col("_quotient").desc(), F.col(tie))
    won = asked.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= F.col("_open"))
    more = won.groupBy(F.col(tie).alias("_party")).agg(F.count(F.lit(1)).alias("_won"))
    joined = ranged.join(more, F.col(tie) == F.col("_party"), "left")
    quota = F.col("_sure") + F.coalesce("_won", F.lit(0))
    return joined.withColumn("quota", quota).drop("_sure", "_top", "_seats", "_open", "_party", "_won")


def row_key(doc_id: str, text: str, source: str) -> Column:
    """A digest of a row's id, source and text; null ids, sources and texts are values of their own."""
    named = F.to_json(F.struct(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{source}`").cast("string").alias("s")))
    return F.md5(F.concat(named, F.coalesce(F.md5(F.col(f"`{text}`")), F.lit("-"))))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    with_key: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, tail_words, front_words, first_word).

    ``taken`` words are ``passes`` whole copies, ``tail_words`` from word ``first_word`` on, and
    the first ``front_words``.  The ring of a shard is cut by words, so most documents are taken
    whole or not at all; the two ends of a shard's run are parts.

    Nulls: a null text has size 0; a null source is a source of its own, the last; rows
    without an id are placed by a digest of their text instead.  Repeated rows are rows of their own.  An empty
    table gives no rows, and a table without words takes nothing.  ``with_key`` adds ``_key``,
    the digest of a row's id, source and text.
    """
    key = row_key(doc_id, text, source)
    if not with_key:
        key = F.when(F.col(f"`{doc_id}`").isNull(), key)
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = cut(
        docs.select(
            F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            size.alias("size"),
            key.alias("_key"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, most))
    asked = targets.withColumn("_most", F.ceil(most * F.col("source_size") / block_words).cast("bigint"))
    blocks = F.floor(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words + 0.5)
    shared = sainte_lague(asked, "target", blocks, "_rank", "_most")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint")
    shared = cut(
        shared.select(
            F.col("source").alias("_source"), "_rank", "source_size", "target", "quota", shards.alias("_shards")
        )
    )
    known = rows.join(broadcast_if_small(shared), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    id_text = F.coalesce(F.col("doc_id").cast("string"), "_key")
    known = known.withColumn("_order", _hash(F.lit(str(seed)), id_text))
    known = known.withColumn("_shard", F.col("_order") % F.col("_shards"))
    shard = W.partitionBy("_rank", "_shard")
    ring = shard.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed + 1)), id_text)), "doc_id", "size", "_key")
    known = known.withColumn("_end", F.sum("size").over(ring.rowsBetween(W.unboundedPreceding, 0)))
    known = known.withColumn("_ring", F.sum("size").over(shard))
    # The shard's blocks: its words over the words that one block of the source stands for.
    own = F.when(
        F.col("source_size") > 0, F.floor(F.col("quota") * F.col("_ring") / F.col("source_size") + 0.5)
    ).otherwise(0)
    words = F.least(own.cast("bigint") * block_words, most * F.col("_ring"))
    known = known.withColumn("_words", words)
    known = known.withColumn("_passes", F.when(F.col("_ring") > 0, F.floor(F.col("_words") / F.col("_ring"))).otherwise(0))
    known = known.withColumn("_run", F.col("_words") - F.col("_passes") * F.col("_ring"))
    start = F.when(
        F.col("_ring") > 0, _hash(F.lit(str(seed + 2)), F.col("_rank").cast("string"), F.col("_shard").cast("string")) % F.col("_ring")
    ).otherwise(0)
    known = known.withColumn("_start", start).withColumn("_begin", F.col("_end") - F.col("size"))

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_end"), high) - F.greatest(F.col("_begin"), low))

    # The run covers [start, start + run) of the ring, and what is beyond its end at the front.
    tail = overlap(F.col("_start"), F.col("_start") + F.col("_run"))
    front = overlap(F.lit(0), F.col("_start") + F.col("_run") - F.col("_ring"))
    taken = F.col("_passes") * F.col("size") + tail + front
    first_word = F.greatest(F.lit(0), F.col("_start") - F.col("_begin"))
    return known.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.cast("bigint").alias("taken"),
        F.col("_passes").cast("bigint").alias("passes"),
        tail.cast("bigint").alias("tail_words"),
        front.cast("bigint").alias("front_words"),
        first_word.cast("bigint").alias("first_word"),
        *(["_key"] if with_key else []),
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each whole copy and each part that it takes.

    Rows are known by a digest of id, source and text, so that rows without an id, and other texts under
    one id, are in it with the words they are planned with.  Repeated rows have their other
    columns from one of them.  Rows without words are in no mix.
    """
    plan = mix_sources(docs, doc_id, text, with_key=True, **options).filter("taken > 0")
    plan = plan.select("_key", "passes", "tail_words", "front_words", "first_word", F.col("size").alias("_size"))
    # The rows are dealt out by the key once, for both steps.
    keyed = docs.withColumn("_key", row_key(doc_id, text, options.get("source", "source"))).dropDuplicates(["_key"])
    joined = keyed.join(plan, "_key")
    own = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(own, F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    whole, none = F.array(own), F.array().cast("array<string>")

    def part(first: Column, count: Column) -> Column:
        cut_out = F.array(F.array_join(F.slice(pieces, (first + 1).cast("int"), count.cast("int")), ""))
        return F.when(count <= 0, none).when(count == F.col("_size"), whole).otherwise(cut_out)

    copies = F.concat(
        F.array_repeat(own, F.col("passes").cast("int")),
        part(F.col("first_word"), F.col("tail_words")),
        part(F.lit(0), F.col("front_words")),
    )
    names = [F.col("_copy").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.withColumn("_copy", F.explode(copies)).select(*names)
