"""Mixing sources to target shares of tokens, with capped repeats.

Each document gets an Efraimidis-Spirakis key, an exponential variable over its quality weight:
taking documents by ascending key is weighted sampling without replacement. A source with budget B
and A tokens is used for floor(B / A) complete epochs, up to its max_repeats; what is left of B is
filled by a prefix of its documents in key order, as long as the next document fits.

The prefix is found without sorting a source in one task: keys are cut into buckets by their logarithm,
token sums per (source, bucket) are prefix-summed (some ten thousand rows per source at most), and the
bucket that the budget cuts is cut again into FINE buckets, of which again one is cut. Only that one is
sorted. A bucket of the first kind is a 512th of an octave of the key, so of a source's keys, which are
exponential variables over weights, it holds less than a thousandth whatever the weights.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamql.session import pin

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
OCTAVE = 512  # buckets of one octave of the key
FINE_BITS = 12  # a bucket is cut into 2**FINE_BITS
SEED = 17


def with_tokens(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """``df`` without ``text`` and with its number of tokens; null and empty texts have 0."""
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept).schema.add(out, "long")

    def count(batches: Iterator) -> Iterator:
        import public_tokenizers
        import pyarrow as pa
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sizes], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(count, schema)


def source_label(column: str) -> Column:
    """A source in one form: blanks trimmed, lower case."""
    return F.lower(F.trim(column))


def quality(text: str) -> Column:
    """A weight from 0.01 to 1, the product of four shares: letters, marks and blanks among the characters;
    the length up to 200 characters; different words among the words, up to three in ten; and words that
    are no longer than 40 characters, for scripts with blanks."""
    raw = F.col(text)
    length = F.greatest(F.length(raw), F.lit(1))
    letters = F.length(F.regexp_replace(raw, r"[^\p{L}\p{M} ]+", "")) / length
    words = F.split(raw, " ")
    n_words = F.greatest(F.size(words), F.lit(1))
    varied = F.least(F.size(F.array_distinct(words)) / n_words / F.lit(0.3), F.lit(1.0))
    unspaced = raw.rlike("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")
    sound = F.when(unspaced, F.lit(1.0)).otherwise(F.greatest(1 - F.regexp_count(raw, F.lit(r"\S{41,}")) / n_words, F.lit(0.0)))
    return F.greatest(F.coalesce(letters * F.least(length / F.lit(200.0), F.lit(1.0)) * varied * sound, F.lit(0.0)), F.lit(0.01))


def es_key(weight: Column, identity: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1) from a hash of the identity and the seed."""
    unit = (F.shiftrightunsigned(F.xxhash64(identity, F.lit(seed)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def mix(sized: DataFrame, targets: DataFrame, octave: int = OCTAVE, fine_bits: int = FINE_BITS) -> tuple[DataFrame, DataFrame]:
    """(picks, report) of ``sized`` (doc_id, source, tokens, key) and ``targets`` (source,
    target_share, max_repeats).

    picks: (doc_id, source, tokens, copies) with copies from 1 to max_repeats. report: one row per
    target. The size to fill is the sum of all tokens of ``sized``, rows of no target among them.
    Documents without a target source or without tokens are never picked; a target without documents
    falls short by all its budget. Equal keys are settled by doc_id.
    """
    all_tokens = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))  # one row
    octaves = F.log2(F.greatest(F.col("key"), F.lit(1e-300)))
    fine = F.floor(octaves * F.lit(float(octave << fine_bits))).cast("long")
    docs = sized.filter(F.col("tokens") > 0).withColumn("fine", fine).withColumn("bucket", F.shiftright("fine", fine_bits))
    goals = targets.select("source", "target_share", "max_repeats").crossJoin(F.broadcast(all_tokens)).withColumn("budget", F.floor(F.col("target_share") * F.col("all_tokens")).cast("long"))

    def cut(sums: DataFrame, place: str) -> DataFrame:
        """The one row per source in whose tokens its rest ends, with the tokens ``before`` it."""
        upto = F.sum("held").over(Window.partitionBy("source").orderBy(place))
        placed = sums.withColumn("before", F.col("before") + upto - F.col("held"))
        return placed.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("held"))).drop("held")

    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))
    sums = sums.withColumn("available", F.sum("held").over(Window.partitionBy("source"))).join(goals, "source")
    epochs = F.least(F.floor(F.try_divide("budget", "available")), F.col("max_repeats")).cast("int")
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0))
    sums = sums.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("before", F.lit(0).cast("long"))
    coarse = cut(sums.select("source", "bucket", "held", "epochs", "rest", "before"), "bucket")
    # from here on there is one row per target in ``coarse`` and ``plan``; the rest is less than a source has, so it always ends in one
    sums = docs.join(F.broadcast(coarse), ["source", "bucket"]).groupBy("source", "fine", "epochs", "rest", "before").agg(F.sum("tokens").alias("held"))
    plan = pin(cut(sums, "fine").select("source", F.col("fine").alias("edge"), "epochs", "rest", "before"))

    joined = docs.join(F.broadcast(plan), "source")
    plain = joined.filter(F.col("fine") != F.col("edge")).withColumn("extra", (F.col("fine") < F.col("edge")).cast("int"))
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = joined.filter(F.col("fine") == F.col("edge")).withColumn("extra", (F.col("before") + run <= F.col("rest")).cast("int"))
    picks = plain.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("extra")).filter(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")

    used = picks.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    stock = docs.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    report = goals.join(stock, "source", "left").join(used, "source", "left").na.fill(0, ["available_tokens", "used_tokens", "n_documents", "most_copies"])
    mixed = used.agg(F.sum("used_tokens").alias("mixed_tokens"))  # one row
    report = report.crossJoin(F.broadcast(mixed)).select(
        "source", "target_share", "max_repeats", F.col("budget").alias("target_tokens"), "available_tokens", "n_documents", "most_copies", "used_tokens",
        F.coalesce(F.try_divide("used_tokens", "all_tokens"), F.lit(0.0)).alias("share_of_all"), F.coalesce(F.try_divide("used_tokens", "mixed_tokens"), F.lit(0.0)).alias("share_of_mix"),
        (F.col("budget") - F.col("used_tokens")).alias("shortfall_tokens"),
    )
    return picks, report


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, key) of every document, counted once and kept in the shared folder."""
    rows = documents.select("doc_id", source_label("source").alias("source"), "text", es_key(quality("text"), F.col("doc_id"), seed).alias("key"))
    return pin(with_tokens(rows, tokenizer=tokenizer).select("doc_id", "source", "tokens", "key"))
