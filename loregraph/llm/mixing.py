"""Mixing sources to target shares by systematic sampling.

Sizes are tokens of a public tokenizer. Every document of a source is expected ``rate`` times in the mix; the expected copies are summed
along the source, one random offset is added, and a document is emitted once for each whole number its interval crosses.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.session import broadcast_if_small, checkpointed

#: Place of the vocabulary files; a parameter everywhere it is used.
TOKENIZER_PATH = os.environ.get("TOKENIZER_PATH", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Rows of a source that one task ranks.
BLOCK_ROWS = 200_000


def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, *keep: str, tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """``id``, ``tokens`` and the columns ``keep``; a null or empty text has 0 tokens."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *[F.col(k) for k in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "t") + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer_path)
        for b in batches:
            b["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b.pop("t")]
            yield b

    return src.mapInPandas(run, schema)


def source_sizes(docs: DataFrame, targets: DataFrame, *, tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """(id, tokens, source) of the documents whose source is listed; the list is a dimension table whose size is checked before it is broadcast."""
    listed = broadcast_if_small(targets.select("source").filter(F.col("source").isNotNull()).distinct())
    return token_counts(docs.select(F.col("doc_id"), "text", "source").join(listed, "source", "left_semi"), "doc_id", "text", "source", tokenizer_path=tokenizer_path)


def _plan(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Per listed source: its size, the rate at which its documents enter, whether the cap binds."""
    per = sized.groupBy("source").agg(F.sum("tokens").alias("src_tokens"), F.count("*").alias("src_docs"))
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).filter(F.col("source").isNotNull())
    t = t.groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    p = t.join(per, "source", "left").fillna(0, ["src_tokens", "src_docs"])
    # one row per listed source: a dimension-sized window
    p = p.withColumn("total_tokens", F.sum("src_tokens").over(Window.partitionBy()))
    want = F.col("target_share") * F.col("total_tokens")
    return p.select(
        "*",
        want.alias("target_tokens"),
        (F.col("src_tokens") * F.col("max_repeats") < want).alias("capped"),
        F.when(F.col("src_tokens") > 0, F.least(F.col("max_repeats").cast("double"), want / F.col("src_tokens"))).otherwise(0.0).alias("rate"),
        (F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("offset"),
    )


def _copies(sized: DataFrame, plan: DataFrame, seed: int, block_rows: int) -> DataFrame:
    """Copies per document. A source is ranked in blocks of about ``block_rows`` rows, whose counts are summed first, so that no task sees a whole source."""
    p = broadcast_if_small(plan.select("source", "rate", "offset", "src_docs"))
    d = sized.join(p, "source").withColumn("h", F.xxhash64("id", F.lit(seed)))
    # blocks by size class first: neighbours have about the same size, which keeps the sampled tokens close to the expected ones
    d = d.withColumn("blk", F.struct(F.floor(F.log2(F.col("tokens") + 1)).alias("c"), F.pmod(F.col("h"), F.ceil(F.col("src_docs") / F.lit(block_rows))).alias("b")))
    counts = d.groupBy("source", "blk").agg(F.count("*").alias("n"))
    before = counts.select("source", "blk", (F.sum("n").over(Window.partitionBy("source").orderBy("blk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "blk").orderBy("tokens", "h", "id")) + F.col("before")
    d = d.join(broadcast_if_small(before), ["source", "blk"]).withColumn("rank", rank)
    upto = lambda r: F.floor(F.round(F.col("offset") + r * F.col("rate"), 9))
    return d.select("id", "source", "tokens", (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, targets: DataFrame, *, seed: int = 17, tokenizer_path: str = TOKENIZER_PATH, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies > 0) and the report of the shares reached.

    The report has one row per source of ``targets``: target and actual share and tokens, the source's size, ``capped`` (its documents, each
    used max_repeats times, hold less than target_share x T, T being the tokens of all listed sources). A null text has size 0; a source without
    documents is reported with 0 tokens; a null share or cap counts as 0; a source listed twice counts once, with the larger values;
    documents of unlisted or null sources stay out; equal documents are sampled as separate rows.
    """
    sized = checkpointed(source_sizes(docs, targets, tokenizer_path=tokenizer_path))
    plan = checkpointed(_plan(sized, targets, seed))
    copies = _copies(sized, plan, seed, block_rows)
    mix = copies.filter("copies > 0").select(F.col("id").alias("doc_id"), "source", "tokens", "copies")
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_docs"), F.max("copies").alias("most_copies"))
    report = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    report = report.select(
        "source", "target_share", "max_repeats", "src_docs", "src_tokens", "total_tokens", "target_tokens", "capped", "rate", "mixed_docs", "most_copies", "mixed_tokens",
        F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0).alias("actual_share"),
    )
    return mix, report
