"""Token counts with a digest cache.

The cache is a Parquet folder per tokenizer version with one count per content digest. A run joins the digests of its texts
to the stored counts, encodes each distinct text that misses once, and appends those counts. A tokenizer version is the
digest of its file and of the library that reads it, so another file never meets old counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.llm.words import slices
from fieldpulse.session import cut_lineage, scratch

LIMIT = 4096
_CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str, content: bytes) -> str:
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    return hashlib.sha256(f"{library} {version(library)}\n".encode() + content).hexdigest()[:24]


def load(path: str, content: bytes):
    """A function from a list of texts to their token counts."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor
    pieces = SentencePieceProcessor(model_proto=content)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def _encode(path: str, content: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(path, content)
        for whole in batches:
            for batch in slices(whole, "body", 1 << 20):
                n = count(batch.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())],
                                                 names=["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """One count per digest; empty before the first run."""
    try:
        return spark.read.schema(_CACHE).parquet(folder).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit.

    Null is normalised to the empty text, which has no tokens; nothing else is changed before counting, since blanks and case
    change counts. ``tokenizer`` is the path of a .json or .model file on the driver. ``cache`` is a folder that all executors
    share and that outlives the session; without one a new folder is used. Repeated rows come back as often; a null key is
    returned as it is; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        content = file.read()
    folder = f"{(cache or scratch(spark, 'token-counts')).rstrip('/')}/{tokenizer_version(tokenizer, content)}"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(body, 256)).alias("digest"), F.col(key).alias("id"), body.alias("body"))
    misses = rows.groupBy("digest").agg(F.min("id").alias("one")).join(
        read_cache(spark, folder).select("digest"), "digest", "left_anti").select(F.col("digest").alias("d"), "one")
    texts = rows.join(misses, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("one"))).select("digest", "body")
    texts.mapInArrow(_encode(tokenizer, content), _CACHE).write.mode("append").parquet(folder)
    stored = cut_lineage(read_cache(spark, folder))  # a written table, so that the join on large groups can be split
    counted = rows.select("digest", "id", F.octet_length("body").cast("long").alias("n_bytes")).join(stored, "digest")
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
