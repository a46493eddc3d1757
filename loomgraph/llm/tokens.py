"""Encoding of a whole corpus with a public tokenizer through one global shuffle of distinct words.

Each text is cut into pre-tokens. A batch of texts keeps the sequence of its pre-tokens as numbers into the batch's
own dictionary (the positions), and only dictionaries are shuffled by word: a word that fills the corpus arrives once
a batch, not once an occurrence. Every distinct word is encoded once, its ids are joined back to the dictionaries, and
the texts of a batch are put together by position. Decoding joins ids with the table of token bytes.

Null and empty texts have no pre-tokens and an empty list of ids. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.plans.skew import spread_join
from loomgraph.plans.staging import staged

#: Where the vocabulary files of the public tokenizers are.
TOKENIZER_DIR = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Vocabulary of the queries.
VOCABULARY = "byte_bpe_50k"
# Fixed value: the pre-token pattern published with the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts and characters of a batch: it ends at whichever comes first, after a whole text.
BATCH_TEXTS, BATCH_CHARS = 2000, 1_000_000

_PARTS = "batch long, kind int, doc_id long, codes array<int>, word binary"


def rank_file(vocabulary: str = VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> bytes:
    """A vocabulary's rank file, under a megabyte; the driver reads it and sends it with the tasks."""
    with open(f"{tokenizer_dir}/{vocabulary}.tiktoken", "rb") as file:
        return file.read()


def ranks(file: bytes) -> dict[bytes, int]:
    """Token bytes and their ids, of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line.strip())}


def _cutter():
    """Kernel: (doc_id, text) to a row per text (kind 1: codes) and per word of the batch's dictionary (kind 0)."""

    def flush(batch: int, docs: list[int], codes: list[list[int]], words: dict[str, int]) -> pa.RecordBatch:
        w, d = len(words), len(docs)
        return pa.record_batch(
            [
                pa.array([batch] * (w + d), pa.int64()), pa.array([0] * w + [1] * d, pa.int32()), pa.array(list(range(w)) + docs, pa.int64()),
                pa.array([None] * w + codes, pa.list_(pa.int32())), pa.array([x.encode() for x in words] + [None] * d, pa.binary()),
            ],
            ["batch", "kind", "doc_id", "codes", "word"],
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        cut = regex.compile(PATTERN).findall
        number, docs, codes, words, chars = TaskContext.get().partitionId() << 32, [], [], {}, 0
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                text = text.as_py() or ""
                codes.append([words.setdefault(w, len(words)) for w in cut(text)])
                docs.append(doc)
                chars += len(text)
                if len(docs) >= BATCH_TEXTS or chars >= BATCH_CHARS:
                    yield flush(number, docs, codes, words)
                    number, docs, codes, words, chars = number + 1, [], [], {}, 0
        if docs:
            yield flush(number, docs, codes, words)

    return kernel


def _encoder(file: bytes):
    """Kernel: words to (word, ids)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = None
        for rows in batches:
            coder = coder or tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(file), special_tokens={})
            ids = coder.encode_ordinary_batch([w.decode() for w in rows.column(0).to_pylist()], num_threads=1)
            yield pa.record_batch([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return kernel


def _joiner(count_only: bool):
    """Kernel over rows sorted by (batch, kind): dictionaries first, then texts, as ids or as their number."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, table = None, {}
        for rows in batches:
            docs, out = [], []
            for batch, kind, doc, codes, ids in zip(*(c.to_pylist() for c in rows.columns)):
                if batch != here:
                    here, table = batch, {}
                if kind == 0:
                    table[doc] = len(ids) if count_only else ids
                    continue
                docs.append(doc)
                out.append(sum(map(table.__getitem__, codes)) if count_only else [i for c in codes for i in table[c]])
            if docs:
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(out, pa.int64() if count_only else pa.list_(pa.int32()))], ["doc_id", "n_tokens" if count_only else "ids"])

    return kernel


def encoded(texts: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR, count_only: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, or (doc_id, n_tokens): one row out for each row in, whatever its id."""
    parts = staged(texts.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cutter(), _PARTS), "parts")
    dictionary = parts.where("kind = 0").select("batch", F.col("doc_id").alias("code"), "word")
    coded = dictionary.select("word").distinct().mapInArrow(_encoder(rank_file(vocabulary, tokenizer_dir)), "word binary, ids array<int>")
    back = spread_join(dictionary, coded, "word", "inner", dictionary.count())
    both = back.select("batch", F.lit(0).alias("kind"), F.col("code").alias("doc_id"), F.lit(None).cast("array<int>").alias("codes"), "ids").unionByName(
        parts.where("kind = 1").select("batch", "kind", "doc_id", "codes", F.lit(None).cast("array<int>").alias("ids"))
    )
    ordered = both.repartition("batch").sortWithinPartitions("batch", "kind")
    return ordered.mapInArrow(_joiner(count_only), "doc_id long, n_tokens long" if count_only else "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(token, bytes in hexadecimal digits): the vocabulary, some 50,000 rows."""
    return spark.createDataFrame([(i, b.hex()) for b, i in ranks(rank_file(vocabulary, tokenizer_dir)).items()], "token int, bytes string")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): ids joined with the table of token bytes, put together by position.

    doc_id must be unique. An empty list gives an empty text; bytes that are no UTF-8 give the replacement character.
    """
    table = token_bytes(ids.sparkSession, vocabulary, tokenizer_dir)
    placed = ids.select("doc_id", F.posexplode("ids").alias("at", "token")).join(F.broadcast(table), "token")  # a vocabulary's size is fixed
    joined = placed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bytes"))), lambda x: x["bytes"]), "").alias("hexa"))
    return ids.select("doc_id").join(joined, "doc_id", "left").select("doc_id", F.decode(F.unhex(F.coalesce("hexa", F.lit(""))), "UTF-8").alias("text"))
