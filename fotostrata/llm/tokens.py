"""Encoding a corpus with a public byte-level BPE tokenizer, each distinct word once.

Pre-tokens are exploded and the distinct ones, counted with map-side combining,
encoded once each. The most frequent, a table of bounded size, are joined by
broadcast: a document's ids come out in order where its text lies, without being
shuffled, and with a note of each place where a rarer pre-token stands. Those
are exploded with their positions, joined to their ids in a shuffle, and put in
at their places. Decoding joins the token-byte table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotostrata.operators.lookup import skewed_lookup
from fotostrata.session import materialise

#: Folder of the vocabulary files; a parameter everywhere.
TOKENIZERS = os.environ.get("FOTOSTRATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's own pattern; (?U) gives \s its Unicode meaning in Java.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The broadcast table: so many of the most frequent words, while they and their ids take at most so many bytes; longer words are joined in the shuffle.
HOT_WORDS, HOT_BYTES, HOT_CHARS = 50_000, 8_000_000, 1_024

_encoders: dict[str, object] = {}


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder(path: str):
    """The tokenizer of a rank file, made once in each Python worker."""
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=_ranks(path), special_tokens={})
    return _encoders[path]


def pre_tokens(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PRE_TOKEN), F.lit(0))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids): each row's word encoded as one pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc._encode_single_piece(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def look_up(words: pa.ListArray, hot: pa.Array, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Ids of lists of words by a table: word k of ``hot`` has ids[starts[k] : starts[k + 1]].

    Returns the ids of all lists and where each list's begin; and, for the words
    not in the table, where each list's begin, the words, and how many ids of
    their list stand before them.
    """
    offsets = words.offsets.to_numpy()
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    at = pc.index_in(flat, value_set=hot)
    missing = at.is_null().to_numpy(zero_copy_only=False)
    at = at.fill_null(0).to_numpy()
    sizes = np.where(missing, 0, (starts[1:] - starts[:-1])[at]) if len(hot) else np.zeros(len(at), np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    got = ids[np.repeat(starts[at] - before[:-1], sizes) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.int32)
    rare = np.flatnonzero(missing)
    rare_offsets = np.searchsorted(rare, offsets)
    own_start = before[offsets[:-1]].repeat(np.diff(rare_offsets))
    return got, before[offsets], rare_offsets, flat.take(pa.array(rare)), before[rare] - own_start


def _pieces(docs: DataFrame, key: str, text: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc, ids, rare) of every document with a text, and (word, ids, n) of the rarer words; rare lists them with the number of ids before them."""
    spark = docs.sparkSession
    listed = docs.where(F.col(text) != "").select(F.col(key).alias("doc"), pre_tokens(F.col(text)).alias("words"))
    # exploded without a name in between, for which a filter would be inferred that splits the text twice more
    # written once: the counts feed both tables below, and a lost executor must not cost the shuffle again
    words = materialise(docs.select(F.explode(pre_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    first = words.where(F.length("word") <= HOT_CHARS).orderBy(F.desc("n"), "word").limit(HOT_WORDS)
    table = encode_words(first, path).toArrow().combine_chunks()  # bounded by HOT_WORDS and HOT_CHARS
    room = pc.add(pc.binary_length(table["word"]), pc.multiply(pc.list_value_length(table["ids"]), 4)).to_numpy()
    table = table.slice(0, int(np.searchsorted(np.cumsum(room), HOT_BYTES, side="right"))).combine_chunks()
    hot = table["word"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    lists = table["ids"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))]) if len(lists) else np.zeros(1, np.int64)
    shared = spark.sparkContext.broadcast((hot, starts, lists.flatten().to_numpy()))
    hot_words = spark.createDataFrame(pa.table({"word": hot}))
    rest = words.join(F.broadcast(hot_words), "word", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got, begins, rare_begins, rare, before = look_up(batch.column(1), *shared.value)
            notes = pa.StructArray.from_arrays([pa.array(before.astype(np.int32)), rare], names=["at", "word"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(got, pa.int32())), pa.ListArray.from_arrays(pa.array(rare_begins.astype(np.int32)), notes)],
                names=["doc", "ids", "rare"],
            )

    pieces = listed.mapInArrow(run, "doc long, ids array<int>, rare array<struct<at:int,word:string>>")
    return pieces, encode_counted(rest, path)


def encode_counted(words: DataFrame, path: str) -> DataFrame:
    """(word, ids, n) of words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc._encode_single_piece(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], names=["word", "ids", "n"])

    return words.select("word", "n").mapInArrow(run, "word string, ids array<int>, n long")


def _put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, ids) of (doc, ids, more): each list of ``more`` (at, nth, ids) goes in before the id number ``at``."""
    for batch in batches:
        out = []
        for ids, more in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            more.sort(key=lambda m: m["nth"])
            at = np.repeat([m["at"] for m in more], [len(m["ids"]) for m in more])
            out.append(np.insert(ids.values.to_numpy(), at.astype(np.int64), np.concatenate([m["ids"] for m in more]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc", "ids"])


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each document, without special tokens.

    A null or empty text gives the empty list. One row per row of ``docs`` with a
    non-null id; ids must be unique (a repeated id would mix its texts). Columns
    besides ``key`` and ``text`` are ignored, an empty table gives no rows.
    """
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).where(F.col(key).isNotNull())
    pieces, rest = _pieces(docs, key, text, path)
    pieces = materialise(pieces, "pieces")
    gaps = pieces.where(F.size("rare") > 0)
    rare = gaps.select("doc", F.posexplode("rare").alias("nth", "r")).select("doc", "nth", "r.at", "r.word")
    found = skewed_lookup(rare, rest, ["word"], "n").groupBy("doc").agg(F.collect_list(F.struct("at", "nth", "ids")).alias("more"))
    whole = gaps.select("doc", "ids").join(found, "doc").mapInArrow(_put_in, "doc long, ids array<int>").unionByName(pieces.where(F.size("rare") == 0).select("doc", "ids"))
    bare = docs.where(F.col(text).isNull() | (F.col(text) == "")).select(key, F.array().cast("array<int>").alias("ids"))
    return whole.select(F.col("doc").alias(key), "ids").unionByName(bare)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): how many tokens each document has; 0 for a null or empty text."""
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).where(F.col(key).isNotNull())
    pieces, rest = _pieces(docs, key, text, path)
    pieces = materialise(pieces.select("doc", F.size("ids").cast("long").alias("n"), F.col("rare.word").alias("rare")), "pieces")
    rare = pieces.where(F.size("rare") > 0).select("doc", F.explode("rare").alias("word"))
    more = skewed_lookup(rare, rest, ["word"], "n").select("doc", F.size("ids").cast("long").alias("n"))
    sized = pieces.select("doc", "n").unionByName(more).groupBy("doc").agg(F.sum("n").alias("n_tokens"))
    bare = docs.where(F.col(text).isNull() | (F.col(text) == "")).select(key, F.lit(0).cast("long").alias("n_tokens"))
    return sized.withColumnRenamed("doc", key).unionByName(bare)


def token_bytes(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(id, bytes) of the vocabulary; its size is that of the tokenizer, whatever the corpus."""
    ranks = _ranks(vocabulary or os.path.join(TOKENIZERS, VOCABULARY))
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of token ids, by joining the token-byte table.

    An empty or null list gives the empty text; ids outside the vocabulary fail
    the query rather than vanish; bytes that are no UTF-8 become U+FFFD.
    """
    table = token_bytes(encoded.sparkSession, vocabulary)
    parts = encoded.select(F.col(key), F.posexplode(ids).alias("pos", "id")).join(F.broadcast(table), "id", "left")
    known = F.when(F.col("bytes").isNotNull(), F.hex("bytes")).otherwise(F.raise_error(F.lit("token id outside the vocabulary")))
    text = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", known.alias("hex")))).alias("p"))
    whole = text.select(key, F.make_valid_utf8(F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "")).cast("string")).alias("text"))
    return whole.unionByName(encoded.where(F.coalesce(F.size(ids), F.lit(0)) <= 0).select(key, F.lit("").alias("text")))
