"""Token counts: each distinct pre-token is tokenized once, and documents sum over their pre-tokens."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, shuffle_width, text_or_empty

_BYTES_A_BATCH = 32 << 20
_BUCKETS_A_PARTITION, _MOST_BUCKETS = 8, 4096  # of pre-tokens; a batch has a row for each bucket, so their number doesn't grow with the cluster
# Fixed value: how a byte-level pre-tokenizer with its own pattern cuts a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str):
    """The tokenizers library's tokenizer for a vocabulary file, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splitter(whole) -> Callable[[str], list[str]]:
    """How a tokenizer cuts a text into pre-tokens, so that the tokens of the text are those of the parts one after the other.

    The strings of its added tokens, which it looks for first, are parts of
    their own. Tokenizers that normalize texts first, or whose added tokens
    take white space with them, are not supported.
    """
    plan = json.loads(whole.to_str())
    if plan["normalizer"] is not None or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in plan["added_tokens"]):
        raise ValueError("a tokenizer without normalizer, whose added tokens stand for themselves, is needed")
    kind = plan["pre_tokenizer"] or {}
    if kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]:
        cut = regex.compile(BYTE_LEVEL).findall
    else:
        cut = lambda text: [text[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(text)]
    special = [x["content"] for x in plan["added_tokens"]]
    if not special:
        return cut
    around = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def parts(text: str) -> list[str]:
        if not any(x in text for x in special):
            return cut(text)
        return [y for k, x in enumerate(around.split(text)) for y in ([x] if k % 2 else cut(x))]

    return parts


#: Of each batch of documents: a row for each bucket of pre-tokens (in how many documents each of
#: `words` stands, and in which of them how often), and in a bucket below zero a row with the documents' ids and sizes in bytes.
_SENT = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("word", pa.binary()), ("doc", pa.binary()), ("times", pa.binary())])
_SENT_DDL = "batch string, bucket int, words array<string>, ids array<long>, word binary, doc binary, times binary"


def _bucket(word: str, width: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % width


def _frequencies(path: str, width: int):
    def rows(ids: list, texts: list[str], batch: str, pretokens) -> Iterator[dict]:
        words: dict[str, int] = {}
        found = []
        for text in texts:
            parts = pretokens(text)
            found.append(np.fromiter((words.setdefault(x, len(words)) for x in parts), np.int64, len(parts)))
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        pairs, times = np.unique(np.concatenate(found) * len(texts) + owner, return_counts=True)
        sizes = np.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], "<i8")
        yield {"batch": batch, "bucket": -1 - _bucket(batch, width), "words": [], "ids": ids, "word": b"", "doc": b"", "times": sizes.tobytes()}
        listed, bucket = list(words), np.fromiter((_bucket(x, width) for x in words), np.int64, len(words))
        by_bucket = np.argsort(bucket, kind="stable")  # the words of a bucket stand together
        first = np.searchsorted(bucket[by_bucket], np.arange(width + 1))
        place = np.empty(len(words), np.int64)
        place[by_bucket] = np.arange(len(words))
        word = place[pairs // len(texts)]
        order = np.argsort(word, kind="stable")
        word, doc, times = word[order], (pairs % len(texts))[order].astype("<u4"), times[order].astype("<u4")
        documents = np.bincount(word, minlength=len(words)).astype("<u4")  # of each word
        cuts = np.searchsorted(word, first)
        for k in np.flatnonzero(np.diff(first)):
            part = slice(cuts[k], cuts[k + 1])
            own = [listed[i] for i in by_bucket[first[k] : first[k + 1]]]
            yield {"batch": batch, "bucket": int(k), "words": own, "ids": [], "word": documents[first[k] : first[k + 1]].tobytes(), "doc": doc[part].tobytes(), "times": times[part].tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, pretokens = TaskContext.get().partitionId(), 0, 0, splitter(tokenizer(path))
        ids: list = []
        texts: list[str] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= _BYTES_A_BATCH:
                    yield from _batched(rows(ids, texts, f"{task}-{number}", pretokens), _SENT)
                    ids, texts, size, number = [], [], 0, number + 1
        if texts:
            yield from _batched(rows(ids, texts, f"{task}-{number}", pretokens), _SENT)

    return run


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_pylist(part, schema)


_PART = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("values", pa.binary())])


def _counted(path: str, cached: int = 1_000_000, characters: int = 64 << 20):
    """In the task that has all of a bucket: tokenizes each distinct pre-token once (again only if more
    than `cached`, or than so many characters of them, are there) and sums per document of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch
        known: dict[str, int] = {}
        held = 0

        def sums_of(row: dict) -> dict:
            nonlocal known, held
            if row["bucket"] < 0:
                return {"batch": row["batch"], "bucket": -1, "ids": row["ids"], "values": row["times"]}
            new = [x for x in row["words"] if x not in known]
            held += sum(map(len, new))
            if len(known) + len(new) > cached or held > characters:
                known, new = {}, row["words"]
                held = sum(map(len, new))
            for at in range(0, len(new), 4096):
                known.update(zip(new[at : at + 4096], (len(x.ids) for x in encode(new[at : at + 4096], add_special_tokens=False))))
            pieces = np.array([known[x] for x in row["words"]], np.int64)
            weights = np.repeat(pieces, np.frombuffer(row["word"], "<u4")) * np.frombuffer(row["times"], "<u4")
            doc = np.frombuffer(row["doc"], "<u4")
            sums = np.bincount(doc, weights).astype("<i8")
            return {"batch": row["batch"], "bucket": row["bucket"], "ids": [], "values": sums.tobytes()}

        for batch in batches:
            for at in range(0, len(batch), 64):
                yield pa.RecordBatch.from_pylist([sums_of(row) for row in batch.slice(at, 64).to_pylist()], _PART)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the task that has all buckets of a batch of documents: adds them up as they come."""
    heads: dict[str, dict] = {}
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                heads[row["batch"]] = row
                continue
            values = np.frombuffer(row["values"], "<i8")
            held = sums.get(row["batch"])
            if held is None or len(held) < len(values):
                held = np.concatenate([np.zeros(0, np.int64) if held is None else held, np.zeros(len(values) - (0 if held is None else len(held)), np.int64)])
            held[: len(values)] += values
            sums[row["batch"]] = held
    for name, head in heads.items():
        total = np.zeros(len(head["ids"]), np.int64)
        if name in sums:  # else all texts of the batch are empty
            total[: len(sums[name])] += sums[name]
        yield pa.RecordBatch.from_arrays([pa.array(head["ids"], pa.int64()), pa.array(np.frombuffer(head["values"], "<i8")), pa.array(total)], names=["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of each whole text: id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit`).

    1. Each batch of documents (32 MB of text) is cut into the tokenizer's own
       pre-tokens, and their frequencies by document go out by bucket of the
       pre-token; the documents' ids and sizes go by batch.
    2. The task that has a bucket tokenizes each distinct pre-token once, joins
       that to the frequencies and sums by document of the batch. A very common
       pre-token has one entry a batch, so no bucket is hot.
    3. The sums of a batch's buckets are added up.

    Of texts only distinct pre-tokens go through a shuffle, and no ids of tokens.
    Special tokens' strings in a text count as the library counts them by default.

    Null or empty texts have 0 bytes and 0 tokens; null ids stay null; repeated
    rows have a row each; an empty table gives an empty result; other columns
    are not read.
    """
    width = shuffle_width(docs.sparkSession)
    buckets = min(_BUCKETS_A_PARTITION * width, _MOST_BUCKETS)  # several a partition, so that none is empty and none has much more than others
    sent = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(docs, text_column).alias("text")).mapInArrow(frugal(_frequencies(path, buckets)), _SENT_DDL)
    part = sent.repartition(width, "bucket").mapInArrow(frugal(_counted(path)), "batch string, bucket int, ids array<long>, values binary")
    total = part.repartition(width, "batch").mapInArrow(_totals, "id long, n_bytes long, n_tokens long")
    return total.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
