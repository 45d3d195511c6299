"""Token-id files: canonical length-limited Huffman codes, in blocks that decode on their own.

A file set is a Parquet table `blocks`, one row per block of about BLOCK ids of whole documents in ascending id order
(of one partition of the writer; its files hold the blocks in ascending order of row, too),
and a Parquet table `code` with the length of each id's code (package-merge over the global counts, at most LIMIT
bits; canonical codes follow from the lengths). A block's payload holds its documents' ids and token counts, the bit
offset of every STRIDE-th token, and the bits. Decoding walks all stretches between checkpoints at once, one table
look-up a token.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read, written
from .tokens import token_ids

LIMIT = 18
BLOCK, STRIDE = 1 << 18, 256
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with at most `limit` bits (package-merge); 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    coins = []  # per level from the deepest: which of the sorted coins are single ids
    level = weights
    for _ in range(limit):
        coins.append(level)
        paired = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        level = np.sort(np.concatenate((weights, paired)), kind="stable")
    take = 2 * len(used) - 2
    own = np.zeros(len(used), np.uint8)
    for k in range(limit - 1, -1, -1):
        pairs = coins[k - 1][: len(coins[k - 1]) // 2 * 2].reshape(-1, 2).sum(axis=1) if k else np.empty(0, np.int64)
        single = np.argsort(np.concatenate((weights, pairs)), kind="stable")[:take] < len(weights)
        own[: int(single.sum())] += 1
        take = 2 * int((~single).sum())
    lengths[used] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - last
        codes[i], code, last = code, code + 1, int(lengths[i])
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every `limit` bits: the id whose code they start with, and its length in the low 5 bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    table = np.repeat(order.astype(np.int64) << 5 | lengths[order], spans)
    return np.concatenate((table, np.zeros((1 << limit) - len(table), np.int64)))


def encode_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    word = codes[ids].astype(np.int64) << (32 - size - (at & 7))
    n = bits // 8 + 5
    body = np.zeros(n)
    for k in range(4):
        body += np.bincount((at >> 3) + k, weights=(word >> (24 - 8 * k)) & 255, minlength=n)[:n]
    return struct.pack("<4sIIQ", b"LHB2", len(doc_ids), len(ids), bits) + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + at[::STRIDE].astype("<u8").tobytes() + body.astype(np.uint8).tobytes()


def decode_block(payload: bytes, table: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, their token counts, all token ids)."""
    magic, n_docs, n_ids, _ = struct.unpack_from("<4sIIQ", payload)
    if magic != b"LHB2":
        raise ValueError("not a block")
    at = struct.calcsize("<4sIIQ")
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    counts = np.frombuffer(payload, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    lanes = -(-n_ids // STRIDE)
    place = np.frombuffer(payload, "<u8", lanes, at).astype(np.int64)
    raw = np.concatenate((np.frombuffer(payload, np.uint8, -1, at + 8 * lanes), np.zeros(8, np.uint8))).astype(np.int64)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.zeros((STRIDE, lanes), np.int64)
    last = n_ids - (lanes - 1) * STRIDE
    for k in range(STRIDE):
        if k == last:  # the last lane is shorter
            place = place[:-1]
            if not len(place):
                break
        found = table[(words[place >> 3] >> (32 - limit - (place & 7))) & ((1 << limit) - 1)]
        out[k, : len(place)] = found >> 5
        place = place + (found & 31)
    return doc_ids, counts, out.T.reshape(-1)[:n_ids]


def write(tokens: DataFrame, path: str, vocabulary: int, limit: int = LIMIT) -> None:
    """Write `tokens` (row, doc_id, ids: binary of 2-byte ids), stored in ascending order of row, as a file set."""

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for part in parts:
            total += np.bincount(np.frombuffer(b"".join(part["ids"]), "<u2"), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    counts = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInPandas(tally, "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # a row per id of the vocabulary at most
        counts[r[0]] = r[1]
    lengths = code_lengths(counts, limit)
    codes = canonical(lengths)
    spark = tokens.sparkSession
    spark.createDataFrame([(limit, lengths.tobytes())], "bits int, lengths binary").coalesce(1).write.parquet(f"{path}/code")

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, ids, held, first = [], [], 0, 0

        def block() -> pd.DataFrame:
            whole = np.frombuffer(b"".join(ids), "<u2")
            payload = encode_block(np.array([d for d, _ in rows], np.int64), np.array([n for _, n in rows], np.int64), whole, codes, lengths)
            return pd.DataFrame({"row": [first], "n_ids": [len(whole)], "payload": [payload]})

        for part in parts:
            null = part["doc_id"].isna()
            for row, doc, raw in zip(part["row"], part["doc_id"].astype("Int64").where(~null, NULL_ID), part["ids"], strict=True):
                if rows and int(row) >> 33 != first >> 33:  # one task may read several stored partitions, in any order
                    yield block()
                    rows, ids, held = [], [], 0
                first = first if rows else int(row)
                rows.append((int(doc), len(raw) // 2))
                ids.append(raw)
                held += len(raw) // 2
                if held >= BLOCK:
                    yield block()
                    rows, ids, held = [], [], 0
        if rows:
            yield block()

    blocks = tokens.select("row", "doc_id", "ids").mapInPandas(encode, "row long, n_ids long, payload binary")
    parts = (tokens.agg(F.max("row")).first()[0] or 0) >> 33
    blocks.repartitionById(parts + 1, F.shiftright("row", 33).cast("int")).sortWithinPartitions("row").write.parquet(f"{path}/blocks")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: doc_id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit).

    Block starts go by partition of the writer, then by block: neither step holds more than a partition's blocks.
    """
    bits, raw = spark.read.parquet(f"{path}/code").first()
    table = decode_table(np.frombuffer(raw, np.uint8), bits)
    blocks = spark.read.parquet(f"{path}/blocks")
    index = blocks.select("row", "n_ids", F.shiftright("row", 33).alias("part"))
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", upto(Window.orderBy("part")).alias("base"))
    starts = index.withColumn("inner", upto(Window.partitionBy("part").orderBy("row"))).join(parts, "part").select(F.col("row").alias("r"), (F.col("base") + F.col("inner")).alias("start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, payload in zip(batch["start"], batch["payload"], strict=True):
                docs, counts, ids = decode_block(payload, table, bits)
                ends = np.cumsum(counts.astype(np.int64))
                flat = ids.astype("<u4").tobytes()
                begins = ends - counts
                yield pd.DataFrame({"doc_id": pd.Series(docs).astype("Int64").where(docs != NULL_ID), "start": start + begins, "ids": [flat[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]})

    met = blocks.select("row", "payload").join(starts, F.col("row") == F.col("r")).select("start", "payload")
    return met.mapInPandas(decode, "doc_id long, start long, ids binary")


def write_documents(docs: DataFrame, tokenizer_path: str, vocabulary: int, path: str, end: int = 1, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Tokenise whole texts (null: empty) and write them, each with id `end` after it, in ascending id order (null ids first).

    Whole rows are range-partitioned once by (id, hash of the text): ids that repeat, however often, spread out unless
    their texts are equal too. An empty table gives an empty file set.
    """
    if vocabulary > 1 << 16:
        raise ValueError("ids of two bytes only")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    tie = F.xxhash64("text")
    ordered = own.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    tokens = written(ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", token_ids(F.col("text"), tokenizer_path, end, 2).alias("ids")), "tokens")
    write(tokens, path, vocabulary)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Contract query: write all documents as token-id files and read them back."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49408, path)
    back = read_back(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
