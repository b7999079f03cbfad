"""Token-ID output in bit- or byte-plane shuffled chunks.

Documents are put in ascending id order, encoded, and their ids (an end id closes each document) written as
segments of whole documents. A segment's ids are cut into blocks of fixed size; each block is transposed into
planes (one bit, or one byte, of every id), every plane is compressed with zstandard, and a chunk index keeps
where each block and plane lies. Segments are rows of a Parquet table in the shared folder: Spark's commit
protocol makes the files whole when executors are lost, and any store can hold them.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import held, new_path, pieces

#: Ids in a block, ids after which a segment is closed, words kept in a worker's cache.
BLOCK, SEGMENT, CACHE = 65_536, 1 << 20, 600_000
#: The id that ends a document.
END_ID = 2
SCHEMA = "shard int, segment int, shard_start long, doc_ids array<long>, lengths array<long>, chunks array<struct<ids:int,offset:long,planes:array<int>>>, payload binary"


# ---- file format

def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of ids below 2^32, the lowest first; planes above the largest id are left out."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        n = max(1, (int(ids.max()).bit_length() + 7) // 8)
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(n)]
    n = max(1, int(ids.max()).bit_length())
    flat = np.unpackbits(raw, axis=1, bitorder="little")[:, :n]
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if not bits:
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        flat = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
        raw = np.packbits(flat, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def encode_segment(ids: np.ndarray, bits: bool, block: int = BLOCK) -> tuple[list[dict], bytes]:
    import zstandard

    z, chunks, parts, at = zstandard.ZstdCompressor(level=1), [], [], 0
    for k in range(0, len(ids), block):
        part = ids[k : k + block]
        planes = [z.compress(p) for p in to_planes(part, bits)]
        chunks.append({"ids": len(part), "offset": at, "planes": [len(p) for p in planes]})
        parts += planes
        at += sum(map(len, planes))
    return chunks, b"".join(parts)


def decode_segment(chunks: list[dict], payload: bytes, bits: bool) -> np.ndarray:
    import zstandard

    z, out = zstandard.ZstdDecompressor(), []
    for c in chunks:
        at, planes = c["offset"], []
        for n in c["planes"]:
            planes.append(z.decompress(payload[at : at + n]))
            at += n
        out.append(from_planes(planes, c["ids"], bits))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# ---- encoding

#: A pre-tokenizer pattern whose matches hold no white space, and of letters, one digit or other signs each (fixed value).
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def wordwise(config: dict) -> bool:
    """Whether a tokenizer gives a text the ids of its words in turn, and lower-cases: judged by its own parts."""
    norm, pre, model = (config.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    norms = norm.get("normalizers", [])
    splits = pre.get("pretokenizers", [])
    return (
        [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1]["pattern"] == {"Regex": r"\s+"} and norms[1]["content"] == " "
        and len(splits) == 2 and splits[0]["type"] == "Split" and splits[0]["pattern"] == {"Regex": WORDWISE} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and splits[1]["type"] == "ByteLevel" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and not config.get("post_processor") and not config.get("truncation") and not config.get("padding") and not model.get("dropout")
        and all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in config.get("added_tokens", []))
    )


class WordEncoder:
    """Whole texts through a tokenizer of the tokenizers library.

    Where the tokenizer works word by word (see wordwise), each distinct word goes to the library once while the
    cache has room, words being divided at ASCII white space and ASCII letters lower-cased first, as the tokenizer
    does. With any other tokenizer the library gets the whole texts.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.by_word = wordwise(json.loads(self.tokenizer.to_str()))
        zero = self._plain(["0"])[0]
        #: A digit is a token of its own, so between words without it its id shows where they end.
        self.zero = zero[0] if len(zero) == 1 and self._plain(["a 0 b 0 c"])[0].count(zero[0]) == 2 else None
        self.tails = {t: array("I", self._plain([t])[0]).tobytes() for t in (".", ",")}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.batch(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """New words; those without 0 go to the library in one text, with 0 between them."""
        out: dict[bytes, bytes] = {}
        joined = [w for w in words if b"0" not in w and b"<|" not in w] if self.zero is not None else []
        for k in range(0, len(joined), 4096):
            part = joined[k : k + 4096]
            ids = np.array(self._plain([" 0 ".join(w.decode() for w in part) + " 0"])[0], "<u4")
            ends = np.flatnonzero(ids == self.zero)
            if len(ends) != len(part):
                continue  # some word made the same id: those go one by one below
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, (ends * 4).tolist(), strict=True):
                out[w] = raw[at:e]
                at = e + 4
        rest = [w for w in words if w not in out]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for w, ids in zip(part, self._plain([w.decode() for w in part]), strict=True):
                out[w] = array("I", ids).tobytes()
        return out

    def _missing(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A word that ends in one . or , after a letter is its stem and that mark."""
        stems, tailed = set(), []
        for w in words:
            if len(w) > 1 and w[-1] in b".," and w[-2:-1].isalpha() and b"<|" not in w:
                tailed.append(w)
                if w[:-1] not in self.cache:
                    stems.add(w[:-1])
            elif w not in self.cache:
                stems.add(w)
        new = self._encode(sorted(stems))
        get = lambda s: new[s] if s in new else self.cache[s]
        for w in tailed:
            new[w] = get(w[:-1]) + self.tails[chr(w[-1])]
        return new

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not self.by_word:
            return [array("I", ids).tobytes() for ids in self._plain([t or "" for t in texts])]
        words, ends = [], []
        for t in texts:
            raw = (t or "").encode()
            words += (raw.lower() if b"<|" not in raw else raw).split()
            ends.append(len(words))
        found = list(map(self.cache.get, words))
        none = [i for i, v in enumerate(found) if v is None]
        if none:
            new = self._missing({words[i] for i in none})
            for i in none:
                found[i] = new[words[i]]
            self.cache.update((w, ids) for w, ids in islice(new.items(), max(0, CACHE - len(self.cache))) if len(w) <= 64)
        out, at = [], 0
        for e in ends:
            out.append(b"".join(found[at:e]))
            at = e
        return out


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int, bits: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, segment, start = TaskContext.get().partitionId(), 0, 0
    encode, stop = held(path, lambda: WordEncoder(path)), int(end).to_bytes(4, "little")
    docs, parts, size = [], [], 0
    schema = pa.schema([
        ("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("chunks", pa.list_(pa.struct([("ids", pa.int32()), ("offset", pa.int64()), ("planes", pa.list_(pa.int32()))]))), ("payload", pa.binary()),
    ])

    def close() -> pa.RecordBatch:
        chunks, payload = encode_segment(np.frombuffer(b"".join(parts), "<u4"), bits)
        row = {"shard": shard, "segment": segment, "shard_start": start, "doc_ids": docs, "lengths": [len(p) // 4 for p in parts], "chunks": chunks, "payload": payload}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for b in pieces(batches, 1, 1 << 20):
        for i, raw in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
            docs.append(i)
            parts.append(raw + stop)
            size += len(parts[-1]) // 4
            if size >= SEGMENT:
                yield close()
                segment, start, docs, parts, size = segment + 1, start + size, [], [], 0
    if docs:
        yield close()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, doc: str = "doc_id", text: str = "text", end: int = END_ID, bits: bool = False) -> None:
    """Writes docs to the folder `out` in ascending id order; null ids come first, null texts are empty.

    Rows that share an id stay side by side in the order of a hash of their text, each with its own entry. A text
    of any length stays whole in its segment. An empty table writes no segment.
    """
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "d").sortWithinPartitions("d", F.xxhash64("t"))
    ordered.mapInArrow(lambda it: _segments(it, tokenizer, end, bits), SCHEMA).write.option("compression", "none").parquet(out)


# ---- reading back

def _read(batches: Iterator[pa.RecordBatch], bits: bool) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 6, most_rows=1):
        for row in b.to_pylist():
            raw = decode_segment(row["chunks"], row["payload"], bits).tobytes()
            ids, starts, lengths, sums, at = [], [], [], [], 0
            for d, n in zip(row["doc_ids"], row["lengths"], strict=True):
                ids.append(d)
                starts.append(row["base"] + row["shard_start"] + at // 4)
                lengths.append(n)
                sums.append(zlib.crc32(memoryview(raw)[at : at + 4 * n]))
                at += 4 * n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, out: str, bits: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files' payload."""
    table = spark.read.schema(SCHEMA).parquet(out)
    shards = table.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return table.join(F.broadcast(base), "shard").mapInArrow(lambda it: _read(it, bits), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = new_path(spark, "tokens")
    write_tokens(docs, out, tokenizer_path())
    return read_tokens(spark, out)
