"""Token ids in a content-addressed store.

Layout of a store folder, all Parquet so that any file system Spark knows can hold it:
  chunks/    kind=chunk: key (16-byte BLAKE2b of the chunk's ids as little-endian unsigned 32-bit), n, width, data.
             A chunk is stored once, whoever uses it; data holds its ids with `width` bytes each.
  recipes/   in ascending doc_id order: doc_id, place, start, n_tokens, keys (the document's chunks in
             order), crc, root (BLAKE2b of the keys).
  manifest/  level, node, hash: a Merkle tree over the recipes' roots, 1024 children a node; the only node
             of the highest level names the whole corpus.
Chunks are cut where a rolling hash of the last four ids has its top bits zero, so equal stretches of
different documents are cut alike.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, drop_path, mix, new_path, slices, text_of, trimmed, written

#: Any blank of Unicode; two in a row keep a text from being cut at its spaces before encoding.
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_TOKENIZERS: dict[str, _Encoder] = {}
CACHE_WORDS = 150_000  # of each of the two generations of the cache
FAN = 1024
#: The byte-level pre-tokenizer's own pattern, and its characters for the 256 bytes. Fixed values.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
_BYTE_CHARS = [_CHARS[b] for b in range(256)]


class _Encoder:
    """A tokenizer file, with the ids of words met before. Two generations bound the cache and keep frequent words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre = d.get("pre_tokenizer") or {}
        #: Whether texts may be cut into the pre-tokenizer's pieces here and each distinct piece encoded once.
        self.cut = d["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("normalizer") and not d.get("post_processor")
        self.added = [t["content"] for t in d.get("added_tokens", [])]
        self.model = self.whole.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(strings, add_special_tokens=False)]

    def words(self, strings: list[str]) -> list[bytes]:
        """Ids of single pieces of the pre-tokenizer."""
        out = [*map(self.young.get, strings)]
        get, tokenize = self.old.get, self.model.tokenize
        fresh: dict[str, bytes] = {}
        for i, got in enumerate(out):
            if got is None:
                s = strings[i]
                got = get(s) or fresh.get(s)
                if got is None:
                    mapped = s.replace(" ", _BYTE_CHARS[32]) if s.isascii() and s.isprintable() else "".join([_BYTE_CHARS[b] for b in s.encode()])
                    got = array("I", [t.id for t in tokenize(mapped)]).tobytes()
                fresh[s] = out[i] = got
        self.young |= fresh
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        return out


def _encoder(path: str) -> _Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Encoder(path)
    return _TOKENIZERS[path]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges [begin, begin + size), one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _pool(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size, size


def _spaced(encoder: _Encoder, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each name with a space before it. A name starts with a non-blank or is empty, so the pieces of all names in a row are those of each."""
    names = dictionary.to_pylist()
    # Letters only: one piece. The others are cut by the pattern, all at once.
    single = pc.match_substring_regex(dictionary, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False) | pc.equal(dictionary, "").to_numpy(zero_copy_only=False)
    mixed = np.flatnonzero(~single)
    full = [" " + names[i] for i in mixed.tolist()]
    joined = "".join(full)
    if any(x in joined for x in encoder.added):
        return _pool(encoder.texts([" " + x for x in names]))
    plain = np.flatnonzero(single)
    pool, begin, size = _pool(encoder.words([" " + names[i] for i in plain.tolist()]))
    found = pa.array(_PIECES.findall(joined), pa.string()).dictionary_encode()
    pieces = found.dictionary.to_pylist()
    pool2, begin2, size2 = _pool(encoder.words(pieces))
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.fromiter(map(len, pieces), np.int64, len(pieces))
    owner = np.searchsorted(np.cumsum(np.fromiter(map(len, full), np.int64, len(full))), np.cumsum(letters[code]))
    ids = pool2[_spread(begin2[code], size2[code])]
    n = np.bincount(owner, size2[code], len(full)).astype(np.int64)
    begins, sizes = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    begins[plain], sizes[plain] = begin, size
    begins[mixed], sizes[mixed] = len(pool) + np.cumsum(n) - n, n
    return np.concatenate([pool, ids]), begins, sizes


def encode(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts (each followed by end_id) and the number of ids of each.

    The byte-level pre-tokenizer never joins characters across a single space between two non-blank ones,
    so a text without two blanks in a row is cut there and each distinct word is encoded once. Other texts,
    and all texts under another kind of tokenizer, are encoded whole.
    """
    encoder = _encoder(path)
    odd = pc.match_substring_regex(texts, _BLANKS).to_numpy(zero_copy_only=False) | (not encoder.cut)
    lists = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(counts) - counts
    # Words after a space, words at a text's start, the end id, whole odd texts: in one numbering.
    heads = codes[starts[counts > 0]]
    first = {c: len(coded.dictionary) + i for i, c in enumerate(dict.fromkeys(heads.tolist()))}
    pool, begin, size = _spaced(encoder, coded.dictionary)
    more = encoder.texts([coded.dictionary[c].as_py() for c in first]) + [np.array([end_id], "<u4").tobytes()] + encoder.texts(texts.filter(pa.array(odd)).to_pylist())
    pool2, begin2, size2 = _pool(more)
    pool, begin, size = np.concatenate([pool, pool2]), np.concatenate([begin, begin2 + len(pool)]), np.concatenate([size, size2])
    codes = codes.copy()
    codes[starts[counts > 0]] = [first[c] for c in heads.tolist()]
    end = len(coded.dictionary) + len(first)
    total = np.where(odd, 1, counts) + 1
    at = np.concatenate([[0], np.cumsum(total)])
    seq = np.full(int(at[-1]), end, np.int64)
    inner = np.ones(len(seq), bool)
    inner[at[1:] - 1] = False
    owner = np.repeat(np.arange(len(total)), total)
    fill = np.empty(int(inner.sum()), np.int64)
    from_odd = odd[owner[inner]]
    fill[from_odd] = end + 1 + np.arange(int(odd.sum()))
    fill[~from_odd] = codes[np.repeat(~odd, counts)]
    seq[inner] = fill
    n = size[seq]
    return pool[_spread(begin[seq], n)], np.add.reduceat(n, at[:-1]) if len(total) else n


def cuts(ids: np.ndarray, mean_bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one document's ids, by a rolling hash of four ids."""
    if len(ids) <= least:
        return [len(ids)]
    with np.errstate(over="ignore"):
        h = mix(ids.astype(np.uint64) + np.uint64(1))
        roll = h.copy()
        for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), 1):
            roll[k:] += h[:-k] * np.uint64(m)
    out, last = [], 0
    for c in np.flatnonzero(roll >> np.uint64(64 - mean_bits) == 0) + 1:
        while c - last > most:
            last += most
            out.append(last)
        if c - last >= least:
            out.append(int(c))
            last = int(c)
    while len(ids) - last > most:
        last += most
        out.append(last)
    if last < len(ids):
        out.append(len(ids))
    return out


def _key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_ROWS = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("width", pa.int32()), ("keys", pa.list_(pa.binary())), ("data", pa.binary())])
_DDL = "kind string, key binary, doc_id long, n long, crc long, width int, keys array<binary>, data binary"


def _rows(path: str, end_id: int, mean_bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches, most=8 << 20):
            ids, counts = encode(b.column("text"), path, end_id)
            ids = ids.astype("<u4")
            out: dict[str, list] = {f: [] for f in _ROWS.names}
            at = 0
            for doc_id, n in zip(b.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own, keys, last = ids[at:at + n], [], 0
                at += n
                for c in cuts(own, mean_bits, least, most):
                    part = own[last:c]
                    last = c
                    key = _key(part.tobytes())
                    keys.append(key)
                    if key not in seen:  # only saves shuffle; the store drops what other tasks send again
                        if len(seen) < 200_000:
                            seen.add(key)
                        wide = 2 if int(part.max()) < 1 << 16 else 4
                        row = ("chunk", key, None, len(part), None, wide, None, part.astype(f"<u{wide}").tobytes())
                        for f, x in zip(_ROWS.names, row, strict=True):
                            out[f].append(x)
                row = ("recipe", _key(b"".join(keys) + str(doc_id).encode()), doc_id, n, zlib.crc32(own.tobytes()), None, keys, None)
                for f, x in zip(_ROWS.names, row, strict=True):
                    out[f].append(x)
            yield pa.RecordBatch.from_pydict(out, _ROWS)

    return run


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, mean_bits: int = 10, least: int = 256, most: int = 8192) -> str:
    """Encode whole texts and write the store; returns its folder.

    A null text is empty: its document has the end id alone. Rows that share an id follow each other, in
    order of their ids' crc32; a null id comes first. An empty table gives an empty store with a manifest
    of no node. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or new_path(spark, "token-store")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    made = base.mapInArrow(trimmed(_rows(tokenizer_path, end_id, mean_bits, least, most)), _DDL)
    # Equal chunks of different tasks meet here, once a task at most; recipes are spread by their own key.
    first = F.row_number().over(Window.partitionBy("kind", "key").orderBy("doc_id"))
    made = made.withColumn("first", first).where("kind = 'recipe' or first = 1").drop("first")
    staged = f"{path}/chunks"
    made.write.option("compression", "zstd").partitionBy("kind").parquet(staged)
    rows = spark.read.schema(_DDL).parquet(staged)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = rows.where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "crc", "keys")
    ranged = written(recipes.repartitionByRange(n, F.col("doc_id"), F.col("crc")).sortWithinPartitions("doc_id", "crc").withColumn("pid", F.spark_partition_id()), "recipes")
    sums = ranged.groupBy("pid").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = sums.select("pid", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("pid").orderBy("doc_id", "crc", "n_tokens")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(bases), "pid").select(
        "doc_id", (F.col("c0") + F.row_number().over(inside) - 1).alias("place"), (F.col("t0") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("start"),
        "n_tokens", "keys", "crc", F.sha2(F.array_join(F.transform("keys", F.hex), ""), 256).alias("root"))
    placed.repartitionByRange(n, "place").sortWithinPartitions("place").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_path(spark, f"{path}/chunks/kind=recipe")
    write_manifest(spark, path)
    return path


def write_manifest(spark: SparkSession, path: str) -> None:
    merkle(spark.read.parquet(f"{path}/recipes")).write.mode("overwrite").parquet(f"{path}/manifest")


def merkle(recipes: DataFrame) -> DataFrame:
    """level, node, hash: SHA-256 of the joined hashes of up to 1024 children; level 1 is over documents."""
    now = recipes.select(F.col("place").alias("node"), F.col("root").alias("hash"))
    out, level = None, 0
    while True:
        level += 1
        up = now.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("c"))
        now = written(up.select("node", F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ""), 256).alias("hash")), "merkle")
        part = now.select(F.lit(level).alias("level"), "node", "hash")
        out = part if out is None else out.unionByName(part)
        if now.limit(2).count() < 2:
            return out


def _chunk_info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, crc = [], []
        for key, width, data in zip(b.column("key").to_pylist(), b.column("width").to_pylist(), b.column("data").to_pylist(), strict=True):
            raw = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
            if _key(raw) != key:
                raise ValueError(f"chunk {key.hex()} does not have its content")
            n.append(len(raw) // 4)
            crc.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "n", "crc"])


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc's, both bit-reversed."""
    p, m = 0, 1 << 31
    while a:
        if a & m:
            p ^= b
            a ^= m
        m >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return p


_SHIFTS: dict[int, int] = {}


def _shift(n: int) -> int:
    """x to the power 8 n."""
    if n not in _SHIFTS:
        out, square, k = 1 << 31, 1 << 23, n
        while k:
            if k & 1:
                out = _times(out, square)
            square = _times(square, square)
            k >>= 1
        if len(_SHIFTS) > 100_000:
            _SHIFTS.clear()
        _SHIFTS[n] = out
    return _SHIFTS[n]


def crc_join(crcs: list[int], lengths: list[int]) -> int:
    """crc32 of a sequence of byte strings from the crc32 and length of each."""
    out = 0
    for c, n in zip(crcs, lengths, strict=True):
        out = _times(_shift(n), out) ^ c
    return out


def _join_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, total = [], []
        for parts in b.column("parts").to_pylist():
            out.append(crc_join([p["crc"] for p in parts], [4 * p["n"] for p in parts]))
            total.append(sum(p["n"] for p in parts))
        yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(total, pa.int64()), pa.array(out, pa.int64())], ["place", "n_read", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, verified, one row a document.

    Every chunk is read, checked against its address, and its crc joined to those of its document's other
    chunks; verified compares the result with the recipe, and fails the query if the manifest differs.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    stored = spark.read.parquet(f"{path}/manifest")
    again = merkle(recipes)
    if not (again.exceptAll(stored).isEmpty() and stored.exceptAll(again).isEmpty()):
        raise ValueError("the recipes are not those of the manifest")
    chunks = spark.read.schema("key binary, width int, data binary, kind string").parquet(f"{path}/chunks").where("kind = 'chunk'").select("key", "width", "data")
    info = chunks.mapInArrow(_chunk_info, "key binary, n long, crc long")
    uses = recipes.select("place", F.posexplode("keys").alias("pos", "key"))
    parts = uses.join(info, "key").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    read = parts.mapInArrow(_join_documents, "place long, n_read long, ids_crc32 long")
    return recipes.select("place", "doc_id", "start", "n_tokens", "crc").join(read, "place").select(
        "doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32", ((F.col("n_read") == F.col("n_tokens")) & (F.col("crc") == F.col("ids_crc32"))).alias("verified"))


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.concatenate([np.frombuffer(p["data"], f"<u{p['width']}").astype(np.int64) for p in parts]) for parts in b.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "place", "ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents themselves: doc_id, place, ids."""
    chunks = spark.read.schema("key binary, width int, data binary, kind string").parquet(f"{path}/chunks").where("kind = 'chunk'").select("key", "width", "data")
    uses = spark.read.parquet(f"{path}/recipes").select("doc_id", "place", F.posexplode("keys").alias("pos", "key"))
    parts = uses.join(chunks, "key").groupBy("doc_id", "place").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "data"))).alias("parts"))
    return parts.mapInArrow(_ids_of, "doc_id long, place long, ids array<bigint>")


def drop_store(spark: SparkSession, path: str) -> None:
    drop_path(spark, path)
