"""Token ids in a seekable binary format: independent zstandard frames, a document index, and a trailing seek table.

A shard file is: data frames, each the little-endian ids of some whole documents (no document is split; a frame closes
once it holds `frame_ids` ids); a skippable frame with the index (doc_id, presence of doc_id, ids of each document, and
the documents of each frame); and the seek table as a skippable frame in the published seekable layout: compressed and
decompressed size and checksum (low 32 bits of xxh64) of each frame, the count of frames, a descriptor and a magic
number. A reader takes the end of the file, then only the frames that hold the documents it wants.

Documents are dealt by ranges of doc_id (ties: by a hash of the text, then the text), one shard for each range, so that
shard after shard the ids stand in ascending order of doc_id, null first. Only one row for each shard comes to the
driver. A shard is written under another name and then renamed; a repeated or speculative task writes the same file.
Null and empty texts hold the end id alone. Repeated rows are written each.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.llm.common import new_folder, partitions

END_ID = 2
FRAME_IDS = 1 << 16
CACHE_PARTS, CACHE_WORDS, LONGEST_CACHED, LEVEL = 200_000, 2_000_000, 40, 1
#: Code points of texts that are encoded together.
TOGETHER = 16_000_000
#: How byte-level vocabularies write a space.
SPACE = "\u0120"
# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

# The characters of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Parts of a text that byte-level pre-tokenising never joins: each run of white space with what follows it.
_PARTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space other than blanks and line ends, each searched for by itself: a text of narrow characters ends the search for wide
#: ones at once.
_RARE = [chr(c) for c in range(0x110000) if re.match(f"[{WHITE}]", chr(c)) and chr(c) not in " \n"]


def _has_runs(text: str) -> bool:
    """Whether white space may stand beside white space or at the start, or other than blanks and line ends occurs."""
    return text[:1] in (" ", "\n") or any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or any(c in text for c in _RARE)


class Recent(dict):
    """A cache of two generations: once the young one is full it becomes the old one, and what is asked for again comes back."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def unknown(self, keys: set[str]) -> list[str]:
        """The keys that neither generation has; those that only the old one has become young."""
        new = keys.difference(self)
        again = new.intersection(self.old)
        for k in again:
            self[k] = self.old[k]
        return list(new.difference(again))

    def aged(self) -> None:
        if len(self) > self.size:
            self.old = self.copy()
            self.clear()


class Encoder:
    """Ids of texts by the tokenizers library, part by part with a bounded cache. Exact for byte-level pre-tokenisers whose
    pre-tokens have white space at their start only; with any other tokenizer (`parted` is false) whole texts are encoded."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.parted = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and spec.get("normalizer") is None and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
            and not spec.get("truncation") and not spec.get("padding")
        )
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        #: Ids of parts as they are; and words after a space: the words, how many ids each has, and the ids of all in a row.
        self.parts = Recent(CACHE_PARTS)
        self.known, self.sizes, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_spaces(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space. Joined by spaces, only the first token of each has a space at its start."""
        out, groups = [], [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for part, found in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            first = np.flatnonzero(self.starts[ids])
            if len(first) != len(part) or first[0]:
                out += self._whole([" " + w for w in part])
                continue
            raw, bounds = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of different parts as they stand, by the cache; long ones aren't kept."""
        new = self.parts.unknown(set(parts))
        found = dict(zip(new, self._whole(new))) if new else {}
        self.parts.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST_CACHED)
        out = {p: found[p] if p in found else self.parts[p] for p in parts}
        self.parts.aged()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.parted:
            return self._whole(texts)
        out: list[bytes] = [b""] * len(texts)
        runs = [i for i, t in enumerate(texts) if t and _has_runs(t)]
        split = [_PARTS.findall(texts[i]) for i in runs]
        known = self._parts(list({p for parts in split for p in parts}))
        for i, parts in zip(runs, split):
            out[i] = b"".join(map(known.__getitem__, parts))
        plain = sorted(set(range(len(texts))).difference(runs))
        for i, ids in zip(plain, self._in_words([texts[i] for i in plain])):
            out[i] = ids
        return out

    def _in_words(self, texts: list[str]) -> list[bytes]:
        """Texts in which single spaces stand between words. Words become numbers of a dictionary, known words are found in the cache
        as a whole, and ids are gathered by number: only new words are handled one by one."""
        if not texts:
            return []
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.values)
        words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(place))
        found = self._after_spaces(new.to_pylist())
        # entries: cached words, new words, and the first words of texts, which have no space before them
        heads, head_at = np.unique(at[bounds[:-1]], return_inverse=True)
        head_words = words.take(pa.array(heads)).to_pylist()
        head_ids = self._parts(head_words)
        more = [*found, *(head_ids[w] for w in head_words)]
        more_sizes = np.array([len(x) for x in more], np.int64) // 4
        sizes = np.concatenate([self.sizes, more_sizes])
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(more), "<u4")])
        starts = np.cumsum(sizes) - sizes
        entry = place.fill_null(-1).to_numpy().astype(np.int64)
        entry[entry < 0] = len(self.known) + np.arange(len(new))
        at = entry[at]
        at[bounds[:-1]] = len(self.known) + len(new) + head_at
        n = sizes[at]
        ends = np.cumsum(n)
        ids = pool[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1])].tobytes()
        self._remember(words, entry, new, sizes, starts, pool)
        cuts = [0, *(4 * ends[bounds[1:] - 1]).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _remember(self, words, entry: np.ndarray, new, sizes: np.ndarray, starts: np.ndarray, pool: np.ndarray) -> None:
        """Add the new words to the cache; once it is full it begins anew with the words of these texts. Long words aren't kept."""
        import pyarrow as pa
        import pyarrow.compute as pc

        full = len(self.known) + len(new) > CACHE_WORDS
        some, at = (words, entry) if full else (new, len(self.known) + np.arange(len(new)))
        short = pc.less_equal(pc.utf8_length(some), LONGEST_CACHED).to_numpy(zero_copy_only=False)
        at, n = at[short], sizes[at[short]]
        ids = pool[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        some = some.filter(pa.array(short))
        if full:
            self.known, self.sizes, self.pool = some, n, ids
        else:
            self.known = pa.concat_arrays([self.known, some])
            self.sizes, self.pool = np.concatenate([self.sizes, n]), np.concatenate([self.pool, ids])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shard(docs: Iterator[tuple[int | None, bytes]], sink, frame_ids: int = FRAME_IDS) -> tuple[int, int]:
    """Write (doc_id, ids as little-endian uint32) in the given order; gives the counts of documents and ids."""
    import xxhash
    import zstandard

    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
    table, frame, held, ids, lengths, per_frame, total = [], [], 0, [], [], [], 0

    def close() -> None:
        nonlocal frame, held
        if frame:
            raw = b"".join(frame)
            packed = packer.compress(raw)
            sink.write(packed)
            table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            per_frame.append(len(frame))
            frame, held = [], 0

    for doc_id, data in docs:
        frame.append(data)
        n = len(data) // 4
        held, total = held + n, total + n
        ids.append(doc_id)
        lengths.append(n)
        if held >= frame_ids:
            close()
    close()
    known = np.array([i is not None for i in ids], "u1")
    index = struct.pack("<QQ", len(ids), len(per_frame)) + np.array([i or 0 for i in ids], "<i8").tobytes()
    index += known.tobytes() + np.array(lengths, "<u8").tobytes() + np.array(per_frame, "<u4").tobytes()
    index = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress(index)
    sink.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
    table.append(struct.pack("<III", len(index) + 8, 0, 0))
    sink.write(struct.pack("<II", SEEK_FRAME, 12 * len(table) + 9) + b"".join(table))
    sink.write(struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC))
    return len(ids), total


class ShardReader:
    """Reads documents of a shard from a seekable file, frame by frame; a damaged file raises ValueError."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        if size < 17:
            raise ValueError("no seek table")
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        start = size - 9 - 12 * n - 8
        if magic != SEEK_MAGIC or start < 0 or struct.unpack("<II", self._at(start, 8)) != (SEEK_FRAME, 12 * n + 9):
            raise ValueError("no seek table")
        table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.frames = table[:-1]
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        head = int(self.offsets[-2])
        if struct.unpack("<II", self._at(head, 8)) != (SKIPPABLE, int(table[-1, 0]) - 8):
            raise ValueError("no document index")
        index = self._unpack(self._at(head + 8, int(table[-1, 0]) - 8))
        docs, frames = struct.unpack_from("<QQ", index)
        at = 16
        self.doc_ids = np.frombuffer(index, "<i8", docs, at)
        self.known = np.frombuffer(index, "u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
        per_frame = np.frombuffer(index, "<u4", frames, at + 17 * docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(per_frame)])  # of each frame
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])  # of each document in the shard

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("cut off")
        return data

    def _unpack(self, data: bytes) -> bytes:
        import zstandard

        try:
            return self.unpacker.decompress(data)
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame: {e}") from e

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        raw = self._unpack(self._at(int(self.offsets[k]), int(self.frames[k, 0])))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k}: checksum differs")
        return np.frombuffer(raw, "<u4")

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the given rows of the index, all by default; only their frames are decompressed."""
        rows = np.arange(len(self.doc_ids)) if rows is None else np.sort(np.asarray(rows, np.int64))
        at, ids = -1, None
        for row, k in zip(rows.tolist(), (np.searchsorted(self.first, rows, "right") - 1).tolist()):
            if k != at:
                at, ids = k, self.frame(k)
            start = self.starts[row] - self.starts[self.first[k]]
            yield row, ids[start : start + self.lengths[row]]

    def rows_of(self, doc_ids: list[int]) -> np.ndarray:
        return np.flatnonzero(self.known & np.isin(self.doc_ids, np.asarray(doc_ids, np.int64)))


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_ids(df: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode the whole texts of (doc_id, text) and write them as shards in folder (a URI that pyarrow can open).

    Gives one row for each shard: shard, docs, ids and start, the count of ids in the shards before it."""
    spark = df.sparkSession
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie"))
    dealt = docs.repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first(), "tie")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, tool = TaskContext.get().partitionId(), encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()

        def rows():
            doc_ids, texts, size = [], [], 0
            for part in batches:
                doc_ids.extend(part["doc_id"].astype("Int64"))
                texts.extend(t or "" for t in part["text"])
                size += int(part["text"].str.len().sum())
                if size >= TOGETHER:
                    yield from encoded(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            yield from encoded(doc_ids, texts)

        def encoded(doc_ids: list, texts: list[str]):
            for i, ids in zip(doc_ids, tool.encode(texts)):
                yield (None if i is pd.NA else int(i)), ids + end

        system, path = _open(f"{folder}/shard-{shard:06d}.ids.zst")
        own = f"{path}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(own) as sink:
            n, total = write_shard(rows(), sink)
        if n:
            system.move(own, path)
            yield pd.DataFrame({"shard": [shard], "docs": [n], "ids": [total]})
        else:
            system.delete_file(own)

    _make_folder(spark, folder)
    rows = dealt.select("doc_id", "text").mapInPandas(write, "shard int, docs long, ids long").collect()
    start, manifest = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        manifest.append((r.shard, r.docs, r.ids, start))
        start += r.ids
    return spark.createDataFrame(manifest, "shard int, docs long, ids long, start long")


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_ids(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, frame) read back from the shards; only those of doc_ids if given."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for shard, start in zip(part["shard"], part["start"]):
                system, path = _open(f"{folder}/shard-{shard:06d}.ids.zst")
                with system.open_input_file(path) as source:
                    reader = ShardReader(source)
                    wanted = None if doc_ids is None else reader.rows_of(doc_ids)
                    out = [
                        (int(reader.doc_ids[r]) if reader.known[r] else None, start + int(reader.starts[r]), len(ids), zlib.crc32(ids.tobytes()))
                        for r, ids in reader.documents(wanted)
                    ]
                    got = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                    yield got.astype({"doc_id": "Int64"})

    # one task for each shard: its row says where, the task reads the file itself
    count = max(1, manifest.count())
    dealt = manifest.repartitionByRange(count, "shard").select("shard", "start")
    return dealt.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def roundtrip(df: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents into a new shared folder and read them back."""
    folder = new_folder(df.sparkSession, "ids")
    return read_ids(write_ids(df, tokenizer_path, folder, end_id), folder)
