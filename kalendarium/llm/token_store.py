"""Token ids in one concatenated array with Elias-Fano coded document boundaries (operator 1).

File format, a Parquet table with one row per segment, in ascending document order by (shard, segment):

    shard, segment          position of the segment
    n_docs, n_tokens        size of the segment
    n_missing               its leading documents without doc_id
    first_id, last_id       range of its document ids (row groups prune on it)
    width                   bytes of one token id, 2 or 4
    ids                     the concatenated ids, little-endian
    ends                    Elias-Fano code of the documents' end offsets within ``ids``
    doc_ids                 Elias-Fano code of doc_id - first_id of the documents that have one

A segment holds at most SEGMENT_TOKENS ids or one document, and at most SEGMENT_DOCS documents, so
tasks hold one segment at a time. An Elias-Fano code of n values below u takes 2 + log2(u / n) bits a
value and a 32-bit select sample per SAMPLE values; there is no table of 64-bit offsets.

Rows: a null text is empty; documents without id come first; equal ids follow each other in the order
of their text hash, so reruns agree. An empty table gives files without rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalendarium.llm.common import per_worker, small_batches, text_of

SEGMENT_TOKENS = 1 << 20
SEGMENT_DOCS = 1 << 16
SAMPLE = 64
#: words of a generation of the per-worker memo; it keeps two, and words met again move to the younger one
MEMO = 300_000
#: words that the tokenizer takes as one text; longer ones cost it more a word
PART = 256
#: marks that never join letters before them: a sure cut between the two
MARKS = ".,;:!?*%$&#|"

FILE_SCHEMA = (
    "shard int, segment int, n_docs int, n_tokens long, n_missing int, first_id long, last_id long, "
    "width int, ids binary, ends binary, doc_ids binary"
)


class EliasFano:
    """Ascending non-negative integers; ``select(i)`` is the i-th, ``decode()`` all of them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits((values[:, None] >> shifts & 1).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = struct.unpack_from("<IBII", data)
        at = struct.calcsize("<IBII")
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", -1, at + n_low + n_high))

    def _lows(self, lo: int, hi: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(hi - lo, dtype=np.int64)
        first, last = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(self.low[first >> 3:(last + 7) >> 3], bitorder="little")[first & 7:][: last - first]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def decode(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Values lo to hi - 1, read from the nearest select sample on."""
        hi = self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return np.zeros(0, dtype=np.int64)
        start, stop = int(self.samples[lo // SAMPLE]), (hi - 1) // SAMPLE + 1
        end = int(self.samples[stop]) if stop < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[start >> 3:(end + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[start & 7:]) + start
        places = ones[lo - lo // SAMPLE * SAMPLE:][: hi - lo]
        return ((places - np.arange(lo, hi)) << self.low_bits) | self._lows(lo, hi)

    def select(self, i: int) -> int:
        return int(self.decode(i, i + 1)[0])


class Encoder:
    """Whole texts to ids. A blank that follows no white space always begins a piece of a byte-level
    vocabulary, so texts are cut there and each different word of a batch is encoded once (frequent ones
    are kept in a bounded memo); words become numbers, and numbers ids, in Arrow. Other tokenizers take the
    texts whole."""

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.blank_after_space = re.compile(r"\s ")
        self.blank_after_word = re.compile(r"(?<=\S) ")
        self.latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
        from tokenizers.pre_tokenizers import ByteLevel

        probe = "a b"
        state = self.tokenizer.pre_tokenizer
        self.by_word = isinstance(state, ByteLevel) and self.tokenizer.normalizer is None and len(state.pre_tokenize_str(probe)) == 2

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words as they stand after a blank. Words are encoded many at a time: the ids of the
        joined text are dealt out where a token begins with the blank."""
        simple = {w for w in missing if w and w[-1].isalnum() and not w[0].isspace()}
        split, whole, letters = [], [], set()
        for word in missing - simple:
            bare = word.rstrip(MARKS)
            if len(bare) < len(word) and (bare.isascii() and bare.isalpha() or self.latin.fullmatch(bare)):
                split.append((word, bare, word[len(bare):]))
                letters.add(bare)
            elif not word or word[0].isspace():  # a blank before it wouldn't begin its piece among others
                whole.append(word)
            else:
                simple.add(word)
        learned = {}
        # the words themselves are known to be missing, only their letters may have been met
        for w in letters - simple:
            ids = self.words.get(w) or self.older.get(w)
            if ids:
                learned[w] = ids
            else:
                simple.add(w)
        new = list(simple)
        parts = [new[at:at + PART] for at in range(0, len(new), PART)]
        while parts:
            part = parts.pop()
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part):
                data, bounds = ids.tobytes(), [*(starts * self.width).tolist(), len(ids) * self.width]
                learned.update(zip(part, [data[a:b] for a, b in zip(bounds, bounds[1:])]))
            elif len(part) > 64:  # some word has blanks of its own
                parts += [part[: len(part) // 2], part[len(part) // 2:]]
            else:
                learned.update(zip(part, self.whole([" " + w for w in part])))
        marks = sorted({m for _, _, m in split})
        mark_ids = dict(zip(marks, self.whole(marks)))
        learned.update([(word, learned[letters] + mark_ids[m]) for word, letters, m in split])
        learned.update(zip(whole, self.whole([" " + w for w in whole])))
        return learned

    def _remember(self, words: dict[str, bytes]) -> None:
        if len(self.words) > MEMO:
            self.older, self.words = self.words, {}
        self.words.update(words)

    @property
    def begins(self) -> np.ndarray:
        """For each id, whether its token begins with a blank."""
        if not hasattr(self, "_begins"):
            size = self.tokenizer.get_vocab_size()
            self._begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        return self._begins

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [ids for at in range(0, len(texts), 64) for ids in self.whole(texts[at:at + 64])]
        odd = [self._has_odd_blank(t) for t in texts]
        plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string()), " ")
        cut = pa.array([self.blank_after_word.split(t) for t, o in zip(texts, odd) if o], pa.list_(pa.large_string()))
        found = {False: iter(self._joined(plain)), True: iter(self._joined(cut))}
        return [next(found[o]) for o in odd]

    def _has_odd_blank(self, text: str) -> bool:
        if text.isascii():  # str.find is faster than the pattern
            return any(pair in text for pair in ("  ", "\n ", "\t ", "\r ", "\v ", "\f ", "\x1c ", "\x1d ", "\x1e ", "\x1f "))
        return self.blank_after_space.search(text) is not None

    def _joined(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of texts that are given as lists of at least one word."""
        if not len(cut):
            return []
        heads, bounds = self.whole(pc.list_element(cut, 0).to_pylist()), cut.offsets.to_numpy()
        after = np.ones(len(cut.values), dtype=bool)
        after[bounds[:-1]] = False
        words = cut.values.filter(pa.array(after)).dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, different))
        unmet = [at for at, ids in enumerate(found) if ids is None]
        if unmet:
            # most words were met lately: the older generation and the tokenizer are asked for the others only
            words_unmet = [different[at] for at in unmet]
            new = dict(zip(words_unmet, map(self.older.get, words_unmet)))
            new.update(self._learn({w for w, ids in new.items() if ids is None}))
            for at, w in zip(unmet, words_unmet):
                found[at] = new[w]
            self._remember(new)
        ids = pa.array(found, pa.large_binary())
        spread = ids.take(words.indices)
        if not len(spread):
            return heads
        # the words' ids follow each other in one buffer, so a text is a range of it
        places, data = np.frombuffer(spread.buffers()[1], np.int64, len(spread) + 1), memoryview(spread.buffers()[2] or b"")
        bounds = places[bounds - np.arange(len(bounds))].tolist()
        return [head + bytes(data[a:b]) for head, a, b in zip(heads, bounds, bounds[1:])]


def _segment(shard: int, number: int, doc_ids: list, ids: list[bytes], width: int) -> dict:
    ends = np.cumsum([len(x) // width for x in ids])
    given = [d for d in doc_ids if d is not None]
    first = given[0] if given else None
    return {
        "shard": shard, "segment": number, "n_docs": len(ids), "n_tokens": int(ends[-1]), "n_missing": len(ids) - len(given),
        "first_id": first, "last_id": given[-1] if given else None, "width": width, "ids": b"".join(ids),
        "ends": EliasFano.of(ends).to_bytes(),
        "doc_ids": EliasFano.of(np.array([d - first for d in given], dtype=np.int64)).to_bytes(),
    }


def _segments(tokenizer_path: str, end_id: int | None):
    def run(batches):
        from pyspark import TaskContext

        encoder = per_worker(f"encoder:{tokenizer_path}", lambda: Encoder(tokenizer_path))
        tail = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
        shard, number, size, doc_ids, ids = TaskContext.get().partitionId(), 0, 0, [], []
        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("n_missing", pa.int32()),
                            ("first_id", pa.int64()), ("last_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("doc_ids", pa.binary())])
        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                encoded += tail
                far = bool(doc_ids) and doc_id is not None and doc_ids[0] is not None and doc_id - doc_ids[0] >= 1 << 62
                if doc_ids and (size + len(encoded) > SEGMENT_TOKENS * encoder.width or len(doc_ids) >= SEGMENT_DOCS or far):
                    yield pa.RecordBatch.from_pylist([_segment(shard, number, doc_ids, ids, encoder.width)], schema)
                    number, size, doc_ids, ids = number + 1, 0, [], []
                doc_ids.append(doc_id)
                ids.append(encoded)
                size += len(encoded)
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_segment(shard, number, doc_ids, ids, encoder.width)], schema)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2) -> None:
    """Encode every whole text and write the ids in ascending doc_id order. The rows are dealt out by
    ranges of (doc_id, text hash), so one repeated id doesn't land in one task."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_segments(tokenizer_path, end_id), FILE_SCHEMA).write.parquet(path)


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['width']}")
                ends = EliasFano.from_bytes(row["ends"]).decode()
                starts = np.concatenate([[0], ends[:-1]])
                given = EliasFano.from_bytes(row["doc_ids"]).decode() + (row["first_id"] or 0)
                wide = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)]
                columns = [
                    pa.array([row["shard"]] * len(ends), pa.int32()), pa.array([row["segment"]] * len(ends), pa.int32()),
                    pa.array([None] * row["n_missing"] + given.tolist(), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(w) for w in wide], pa.int64()),
                ]
                names = ["shard", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(wide, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    and on demand the ids as little-endian 32-bit integers."""
    file = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = file.select("shard", "segment", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # segments are numbered within shards, shards (one per writing task) across the file
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", before(W.orderBy("shard")).alias("shard_base"))
    segments = sizes.withColumnRenamed("n_tokens", "n").select("shard", "segment", before(W.partitionBy("shard").orderBy("segment")).alias("base"))
    bases = segments.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("shard_base")).alias("base"))
    schema = "shard int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    docs = file.mapInArrow(_documents(with_ids), schema)
    more = ["ids"] if with_ids else []
    return docs.join(bases, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *more)


def token_ids(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document: only row groups whose id range holds it are read."""
    file = spark.read.schema(FILE_SCHEMA).parquet(path).filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return file.mapInArrow(_documents(True), "shard int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long, ids binary").filter(F.col("doc_id") == doc_id)
