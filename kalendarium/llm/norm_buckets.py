"""Ranked lexical search with norm buckets over impact vectors (operator 13).

A document is a vector of impacts of its terms (integers that grow with the term's count and fall with the
document's length), an item a vector of term weights times counts; the score is their product. Items are
the stated queries and are taken in blocks of ITEM_BLOCK; only coordinates that an item of the block holds
are kept, which leaves every score as it is.

Each task reads its documents in chunks of at most CHUNK coordinates, orders a chunk's vectors by length and
cuts them into buckets. For an item with k-th best score t so far:

* a bucket is passed over where |item| * (longest vector) < t (Cauchy-Schwarz), and with it all after it;
* the smallest set of leading coordinates is found whose rest can't reach t alone; a candidate holds one;
* a coordinate whose feasible range of the unit vector excludes zero must be held, within that range;
* what is left is accumulated, coordinate by coordinate, and dropped as soon as even the rest of both vectors
  (Cauchy-Schwarz once more) can't lift it to t; FEW candidates are scored at once.

Survivors are scored exactly in 64-bit integers. Bounds are doubles with a slack far above their rounding.
Thresholds start from the scores of a hashed share of the documents (any documents' k-th score is a lower
bound of the final one), so tasks prune from their first chunk on; the share never limits what is searched.
A task returns at most k rows per item, which a window ranks.

Rows: null and empty texts have no terms: such documents are never found, such items find nothing; repeated
items are searched each; repeated documents are each ranked; a missing doc_id comes last among equal scores.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalendarium.llm.common import plain_words, run_folder, small_batches, stored, text_bytes

K = 10
ITEM_BLOCK = 2048
#: coordinates per chunk and documents per bucket
CHUNK = 4_000_000
BUCKET = 4096
#: so few candidates are scored without further bounds
FEW = 32
#: one in so many documents gives the first thresholds
SEED_SHARE = 64
SLACK = 1e-9
NO_ID = (1 << 63) - 1


def _vectors(numbers: dict[bytes, int]):
    """Counts of the block's terms per document, as arrays of term numbers and counts."""

    def run(batches):
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = plain_words(text)
                held = [(numbers[w], n) for w, n in Counter(words).items() if w in numbers]
                sizes.append(len(words))
                pairs = np.array(held, dtype="<i4").reshape(-1, 2)
                terms.append(pairs[:, 0].tobytes())
                counts.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return run


def _holders(n_terms: int):
    """Documents per term number; number -1 counts the documents with terms, -2 all their terms."""

    def run(batches):
        df, documents, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=n_terms)
            sizes = batch.column("n").to_numpy()
            documents, total = documents + int((sizes > 0).sum()), total + int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], held]), pa.int32()), pa.array(np.concatenate([[documents, total], df[held]]), pa.int64())], ["term", "n"])

    return run


class Item:
    """An item's coordinates by falling weight, and the length of what follows each of them."""

    def __init__(self, no: int, item_id: int | None, terms: np.ndarray, weights: np.ndarray):
        order = np.lexsort((terms, -weights))
        self.no, self.item_id, self.terms, self.weights = no, item_id, terms[order], weights[order]
        squares = self.weights.astype(np.float64) ** 2
        self.rest = np.sqrt(np.append(np.cumsum(squares[::-1])[::-1], 0.0))
        self.length = float(self.rest[0])


class Bucket:
    """Vectors of similar length: rows of coordinates for scoring, postings by term for the bounds."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, lengths: np.ndarray):
        self.ids, self.starts, self.terms, self.impacts, self.lengths = ids, starts, terms, impacts, lengths
        self.longest = float(lengths.max(initial=0.0))
        row = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = row[order], impacts[order].astype(np.float64)
        self.known, first = np.unique(terms[order], return_index=True)
        self.bounds = np.append(first, len(order))

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = int(np.searchsorted(self.known, term))
        if at == len(self.known) or self.known[at] != term:
            return self.rows[:0], self.values[:0]
        return self.rows[self.bounds[at]:self.bounds[at + 1]], self.values[self.bounds[at]:self.bounds[at + 1]]

    def candidates(self, item: Item, least: float) -> np.ndarray:
        """Rows that the bounds can't exclude from a score of ``least`` or more."""
        least *= 1 - SLACK
        lead = int(np.searchsorted(-item.rest * self.longest, -least, side="right")) if least > 0 else len(item.terms)
        lead = min(lead, len(item.terms))
        if least > 0:
            cosine = min(1.0, least / (item.length * self.longest))
            unit = item.weights / item.length
            away = math.sqrt(1 - cosine**2)
            low = unit * cosine - np.sqrt(np.maximum(1 - unit**2, 0)) * away - SLACK
            high = np.where(unit > cosine, 1.0, unit * cosine + np.sqrt(np.maximum(1 - unit**2, 0)) * away) + SLACK
            needed = np.flatnonzero(low > 0)
            if len(needed):
                kept = None
                for f in needed:
                    rows, values = self.posting(int(item.terms[f]))
                    # the angle bounds hold for vectors as long as the longest; shorter ones need a larger share
                    share = values / self.lengths[rows]
                    rows = rows[(share >= low[f]) & (share <= high[f])]
                    kept = rows if kept is None else kept[np.isin(kept, rows, assume_unique=True)]
                return kept
        if not lead:
            return self.rows[:0]
        postings = [self.posting(int(t)) for t in item.terms[:lead]]
        rows, values = np.concatenate([r for r, _ in postings]), np.concatenate([v for _, v in postings])
        weights = np.repeat(item.weights[:lead].astype(np.float64), [len(r) for r, _ in postings])
        sums = np.bincount(rows, values * weights, len(self.ids))
        left = self.lengths**2 - np.bincount(rows, values**2, len(self.ids))
        kept = np.flatnonzero(sums > 0)
        for f in range(lead, len(item.terms) + 1):
            reach = sums[kept] + item.rest[f] * np.sqrt(np.maximum(left[kept], 0) + SLACK * self.lengths[kept] ** 2)
            kept = kept[reach >= least]
            if f == len(item.terms) or len(kept) <= FEW:
                return kept
            rows, values = self.posting(int(item.terms[f]))
            sums[rows] += values * float(item.weights[f])
            left[rows] -= values**2

    def scores(self, item: Item, rows: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """Exact integer scores of some rows."""
        scratch[item.terms] = item.weights
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        out = np.add.reduceat(scratch[self.terms[at]] * self.impacts[at], ends - sizes)
        scratch[item.terms] = 0
        return out


class Best:
    """The k best (score, smaller id first) of one item, and the score a newcomer must reach."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.ids, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(self.least, 1)
        ids, scores = np.append(self.ids, ids[good]), np.append(self.scores, scores[good])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = max(self.least, float(self.scores[-1]))


def buckets_of(ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, total: int, bucket: int = BUCKET) -> list[Bucket]:
    """A chunk's impact vectors in buckets of falling length."""
    m = np.array([25 + 75 * x * documents // total for x in n.tolist()], dtype=np.int64)
    tf = counts.astype(np.int64)
    impacts = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
    starts = np.append(0, np.cumsum(sizes))
    lengths = np.sqrt(np.add.reduceat(impacts.astype(np.float64) ** 2, starts[:-1])) if len(sizes) else np.zeros(0)
    order = np.argsort(-lengths, kind="stable")
    out = []
    for at in range(0, len(order), bucket):
        rows = order[at:at + bucket]
        ends = np.cumsum(sizes[rows])
        take = np.arange(ends[-1]) + np.repeat(starts[rows] - (ends - sizes[rows]), sizes[rows])
        out.append(Bucket(ids[rows], np.append(0, ends), terms[take], impacts[take], lengths[rows]))
    return out


def search_chunk(buckets: list[Bucket], items: list[Item], best: list[Best], scratch: np.ndarray) -> None:
    lengths = np.array([i.length for i in items])
    for bucket in buckets:
        least = np.array([b.least for b in best])
        for q in np.flatnonzero((lengths * bucket.longest >= least * (1 - SLACK)) & (lengths > 0)).tolist():
            rows = bucket.candidates(items[q], best[q].least)
            if len(rows):
                best[q].add(bucket.ids[rows], bucket.scores(items[q], rows, scratch))


def _search(items: list[Item], n_terms: int, documents: int, total: int, k: int, least: dict[int, float], chunk: int):
    def run(batches):
        best, scratch = [Best(k, least.get(i.no, 0.0)) for i in items], np.zeros(n_terms, dtype=np.int64)
        waiting, held = [], 0

        def flush():
            ids, n, terms, counts = zip(*waiting)
            sizes = np.array([len(t) // 4 for t in terms], dtype=np.int64)
            numbers = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
            flat = lambda parts: np.frombuffer(b"".join(parts), "<i4")
            search_chunk(buckets_of(numbers, np.array(n, dtype=np.int64), sizes, flat(terms), flat(counts), documents, total), items, best, scratch)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts"))):
                waiting.append(row)
                held += len(row[2]) // 4
                if held >= chunk:
                    flush()
                    waiting, held = [], 0
        if waiting:
            flush()
        for item, found in zip(items, best):
            if len(found.ids):
                ids = pa.array(found.ids, pa.int64(), mask=found.ids == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.no] * len(ids), pa.int64()), pa.array([item.item_id] * len(ids), pa.int64()), ids, pa.array(found.scores, pa.int64())], ["no", "item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list, folder: str, k: int, chunk: int) -> DataFrame:
    counted = [(r["no"], r["item_id"], Counter(plain_words(bytes(r["text"])))) for r in block]
    words = sorted({w for _, _, c in counted for w in c})
    numbers = {w: i for i, w in enumerate(words)}
    vectors = stored(docs.mapInArrow(_vectors(numbers), "doc_id long, n long, terms binary, counts binary"), f"{folder}/vectors")
    totals = {r["term"]: r["n"] for r in vectors.mapInArrow(_holders(len(words)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = totals.get(-1, 0), totals.get(-2, 0)
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * totals.get(i, 0) + 1))) for i in range(len(words))]
    items = []
    for no, item_id, count in counted:
        at = [numbers[w] for w in count if totals.get(numbers[w])]
        # terms that no document holds, and terms of weight 0, add nothing
        pairs = [(i, weight[i] * count[words[i]]) for i in at if weight[i]]
        if pairs:
            items.append(Item(no, item_id, np.array([i for i, _ in pairs], dtype=np.int64), np.array([w for _, w in pairs], dtype=np.int64)))
    search = lambda rows, least: rows.filter(F.length("terms") > 0).mapInArrow(
        _search(items, len(words), documents, total, k, least, chunk), "no long, item_id long, doc_id long, score long")
    some = vectors.filter(F.pmod(F.xxhash64("terms", "counts"), F.lit(SEED_SHARE)) == 0)
    least = {r["no"]: float(r["score"]) for r in _ranked(search(some, {}), k).filter(F.col("rank") == k).collect()}
    return stored(_ranked(search(vectors, least), k).select("item_id", "rank", "doc_id", "score"), f"{folder}/found")


def search(docs: DataFrame, items: DataFrame, k: int = K, item_block: int = ITEM_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = run_folder(spark, "search")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).withColumn("no", F.monotonically_increasing_id())
    asked = stored(asked, f"{folder}/items")
    n_blocks = max(1, -(-asked.count() // item_block))
    found = None
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("no"), F.lit(n_blocks)) == b).orderBy("no").collect()
        part = _search_block(texts, block, f"{folder}/block-{b}", k, chunk)
        found = part if found is None else found.unionByName(part)
    return found
