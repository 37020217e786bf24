"""Toxicity by the nearest labelled examples (operator 10).

Examples are a seeded sample of at most about MAX_EXAMPLES labelled rows that aren't held out (crc32 of the
doc_id's text mod 3 is not 1), up to half of them of each label. All their terms span the vector space:
plain TF-IDF, (1 + ln(count)) times the inverse document frequency over all documents, vectors of length 1.
Terms that no example holds count in a text's length like terms of one document.

Each text finds its K examples of largest cosine per label, exactly, in a block-max inverted index: examples
lie in blocks of BLOCK; a posting list knows its largest weight per block, so a block's best possible cosine
is a sum of maxima; blocks are visited by falling bound until the bound falls below the K-th cosine found.
Lists of the most frequent terms are kept as dense rows, whose part of all cosines is known exactly.

A neighbour's vote weighs one over its distance, times one plus LABEL_WEIGHT times the share of its
similarity that comes from terms that speak for a label among the examples' different texts, so that few of
them tell in a long text. The share of the toxic votes is calibrated on the examples' own leave-one-out shares, weighed back to the labels' rates.
The neighbours are kept as evidence.

What travels to the tasks is bounded by the texts of MAX_EXAMPLES examples, whatever the size of the corpus;
each Python worker builds the index from it once. Frequencies, vectors and calibration are Spark jobs.

Rows: null and empty texts, and texts without a term of the examples, get the calibrated rate of such
examples; a missing doc_id isn't held out and takes no part in learning. Labels of one doc_id are united
(toxic if any row says so), null labels ignored. Without any label every score is 0.5. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium.llm.common import per_worker, run_folder, small_batches, stored, text_of

MAX_EXAMPLES = 4_000
#: a term that weighs more in votes must stand in this many examples, have these log odds of a label, and a log
#: likelihood ratio this much above what the best of as many terms reaches by chance
LEAST_EXAMPLES, LEAST_LOG_ODDS, MARGIN = 5, math.log(3), 3.0
LABEL_WEIGHT = 100.0
K = 15
BLOCK = 64
#: so many of the most frequent terms are kept as dense rows
FREQUENT = 256
#: texts whose common terms are multiplied together
TOGETHER = 64
#: texts whose terms are counted together
COUNTED = 256
#: blocks that are visited before the bound is asked
FIRST_BLOCKS = 8
#: distances are counted from this cosine, so that one wrongly labelled copy doesn't outvote all others
FARTHEST = 1.2
#: what the overall rate weighs among the votes
PRIOR = 0.1
BINS = 20
THRESHOLD = 0.7
SEED = 29
_WORD = re.compile(r"\w+")
#: bytes of texts in lower case: those of words stay, as all beyond ASCII, others become a blank
_WORD_BYTES = bytes(b if b >= 128 or _WORD.match(chr(b)) else 0x20 for b in range(256))


def _plain(text: str) -> bytes:
    """The text's words in lower case, parted by blanks."""
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not _WORD.match(c):
                text = text.replace(c, " ")
    return text.encode().translate(_WORD_BYTES)


def term_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Text, place in the list of terms and count of each different term of each text, by text and place; the terms."""
    cut = pc.ascii_split_whitespace(pa.array([_plain(t) for t in texts], pa.large_string()))
    row = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    found = cut.flatten().dictionary_encode()
    place, terms = found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in terms:  # beside white space at an end
        given = place != terms.index("")
        row, place = row[given], place[given]
    n = max(len(terms), 1)
    key, counts = np.unique(row * n + place, return_counts=True)
    return key // n, key % n, counts, terms


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), F.lit(3)) == 1


def _term_counts(batches):
    """(term, label, documents) of labelled texts, summed per batch."""
    for batch in batches:
        sums: dict[tuple[str, int], int] = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            for term in set(_plain(text).decode().split()):
                sums[term, label] = sums.get((term, label), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in sums], pa.string()), pa.array([y for _, y in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["term", "label", "n"])


def _frequencies(space: Space):
    def run(batches):
        totals, documents = np.zeros(len(space.terms), dtype=np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for start in range(0, batch.num_rows, COUNTED):
                _, place, _, terms = term_table(batch.column("text").slice(start, COUNTED).to_pylist())
                at = space.numbers(terms)[place]
                totals += np.bincount(at[at >= 0], minlength=len(totals))
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, held), pa.int32()), pa.array(np.append(documents, totals[held]), pa.int64())], ["term", "n"])

    return run


class Space:
    """Unit vectors over the terms: 1 + ln(count), times the term's weight. Terms without number weigh ``rest``."""

    def __init__(self, terms: list[str], weight: np.ndarray | None = None, rest: float = 1.0):
        self.terms, self.weight, self.rest, self._numbers = terms, weight, rest, None

    def __getstate__(self):
        return self.__dict__ | {"_numbers": None}

    def numbers(self, terms: list[str]) -> np.ndarray:
        """The terms' numbers, or -1."""
        if self._numbers is None:
            self._numbers = {term: i for i, term in enumerate(self.terms)}
        return np.fromiter(map(self._numbers.get, terms, repeat(-1)), np.int64, len(terms))

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ascending numbers of each text's terms and their weights."""
        row, place, counts, terms = term_table(texts)
        at = self.numbers(terms)[place]
        weights = (1 + np.log(counts)) * np.where(at >= 0, self.weight[at] if len(self.weight) else 0.0, self.rest)
        norms = np.sqrt(np.bincount(row, weights**2, len(texts)))
        order = np.lexsort((at, row))
        order = order[at[order] >= 0]
        row, at, weights = row[order], at[order], weights[order] / norms[row[order]]
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        return [(at[a:b], weights[a:b]) for a, b in zip(ends, ends[1:])]


def _ragged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return _ranges(starts, ends - starts)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    last = np.cumsum(sizes)
    out = np.repeat(starts - (last - sizes), sizes)
    out += np.arange(last[-1])
    return out


class BlockMaxIndex:
    """Postings by (term, block of examples) with the largest weight of each, and dense rows for the FREQUENT
    terms that most examples hold: their part of all cosines is one matrix product for many texts."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, frequent: int = FREQUENT):
        n = self.n = len(vectors)
        self.block, self.n_blocks = block, -(-n // block)
        sizes = [len(at) for at, _ in vectors]
        example = np.repeat(np.arange(n, dtype=np.int64), sizes)
        term = np.concatenate([np.zeros(0, np.int64), *(np.asarray(at, np.int64) for at, _ in vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        held = np.bincount(term, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[:frequent]
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        self.rows = np.zeros((n, len(often)))
        dense = self.column[term] >= 0
        self.rows[example[dense], self.column[term[dense]]] = weight[dense]
        # stable, so examples stay in order below each term
        order = np.flatnonzero(~dense)
        order = order[np.argsort(term[order], kind="stable")]
        self.example, self.weight = example[order], weight[order]
        term, of_block = term[order], example[order] // block
        starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of_block[1:] != of_block[:-1]))) if len(order) else np.zeros(0, dtype=np.int64)
        self.starts, self.sizes = starts, np.diff(np.append(starts, len(order)))
        self.entry_block = of_block[starts]
        self.of_block, self.block_starts = np.arange(n) // block, np.arange(0, n, block)
        self.maxima = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.entries = np.append(0, np.cumsum(np.bincount(term[starts], minlength=n_terms)))

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the dense rows add to the cosines, a row per text."""
        whole = np.zeros((len(vectors), self.rows.shape[1]))
        for i, (at, weights) in enumerate(vectors):
            column = self.column[at]
            whole[i, column[column >= 0]] = weights[column >= 0]
        out = np.empty((len(vectors), self.n))
        # in products so small that the library keeps them on one core: tasks share a machine
        for a in range(0, self.n, self.block):
            for q in range(0, len(vectors), 8):
                out[q:q + 8, a:a + self.block] = whole[q:q + 8] @ self.rows[a:a + self.block].T
        return out

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int, but: int = -1, common: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k largest cosines above 0, ties to the smaller example; exact."""
        if not self.n or not len(at):
            return []
        common = self.common_part([(at, weights)])[0] if common is None else common
        rare = np.flatnonzero(self.column[at] < 0)
        first, last = self.entries[at[rare]], self.entries[at[rare] + 1]
        entry = _ragged(first, last)
        of_entry, blocks = np.repeat(weights[rare], last - first), self.entry_block[entry]
        # no example of a block can have more than its largest common part and every list's maximum
        bounds = np.maximum.reduceat(common, self.block_starts) + np.bincount(blocks, of_entry * self.maxima[entry], self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        cosines, reached = np.zeros(self.n), 0.0
        # the best blocks first, then at once all others that can hold one of the k nearest
        for visit in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            # leave room for rounding, so that ties are seen
            visit = visit[bounds[visit] >= reached - 1e-9]
            if not len(visit):
                break
            asked = np.zeros(self.n_blocks, dtype=bool)
            asked[visit] = True
            held = np.flatnonzero(asked[blocks])
            of_held = entry[held]
            begin, sizes = self.starts[of_held], self.sizes[of_held]
            posting = _ranges(begin, sizes)
            sums = np.bincount(self.example[posting], self.weight[posting] * np.repeat(of_entry[held], sizes), self.n)
            cosines += np.where(asked[self.of_block], sums + common, 0.0)
            if but >= 0:
                cosines[but] = 0.0
            if k <= self.n:
                reached = float(np.partition(cosines, self.n - k)[self.n - k])
        hits = np.flatnonzero(cosines > 0)
        # those surely below the k-th needn't be sorted
        hits = hits[cosines[hits] >= reached - 1e-9]
        best = hits[np.lexsort((hits, -cosines[hits].round(12)))[:k]]
        return list(zip(cosines[best].tolist(), best.tolist()))


class Model:
    """The examples of both labels with their indexes, built by the workers from plain arrays."""

    def __init__(self, parts: dict):
        self.space = Space(parts["terms"], parts["idf"], parts["rest"])
        self.speaks, self.base, self.labels, self.ids = parts["speaks"], parts["base"], parts["labels"], parts["ids"]
        self.starts, self.at, self.weights = parts["starts"], parts["at"], parts["weights"]
        self.numbers = {h: i for i, h in enumerate(parts["hashes"].tolist())}
        self.of_label, self.indexes = [], []
        for label in (0, 1):
            mine = np.flatnonzero(self.labels == label)
            self.of_label.append(mine)
            self.indexes.append(BlockMaxIndex([(self.at[self.starts[i]:self.starts[i + 1]], self.weights[self.starts[i]:self.starts[i + 1]]) for i in mine], len(parts["terms"])))
        self.scratch = np.zeros(len(parts["terms"]))

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int]) -> list[list[tuple[float, int]]]:
        """For each text (cosine, example) of the K nearest examples of each label, nearest first; never the one in ``but``."""
        found: list[list] = [[] for _ in vectors]
        for mine, index in zip(self.of_label, self.indexes):
            if not len(mine):
                continue
            for i, ((at, weights), common) in enumerate(zip(vectors, index.common_part(vectors))):
                place = int(np.searchsorted(mine, but[i]))
                here = place if place < len(mine) and mine[place] == but[i] else -1
                found[i] += [(s, int(mine[e])) for s, e in index.nearest(at, weights, K, here, common)]
        return [sorted(f, key=lambda x: (-round(x[0], 12), x[1])) for f in found]

    def shares(self, texts: list[str], but: list[int] | None = None) -> list[tuple[float | None, list[tuple[float, int]]]]:
        """The toxic share of each text's votes: one over the distance, more by the share of telling terms in the similarity."""
        out: list[tuple] = []
        for start in range(0, len(texts), TOGETHER):
            vectors = self.space.vectors(texts[start:start + TOGETHER])
            near = self.neighbours(vectors, but[start:start + TOGETHER] if but else [-1] * len(vectors))
            out += [(self._share(*v, n), n) for v, n in zip(vectors, near)]
        return out

    def _share(self, at: np.ndarray, weights: np.ndarray, near: list[tuple[float, int]]) -> float | None:
        if not near:
            return None
        cosines, examples = np.array([s for s, _ in near]), np.array([i for _, i in near])
        telling, told = self.speaks[at], 0.0
        if telling.any():
            self.scratch[at[telling]] = weights[telling]
            begin, end = self.starts[examples], self.starts[examples + 1]
            place = _ragged(begin, end)
            told = np.add.reduceat(self.scratch[self.at[place]] * self.weights[place], np.append(0, np.cumsum(end - begin)[:-1]))
            self.scratch[at[telling]] = 0
        votes = (1 + LABEL_WEIGHT * told / cosines) / (FARTHEST - np.minimum(cosines, 1.0))
        return float((votes @ self.labels[examples] + PRIOR * self.base) / (votes.sum() + PRIOR))


def _bin(share: float) -> int:
    return min(int(share * BINS), BINS - 1)


def _shares(model):
    """Leave-one-out shares of the examples: (bin, or -1 without neighbour; label; examples)."""

    def run(batches):
        made = model()
        counts: Counter = Counter()
        for batch in batches:
            own = [made.numbers[h] for h in batch.column("h").to_pylist()]
            for (share, _), label in zip(made.shares(batch.column("text").to_pylist(), own), batch.column("label").to_pylist()):
                counts[-1 if share is None else _bin(share), label] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in keys], pa.int32()), pa.array([y for _, y in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["bin", "label", "n"])

    return run


def calibrated(counts: dict[tuple[int, int], float], base: float) -> tuple[np.ndarray, float]:
    """Monotone rates per bin (pool adjacent violators), and the rate of texts without neighbour; every bin starts
    with one example of its own middle."""
    total, toxic = np.full(BINS, 1.0), (np.arange(BINS) + 0.5) / BINS
    empty = [base, 1.0]
    for (at, label), n in counts.items():
        if at < 0:
            empty[0], empty[1] = empty[0] + label * n, empty[1] + n
        else:
            total[at], toxic[at] = total[at] + n, toxic[at] + label * n
    pools: list[list[float]] = []
    for t, n in zip(toxic, total):
        pools.append([t, n, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            a, b = pools.pop(), pools.pop()
            pools.append([a[0] + b[0], a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(m), t / n) for t, n, m in pools]), empty[0] / empty[1]


class Scorer:
    """What travels to the tasks: the broadcast examples, the rates per bin."""

    def __init__(self, name: str, parts):
        self.name, self.parts = name, parts
        self.rates, self.without_terms = np.zeros(0), 0.5

    def model(self) -> Model:
        kept = per_worker("toxic-model", dict)
        if self.name not in kept:  # one model at a time
            kept.clear()
            kept[self.name] = Model(self.parts.value)
        return kept[self.name]

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[float, int]]]]:
        shares = self.model().shares(texts)
        return [(self.without_terms if share is None else float(self.rates[_bin(share)]), near) for share, near in shares]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Scorer:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna().filter(~held_out())
    known = marked.groupBy("doc_id").agg(F.max((F.col("label") != 0).cast("int")).alias("label"))
    per_label = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shares = {y: min(1.0, max_examples / 2 / n) for y, n in per_label.items()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about max_examples rows, so the broadcast has a bound
    sample = known.filter(unit < F.when(F.col("label") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0)))
    # copies count once, so that a group of them doesn't pass for many examples
    drawn = rows.join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.any_value("text").alias("text"), F.round(F.avg("label")).cast("int").alias("label"), F.min("doc_id").alias("doc_id"))
    folder = run_folder(spark, "toxic")
    examples = stored(drawn, f"{folder}/examples")
    counts = examples.select("text", "label").mapInArrow(_term_counts, "term string, label int, n long")
    sizes = {int(r["label"]): r["count"] for r in examples.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    with_term = counts.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    cells = [F.col("p") + 0.5, F.col("q") + 0.5, F.lit(pos) - F.col("p") + 0.5, F.lit(neg) - F.col("q") + 0.5]
    odds = F.log(cells[0]) - F.log(cells[1]) - F.log(cells[2]) + F.log(cells[3])
    share = pos / max(pos + neg, 1)
    n = F.col("p") + F.col("q")
    ratio = F.col("p") * F.log(cells[0] / (n + 1) / max(share, 1e-9)) + F.col("q") * F.log(cells[1] / (n + 1) / max(1 - share, 1e-9))
    held = stored(with_term.select("term", n.alias("n"), ratio.alias("ratio"), odds.alias("odds")), f"{folder}/terms")
    by_chance = math.log(max(held.filter(F.col("n") >= LEAST_EXAMPLES).count(), 1))
    speaks = (F.col("n") >= LEAST_EXAMPLES) & (F.abs("odds") >= LEAST_LOG_ODDS) & (F.col("ratio") >= by_chance + MARGIN)
    numbered = held.select("term", speaks.alias("speaks")).toArrow().sort_by("term")
    terms = numbered["term"].to_pylist()
    totals = np.zeros(len(terms) + 1, dtype=np.int64)
    counted = rows.select("text").mapInArrow(_frequencies(Space(terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    totals[counted["term"].to_numpy()] = counted["n"].to_numpy()  # documents at -1, the last
    idf, rest = np.log((1 + totals[-1]) / (1 + totals[:-1])) + 1, math.log((1 + totals[-1]) / 2) + 1 if totals[-1] else 1.0
    # in an order of their own, so that the model doesn't depend on task order
    found = examples.mapInArrow(_vectors(Space(terms, idf, rest)), "h long, doc_id long, label int, at array<int>, weights array<double>").toArrow().combine_chunks()
    found = found.sort_by([("doc_id", "ascending"), ("h", "ascending")]).combine_chunks()
    lists = [found["at"].combine_chunks(), found["weights"].combine_chunks()] if found.num_rows else None
    parts = {
        "terms": terms, "idf": idf, "rest": rest, "speaks": np.array(numbered["speaks"].to_numpy(), dtype=bool), "base": (pos + 0.5) / (pos + neg + 1),
        "labels": found["label"].to_numpy().astype(np.int64), "ids": found["doc_id"].to_pylist(), "hashes": found["h"].to_numpy(),
        "starts": np.append(0, np.cumsum(np.diff(lists[0].offsets.to_numpy()))) if lists else np.zeros(1, dtype=np.int64),
        "at": lists[0].flatten().to_numpy().astype(np.int64) if lists else np.zeros(0, dtype=np.int64), "weights": lists[1].flatten().to_numpy() if lists else np.zeros(0),
    }
    scorer = Scorer(folder, spark.sparkContext.broadcast(parts))
    bins = examples.mapInArrow(_shares(scorer.model), "bin int, label int, n long").groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()
    rate = (per_label.get(1, 0) + 0.5) / (sum(per_label.values()) + 1)
    scorer.rates, scorer.without_terms = calibrated({(r["bin"], r["label"]): r["n"] / shares[r["label"]] for r in bins}, rate)
    return scorer


def _vectors(space: Space):
    def run(batches):
        for batch in batches:
            vectors = space.vectors(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("doc_id"), batch.column("label"), pa.array([a.astype(np.int32) for a, _ in vectors], pa.list_(pa.int32())), pa.array([w for _, w in vectors], pa.list_(pa.float64()))],
                ["h", "doc_id", "label", "at", "weights"])

    return run


def _scores(scorer: Scorer, evidence: int):
    def run(batches):
        model = scorer.model()
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            scored = scorer.scores(batch.column("text").to_pylist())
            near = [[{"doc_id": model.ids[i], "toxic": int(model.labels[i]), "cosine": s} for s, i in found[:evidence]] for _, found in scored]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([s for s, _ in scored], pa.float64()), pa.array(near, kind)], ["doc_id", "text_hash", "score", "evidence"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, evidence: int = 3) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted, evidence (nearest examples: doc_id, toxic, cosine)."""
    scorer = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    scored = rows.mapInArrow(_scores(scorer, evidence), "doc_id long, text_hash long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
    return scored.select("doc_id", "text_hash", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, all columns as they are, whose score is below the threshold."""
    scorer = fit(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([s for s, _ in scorer.scores(texts.tolist())], dtype="float64")

    return docs.filter(score(text_of()) < threshold)
