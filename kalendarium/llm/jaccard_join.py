"""Jaccard join of documents by their word shingles as a blocked sparse matrix product (operator 12).

A document's row of the incidence matrix is its set of distinct SHINGLE-word shingles (64-bit hashes; fewer
words make one shingle of all). Two documents link at |A and B| * 100 >= percent * |A or B|, that is an
overlap of at least percent * (|A| + |B|) / (100 + percent). The overlaps are cells of matrix times
transpose, computed in blocks:

* columns come in two panels. The leading panel holds the first |A| - ceil(percent * |A| / 100) + 1 shingles
  of each row in one global order, rare ones first; linked rows share a column there. The order comes from
  a sketch of column counts over all documents (at most MAX_SKETCH counters); any order gives the same links.
* rows come in blocks by size; only neighbouring blocks can hold links.
* the leading panel's product accumulates overlap counts; a cell is dropped where even the whole rest of a
  row (|A| minus its leading columns) couldn't lift it to the size-derived bound.
* cells left over get the overlap of the whole rows, accumulated panel by panel with the same bound.

Equal sets are one row. Dense groups don't list their pairs: first each row meets one leader per (column,
block), as many cells as the panel has entries, and the links found are joined to groups. Columns that still
hold several groups do so again with LEADERS leaders each. Then only columns that hold several groups even
now are multiplied, and only between rows of different groups: their rows lie in tiles of at most about TILE
rows, tiles with a common column meet, and a task multiplies two tiles and keeps a forest of their links. So
neither cells nor links are listed one by one; what grows with the square of a group is pairs of tiles.

Rows: null and empty texts have an empty set and link with nothing, also not with each other; a missing
doc_id takes part, a group's component_id is the smallest doc_id it has, or null; repeated rows share a
set. An empty table gives an empty result. Equal 64-bit numbers of different sets are looked for with a
second hash; if any are found, all numbers are made again with another seed.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium.llm.common import Memo, per_worker, run_folder, small_batches, stored, text_bytes
from kalendarium.llm.components import components

SHINGLE = 4
PERCENT = 85
MIN_SKETCH, MAX_SKETCH = 1 << 16, 1 << 24
#: bytes of text per counter of the sketch
BYTES_PER_COUNTER = 768
SLICE = 1 << 12
#: leaders per column and block in the second round
LEADERS = 8
#: columns per step when the whole rows of a cell are multiplied
PANEL = 4096
#: rows and leading entries of a tile
TILE, TILE_ENTRIES = 256, 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (one-to-one)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def word_hashes(seed: int) -> Memo:
    from xxhash import xxh3_64_intdigest

    return Memo(lambda word: xxh3_64_intdigest(word, seed))


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` neighbours."""
    n = len(hashes) - width + 1
    sums = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        # each place has a multiplier of its own, so order counts
        sums = _mixed(sums + hashes[i:n + i] * (_ODD[i % 4] + np.uint64(2 * (i // 4))))
    return sums


def shingle_sets(texts: list[bytes], words: Memo, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    # bytes.lower() and bytes.split() touch exactly A-Z and the six white-space characters
    parts = [t.lower().split() for t in texts]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    hashes = np.fromiter((words[w] for p in parts for w in p), np.uint64, ends[-1] if ends else 0)
    runs = _rolled(hashes, shingle) if len(hashes) >= shingle else hashes[:0]  # those over a text's end are not used
    out = []
    for p, end in zip(parts, ends):
        start = end - len(p)
        out.append(np.unique(runs[start:end - shingle + 1]) if len(p) >= shingle else _rolled(hashes[start:end], len(p)) if p else hashes[:0])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sets(shingle: int, seed: int, size: int):
    """A narrow row per document, and at a task's end its part of the column sketch, in slices."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        words = per_worker(f"shingle-words:{seed}", lambda: word_hashes(seed))
        counts = np.zeros(size, dtype=np.uint32)
        names = ["doc_id", "text_hash", "n_shingles", "set_id", "proof", "slice", "counts"]
        for batch in batches:
            rows = shingle_sets(batch.column("text").to_pylist(), words, shingle)
            flat = np.concatenate([*rows, np.zeros(0, dtype=np.uint64)])
            # columns of a row are distinct, their counters need not be
            np.add.at(counts, (flat & np.uint64(size - 1)).astype(np.int64), 1)
            packed = [r.tobytes() for r in rows]
            none = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(r) for r in rows], pa.int64()), pa.array([_signed(xxh3_64_intdigest(r, seed)) for r in packed], pa.int64()),
                 pa.array([_signed(xxh3_64_intdigest(r, seed + 1)) for r in packed], pa.int64()), *none], names)
        held = [a for a in range(0, size, SLICE) if counts[a:a + SLICE].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(held), pa.int64())] * 5 + [pa.array([a // SLICE for a in held], pa.int32()), pa.array([counts[a:a + SLICE].tobytes() for a in held], pa.binary())], names)

    return run


def _columns(shingle: int, seed: int):
    """set_id and columns of texts, once per task."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        words, seen = per_worker(f"shingle-words:{seed}", lambda: word_hashes(seed)), set()
        for batch in batches:
            rows = {}
            for row in shingle_sets(batch.column("text").to_pylist(), words, shingle):
                packed = row.tobytes()
                set_id = _signed(xxh3_64_intdigest(packed, seed))
                if packed and set_id not in seen:
                    seen.add(set_id)
                    rows[set_id] = packed
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["set_id", "columns"])

    return run


def _summed(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            sums[at] = sums.get(at, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
    packed = [np.minimum(s, 0xFFFFFFFF).astype("<u4").tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])


def sketch_size(text_bytes: int) -> int:
    """Counters for so many bytes of text: a power of two that grows with the input up to a bound."""
    size = MIN_SKETCH
    while size < MAX_SKETCH and size * BYTES_PER_COUNTER < text_bytes:
        size *= 2
    return size


def column_sketch(parts: DataFrame, size: int) -> np.ndarray:
    """Counts of columns by their low bits, summed over the tasks' parts."""
    out = np.zeros(size, dtype=np.uint32)
    for part in parts.repartition("slice").mapInArrow(_summed, "slice int, counts binary").collect():
        out[part["slice"] * SLICE:(part["slice"] + 1) * SLICE] = np.frombuffer(part["counts"], "<u4")
    return out


def leading(n: int, percent: int = PERCENT) -> int:
    """Columns of a row of n that meet every row it links with."""
    return n + percent * -n // 100 + 1


def size_block(n: int, percent: int = PERCENT) -> int:
    """Linked rows lie in the same or in neighbouring blocks (their sizes differ by less than the base)."""
    return int(np.log(n) / -np.log(percent / 100 - 0.01))


def _leading_panel(sketch, percent: int, shingle: int, seed: int):
    whole = _columns(shingle, seed)

    def run(batches):
        counts = sketch.value
        for batch in whole(batches):
            firsts, sizes = [], [len(c) // 8 for c in batch.column("columns").to_pylist()]
            for row in batch.column("columns").to_pylist():
                columns = np.frombuffer(row, "<u8")
                often = counts[(columns & np.uint64(len(counts) - 1)).astype(np.int64)]
                firsts.append(columns[np.lexsort((columns, often))[: leading(len(columns), percent)]])
            times = [len(c) for c in firsts]
            blocks = np.array([size_block(n, percent) for n in sizes], dtype=np.int32)
            flat = np.concatenate([*firsts, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            spread = lambda values, kind: pa.array(np.repeat(np.asarray(values), times), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), spread(batch.column("set_id").to_numpy(), pa.int64()), spread(np.array(sizes, dtype=np.int64), pa.int64()), spread(blocks, pa.int32())], ["column", "set_id", "n", "block"])

    return run


def _shared(batches):
    """Entries of columns with at least two rows, each once; entries come sorted by (column, row)."""
    waiting, paired_before = None, False  # the last entry waits for the next one of its column
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if waiting is None else [waiting, batch])
        column, row = table.column("column").to_numpy(), table.column("set_id").to_numpy()
        first = np.append(True, (column[1:] != column[:-1]) | (row[1:] != row[:-1]))
        table, column = table.filter(pa.array(first)), column[first]
        goes_on = column[1:] == column[:-1]
        paired = np.append(goes_on, False) | np.append(paired_before, goes_on)
        yield from table.slice(0, len(column) - 1).filter(pa.array(paired[:-1])).to_batches()
        waiting, paired_before = table.slice(len(column) - 1).combine_chunks().to_batches()[0], bool(paired[-1])
    if paired_before:
        yield waiting


def overlap(a: np.ndarray, b: np.ndarray, least: int, panel: int = PANEL) -> int:
    """Shared numbers of two sorted sets, panel by panel; stops at a count that can't reach ``least`` any more."""
    if len(a) > len(b):
        a, b = b, a
    found = 0
    for at in range(0, len(a), panel):
        part = a[at:at + panel]
        some = b[np.searchsorted(b, part[0]):np.searchsorted(b, part[-1], side="right")]
        if len(some):
            found += int((some[np.minimum(np.searchsorted(some, part), len(some) - 1)] == part).sum())
        if found + len(a) - at - len(part) < least:
            break
    return found


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            links = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "columns_a", "columns_b"))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                least = -(-percent * (len(x) + len(y)) // (100 + percent))
                links.append(overlap(x, y, least) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


class Matrix:
    """The rows of the incidence matrix: narrow in the run folder, their columns made again from the texts
    where they are asked for (written out they would take more room than the texts)."""

    def __init__(self, docs: DataFrame, folder: str, shingle: int = SHINGLE, percent: int = PERCENT):
        small_batches(docs.sparkSession)
        self.folder, self.shingle, self.percent = folder, shingle, percent
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
        size = sketch_size(self.texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        layout = "doc_id long, text_hash long, n_shingles long, set_id long, proof long, slice int, counts binary"
        for self.seed in count(7, 2):
            made = stored(self.texts.mapInArrow(_sets(shingle, self.seed, size), layout), f"{folder}/sets-{self.seed}")
            self.rows = made.filter(F.col("slice").isNull()).drop("slice", "counts")
            if self.rows.groupBy("set_id").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).filter("lo <> hi").isEmpty():
                break
        self.sketch = docs.sparkSession.sparkContext.broadcast(column_sketch(made.filter(F.col("slice").isNotNull()).select("slice", "counts"), size))

    def panel(self) -> DataFrame:
        """column, set_id, n, block of the leading panel, without columns of one row."""
        entries = self.texts.select("text").mapInArrow(_leading_panel(self.sketch, self.percent, self.shingle, self.seed), "column long, set_id long, n long, block int")
        return stored(entries.repartition("column").sortWithinPartitions("column", "set_id").mapInArrow(_shared, entries.schema), f"{self.folder}/panel")

    def columns(self, set_ids: DataFrame, folder: str) -> DataFrame:
        """set_id, columns of some rows; one text of each is read again."""
        # both are written first, so that the planner knows their size before texts would be shuffled for them
        some = stored(set_ids, f"{folder}/taking-part")
        texts = stored(self.rows.join(some, "set_id").groupBy("set_id").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct(), f"{folder}/texts")
        made = self.texts.join(texts, "text_hash", "left_semi").select("text").mapInArrow(_columns(self.shingle, self.seed), "set_id long, columns binary")
        return stored(made.groupBy("set_id").agg(F.any_value("columns").alias("columns")), f"{folder}/rows")

    def links(self, cells: DataFrame, folder: str) -> DataFrame:
        """The (a, b) cells whose rows really link; only rows that take part in a cell travel, each text once."""
        cells = stored(cells, f"{folder}/cells")
        whole = self.columns(cells.select(F.col("a").alias("set_id")).unionByName(cells.select(F.col("b").alias("set_id"))).distinct(), folder)
        side = lambda c: whole.select(F.col("set_id").alias(c), F.col("columns").alias(f"columns_{c}"))
        met = cells.join(side("b"), "b").join(side("a"), "a").select("a", "b", "columns_a", "columns_b")
        return stored(met.mapInArrow(_verified(self.percent), "a long, b long"), f"{folder}/links")

    def tile_links(self, cells: DataFrame, folder: str) -> DataFrame:
        """Links that join the rows of cells as all their links do; whole rows travel by tiles."""
        cells = stored(cells, f"{folder}/cells")
        members = stored(cells.mapInArrow(_taking_part, "tile long, set_id long").distinct(), f"{folder}/members")
        whole = self.columns(members.select("set_id").distinct(), folder)
        packed = members.join(whole, "set_id").groupBy("tile").agg(F.collect_list(F.struct("set_id", "columns")).alias("rows"))
        side = lambda c: packed.select(F.col("tile").alias(f"tile_{c}"), F.col("rows").alias(f"rows_{c}"))
        met = cells.join(side("a"), "tile_a").join(side("b"), "tile_b").select("cells", "rows_a", "rows_b")
        return stored(met.mapInArrow(_tile_links(self.percent), "a long, b long"), f"{folder}/links")


def _may_link(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _lifted(counted: DataFrame, percent: int) -> DataFrame:
    """Cells (a, b, n, m, found) whose leading overlap the rest of the rows can lift to the bound: they add at
    most what lies beyond the leading columns of one of the two."""
    least = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent))
    beyond = lambda c: F.ceil(F.lit(percent) * F.col(c) / F.lit(100)) - 1
    return counted.filter(F.col("found") + F.greatest(beyond("n"), beyond("m")) >= least).select("a", "b")


def _leader_cells(panel: DataFrame, percent: int, leaders: int = 1) -> DataFrame:
    """Each row with some leaders of its column and block (the smallest rows by as many hashes), where the
    leading panel allows a link. A panel with roots gives cells between different groups only."""
    picks = [F.min(F.struct(F.xxhash64("set_id", F.lit(i)).alias("h"), "set_id"))["set_id"] for i in range(leaders)]
    led = panel.groupBy("column", "block").agg(F.array_distinct(F.array(*picks)).alias("b")).withColumn("b", F.explode("b"))
    met = panel.join(led, ["column", "block"]).filter("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()
    rooted = "root" in panel.columns
    side = lambda c, n: panel.select("column", F.col("set_id").alias(c), F.col("n").alias(n), *([F.col("root").alias(f"root_{c}")] if rooted else []))
    found = met.join(side("a", "n"), "a").join(side("b", "m"), ["b", "column"]).filter(_may_link("n", "m", percent))
    found = found.filter("root_a <> root_b") if rooted else found
    return _lifted(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("found"), F.any_value("n").alias("n"), F.any_value("m").alias("m")), percent)


def _open_panel(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of columns that still hold several groups, with their group."""
    placed = panel.join(groups, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    several = placed.groupBy("column").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("column")
    return placed.join(several, "column", "left_semi")


def _tiles(still: DataFrame) -> DataFrame:
    """set_id, tile of the open rows. Rows lie with others that hold the same most frequent column of theirs, at
    most about TILE rows or TILE_ENTRIES entries together; any tiling gives the same links."""
    often = still.groupBy("column").agg(F.count(F.lit(1)).alias("held"))
    home = still.join(often, "column").groupBy("set_id").agg(F.max(F.struct("held", "column"))["column"].alias("home"), F.count(F.lit(1)).alias("entries"))
    parts = home.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("entries") / TILE_ENTRIES)).alias("parts"))
    return home.join(parts, "home").select("set_id", F.xxhash64("home", F.pmod(F.xxhash64("set_id"), F.col("parts"))).alias("tile"))


def _flat(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """All columns of a tile's rows, and the row of each."""
    columns = rows.field("columns")
    if pa.types.is_list(columns.type):
        sizes, flat = np.diff(columns.offsets.to_numpy()), columns.flatten().to_numpy().view(np.uint64)
    else:
        packed = columns.to_pylist()
        sizes, flat = np.array([len(c) // 8 for c in packed], dtype=np.int64), np.frombuffer(b"".join(packed), "<u8")
    return flat, np.repeat(np.arange(len(sizes)), sizes)


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], panel: int = PANEL) -> np.ndarray:
    """Overlaps of all rows of two tiles: incidence times transpose, by panels of the columns both hold."""
    both = np.intersect1d(a[0], b[0])
    out = np.zeros(shape, dtype=np.int64)
    held = []
    for columns, row in (a, b):
        at = np.searchsorted(both, columns)
        known = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == columns) if len(both) else at[:0]
        known = known[np.argsort(at[known], kind="stable")]
        held.append((at[known], row[known]))
    for start in range(0, len(both), panel):
        sides = []
        for (at, row), n in zip(held, shape):
            lo, hi = np.searchsorted(at, [start, start + panel])
            side = np.zeros((n, min(panel, len(both) - start)), dtype=np.float32)
            side[row[lo:hi], at[lo:hi] - start] = 1
            sides.append(side)
        # 32-bit floats hold counts of a panel exactly
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _least(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (n[:, None] + m[None, :]) // (100 + percent))


def _tile_cells(percent: int):
    """Cells of a tile pair that the leading overlap leaves over: rows of different groups."""

    def run(batches):
        for batch in batches:
            kept = []
            for x, y, same in zip(batch.column("rows_a"), batch.column("rows_b"), batch.column("same").to_pylist()):
                x, y = x.values, y.values
                (a, n, root_a), (b, m, root_b) = ([rows.field(c).to_numpy() for c in ("set_id", "n", "root")] for rows in (x, y))
                found = product(_flat(x), _flat(y), (len(a), len(b)))
                beyond = np.maximum((-(-percent * n // 100) - 1)[:, None], (-(-percent * m // 100) - 1)[None, :])
                left = (found > 0) & (found + beyond >= _least(n, m, percent)) & (root_a[:, None] != root_b[None, :])
                left &= (n[:, None] * 100 >= m[None, :] * percent) & (m[None, :] * 100 >= n[:, None] * percent)
                if same:
                    left &= a[:, None] < b[None, :]
                i, j = np.nonzero(left)
                kept.append(np.column_stack([a[i], b[j]]).astype("<i8").tobytes() if len(i) else None)
            out = pa.RecordBatch.from_arrays([batch.column("tile_a"), batch.column("tile_b"), pa.array(kept, pa.binary())], ["tile_a", "tile_b", "cells"])
            yield out.filter(out.column("cells").is_valid())

    return run


def _group_cells(still: DataFrame, percent: int, tiles: DataFrame | None = None) -> DataFrame:
    """tile_a, tile_b, cells: per pair of tiles the (set_id, set_id) cells between rows of different groups with
    enough shared leading columns. Only tiles with a common column meet; rows of a dense column meet within tasks."""
    placed = still.join(_tiles(still) if tiles is None else tiles, "set_id")
    met = placed.groupBy("column", "tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    side = lambda c: met.select("column", *[F.col(x).alias(f"{x}_{c}") for x in ("tile", "lo", "hi", "least", "most")])
    in_reach = (F.col("most_a") * 100 >= F.col("least_b") * percent) & (F.col("most_b") * 100 >= F.col("least_a") * percent)
    several = F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b")
    pairs = side("a").join(side("b"), "column").filter((F.col("tile_a") <= F.col("tile_b")) & in_reach & several).select("tile_a", "tile_b").distinct()
    rows = placed.groupBy("tile", "set_id").agg(F.any_value("n").alias("n"), F.any_value("root").alias("root"), F.collect_list("column").alias("columns"))
    packed = rows.groupBy("tile").agg(F.collect_list(F.struct("set_id", "n", "root", "columns")).alias("rows"))
    whole = lambda c: packed.select(F.col("tile").alias(f"tile_{c}"), F.col("rows").alias(f"rows_{c}"))
    joined = pairs.join(whole("a"), "tile_a").join(whole("b"), "tile_b").select("tile_a", "tile_b", "rows_a", "rows_b", (F.col("tile_a") == F.col("tile_b")).alias("same"))
    return joined.mapInArrow(_tile_cells(percent), "tile_a long, tile_b long, cells binary")


def _taking_part(batches):
    """tile, set_id of the rows in cells."""
    for batch in batches:
        found: dict[int, set] = {}
        for a, b, cells in zip(*(batch.column(c).to_pylist() for c in ("tile_a", "tile_b", "cells"))):
            cells = np.frombuffer(cells, "<i8").reshape(-1, 2)
            for tile, rows in ((a, cells[:, 0]), (b, cells[:, 1])):
                found.setdefault(tile, set()).update(np.unique(rows).tolist())
        times = [len(rows) for rows in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(found), dtype=np.int64), times)), pa.array([r for rows in found.values() for r in rows], pa.int64())], ["tile", "set_id"])


def _forest(a: list[int], b: list[int]) -> list[bool]:
    """Which links join what those before them left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for x, y in zip(a, b):
        x, y = find(x), find(y)
        root[x] = y
        keep.append(x != y)
    return keep


def _tile_links(percent: int):
    """Links of a tile pair by the whole rows; of links that close a circle none."""

    def run(batches):
        for batch in batches:
            for x, y, cells in zip(batch.column("rows_a"), batch.column("rows_b"), batch.column("cells").to_pylist()):
                x, y, cells = x.values, y.values, np.frombuffer(cells, "<i8").reshape(-1, 2)
                (of_x, row_x), (of_y, row_y) = _flat(x), _flat(y)
                n, m = np.bincount(row_x, minlength=len(x)), np.bincount(row_y, minlength=len(y))
                linked = product((of_x, row_x), (of_y, row_y), (len(x), len(y))) >= _least(n, m, percent)
                at = []
                for rows, wanted in ((x, cells[:, 0]), (y, cells[:, 1])):
                    ids = rows.field("set_id").to_numpy()
                    order = np.argsort(ids)
                    at.append(order[np.searchsorted(ids[order], wanted)])
                cells = cells[linked[at[0], at[1]]]
                cells = cells[np.array(_forest(cells[:, 0].tolist(), cells[:, 1].tolist()), dtype=bool)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cells[:, 0])), pa.array(np.ascontiguousarray(cells[:, 1]))], ["a", "b"])

    return run


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id, root (a set_id, one per group) and component_id of every row."""
    folder = run_folder(docs.sparkSession, "jaccard")
    matrix = Matrix(docs, folder, shingle, percent)
    panel = matrix.panel()
    links = matrix.links(_leader_cells(panel, percent), f"{folder}/leaders")
    for turn in range(2):
        groups = stored(components(links, f"{folder}/led-{turn}").select(F.col("node").alias("set_id"), "root"), f"{folder}/groups-{turn}")
        panel = stored(_open_panel(panel, groups), f"{folder}/open-{turn}")
        if turn:
            cells = _group_cells(panel, percent, stored(_tiles(panel), f"{folder}/tiles"))
            links = links.unionByName(matrix.tile_links(cells, f"{folder}/between-{turn}"))
        else:
            links = links.unionByName(matrix.links(_leader_cells(panel, percent, LEADERS), f"{folder}/between-{turn}"))
            panel = panel.drop("root")
    whole = components(links, f"{folder}/all").select(F.col("node").alias("set_id"), "root")
    narrow = matrix.rows.select("doc_id", "text_hash", "n_shingles", "set_id")
    least = narrow.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    placed = stored(least.join(whole, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), f"{folder}/placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    resolved = placed.join(smallest, "root").select("set_id", "root", "component_id")
    linked = narrow.filter("n_shingles > 0").join(resolved, "set_id")
    alone = narrow.filter("n_shingles = 0").select("*", F.col("set_id").alias("root"), F.col("doc_id").alias("component_id"))
    columns = ["doc_id", "text_hash", "n_shingles", "set_id", "root", "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns))
