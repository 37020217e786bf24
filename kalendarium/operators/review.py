"""Fuzzy duplicate review: which (region, day) sets are worth judging, their fingerprints, the work
list, and applying or undoing judged merges.

The pre-filter asks only whether a day holds *some* candidate pair, so no pairs are listed. Cheap
tests run as plain aggregates; the costly ones only see days still undecided.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kalendarium import scale
from kalendarium.functions.keys import location_tokens, normalize_title
from kalendarium.functions.similarity import similar
from kalendarium.functions.times import as_ntz
from kalendarium.session import cut_lineage

DAY = ["region_id", "day"]
#: ids per range of a day's digest
ID_RANGE = 65_536
SHORT = 5
# rarest letters first; any fixed order is exact, this one keeps candidate groups small
_RARE_FIRST = "qxyj0123456789vpzkwofbmgculhdstraine"


def display_location() -> Column:
    named = F.concat_ws(" · ", "venue_name", "venue_city")
    return F.when(F.col("venue_name").isNotNull(), named).otherwise(F.col("location_text"))


def day_sets(visible: DataFrame, now: str, horizon: int = 60) -> DataFrame:
    """Each visible event under every day of the horizon it is listed on."""
    first = dt.datetime.fromisoformat(now).date()
    last = first + dt.timedelta(days=horizon - 1)
    end = F.coalesce("ends_at", "starts_at")
    timed_midnight = ~F.col("all_day") & F.col("ends_at").isNotNull() & (F.col("ends_at") == F.to_date("ends_at").cast("timestamp_ntz"))
    until = F.when(timed_midnight, F.date_sub(F.to_date(end), 1)).otherwise(F.to_date(end))
    low, high = F.greatest(F.to_date("starts_at"), F.lit(first)), F.least(until, F.lit(last))
    return visible.withColumns({"_low": low, "_high": high}).filter("_low <= _high").withColumn("day", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def day_fingerprints(sets: DataFrame) -> DataFrame:
    """Digest of the id set per (region, day) in two levels: sha1 of the sorted, comma-joined ids of each
    range of ID_RANGE ids, then sha1 of the comma-joined range digests in order. No task holds all ids of
    a day; unlike a digest of the plain list it needs no bound on their number."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")
    ranges = sets.groupBy(*DAY, F.floor(F.col("id") / ID_RANGE).alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.sha1(ids).alias("_digest"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("_range", "_digest"))), lambda r: r["_digest"])
    return ranges.groupBy(*DAY).agg(F.sum("_n").alias("n"), F.sha1(F.array_join(digests, ",")).alias("fingerprint"))


def _titled(sets: DataFrame) -> DataFrame:
    return sets.withColumn("_t", normalize_title(F.col("title"))).filter(F.col("_t") != "")


def days_with_equal_titles(sets: DataFrame) -> DataFrame:
    counts = _titled(sets).groupBy(*DAY, "_t").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1").select(*DAY).distinct()


def days_with_shared_place(sets: DataFrame) -> DataFrame:
    """Same start time and a common location token, regardless of wording."""
    clock = F.when(F.col("all_day"), "allday").otherwise(F.date_format("starts_at", "HH:mm"))
    tokens = sets.select(*DAY, clock.alias("clock"), F.explode(location_tokens(display_location())).alias("token"))
    return tokens.groupBy(*DAY, "clock", "token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*DAY).distinct()


def _distinct_titles(sets: DataFrame) -> DataFrame:
    """Titles of a day with their first and last place in listing order (the similarity is directed:
    earlier event first)."""
    place = F.struct("starts_at", "id")
    return _titled(sets).groupBy(*DAY, "_t").agg(F.min(place).alias("first"), F.max(place).alias("last"))


def days_with_contained_title(sets: DataFrame) -> DataFrame:
    """One normalized title (five letters or more) inside another. A shorter title is looked up by its
    rarest five-letter piece of that day among the pieces of all titles: exact, and a common word
    does not become the join key."""
    titles = _distinct_titles(sets).select(*DAY, "_t").filter(F.length("_t") >= SHORT)
    starts = F.sequence(F.lit(1), F.length("_t") - (SHORT - 1))
    pieces = titles.withColumn("piece", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("_t", i, F.lit(SHORT))))))
    usage = pieces.groupBy(*DAY, "piece").agg(F.count(F.lit(1)).alias("uses"))
    counted = scale.join_back(pieces, usage.withColumn("_n", F.col("uses")), [*DAY, "piece"], "_t")
    rarest = counted.groupBy(*DAY, "_t").agg(F.min(F.struct("uses", "piece")).alias("r"))
    short = rarest.filter(F.col("r.uses") > 1).select(*DAY, F.col("r.piece").alias("piece"), F.col("_t").alias("short"))
    hits = short.join(pieces, [*DAY, "piece"]).filter((F.col("short") != F.col("_t")) & F.contains("_t", F.col("short")))
    return hits.select(*DAY).distinct()


def _letters(c: Column) -> Column:
    """Letters numbered by occurrence (a1, a2, ...), rarest first: a multiset as a set."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    numbered = F.transform(chars, lambda x, i: F.struct(
        (-F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x))).alias("nth"), F.instr(F.lit(_RARE_FIRST), x).alias("rare"), x.alias("c")
    ))
    return F.transform(F.array_sort(numbered), lambda s: F.concat(s["c"], s["nth"].cast("string")))


def days_with_similar_titles(sets: DataFrame, percent: int = 60) -> DataFrame:
    """Two titles at least ``percent`` covered by common runs. Common runs cannot exceed the common
    letters, so a pair must share one of the first ``len - ceil(share * len) + 1`` letters of both in
    the fixed order; only such pairs, with enough common letters, reach the Python similarity."""
    p = percent / 200
    titles = _distinct_titles(sets).withColumn("n", F.length("_t")).withColumn("letters", _letters(F.col("_t")))
    need = F.ceil(F.col("n") * (p / (1 - p)) - 1e-9)
    keyed = titles.withColumn("head", F.slice("letters", F.lit(1), (F.col("n") - need + 1).cast("int"))).withColumn("key", F.explode("head"))
    a = keyed.select(*DAY, "key", *[F.col(c).alias(f"a_{c}") for c in ("_t", "n", "letters", "head", "first", "last")])
    b = keyed.select(*DAY, "key", *[F.col(c).alias(f"b_{c}") for c in ("_t", "n", "letters", "head", "first", "last")])
    total = F.col("a_n") + F.col("b_n")
    enough = lambda overlap: overlap * 200 >= total * percent
    pairs = (
        a.join(b, [*DAY, "key"])
        .filter((F.col("a__t") < F.col("b__t")) & enough(F.least("a_n", "b_n")))
        .filter(F.col("key") == F.array_intersect("a_head", "b_head")[0])
        .filter(enough(F.size(F.array_intersect("a_letters", "b_letters"))))
    )
    forward = (F.col("a_first") < F.col("b_last")) & similar(F.col("a__t"), F.col("b__t"), percent)
    backward = (F.col("b_first") < F.col("a_last")) & similar(F.col("b__t"), F.col("a__t"), percent)
    return pairs.filter(forward | backward).select(*DAY).distinct()


def days_with_similar_neighbours(sets: DataFrame, percent: int = 60) -> DataFrame:
    """Quick proof for busy days: similarity of alphabetic neighbours sharing the first two letters."""
    titles = _distinct_titles(sets)
    near = F.lag("_t").over(W.partitionBy(*DAY, F.left("_t", F.lit(2))).orderBy("_t"))
    began = F.lag("first").over(W.partitionBy(*DAY, F.left("_t", F.lit(2))).orderBy("_t"))
    pairs = titles.withColumns({"_p": near, "_began": began}).filter(F.col("_began") < F.col("last"))
    return pairs.filter(similar(F.col("_p"), F.col("_t"), percent)).select(*DAY).distinct()


def candidate_days(sets: DataFrame) -> DataFrame:
    """(region, day) sets holding at least one candidate pair. Each test only sees days the cheaper
    ones have not settled."""
    counts = sets.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*DAY)
    busy = sets.join(counts, DAY, "left_semi")
    found = cut_lineage(days_with_equal_titles(busy).unionByName(days_with_shared_place(busy)).distinct())
    for test in (days_with_contained_title, days_with_similar_neighbours, days_with_similar_titles):
        rest = busy.join(found, DAY, "left_anti")
        found = cut_lineage(found.unionByName(test(rest)))
    return found


def worklist(sets: DataFrame, reviewed_days: DataFrame, budget: int | None = None, force: bool = False) -> DataFrame:
    """Days to act on: ``review`` (within the budget, if there is one) or ``store`` (nothing to judge:
    checkpoint only). Regions then days in order; once the budget is spent nothing further is touched."""
    prints = day_fingerprints(sets).filter("n > 1")
    if not force:
        prints = prints.join(reviewed_days.select(*DAY, "fingerprint"), [*DAY, "fingerprint"], "left_anti")
    flagged = prints.join(candidate_days(sets).withColumn("_candidate", F.lit(True)), DAY, "left")
    # at most regions x horizon rows from here on
    calls = F.sum(F.when(F.col("_candidate"), 1).otherwise(0)).over(W.orderBy(*DAY).rowsBetween(W.unboundedPreceding, 0))
    state = F.when(F.col("_candidate"), "review").otherwise("store")
    kept = flagged if budget is None else flagged.withColumn("_calls", calls).filter(F.col("_calls") <= budget)
    return kept.select(*DAY, "n", "fingerprint", state.alias("state"))


def remaining_fingerprints(sets: DataFrame, merges: DataFrame) -> DataFrame:
    """Fingerprints of what was judged minus what was merged away."""
    return day_fingerprints(sets.join(merges.select(F.col("duplicate_id").alias("id")), "id", "left_anti"))


def veto_pairs(decisions: DataFrame) -> DataFrame:
    """Pairs an admin separated, in both directions."""
    undone = decisions.filter(
        F.col("undone_by_admin_at").isNotNull() & F.col("duplicate_event_id").isNotNull() & F.col("canonical_event_id").isNotNull()
    )
    a = undone.select(F.col("duplicate_event_id").alias("duplicate_id"), F.col("canonical_event_id").alias("canonical_id"))
    return a.unionByName(a.select(F.col("canonical_id").alias("duplicate_id"), F.col("duplicate_id").alias("canonical_id"))).distinct()


def valid_proposals(proposals: DataFrame, sets: DataFrame, events: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Both ids in the judged set, distinct, published, canonical free, pair not vetoed."""
    judged = sets.select(*DAY, "id")
    published = events.filter(F.col("status") == "published").select("id", "duplicate_of")
    rows = proposals.filter(F.col("duplicate_id") != F.col("canonical_id")).join(vetoes, ["duplicate_id", "canonical_id"], "left_anti")
    free = published.filter(F.col("duplicate_of").isNull()).select("id")
    for side, pool in (("duplicate_id", published.select("id")), ("canonical_id", free)):
        rows = rows.join(judged.withColumnRenamed("id", side), [*DAY, side], "left_semi").join(pool.withColumnRenamed("id", side), side, "left_semi")
    return rows


def accept_in_order(proposals: DataFrame) -> DataFrame:
    """Proposals that hold when applied one after another (region, day, position): an event demoted
    earlier can neither be demoted again nor be kept as canonical.

    Solved in rounds instead of one by one: a proposal is accepted once every earlier one demoting
    either of its events is rejected, and rejected once one of those is accepted. Each round settles
    at least the first open proposal of every conflict chain."""
    seq = F.struct(*DAY, "position")
    state = cut_lineage(proposals.withColumn("seq", seq).withColumn("verdict", F.lit(None).cast("string")))
    while True:
        live = state.filter(F.coalesce("verdict", F.lit("")) != "rejected")
        firsts = live.groupBy(F.col("duplicate_id").alias("event")).agg(
            F.min(F.struct("seq", F.coalesce(F.col("verdict") == "accepted", F.lit(False)).alias("accepted"))).alias("m")
        )
        open_rows = state.filter(F.col("verdict").isNull())
        for side in ("duplicate", "canonical"):
            sizes = open_rows.groupBy(F.col(f"{side}_id").alias("event")).agg(F.count(F.lit(1)).alias("_n")).join(firsts, "event")
            named = sizes.select(F.col("event").alias(f"{side}_id"), "_n", F.col("m").alias(f"{side}_first"))
            open_rows = scale.join_back(open_rows, named, [f"{side}_id"], "position").drop("_n")
        d, c, own = F.col("duplicate_first"), F.col("canonical_first"), F.col("seq")
        earlier = lambda m: F.coalesce(m["seq"] < own, F.lit(False))
        verdict = (
            F.when((earlier(d) & d["accepted"]) | (earlier(c) & F.coalesce(c["accepted"], F.lit(False))), "rejected")
            .when(~earlier(d) & ~earlier(c), "accepted")
        )
        settled = open_rows.withColumn("verdict", verdict).select(*state.columns)
        state = cut_lineage(state.filter(F.col("verdict").isNotNull()).unionByName(settled))
        if state.filter(F.col("verdict").isNull()).isEmpty():
            return state.filter(F.col("verdict") == "accepted").select(*proposals.columns)


def apply_merges(events: DataFrame, accepted: DataFrame, now: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Events with the accepted duplicates demoted, and the decision rows to log."""
    link = accepted.select(F.col("duplicate_id").alias("id"), F.col("canonical_id").alias("_c"))
    merged = events.join(link, "id", "left").withColumns({
        "status": F.when(F.col("_c").isNotNull(), "duplicate").otherwise(F.col("status")), "duplicate_of": F.coalesce("_c", "duplicate_of"),
    }).select(*events.columns)
    log = accepted.select(
        "day", F.col("duplicate_id").alias("duplicate_event_id"), F.col("canonical_id").alias("canonical_event_id"), "reason",
        F.lit(model).alias("model"), F.lit(True).alias("active"), F.lit(None).cast("timestamp_ntz").alias("undone_by_admin_at"), as_ntz(now).alias("created_at"),
    )
    return merged, log


def undo_merges(events: DataFrame, decisions: DataFrame, chosen: DataFrame, now: str, by_admin: bool) -> tuple[DataFrame, DataFrame]:
    """Take back active decisions (``chosen``: id); an admin's undo leaves a veto."""
    hit = decisions.filter("active").join(chosen.select("id"), "id", "left_semi").select("id", "duplicate_event_id")
    freed = hit.select(F.col("duplicate_event_id").alias("id"), F.lit(True).alias("_free")).distinct()
    back = F.coalesce("_free", F.lit(False)) & (F.col("status") == "duplicate")
    restored = events.join(freed, "id", "left").withColumn("_back", back).withColumns({
        "status": F.when(F.col("_back"), "published").otherwise(F.col("status")),
        "duplicate_of": F.when(~F.col("_back"), F.col("duplicate_of")),
    }).select(*events.columns)
    veto = as_ntz(now) if by_admin else F.col("undone_by_admin_at")
    marked = decisions.join(hit.select("id", F.lit(True).alias("_hit")), "id", "left").withColumns({
        "active": F.when(F.col("_hit"), False).otherwise(F.col("active")),
        "undone_by_admin_at": F.when(F.col("_hit"), veto).otherwise(F.col("undone_by_admin_at")),
    }).select(*decisions.columns)
    return restored, marked


def reset_region(events: DataFrame, decisions: DataFrame, days: DataFrame, region: int, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undo every active merge of a region (re-decidable) and drop its day checkpoints."""
    subject = decisions.select("id", F.coalesce("duplicate_event_id", "canonical_event_id").alias("_event"))
    where = events.select(F.col("id").alias("_event"), "region_id").filter(F.col("region_id") == region)
    restored, marked = undo_merges(events, decisions, subject.join(where, "_event", "left_semi"), now, by_admin=False)
    return restored, marked, days.filter(F.col("region_id") != region)
