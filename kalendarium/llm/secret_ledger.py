"""Secret scans with a ledger of scanned blobs (operator 6).

Every version of every path is addressed by the sha-256 of its text. The ledger remembers which (blob,
rule version) pairs have been scanned and what was found; a run scans only unseen pairs, appends them,
and joins the findings back to all paths and versions that hold the blob. A rule that changes gets a new
version and is scanned again; the other rules of the blob aren't.

Rows: a null text is the empty blob; copies share one blob and one ledger row, and are scanned once per Arrow
batch: only digests and spans are grouped, so no text is shuffled or sorted for a new ledger. Repeated rows come
back as often as they were given. An empty table gives an empty result and an empty ledger batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendarium.llm.common import run_folder, small_batches, stored, text_of


_CREDENTIALS = re.compile(r"://[^\s:/@]+:[^\s:/@]+@")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def url_passwords(text: str) -> Iterator[tuple[int, int]]:
    """Scheme to at-sign of addresses that hold a user and a password, of whatever length. Parsed outwards from
    ``://``: backwards over the scheme, which begins with its first letter, forwards over the credentials."""
    done = 0
    for m in _CREDENTIALS.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _SCHEME:
            start -= 1
        while start < m.start() and not text[start].isalpha():
            start += 1
        if m.start() - start >= 2:
            yield start, m.end()
        done = m.end()


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if ``group`` has ``least`` characters, or a
    ``parser`` that yields the spans. ``cues`` are lower-case strings of which every match holds one: texts
    without them are skipped."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    cues: tuple[str, ...] = ()
    parser: Callable[[str], Iterator[tuple[int, int]]] | None = None


#: in the order in which spans that start together are listed
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\r?\n[A-Za-z-]+: [^\r\n]*)*[A-Za-z0-9+/=\s]*", 0, 1, ("private key",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("url_password", 2, "", 0, 1, ("://",), url_passwords),
)

LEDGER_SCHEMA = "blob string, scanned array<string>, findings array<struct<rule:string,version:int,start:int,end:int>>"


def scan(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, int, int]]:
    low = text.lower() if any(rule.cues for rule in rules) else ""
    found = []
    for rule in rules:
        if rule.cues and not any(cue in low for cue in rule.cues):
            continue
        if rule.parser is not None:
            found += [(rule, start, end) for start, end in rule.parser(text)]
        else:
            for m in re.compile(rule.pattern, re.ASCII).finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((rule, m.start(), m.end()))
    return found


def _tag(rule: Rule) -> str:
    return f"{rule.name}@{rule.version}"


def _scan_missing(rules: tuple[Rule, ...]):
    by_tag = {_tag(r): r for r in rules}

    def run(batches):
        kind = pa.list_(pa.struct([("rule", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            at: dict[str, int] = {}  # the first place of each blob in the batch
            for place, blob in enumerate(batch.column("blob").to_pylist()):
                at.setdefault(blob, place)
            places, texts = pa.array(at.values(), pa.int64()), batch.column("text")
            scanned, found = batch.column("scanned").take(places), []
            for place, tags in zip(at.values(), scanned.to_pylist()):
                hits = scan(texts[place].as_py(), tuple(by_tag[t] for t in tags))
                found.append([{"rule": r.name, "version": r.version, "start": a, "end": b} for r, a, b in hits])
            yield pa.RecordBatch.from_arrays([batch.column("blob").take(places), scanned, pa.array(found, kind)], ["blob", "scanned", "findings"])

    return run


def update_ledger(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the unseen pairs of the given versions, append them below ``ledger`` and return the ledger.
    A batch is one table that Spark commits as a whole, so a failed run leaves nothing half seen."""
    spark = versions.sparkSession
    small_batches(spark)
    blobs = versions.select(F.sha2(text_of(text), 256).alias("blob"), text_of(text).alias("text"))
    wanted = F.array(*[F.lit(_tag(r)) for r in rules])
    seen = read_ledger(spark, ledger)
    if seen is None:
        unseen = blobs.withColumn("scanned", wanted)
    else:
        before = seen.select("blob", F.explode("scanned").alias("tag")).groupBy("blob").agg(F.collect_set("tag").alias("tags"))
        missing = F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))
        unseen = blobs.join(before, "blob", "left").select("blob", "text", missing.alias("scanned")).filter(F.size("scanned") > 0)
    # a new ledger shuffles spans, not texts; copies of a blob bear the same tags and spans
    one_each = unseen.mapInArrow(_scan_missing(rules), LEDGER_SCHEMA).groupBy("blob").agg(F.any_value(F.struct("scanned", "findings")).alias("s"))
    one_each.select("blob", "s.*").write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The given rows (without the text, and columns of these names) with blob and the spans of the current rule versions, by start,
    then in the order of the rules. A blob under a third of all paths is a skewed join, which adaptive
    execution splits; its ledger side is one short row per batch."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (_tag(r), i)])
    tag = lambda f: F.concat(f["rule"], F.lit("@"), f["version"].cast("string"))
    current = ledger.select("blob", F.explode("findings").alias("f")).filter(order[tag(F.col("f"))].isNotNull())
    spans = current.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("f.start"), order[tag(F.col("f"))].alias("place"), F.col("f.end"), F.col("f.rule")))).alias("spans"))
    rest = [c for c in versions.columns if c not in (text, "blob", "spans")]
    keyed = versions.select(*rest, F.sha2(text_of(text), 256).alias("blob"))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,rule:string>>")
    return keyed.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """All rows of documents as versions of their paths against a new ledger."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ledger = update_ledger(rows, run_folder(docs.sparkSession, "ledger"))
    return findings(rows, ledger)
