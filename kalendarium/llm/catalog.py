"""Registered queries of the operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendarium.llm import (
    bit_importance, decontamination, hamming_ann, jaccard_join, licence_rules, line_index, mixing, norm_buckets, pii_anchors, secret_ledger,
    simhash_groups, token_store, toxic_neighbours,
)
from kalendarium.llm.common import run_folder

#: a vocabulary file of the installed tokenizers
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_store.read_tokens(spark, path)


def op2_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_index.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_hamming_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "similarity", "first_word", "n_words", "bits")


def _digest(found: DataFrame, kind: str, base: list[str], text) -> DataFrame:
    of = lambda *names: F.filter("spans", lambda s: s[kind].isin(*names))
    counts = [F.size(of(name)).cast("long").alias(f"n_{name}") for name in base]
    return found.select("doc_id", *counts, F.sha2(text(of(*base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secret_ledger.scan_documents(_table(spark, sf_dir, "documents")), "rule", ["assign", "access", "hex"], secret_ledger.span_text)


def op7_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii_anchors.find_personal_data(_table(spark, sf_dir, "documents")), "kind", ["email", "ip", "card", "phone"], pii_anchors.span_text)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.find_licences(_table(spark, sf_dir, "documents"))


def op10_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_neighbours.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


def op11_bit_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = bit_importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_token_store, op2_line_index, op3_hamming_ann, op4_mixing, op5_decontamination, op6_secret_ledger,
    op7_pii_anchors, op8_simhash_groups, op9_licence_rules, op10_toxic_neighbours,
    op11_bit_importance, op12_jaccard_join, op13_norm_buckets,
)}


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)


_KNOWN = _values([(licence_rules.normal_words(text), name) for name, text in licence_rules.SENTENCES.items()])
_RULES = _values([(licence, rule, "|" + "|".join(ids) + "|", "|" + "||".join(ids) + "|", len(ids)) for rule, (licence, ids) in licence_rules.RULES.items()])

ORACLE = {
    "op2_line_index": r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), held as (
    select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
), judged as (
    select k.*, h.first is not null and h.first <> k.doc_id as gone from keyed k left join held h using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id""",
    "op9_licence_rules": rf"""
with known(words, name) as (values {_KNOWN}), rules(licence, rule, ids, ids_twice, n) as (values {_RULES}), doc as (
    select row_number() over () as rid, doc_id, string_split_regex(lower(coalesce(text, '')), '\n|[.!?][\x20\x09-\x0D]') as parts from documents
), part as (
    select rid, doc_id, unnest(parts) as sentence, generate_subscripts(parts, 1) - 1 as pos from doc
), hit as (
    select rid, doc_id, pos, name, lag(pos) over (partition by rid order by pos) as prev
    from part join known on trim(regexp_replace(sentence, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) = words
), run as (
    select rid, any_value(doc_id) as doc_id, list(pos order by pos) as places,
        '|' || string_agg(case when pos - prev > {licence_rules.MAX_GAP + 1} then '|' else '' end || name, '|' order by pos) || '|' as run
    from hit group by rid
), matching as (select * from run join rules on contains(run, ids))
select doc_id, licence, rule,
    places[len(list_filter(string_split(substr(run, 1, strpos(run, ids)), '|'), lambda x: x <> '')) + 1] as first_sentence,
    (length(replace(run, '|', '||')) - length(replace(replace(run, '|', '||'), ids_twice, ''))) // length(ids_twice) as n_matches
from matching m
where not exists (select 1 from matching o where o.rid = m.rid and o.n > m.n and contains(o.ids, m.ids))""",
}
