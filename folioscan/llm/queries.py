"""The driver's queries of the ten operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import line_dedup, mixing, near_dup, perplexity, pieces, quality, syncmers, token_counts, toxicity, warc
from folioscan.llm.common import held_out, load, shared_dir, text_digest

TOXIC_FROM, GOOD_FROM = 0.3, 0.7
#: Target weights of the tree's nodes by name; a node that is not named weighs 1.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 50, 2, "mix"


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def domain_of(source: Column) -> Column:
    """The domain a source belongs to: its number modulo 4; sources without one are of domain 'other'."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string"))).otherwise(F.lit("other"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark, "warc")
    warc.write_archives(load(spark, sf_dir, "pages"), root)
    records = warc.read_archives(spark, root)
    digest = F.coalesce(warc.base32_sha1(F.col("payload")), F.col("payload_digest"))
    return records.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::INT, 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM f
"""


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_neighbours(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    index = line_dedup.LineIndex.build(docs)
    return line_dedup.dedup_lines(docs, index).select("doc_id", "n_lines", "n_dropped", text_digest(F.col("text")).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id <> s.first AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, threshold=GOOD_FROM)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents"), MIX_WEIGHTS, domain_of(F.col("source")), MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


def _share_sql(name: str, nodes: str, parent: list[str], level: str, path: list[str]) -> str:
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"{by} ORDER BY capacity / weight, {level}"
    return f"""
{name}_l AS (SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM ({nodes})),
{name}_f AS (SELECT *, capacity * sharing <= rest * weight AS filled FROM {name}_l),
{name}_o AS (SELECT *, max(CASE WHEN NOT filled THEN rest END) OVER ({by}) AS open_rest,
                   max(CASE WHEN NOT filled THEN sharing END) OVER ({by}) AS open_sharing FROM {name}_f),
{name} AS (SELECT {', '.join(path)}, CASE WHEN filled THEN capacity ELSE least(capacity, weight * open_rest // open_sharing) END AS budget FROM {name}_o)"""


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(level, {}).items())
    return f"CASE {level} {cases} ELSE 1 END" if cases else "1"


OP6_SQL = f"""
WITH r AS (SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> ''
                               THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT % 4)::VARCHAR ELSE 'other' END AS domain,
                  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents WHERE doc_id IS NOT NULL),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {MIX_EPOCHS} AS capacity FROM r GROUP BY ALL),
root AS (SELECT least(sum(capacity), sum(tokens) * {MIX_PERCENT} // 100) AS budget FROM leaf),
{_share_sql('a', f"SELECT domain, {_weight_sql('domain')} AS weight, sum(capacity) AS capacity, any_value(budget) AS budget FROM leaf, root GROUP BY domain", [], 'domain', ['domain'])},
{_share_sql('b', f"SELECT domain, lang, {_weight_sql('lang')} AS weight, sum(capacity) AS capacity, any_value(budget) AS budget FROM leaf JOIN a USING (domain) GROUP BY domain, lang", ['domain'], 'lang', ['domain', 'lang'])},
{_share_sql('c', f"SELECT domain, lang, source, {_weight_sql('source')} AS weight, sum(capacity) AS capacity, any_value(budget) AS budget FROM leaf JOIN b USING (domain, lang) GROUP BY domain, lang, source", ['domain', 'lang'], 'source', ['domain', 'lang', 'source'])},
e AS (SELECT r.*, epoch, md5('{MIX_SEED}:' || epoch || ':' || doc_id) AS place FROM r, (SELECT unnest(range({MIX_EPOCHS})) AS epoch)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens, upto::BIGINT AS upto FROM u JOIN c USING (domain, lang, source) WHERE upto <= budget
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, threshold=TOXIC_FROM)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("terms").cast("long").alias("n_terms"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(load(spark, sf_dir, "documents"), model_file(), decode=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), text_digest(F.col("decoded")).alias("decoded_sha256"), F.coalesce(F.element_at("ends", -1), F.lit(0)).cast("long").alias("covered_bytes")
    )


def sentencepiece_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in full-width letters with ligatures, through a compiled character map; ``spans_sha256`` is of begins and ends."""
    docs = load(spark, sf_dir, "documents")
    wide = F.translate(F.replace("text", F.lit("fi"), F.lit("\ufb01")), "abcdefghijklm", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklm"))
    coded = pieces.encode(docs.withColumn("text", wide), pieces.with_rule(model_file(), "nmt_nfkc"))
    digest = lambda *c: F.sha2(F.array_join(F.concat(*c), ",").cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("begins", "ends").alias("spans_sha256"), F.coalesce(F.element_at("ends", -1), F.lit(0)).cast("long").alias("covered_bytes"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), model_file())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", *perplexity.BASE, "base_failed", "kept", "typical")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_syncmers, op3_line_dedup, op4_near_duplicates, op5_quality, op6_mix_sources, op7_toxicity, op8_sentencepiece, sentencepiece_mapped, op9_token_counts, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_line_dedup": OP3_SQL, "op6_mix_sources": OP6_SQL}
