"""One query for each training-data operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import compaction, exact_dedup, id_files, licenses, lm_score, mixing, ngram_join, packing, pii, quality
from loomspan.llm.common import new_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as small shards, compacted, and read back through the last manifest."""
    store = compaction.ShardStore(spark, new_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum(older_than_s=0)  # a store of this query alone
    return store.read().selectExpr("doc_id", "source", "lang", "n_chars", "sha2(coalesce(text, ''), 256) AS text_sha256")


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return id_files.read_ids(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ngram_join.jaccard_join(table(spark, sf_dir, "documents"))
    return rows.selectExpr("id AS doc_id", "n_shingles", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_slot: the document's first slot in the mix, -1 for none; n_slots: in how many it lies."""
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.selectExpr("id AS doc_id", "size", "source_size", "target", "taken", "coalesce(array_min(passes), -1) AS first_slot", "n_slots")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.feistel_pseudonyms(table(spark, sf_dir, "documents")).drop("spans")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_lm_score, op2_compaction, op3_id_files, op4_quality, op5_ngram_jaccard, op6_exact_dedup, op7_packing, op8_mixing, op9_pseudonyms, op10_licenses)
    return {f.__name__: f for f in every}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed text: white space of the contracts in DuckDB's regex syntax.
_SPACE = r"[\x20\x09-\x0D]+"
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_compaction": "SELECT doc_id, source, lang, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
        "op5_ngram_jaccard": f"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
                  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
            FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)""",
        "op6_exact_dedup": f"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY norm)""",
        "op8_mixing": f"""
            WITH d AS (SELECT doc_id, source, {_SIZE} AS size,
                              md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS code FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
            w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
            c AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM w),
            l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_left FROM c),
            f AS (SELECT *, cap * weights_left >= remaining * weight AS fits FROM l),
            g AS (SELECT source, source_size,
                         CASE WHEN fits THEN CAST(first_value(CAST(remaining AS BIGINT)) OVER (PARTITION BY fits ORDER BY k) * weight AS DOUBLE)
                                             / first_value(CAST(weights_left AS BIGINT)) OVER (PARTITION BY fits ORDER BY k) ELSE CAST(cap AS DOUBLE) END AS target FROM f),
            p AS (SELECT d.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS quota,
                         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY substr(code, 1, 8), doc_id, size) - size AS BIGINT) AS begins
                  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
            goal AS (SELECT source, blocks, sum(blocks) OVER (ORDER BY source NULLS LAST) - blocks AS lo, sum(blocks) OVER () AS total
                     FROM (SELECT source, CAST(ceil(floor(target) / {mixing.BLOCK_WORDS}) AS BIGINT) AS blocks FROM g WHERE floor(target) > 0)),
            points AS (SELECT slot, (CAST(slot AS HUGEINT) * {mixing.STEP} % {mixing.LATTICE}) * (SELECT max(total) FROM goal) // {mixing.LATTICE} AS spot
                       FROM (SELECT unnest(range((SELECT CAST(max(total) AS BIGINT) FROM goal))) AS slot)),
            owned AS (SELECT source, slot, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM points JOIN goal ON spot >= lo AND spot < lo + blocks),
            got AS (SELECT source, count(*) AS n FROM owned GROUP BY source),
            missed AS (SELECT goal.source, lo, total, unnest(range(coalesce(n, 0), blocks)) AS k FROM goal LEFT JOIN got ON goal.source IS NOT DISTINCT FROM got.source WHERE coalesce(n, 0) < blocks),
            slots AS (SELECT source, k, slot FROM owned WHERE k < blocks UNION ALL SELECT source, k, total + lo + k FROM missed),
            runs AS (SELECT doc_id, source, size, begins, unnest(range(begins_at // {mixing.BLOCK_WORDS}, (least(begins_at + size, quota) - 1) // {mixing.BLOCK_WORDS} + 1)) AS k
                     FROM (SELECT *, begins + source_size * pass AS begins_at FROM p, (SELECT unnest([0, 1, 2]) AS pass)) WHERE size > 0 AND begins_at < quota),
            lies AS (SELECT doc_id, runs.source AS source, size, begins, min(slot) AS first_slot, count(*) AS n_slots FROM runs JOIN slots ON runs.source IS NOT DISTINCT FROM slots.source AND runs.k = slots.k GROUP BY doc_id, runs.source, size, begins)
            SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, source_size, target,
                   CAST(greatest(0, least(p.size, quota - p.begins)) + greatest(0, least(p.size, quota - source_size - p.begins))
                        + greatest(0, least(p.size, quota - 2 * source_size - p.begins)) AS BIGINT) AS taken,
                   CAST(coalesce(first_slot, -1) AS BIGINT) AS first_slot, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots
            FROM p LEFT JOIN lies ON p.doc_id IS NOT DISTINCT FROM lies.doc_id AND p.source IS NOT DISTINCT FROM lies.source AND p.size = lies.size AND p.begins = lies.begins""",
    }
