"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.llm import (
    exact, lm, manifest, mixing, neighbours, packing, pages, rollup, runs, shards, simhash, toxicity, urls,
)
from verdigate.llm.common import Scratch, read, text_of, word_count
from verdigate.sources.ingest import configure

Query = Callable[[SparkSession, str], DataFrame]


def op1_vantage_point_search(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.nearest(read(spark, directory, "embeddings"))


def _rollup(spark: SparkSession, directory: str, first, second) -> DataFrame:
    path = Scratch(spark).folder()
    return rollup.maintain(
        read(spark, directory, "documents"), read(spark, directory, "labels"), path, first, second,
        Scratch(spark),
    )


def op2_token_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """Totals under a word counter and a byte-level BPE vocabulary."""
    bpe = rollup.bpe_counter()(F.col("text"))
    return _rollup(spark, directory, ("words-1", word_count(text_of())), ("byte-bpe-50k", bpe))


def op2_word_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """The same with two counters that SQL has, so that SQL can check it."""
    signs = F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]")), F.lit(0))
    return _rollup(spark, directory, ("words-1", word_count(text_of())), ("signs-1", signs))


def op3_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    return urls.judge(read(spark, directory, "pages"), urls.train(urls.labelled_urls(spark)))


def op4_length_buckets(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(read(spark, directory, "documents"))


def op5_block_naming(spark: SparkSession, directory: str) -> DataFrame:
    found = exact.exact_duplicates(read(spark, directory, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_mixing(spark: SparkSession, directory: str) -> DataFrame:
    docs, labels = read(spark, directory, "documents"), read(spark, directory, "labels")
    mixed = mixing.mix(mixing.sized(docs, labels, Scratch(spark)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_lattice_scores(spark: SparkSession, directory: str) -> DataFrame:
    return lm.lattice_scores(read(spark, directory, "documents"))


def op8_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.score(read(spark, directory, "documents"), read(spark, directory, "labels"))


def op9_simhash_groups(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, directory, "documents"))


def op10_kd_shards(spark: SparkSession, directory: str) -> DataFrame:
    return shards.kd_shards(read(spark, directory, "documents"))


def op11_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    return runs.periodic_runs(read(spark, directory, "documents"))


def op12_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return manifest.merkle_manifest(read(spark, directory, "documents"), Scratch(spark))


def op13_main_text(spark: SparkSession, directory: str) -> DataFrame:
    return pages.main_texts(read(spark, directory, "pages"), Scratch(spark))


OP2_SQL = r"""
WITH counts AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS a,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]')) AS b
  FROM documents),
rated AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
live AS (
  SELECT source, lang, 'words-1' AS tokenizer, a AS tokens
  FROM counts LEFT JOIN rated USING (doc_id) WHERE q IS NULL OR q NOT IN (0, 1)
  UNION ALL
  SELECT source, lang, 'signs-1', b FROM counts JOIN rated USING (doc_id) WHERE q = 1)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
FROM live GROUP BY source, lang, tokenizer
"""

OP5_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS z
  FROM documents),
best AS (
  SELECT z, count(*) AS group_size, sha256(z) AS text_sha256,
         arg_max(doc_id, (n, -doc_id)) AS keep_id
  FROM plain GROUP BY z)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM plain JOIN best USING (z)
"""

OP6_SQL = r"""
WITH docs AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN q IS NULL THEN 1.0 WHEN q > 0 THEN 2.0 ELSE 0.5 END AS w
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1) r
    ON d.doc_id = r.doc_id),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([5, 2, 1][k % 3 + 1] AS DOUBLE) AS w,
         2.0e0 * source_size AS cap FROM sources),
run AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER early, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER early, 0)) AS level
  FROM weighed
  WINDOW early AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, cap / w) AS level FROM run WHERE cap > level * w),
targets AS (
  SELECT source, source_size,
         CASE WHEN final.level IS NULL THEN cap ELSE least(cap, final.level * w) END AS target
  FROM run CROSS JOIN final),
placed AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (
           PARTITION BY docs.source
           ORDER BY -ln((CAST('0x' || substr(md5('mix-1|' || doc_id), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0) / w, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (CASE WHEN size > 0 THEN epochs ELSE 0 END
         + CASE WHEN size > 0 AND start + size / 2.0e0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(i)),
tables AS (SELECT list(v ORDER BY i) AS t FROM crc),
checked AS (
  SELECT doc_id, list_reduce(
           list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) CROSS JOIN tables),
fields AS (
  SELECT d.doc_id, lang, text,
         coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed_chars
  FROM documents d LEFT JOIN checked USING (doc_id)),
leaves AS (
  SELECT doc_id, lang,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(CAST(changed_chars AS VARCHAR)) || ':' || changed_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) AS changed
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2
  FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 2, size),
subroots AS (SELECT tree, level AS height, digest AS subroot FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, tree AS pos, subroot AS digest, count(*) OVER () AS size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2
  FROM tops WHERE size > 1 GROUP BY level, pos // 2, size),
steps AS (
  SELECT p.tree, p.pos, n.level AS step, n.digest, n.pos % 2 = 0 AS before
  FROM placed p JOIN nodes n ON n.tree = p.tree AND n.pos = xor(p.pos >> n.level, 1)
  UNION ALL
  SELECT p.tree, p.pos, s.height + t.level, t.digest, t.pos % 2 = 0
  FROM placed p JOIN subroots s USING (tree) JOIN tops t ON t.pos = xor(p.tree >> t.level, 1)),
shape AS (
  SELECT tree, s.height + (SELECT max(level) FROM tops) AS top FROM subroots s),
proofs AS (SELECT tree, pos, string_agg(digest, '' ORDER BY step) AS way FROM steps GROUP BY tree, pos),
folds AS (
  SELECT tree, pos, 0 AS step, changed AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1,
         sha256(CASE WHEN s.before THEN s.digest ELSE '' END || f.digest || CASE WHEN s.before THEN '' ELSE coalesce(s.digest, '') END)
  FROM folds f JOIN shape ON shape.tree = f.tree AND f.step < shape.top
  LEFT JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step),
root AS (SELECT digest AS root FROM tops WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(way, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM placed p JOIN subroots USING (tree) JOIN shape USING (tree) CROSS JOIN root
LEFT JOIN proofs ON proofs.tree = p.tree AND proofs.pos = p.pos
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.step = shape.top
"""

SQL = {"op12_merkle_manifest": OP12_SQL, "op2_word_rollup": OP2_SQL, "op5_block_naming": OP5_SQL, "op6_mixing": OP6_SQL}

_ALL = (
    op1_vantage_point_search, op2_token_rollup, op2_word_rollup, op3_url_filter, op4_length_buckets,
    op5_block_naming, op6_mixing, op7_lattice_scores, op8_toxicity, op9_simhash_groups, op10_kd_shards,
    op11_periodic_runs, op12_merkle_manifest, op13_main_text,
)


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return query(configure(spark), directory)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {q.__name__: _configured(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
