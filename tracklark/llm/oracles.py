"""Queries of this subpackage as SQL for DuckDB, where SQL can express them on whole tables."""

from __future__ import annotations

from .mixing import BLOCK_WORDS, PRIMES, SEED, SMALL_BLOCKS, WEIGHTS

#: All quotients are listed and ranked here; the Spark version finds the quotas without such a list.
OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size, md5('{SEED}:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source
), weighted AS (
  SELECT *, ({list(WEIGHTS)})[i % {len(WEIGHTS)} + 1]::double AS weight, 2e0 * source_size AS cap FROM sources
), levels AS (
  SELECT *, cap / weight AS fill, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
  FROM weighted WINDOW below AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, least(cap, coalesce((SELECT arg_min(level, fill) FROM levels WHERE level <= fill), 'inf'::double) * weight) AS target, ceil(source_size / block)::bigint AS n
  FROM (SELECT *, CASE WHEN source_size < {SMALL_BLOCKS * BLOCK_WORDS} THEN 1 ELSE {BLOCK_WORDS} END AS block FROM levels)
), house AS (
  SELECT block, floor(sum(target) / block + 0.5)::bigint AS blocks FROM targets GROUP BY block
), quotients AS (
  SELECT i, block, row_number() OVER (PARTITION BY block ORDER BY target / (2 * b - 1) DESC, i) AS place FROM (SELECT i, block, target, unnest(generate_series(1, 2 * n)) AS b FROM targets)
), quotas AS (
  SELECT i, count(*) AS quota FROM quotients JOIN house USING (block) WHERE place <= blocks GROUP BY i
), turned AS (
  SELECT t.*, coalesce(quota, 0) AS quota, greatest(n, 1) AS m, md5('{SEED}/' || coalesce(source, '')) AS d FROM targets t LEFT JOIN quotas USING (i)
), plans AS (
  SELECT *, list_filter(list_slice({list(PRIMES)}, ('0x' || substr(d, 1, 4))::bigint % {len(PRIMES)} + 1, {len(PRIMES)}) || {list(PRIMES)}, lambda p: p % m <> 0)[1] AS by_, ('0x' || substr(d, 5, 12))::bigint % m AS plus FROM turned
), placed AS (
  SELECT s.doc_id, s.size, p.*, coalesce(sum(s.size) OVER (PARTITION BY i ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS at_ FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
), parts AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN generate_series(at_ // block, (at_ + size - 1) // block) ELSE [NULL] END) AS j FROM placed
), cut AS (
  SELECT *, coalesce(least((j + 1) * block, at_ + size) - greatest(j * block, at_), 0) AS words, (j * coalesce(by_, 0) % m + plus) % m AS pick FROM parts
)
SELECT doc_id, size, source_size, target, coalesce(sum(words * ((pick < quota)::bigint + (pick + m < quota)::bigint)), 0)::bigint AS taken, source FROM cut GROUP BY ALL
"""

#: Links and components for `reps` (id, members, n) and `near` (a, b), both directions.
GROUPS = """
, reach AS (
  SELECT id AS a, id AS b FROM reps UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a
), found AS (
  SELECT id, min(b) AS component_id FROM reps JOIN reach ON id = a GROUP BY id
), counted AS (
  SELECT r.id, r.members - 1 + coalesce(sum(o.members), 0)::bigint AS n_links FROM reps r LEFT JOIN near n ON r.id = n.a LEFT JOIN reps o ON n.b = o.id GROUP BY r.id, r.members
)"""

#: All pairs with a common run of five words are compared.
OP6 = rf"""
WITH RECURSIVE documents_ AS (
  SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') AS told FROM documents
), reps AS (
  SELECT class_id AS id, count(*)::bigint AS members, any_value(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS words FROM documents_ WHERE told GROUP BY class_id
), runs AS (
  SELECT DISTINCT id, hash(array_to_string(list_slice(words, i, i + 4), ' ')) AS run FROM (SELECT id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM reps)
), sizes AS (
  SELECT id, count(*) AS n FROM runs GROUP BY id
), near AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS common FROM runs x JOIN runs y ON x.run = y.run AND x.id <> y.id GROUP BY ALL) JOIN sizes p ON a = p.id JOIN sizes q ON b = q.id WHERE 9 * common >= 4 * (p.n + q.n)
){GROUPS}
SELECT doc_id, class_id, n_links, component_id, doc_id = component_id AS kept FROM documents_ JOIN counted c ON class_id = c.id JOIN found f ON class_id = f.id WHERE told
UNION ALL SELECT doc_id, doc_id, 0, doc_id, true FROM documents_ WHERE NOT told
"""

#: All pairs of a label are compared.
OP3 = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::double[] AS v FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), reps AS (
  SELECT min(vec_id) AS id, count(*)::bigint AS members, label, v FROM valid GROUP BY label, v
), near AS (
  SELECT x.id AS a, y.id AS b FROM reps x JOIN reps y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98
){GROUPS}
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM valid JOIN reps USING (label, v) JOIN counted USING (id) JOIN found USING (id)
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM valid)
"""



def _op11(dimensions: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """Rounds of assignment (all distances) and update, each a table of its own."""
    by = "sum((p[1] - p[2]) * (p[1] - p[2]))"
    nearest = f"SELECT r, min(row(d, c)) AS near FROM (SELECT r, c, (SELECT {by} FROM (SELECT unnest(list_zip(t.v, m.v)) AS p)) AS d FROM kept t, %s m) GROUP BY r"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale}e0 * x::double)::bigint) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({nearest % f'c{i}'})",
            f"s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT near[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{i} USING (r)) GROUP BY c, i)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY i) AS v FROM s{i} GROUP BY c) n USING (c))",
        ]
    parts.append(f"found AS ({nearest % f'c{rounds}'})")
    return f"WITH {', '.join(parts)} SELECT vec_id, near[2]::int AS cluster, near[1]::bigint AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::bigint AS cluster_inertia, (sum(near[1]) OVER ())::bigint AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM kept JOIN found USING (r) JOIN c{rounds} m ON m.c = near[2]"


ORACLE_SQL = {"op11_centroid_clustering": _op11(), "op3_embedding_near_dedup": OP3, "op4_mixing": OP4, "op6_ngram_jaccard_join": OP6}
