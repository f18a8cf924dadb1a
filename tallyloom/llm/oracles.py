"""DuckDB SQL for the corpus queries that SQL expresses on whole tables."""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2)::BIGINT)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY ALL
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix/' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap, (SELECT sum(size) FROM d)::DOUBLE AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, (cap / weight, place)) AS level FROM v WHERE level * weight < cap),
t AS (SELECT source, source_size, place, CASE WHEN v.level * weight >= cap THEN cap ELSE f.level * weight END AS target FROM v LEFT JOIN f ON true),
c AS (SELECT d.*, t.place, source_size, target, coalesce(sum(size) OVER (PARTITION BY t.place ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, round(target)::BIGINT AS given FROM c)
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, given) - start) + greatest(0, least(start + source_size + size, given) - start - source_size) + greatest(0, least(start + 2 * source_size + size, given) - start - 2 * source_size))::BIGINT AS taken FROM x
"""



def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds of op13 one after another, with a row a component."""
    steps = [
        f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale}.0::DOUBLE * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos, q[i] AS x FROM (SELECT r, q, len(q) AS n, unnest(range(1, len(q) + 1)) AS i FROM k)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= {entries})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, min((e, entry)) AS best FROM (SELECT r, part, entry, sum((x - c) * (x - c))::BIGINT AS e FROM x JOIN c{n} USING (part, pos) GROUP BY ALL) GROUP BY ALL)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT part, a{n}.best[2] AS entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM x JOIN a{n} USING (r, part) GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(s{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN s{n} USING (part, entry, pos))")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})")
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"


SQL = {"op2_exact_top_k": TOP_K, "op6_ngram_join": NGRAM_JOIN, "op9_mixing": MIXING, "op13_vector_codes": vector_codes()}
