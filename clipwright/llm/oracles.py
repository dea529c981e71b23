"""SQL twins (DuckDB) of the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(table: str, key: str) -> str:
    """(id, s): distinct runs of five words; of fewer than five words the whole run."""
    return f"""(SELECT DISTINCT id, s FROM (SELECT id, CASE WHEN n < 5 THEN string_agg(w, chr(1)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      ELSE concat_ws(chr(1), w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) END AS s, i, n
      FROM (SELECT id, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i, len(a) AS n FROM (SELECT {key} AS id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS a FROM {table} WHERE text IS NOT NULL)) WINDOW d AS (PARTITION BY id ORDER BY i))
      WHERE n < 5 OR i <= n - 4)"""


def _closure(nodes: str, links: str) -> str:
    """(id, c): the least id that links (a, b), given both ways, reach."""
    return f"""reach AS (SELECT id, id AS other FROM ({nodes}) UNION SELECT r.id, l.b FROM reach r JOIN ({links}) l ON l.a = r.other),
    comp AS (SELECT id, min(other) AS c FROM reach GROUP BY id)"""


OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_closure("SELECT vec_id AS id FROM embeddings", "SELECT * FROM links")}
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id"""

OP4 = f"""WITH RECURSIVE sh AS MATERIALIZED {_shingles("documents", "doc_id")},
sz AS MATERIALIZED (SELECT id, count(*) AS n FROM sh GROUP BY id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2) JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_closure("SELECT doc_id AS id FROM documents", "SELECT * FROM links")}
SELECT doc_id, coalesce(sz.n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents JOIN comp ON comp.id = doc_id LEFT JOIN sz ON sz.id = doc_id"""

OP5 = f"""WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, f.m IS NOT NULL AND f.m <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

OP9 = f"""WITH q AS MATERIALIZED {_shingles("benchmark", "item_id")}, d AS MATERIALIZED {_shingles("documents", "doc_id")}, n AS (SELECT id, count(*) AS n FROM q GROUP BY id)
SELECT item_id, doc_id, n_shared, n.n AS n_item FROM (SELECT q.id AS item_id, d.id AS doc_id, count(*) AS n_shared FROM q JOIN d USING (s) GROUP BY 1, 2) JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n.n"""

_WORD = "[^\\x20\\x09-\\x0D]+"

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{_WORD}') AS a FROM d)),
m AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (NOT regexp_matches(w, '[A-Za-z]|[^\\x00-\\x7F]')) AS letterless,
      count(*) FILTER (length(regexp_replace(w, '[^A-Z]', '', 'g')) > 1 AND NOT regexp_matches(w, '[a-z]')) AS shouted FROM w GROUP BY r),
top AS (SELECT r, max(n) AS commonest FROM (SELECT r, w, count(*) AS n FROM w GROUP BY r, w) GROUP BY r),
g AS MATERIALIZED (SELECT r, i, s, count(*) OVER (PARTITION BY r, s) AS n FROM (SELECT r, i, concat_ws(chr(1), w, lead(w, 1) OVER o, lead(w, 2) OVER o) AS s, lead(w, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE third IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS x(j) WHERE n > 1 GROUP BY r),
li AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(letterless, 0) AS letterless, coalesce(shouted, 0) AS shouted, coalesce(commonest, 0) AS commonest
      FROM d LEFT JOIN m USING (r) LEFT JOIN top USING (r) LEFT JOIN rep USING (r) LEFT JOIN li USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words AND 100 * n_dup_lines <= 50 * n_lines
  AND 100 * letterless <= 30 * n_words AND 100 * shouted <= 50 * n_words AND 100 * commonest <= 30 * n_words AS kept FROM b"""


def _clusters(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """k-means in integers, each round an assignment and a componentwise floor of means."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), q LIMIT {k})"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v.q, c{i}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM (SELECT c, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (SELECT a{i}.c, unnest(v.q) AS x, unnest(range({dims})) AS j FROM v JOIN a{i} USING (r)) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN s{i} USING (c))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST({last}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM v JOIN {last} USING (r) JOIN c{rounds} ON c{rounds}.c = {last}.c"""


OP12 = _clusters()

ORACLE_SQL = {"op11_quality_rules": OP11, "op12_centroid_clusters": OP12, "op2_embedding_neardup": OP2, "op4_ngram_jaccard": OP4, "op5_line_dedup": OP5, "op9_decontamination": OP9}
