"""The queries' results in DuckDB SQL, by other ways than the operators': whole sets and
strings are compared, no hash filter, index or transform. They rest on doc_id being a key."""

from __future__ import annotations

from .media import TILE, WIDTH, npy_bytes, np


def _words(c: str) -> str:
    return f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


#: The 256 steps of CRC-32, as one row with a list.
_CRC_TABLE = """steps AS (
  SELECT k, k AS c, 0 AS step FROM range(256) r(k) UNION ALL SELECT k, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM steps WHERE step < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY k) AS table_ FROM steps WHERE step = 8)"""


def _crc32(hex_bytes: str) -> str:
    """CRC-32 of bytes in hexadecimal; the query joins the table crc."""
    numbers = f"list_transform(regexp_extract_all({hex_bytes}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(coalesce(list_reduce({numbers}, lambda a, b: xor(a >> 8, table_[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295), 4294967295)"


DECONTAM = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), i AS (SELECT item_id, {_words('text')} AS v FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM d), ip AS (SELECT item_id, v, unnest(range(1, len(v))) AS p FROM i),
dg AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] AS g FROM dp), ig AS (SELECT item_id, p, v[p] || ' ' || v[p + 1] AS g FROM ip),
lines AS ( -- four of five equal words have two equal neighbours
  SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS line FROM dg JOIN ig USING (g)
  UNION SELECT doc_id, item_id, 0 FROM d JOIN i ON w = v WHERE len(v) = 1
), aligned AS (
  SELECT doc_id, item_id, greatest(line, 0) AS start_word, len(v) AS n_item, least(len(v), 13) AS width,
    list_transform(range(greatest(line, 0) + 1, least(len(w), len(v) + line) + 1), lambda p: (w[p] = v[p - line])::INT) AS eq
  FROM lines JOIN d USING (doc_id) JOIN i USING (item_id)
), scored AS (
  SELECT *, list_sum(eq) AS matched, list_max(list_transform(range(1, len(eq) - width + 2), lambda k: list_sum(eq[k:k + width - 1]))) AS best FROM aligned WHERE len(eq) >= width AND 10 * list_sum(eq) >= 8 * width
)
SELECT doc_id, item_id, start_word::INT AS start_word, n_item::INT AS n_item, matched::INT AS matched FROM scored WHERE 10 * best >= 8 * width
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start_word) = 1
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_words('text')} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS ( -- a component's smallest id reaches all of it over larger ones
  SELECT DISTINCT a AS doc_id, a AS r FROM edges
  UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id WHERE reach.r < e.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""

REPEATS = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), places AS (
  SELECT doc_id, h, unnest(range(n - 99)) AS p FROM texts WHERE n >= 100
), windows AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS w FROM places
), repeats AS (
  SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1
), covered AS (
  SELECT doc_id, p AS a, p + 100 AS b, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM repeats
), numbered AS (
  SELECT doc_id, a, b, sum((reach IS NULL OR a > reach)::INT) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM covered
), spans AS (
  SELECT doc_id, span, min(a) AS a, max(b) AS b FROM numbered GROUP BY ALL
), pieces AS (
  SELECT doc_id, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS piece, a, b, h, n, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM spans JOIN texts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), result AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) || any_value(substr(h, 2 * b + 1, 2 * (n - b))) FILTER (last) AS rest FROM pieces GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM texts LEFT JOIN result USING (doc_id)
"""


def _name_position(name: str) -> str:
    return f"{name}_at AS (SELECT {name} AS v, (sum(w) OVER (ORDER BY {name} NULLS FIRST) - w / 2) / sum(w) OVER () AS at FROM (SELECT {name}, sum(size)::DOUBLE AS w FROM named GROUP BY {name}))"


def shards_sql(levels: int = 4) -> str:
    """2 ** levels shards: in each level every node's rows are laid out along its widest
    dimension, and cut where its bytes are halved."""
    out = f"""
WITH RECURSIVE {_CRC_TABLE}, texts AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, octet_length(encode(t)) + 1 AS size, length(t) AS chars, {_crc32('h')}::BIGINT AS crc, t,
    CASE WHEN bool_or(source IS NULL) OVER (PARTITION BY t) THEN NULL ELSE min(source) OVER (PARTITION BY t) END AS source,
    CASE WHEN bool_or(lang IS NULL) OVER (PARTITION BY t) THEN NULL ELSE min(lang) OVER (PARTITION BY t) END AS lang FROM texts, crc
), named AS (SELECT doc_id, size, crc, source, lang, log2(size) AS log_size, (size - 1 - chars) / size AS beyond FROM sized),
{_name_position('source')}, {_name_position('lang')}, l0 AS (
  SELECT doc_id, size, crc, row_number() OVER () AS row_, 0 AS node, [s.at, l.at, log_size, beyond] AS dims FROM named JOIN source_at s ON s.v IS NOT DISTINCT FROM source JOIN lang_at l ON l.v IS NOT DISTINCT FROM lang
), whole AS (SELECT [{', '.join(f'coalesce(nullif(max(dims[{k}]) - min(dims[{k}]), 0), 1)' for k in range(1, 5))}] AS whole FROM l0)"""
    for level in range(levels):
        ratios = ", ".join(f"(max(dims[{k}]) - min(dims[{k}])) / any_value(whole[{k}])" for k in range(1, 5))
        out += f""", e{level} AS (SELECT node, [{ratios}] AS r, sum(size) AS total FROM l{level}, whole GROUP BY node),
o{level} AS (SELECT doc_id, size, crc, row_, node, dims, total / 2 AS goal, sum(size) OVER (PARTITION BY node ORDER BY dims[list_position(r, list_max(r))], crc, doc_id, row_) AS upto FROM l{level} JOIN e{level} USING (node)),
l{level + 1} AS (SELECT doc_id, size, crc, row_, dims, node + CASE WHEN upto < goal OR (upto - size < goal AND upto - goal <= goal - upto + size) THEN 0 ELSE {2 ** (levels - level - 1)} END AS node FROM o{level})"""
    return out + f""", dealt AS (SELECT doc_id, size, crc AS text_crc32, node, {_crc32("hex(encode(doc_id || ':' || l.crc))")} % 4 AS bucket FROM l{levels} l, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, node AS shard, (row_number() OVER (PARTITION BY node ORDER BY bucket, doc_id, text_crc32) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM dealt
"""


def _tile(name: str, rows: int, cols: int) -> str:
    """Area means of rows x cols cells: first along the columns, then along the rows."""
    width, height = f"({WIDTH} / {cols}.0::DOUBLE)", f"(r / {rows}.0::DOUBLE)"
    return f"""{name}_x AS (
  SELECT doc_id, r, i, b, sum(v * (least(j + 1, (b + 1) * {width}) - greatest(j, b * {width}))) AS v FROM pixels, range({cols}) c(b) WHERE j + 1 > b * {width} AND j < (b + 1) * {width} GROUP BY ALL
), {name} AS (
  SELECT doc_id, a, b, sum(v * (least(i + 1, (a + 1) * {height}) - greatest(i, a * {height}))) / ({width} * {height}) AS v FROM {name}_x, range({rows}) c(a) WHERE i + 1 > a * {height} AND i < (a + 1) * {height} GROUP BY doc_id, r, a, b
)"""


_NPY_HEAD = npy_bytes(np.zeros((TILE, TILE), np.uint8))[: -TILE * TILE].hex()
IMAGES = f"""
WITH RECURSIVE {_CRC_TABLE}, texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), padded AS (
  SELECT doc_id, n, greatest(1, (n + {WIDTH - 1}) // {WIDTH}) AS r, rpad(h, greatest(1, (n + {WIDTH - 1}) // {WIDTH})::INT * {2 * WIDTH}, '0') AS p FROM texts
), stored AS (
  SELECT *, hex(encode('P5' || chr(10) || '{WIDTH} ' || r || chr(10) || '255' || chr(10))) || p AS m FROM padded
), samples AS (
  SELECT doc_id, r, unnest(regexp_extract_all(p, '..')) AS x, generate_subscripts(regexp_extract_all(p, '..'), 1) - 1 AS k FROM padded
), pixels AS (SELECT doc_id, r, k // {WIDTH} AS i, k % {WIDTH} AS j, ('0x' || x)::INT AS v FROM samples),
{_tile('coarse', 8, 9)}, {_tile('fine', TILE, TILE)}, darker AS (
  SELECT doc_id, a, b, round(v, 6) < lead(round(v, 6)) OVER (PARTITION BY doc_id, a ORDER BY b) AS bit FROM coarse
), bytes AS (SELECT doc_id, a, sum(bit::INT << (7 - b)::INT) AS byte FROM darker WHERE b < 8 GROUP BY ALL),
features AS (SELECT doc_id, string_agg(format('{{:02x}}', byte::INT), '' ORDER BY a) AS feature FROM bytes GROUP BY doc_id),
tiles AS (SELECT doc_id, unhex('{_NPY_HEAD}' || string_agg(format('{{:02x}}', round_even(v, 0)::INT), '' ORDER BY a, b)) AS tile FROM fine GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, r * {WIDTH} AS payload_bytes, sha256(unhex(p)) AS payload_sha256, {_crc32(f'right(p, {2 * WIDTH})')}::BIGINT AS tail_crc32,
  (length(m) // 2)::BIGINT AS media_bytes, sha256(unhex(m)) AS media_sha256, feature, tile
FROM stored JOIN features USING (doc_id) JOIN tiles USING (doc_id), crc
"""


def clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds one after another, every distance computed."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS z FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - z[i]) * (x[i] - z[i])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, min(row({square}::BIGINT, c)) AS m FROM v, c{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT m[2] AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) g(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z FROM s{r} GROUP BY c UNION ALL SELECT c, z FROM c{r} WHERE c NOT IN (SELECT c FROM s{r}))""")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, m[2]::INT AS cluster, m[1] AS distance, sum(m[1]) OVER (PARTITION BY m[2])::BIGINT AS cluster_inertia, sum(m[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = m[2]"""
    )


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v, v q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER w::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"


def _levels(name: str, lists: str) -> str:
    """All levels of trees (tree, l), from the leaves up."""
    return f"{name} AS (SELECT tree, 0 AS lvl, l FROM {lists} UNION ALL SELECT tree, lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM {name} WHERE len(l) > 1)"


def _paths(name: str, nodes: str, levels: str) -> str:
    step = "{'s': l[xor(p >> lvl, 1) + 1], 'left': ((p >> lvl) & 1) = 1}"
    return f"{name} AS (SELECT n.k, list({step} ORDER BY lvl) AS path FROM {nodes} n JOIN {levels} v ON v.tree IS NOT DISTINCT FROM n.tree WHERE len(l) > 1 GROUP BY n.k)"


def manifest_sql() -> str:
    whole, more = (" || ".join(_field(c) for c in ("doc_id", "source", "lang", n, "text")) for n in ("n_chars", "n_chars::HUGEINT + 1"))
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, lang AS tree, sha256({whole}) AS leaf, sha256({more}) AS other, {_crc32("hex(doc_id::VARCHAR)")} AS h FROM documents, crc),
n AS MATERIALIZED (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
trees AS (SELECT tree, list(leaf ORDER BY p) AS l FROM n GROUP BY tree),
{_levels("v", "trees")},
sub AS MATERIALIZED (SELECT tree, l[1] AS subroot FROM v WHERE len(l) = 1),
crown AS MATERIALIZED (SELECT 0 AS tree, tree AS lang, subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS p, p AS k FROM sub),
tops AS (SELECT 0 AS tree, list(subroot ORDER BY p) AS l FROM crown),
{_levels("w", "tops")},
{_paths("low", "n", "v")},
{_paths("high", "crown", "w")},
r AS (SELECT n.*, subroot, (SELECT l[1] FROM w WHERE len(l) = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM n JOIN crown ON crown.lang IS NOT DISTINCT FROM n.tree LEFT JOIN low ON low.k = n.k LEFT JOIN high ON high.k = crown.k),
f AS (SELECT *, list_reduce(path, lambda a, b: {{'s': sha256(CASE WHEN b.s IS NULL THEN a.s WHEN b.left THEN b.s || a.s ELSE a.s || b.s END), 'left': false}}, {{'s': CASE WHEN h % 7 = 0 THEN other ELSE leaf END, 'left': false}}).s AS back FROM r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.s), ''), '')) AS proof_sha256, back AS folded_root, back = root AS verified FROM f
"""
