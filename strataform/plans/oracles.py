"""DuckDB text for the named queries."""

from __future__ import annotations

from strataform.catalog import ORACLES
from strataform.config import ALPHAS

SPACE = r"'^\s+|\s+$'"
NEAR = 1e-12

PANEL = """panel AS (SELECT label, ord, CASE WHEN ord < 6 THEN 'broad' WHEN ord < 14 THEN 'targeted' ELSE 'candidate' END AS role
 FROM (SELECT DISTINCT source AS label, CAST(substr(source, 4) AS INT) AS ord FROM documents))"""
VPANEL = """panel AS (SELECT label, label AS ord, CASE WHEN label < 4 THEN 'broad' WHEN label < 9 THEN 'targeted' ELSE 'candidate' END AS role
 FROM (SELECT DISTINCT label FROM embeddings))"""
CLASS = """CASE WHEN x.role = 'candidate' OR y.role = 'candidate' THEN 'candidate_pair'
 ELSE least(x.role, y.role) || '_' || greatest(x.role, y.role) END"""
UNORDERED = f"unordered AS (SELECT x.label AS a, y.label AS b, {CLASS} AS pair_class FROM panel x JOIN panel y ON x.ord < y.ord)"
ORDERED = f"ordered AS (SELECT x.label AS a, y.label AS b, {CLASS} AS pair_class FROM panel x JOIN panel y ON x.ord <> y.ord)"
STUDIED = f"unordered AS (SELECT x.label AS a, y.label AS b, {CLASS} AS pair_class FROM panel x JOIN panel y ON x.ord < y.ord WHERE x.role <> 'candidate' AND y.role <> 'candidate')"
DIRECTED = f"""directed AS (SELECT x.label AS a, y.label AS b, {CLASS} AS pair_class,
 CASE WHEN x.role = 'broad' AND y.role = 'targeted' THEN 'forward' WHEN x.role = 'targeted' AND y.role = 'broad' THEN 'reverse'
      WHEN x.ord < y.ord THEN 'forward' ELSE 'reverse' END AS direction
 FROM panel x JOIN panel y ON x.ord <> y.ord WHERE x.role <> 'candidate' AND y.role <> 'candidate')"""


def chunked(size: int = 768, where: str = "") -> str:
    least = max(64, size // 4)
    return f"""stripped AS (SELECT source AS label, doc_id, regexp_replace(text, {SPACE}, '', 'g') AS t FROM documents WHERE text IS NOT NULL {where}),
 wins AS (SELECT label, doc_id, t, unnest(range(0, length(t), {size})) AS s FROM stripped WHERE t <> ''),
 cut AS (SELECT label, doc_id, s, least(length(t), s + {size}) AS e, regexp_replace(substr(t, s + 1, {size}), {SPACE}, '', 'g') AS text FROM wins),
 chunks AS (SELECT label, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_in_document, s AS char_start, e AS char_end, text
  FROM cut WHERE length(text) >= {least})"""


CHUNKS = chunked()
INDEXED = "indexed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id, chunk_in_document) - 1 AS chunk_index FROM chunks) WHERE chunk_index < 2048)"
PATTERNS = {"punct": r"[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[^\sA-Za-z0-9]", "stable": r"[A-Za-z0-9_'']+"}


def grams(tokenizers=("punct",), orders=(1,), source="chunks", keep="label, doc_id, chunk_in_document") -> str:
    """tokens, grams: every n-gram with its place."""
    toks = " UNION ALL ".join(f"SELECT {keep}, '{t}' AS tokenizer, regexp_extract_all(lower(text), '{PATTERNS[t]}') AS w FROM {source}" for t in tokenizers)
    parts = []
    for n in orders:
        gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(1, n + 1))
        parts.append(f"SELECT {keep}, tokenizer, {n} AS n, i AS pos, {gram} AS gram FROM (SELECT *, unnest(range(0, len(w) - {n - 1})) AS i FROM toks WHERE len(w) >= {n})")
    return f"toks AS ({toks}), grams AS ({' UNION ALL '.join(parts)})"


COUNTS = "counts AS (SELECT label, tokenizer, n, gram, count(*) AS cnt, min((doc_id * 100000 + chunk_in_document) * 1000 + pos) AS first FROM grams GROUP BY ALL)"


def cells(pairs: str, sizes=(256,), by: str = "", counts: str = "counts", other: str = "counts") -> str:
    """vocab, cells, lexical: per pair and setting, and per pair. ``by``: a column such as a replicate."""
    k, on = (f"{by}, ", f"AND c.{by} = v.{by}") if by else ("", "")
    vk = f"v.{by}, " if by else ""
    cell = f"a, b, {k}tokenizer, n, s"
    values = ", ".join(f"({v})" for v in sizes)
    return f"""vocab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}label, tokenizer, n ORDER BY cnt DESC, first) AS rank FROM {counts}) WHERE rank <= {max(sizes)}),
 met AS (SELECT p.a, p.b, {vk}v.tokenizer, v.n, s.s, v.rank, v.cnt AS x, coalesce(c.cnt, 0) AS y
  FROM {pairs} p JOIN vocab v ON v.label = p.a JOIN (VALUES {values}) s(s) ON v.rank <= s.s
  LEFT JOIN {other} c ON c.label = p.b AND c.tokenizer = v.tokenizer AND c.n = v.n AND c.gram = v.gram {on}),
 parts AS (SELECT *, (x + 1e-12) / sum(x + 1e-12) OVER w AS p, (y + 1e-12) / sum(y + 1e-12) OVER w AS q,
   rank() OVER (PARTITION BY {cell} ORDER BY x) + (count(*) OVER (PARTITION BY {cell}, x) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY {cell} ORDER BY y) + (count(*) OVER (PARTITION BY {cell}, y) - 1) / 2.0 AS ry FROM met WINDOW w AS (PARTITION BY {cell})),
 cells AS (SELECT {cell}, count(*) AS grams, sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) AS js,
   CASE WHEN stddev_pop(rx) > {NEAR} AND stddev_pop(ry) > {NEAR} THEN (avg(rx * ry) - avg(rx) * avg(ry)) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho
  FROM parts GROUP BY ALL HAVING count(*) >= 64),
 lexical AS (SELECT a, b, {k}avg(js) AS lexical_js, avg(rho) AS rho FROM cells GROUP BY ALL)"""


ONE = f"{PANEL}, {CHUNKS}, {grams()}, {COUNTS}"
FORWARD = f"WITH {ONE}, {STUDIED}, {cells('unordered')}, rows AS (SELECT l.*, u.pair_class FROM lexical l JOIN unordered u USING (a, b))"
BOTH = f"WITH {ONE}, {DIRECTED}, {cells('directed')}, rows AS (SELECT l.*, u.pair_class, u.direction FROM lexical l JOIN directed u USING (a, b))"
FAMILY = "family AS (SELECT pair_class, count(*) AS pairs, avg(lexical_js) AS lexical_js, avg(rho) AS rho FROM rows WHERE pair_class <> 'broad_targeted' OR direction = 'forward' GROUP BY 1)"
at = "max(CASE WHEN pair_class = '{}' THEN {} END)".format
DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)".format

LONG = "long AS (SELECT label, vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings)"
NORMAL = f"{LONG}, norms AS (SELECT label, vec_id, sqrt(sum(value * value)) AS r FROM long GROUP BY ALL), normal AS (SELECT label, vec_id, dim, value / CASE WHEN r = 0 THEN 1 ELSE r END AS value FROM long JOIN norms USING (label, vec_id))"
DISTANCES = f"""{NORMAL}, {VPANEL}, {UNORDERED}, cent AS (SELECT label, dim, avg(value) AS value FROM normal GROUP BY ALL),
 dist AS (SELECT a, b, pair_class, 1 - sum(x.value * y.value) / (sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value))) AS centroid_cosine_distance,
  sqrt(sum((x.value - y.value) * (x.value - y.value))) AS centroid_l2_distance FROM unordered JOIN cent x ON x.label = a JOIN cent y ON y.label = b AND y.dim = x.dim GROUP BY ALL)"""
NEAREST = f"""{LONG}, cent AS (SELECT label AS cluster, dim, avg(value) AS value FROM long GROUP BY ALL),
 d AS (SELECT l.label, l.vec_id, c.cluster, round(sum((l.value - c.value) * (l.value - c.value)), 9) AS d FROM long l JOIN cent c USING (dim) GROUP BY ALL),
 near AS (SELECT label, vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY d, cluster) AS k FROM d) WHERE k = 1)"""
FIXED = f"""{NEAREST}, {VPANEL}, {UNORDERED}, grid AS (SELECT a, b, pair_class, k.k FROM unordered, (SELECT unnest(range(0, 10)) AS k) k),
 occ AS (SELECT label, cluster, count(*) AS n FROM near GROUP BY ALL),
 xy AS (SELECT g.*, coalesce(x.n, 0) + 1e-12 AS x, coalesce(y.n, 0) + 1e-12 AS y FROM grid g LEFT JOIN occ x ON x.label = g.a AND x.cluster = g.k LEFT JOIN occ y ON y.label = g.b AND y.cluster = g.k),
 pq AS (SELECT *, x / sum(x) OVER (PARTITION BY a, b) AS p, y / sum(y) OVER (PARTITION BY a, b) AS q FROM xy),
 fixed AS (SELECT a, b, round(sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))), 6) AS semantic_cluster_js FROM pq GROUP BY ALL)"""
GRAMS1 = f"{PANEL}, {CHUNKS}, {INDEXED}, {grams(('stable',), (1,), 'indexed', 'label, chunk_index')}, byc AS (SELECT label, chunk_index, tokenizer, n, gram, count(*) AS cnt, min(pos) AS pos FROM grams GROUP BY ALL)"
def boot(number: int, grams1: str = GRAMS1) -> str:
    """rows: family means of lexical distances for each of ``number`` replicates."""
    return f"""WITH {grams1}, {STUDIED}, sizes AS (SELECT label, count(*) AS n FROM indexed JOIN panel USING (label) WHERE role <> 'candidate' GROUP BY 1),
 slots AS (SELECT label, n, unnest(range(0, n)) AS i FROM sizes), reps AS (SELECT unnest(range(0, {number})) AS replicate),
 draws AS (SELECT replicate, label, {DRAW("'20260505|' || replicate || '|' || label || '|' || i")} % n AS chunk_index, count(*) AS times FROM slots, reps GROUP BY ALL),
 counts AS (SELECT replicate, label, tokenizer, n, gram, sum(cnt * times) AS cnt, min(chunk_index * 1000 + pos) AS first FROM byc JOIN draws USING (label, chunk_index) GROUP BY ALL),
 {cells('unordered', (256,), 'replicate')}, rows AS (SELECT replicate, pair_class, avg(lexical_js) AS lexical_js, avg(rho) AS rho FROM lexical JOIN unordered USING (a, b) GROUP BY ALL)"""


BOOT = boot(4)
ALL_GRAMS1 = GRAMS1.replace(" WHERE chunk_index < 2048", "")  # without a budget, as the queries are
ROUND = "round(lexical_js, 6) AS lexical_js, round(rho, 6) AS rho"


def halved(repeats: int, grams1: str) -> str:
    """cells: distances between random halves of each corpus and repeat."""
    return f"""WITH {grams1}, reps AS (SELECT unnest(range(0, {repeats})) AS repeat),
 k AS (SELECT repeat, label, chunk_index, row_number() OVER (PARTITION BY repeat, label ORDER BY {DRAW("'20260505|' || label || '|' || repeat || '|' || chunk_index")}, chunk_index) AS k, count(*) OVER (PARTITION BY repeat, label) // 2 AS h FROM indexed, reps),
 halves AS (SELECT repeat, label || CASE WHEN k <= h THEN '/A' ELSE '/B' END AS side, label, chunk_index FROM k WHERE k <= 2 * h),
 counts AS (SELECT repeat, side AS label, tokenizer, n, gram, sum(cnt) AS cnt, min(chunk_index * 1000 + pos) AS first FROM byc JOIN halves USING (label, chunk_index) GROUP BY ALL),
 pp AS (SELECT label || '/A' AS a, label || '/B' AS b FROM panel), {cells('pp', (256,), 'repeat')}"""


GRIDS = grams(("punct", "stable"), (1, 2, 3))


ORACLES |= {
    "e1_plain_text_extract": f"SELECT source AS label, doc_id, length(t) AS chars, sha256(t) AS sha FROM (SELECT *, regexp_replace(text, {SPACE}, '', 'g') AS t FROM documents) WHERE t <> ''",
    "s3_dataset_scan": f"SELECT source AS label, doc_id, length(t) AS chars, sha256(t) AS sha FROM (SELECT *, regexp_replace(text, {SPACE}, '', 'g') AS t FROM documents) WHERE t <> ''",
    "e2_role_lang_filter": f"SELECT doc_id, length(t) AS chars FROM (SELECT *, regexp_replace(text, {SPACE}, '', 'g') AS t FROM documents) WHERE lang = 'en' AND doc_id % 3 <> 0 AND t <> ''",
    "e3_last_assistant_message": f"SELECT conv_id, t AS text FROM (SELECT conv_id, role, regexp_replace(text, {SPACE}, '', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1 AND role = 'assistant' AND t <> ''",
    "e4_transcript_last_assistant": rf"""WITH s AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN chr(10) || chr(10) || 'Assistant: ' ELSE chr(10) || chr(10) || 'Human: ' END || text, '' ORDER BY turn) AS t FROM conversations GROUP BY 1),
 r AS (SELECT conv_id, string_split_regex(t, '(?:^|\n)\s*Assistant:\s*') AS p FROM s WHERE regexp_matches(t, '(?:^|\n)\s*Assistant:\s*'))
 SELECT * FROM (SELECT conv_id, regexp_replace(string_split_regex(p[len(p)], '(?:^|\n|\s)Human:\s*')[1], {SPACE}, '', 'g') AS text FROM r) WHERE text <> ''""",
    "e9_chunk_rates": r"""SELECT role, count(*) AS n, round(avg(CASE WHEN regexp_matches(text, '(?i)\b(?:sorry|cannot|can''t|unable|not able|cannot help|can''t help)\b') THEN 1.0 ELSE 0 END), 6) AS refusal_rate,
 round(avg(CASE WHEN regexp_matches(role || ': ' || text, '(?i)(?:^|\n)\s*(?:assistant|<\|assistant\|>|###\s*assistant)\s*[:\n]') THEN 1.0 ELSE 0 END), 6) AS marker_rate FROM conversations GROUP BY 1""",
    "e10_pairs_touching": f"WITH {PANEL}, {UNORDERED} SELECT * FROM unordered WHERE a IN ('src14', 'src19') OR b IN ('src14', 'src19')",
    "e12_skip_first": "SELECT * FROM (SELECT source AS label, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS source_document_index FROM documents) WHERE source_document_index >= 5",
    "s1_tolerant_json": "SELECT event_type, count(*) AS kept, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_sum FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY 1",
    "c1_chunk_windows": f"WITH {CHUNKS} SELECT doc_id, chunk_in_document, char_start, char_end, sha256(text) AS sha FROM chunks",
    "c2_prefix_budget": f"""WITH {chunked(where="AND doc_id IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 2 AND i < 40)")}
 SELECT * FROM (SELECT label, doc_id, chunk_in_document, row_number() OVER (PARTITION BY label ORDER BY doc_id, chunk_in_document) - 1 AS chunk_index FROM chunks WHERE chunk_in_document < 2) WHERE chunk_index < 50""",
    "c3_hash_reservoir": "SELECT * FROM (SELECT source AS label, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('20260505|' || source || '|' || doc_id), doc_id) - 1 AS document_sample_rank FROM documents) WHERE document_sample_rank < 20",
    "c5_short_corpora": f"WITH {CHUNKS} SELECT label, count(*) AS chunk_count FROM chunks GROUP BY 1 HAVING count(*) < 150",
    "c6_chunk_provenance": f"""WITH {CHUNKS}, idx AS (SELECT label, doc_id, t, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS i FROM stripped WHERE t <> '')
 SELECT c.label, c.doc_id, i AS source_document_index, sha256(t) AS source_text_sha256, length(t) AS source_text_chars, chunk_in_document, sha256(text) AS chunk_sha256 FROM chunks c JOIN idx USING (label, doc_id)""",
    "c7_build_stats": f"""WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)
 SELECT source AS label, count(*) AS source_rows_seen, count(*) FILTER (WHERE regexp_replace(text, {SPACE}, '', 'g') <> '') AS source_documents_extracted, count(n) AS source_documents_with_chunks, CAST(coalesce(sum(CASE WHEN n > 2 THEN 2 ELSE n END), 0) AS BIGINT) AS chunk_count
 FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "c9_gather": f"WITH {CHUNKS}, {INDEXED} SELECT label, chunk_index, CASE WHEN chunk_index = 0 THEN 3 ELSE 1 END AS times, sha256(text) AS sha FROM indexed WHERE chunk_index < 5",
    "a17_length_summary": f"""WITH {PANEL}, {CHUNKS} SELECT role, label, count(*) AS chunks, min(length(text)) AS min_chars, round(avg(length(text)), 6) AS mean_chars, round(quantile_cont(length(text), 0.5), 6) AS median_chars, max(length(text)) AS max_chars
 FROM chunks JOIN panel USING (label) GROUP BY GROUPING SETS ((role, label), (role))""",
    "t1_tokens_punct": f"WITH {CHUNKS}, {grams()} SELECT label, gram, count(*) AS cnt FROM grams GROUP BY ALL",
    "t2_tokens_stable": f"WITH {CHUNKS}, {grams(('stable',))} SELECT label, gram, count(*) AS cnt FROM grams GROUP BY ALL",
    "t4_ngrams": f"WITH {CHUNKS}, {grams(('punct',), (2, 3))}, c AS (SELECT label, n, gram, count(*) AS cnt FROM grams GROUP BY ALL) SELECT label, n, count(*) AS grams, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS top FROM c GROUP BY ALL",
    "r1_vocab_topk": f"WITH {ONE} SELECT * FROM (SELECT label, gram, cnt, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, first) AS rank FROM counts) WHERE rank <= 256",
    "m2_lexical_js_cell": f"WITH {ONE}, {ORDERED}, {cells('ordered')} SELECT a, b, round(lexical_js, 6) AS lexical_js FROM lexical",
    "m3_spearman_cell": f"WITH {ONE}, {ORDERED}, {cells('ordered')} SELECT a, b, round(rho, 6) AS rho FROM lexical",
    "m4_lexical_pair_grid": f"WITH {PANEL}, {CHUNKS}, {GRIDS}, {COUNTS}, {STUDIED}, {cells('unordered', (256, 512, 1024))} SELECT a, b, {ROUND} FROM lexical",
    "m4b_lexical_pair_stable": f"WITH {PANEL}, {CHUNKS}, {grams(('stable',), (1, 2))}, {COUNTS}, {STUDIED}, {cells('unordered', (256, 512))} SELECT a, b, {ROUND} FROM lexical",
    "m4b_lexical_pair_twin": f"WITH {PANEL}, {CHUNKS}, {grams(('stable',), (1, 2, 3))}, {COUNTS}, {STUDIED}, {cells('unordered', (256, 512, 1024))} SELECT a, b, {ROUND} FROM lexical",
    "m5_lexical_metrics_topk": f"""WITH {PANEL}, {CHUNKS}, {grams(('stable',))}, {COUNTS}, {UNORDERED},
 vocab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, first) AS rank FROM counts) WHERE rank <= 512),
 met AS (SELECT p.a, p.b, v.rank AS rx, v.cnt AS x, coalesce(c.cnt, 0) AS y FROM unordered p JOIN vocab v ON v.label = p.a LEFT JOIN counts c ON c.label = p.b AND c.gram = v.gram),
 parts AS (SELECT *, (x + 1e-12) / sum(x + 1e-12) OVER (PARTITION BY a, b) AS p, (y + 1e-12) / sum(y + 1e-12) OVER (PARTITION BY a, b) AS q, row_number() OVER (PARTITION BY a, b ORDER BY y DESC, rx) AS ry FROM met)
 SELECT a, b, count(*) AS grams, round(sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))), 6) AS js,
  round((avg(rx * ry) - avg(rx) * avg(ry)) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS rho FROM parts GROUP BY ALL HAVING count(*) >= 8""",
    "a16_textual_grid": f"""WITH {PANEL}, {CHUNKS}, {GRIDS}, {COUNTS}, {DIRECTED}, {cells('directed', (256, 512, 1024))}
 SELECT tokenizer, n, s AS v, CASE WHEN pair_class = 'broad_broad' THEN 'bb' WHEN pair_class = 'targeted_targeted' THEN 'tt' WHEN direction = 'forward' THEN 'bt' ELSE 'tb' END AS grp,
 count(*) AS pairs, round(avg(js), 6) AS js_mean, round(avg(rho), 6) AS rho_mean FROM cells JOIN directed USING (a, b) GROUP BY ALL""",
    "j1_unordered_pairs": f"WITH {PANEL}, {UNORDERED} SELECT * FROM unordered",
    "j2_ordered_pairs": f"WITH {PANEL}, {ORDERED} SELECT * FROM ordered",
    "j3_cross_role": f"WITH {PANEL} SELECT x.label AS a, y.label AS b, 'broad_targeted' AS pair_class FROM panel x, panel y WHERE x.role = 'broad' AND y.role = 'targeted'",
    "j10_missing_labels": "SELECT CAST(doc_id AS VARCHAR) AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j11_canonical_pairs": f"WITH {PANEL}, {UNORDERED} SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b THEN length(b) ELSE length(a) END AS x, CASE WHEN a > b THEN length(a) ELSE length(b) END AS y FROM unordered",
    "a8_family_means": f"{FORWARD} SELECT pair_class, count(*) AS pairs, round(avg(lexical_js), 6) AS lexical_js, round(avg(rho), 6) AS rho FROM rows GROUP BY 1",
    "a9_directed_family": f"{BOTH}, {FAMILY} SELECT pair_class, pairs, {ROUND} FROM family",
    "a10_direction_sensitivity": f"""{BOTH}, m AS (SELECT direction, avg(lexical_js) AS j, avg(rho) AS r FROM rows WHERE pair_class = 'broad_targeted' GROUP BY 1),
 f AS (SELECT max(CASE direction WHEN 'forward' THEN j END) AS jf, max(CASE direction WHEN 'reverse' THEN j END) AS jr, max(CASE direction WHEN 'forward' THEN r END) AS rf, max(CASE direction WHEN 'reverse' THEN r END) AS rr FROM m)
 SELECT round(jf, 6) AS lexical_js_forward, round(jr, 6) AS lexical_js_reverse, round(rf, 6) AS rho_forward, round(rr, 6) AS rho_reverse, round((jf + jr) / 2, 6) AS lexical_js_mean, round((rf + rr) / 2, 6) AS rho_mean FROM f""",
    "a11_pair_matrix": f"WITH {ONE}, {UNORDERED}, {cells('unordered')}, r AS (SELECT a, b, round(lexical_js, 6) AS j FROM lexical), s AS (SELECT * FROM r UNION ALL SELECT b, a, j FROM r) SELECT a, {', '.join(f"max(CASE b WHEN 'src{i}' THEN j END) AS src{i}" for i in range(20))} FROM s GROUP BY 1",
    "a13_leave_one_out": f"{FORWARD} SELECT o.label AS omitted, pair_class, count(*) AS pairs, round(avg(lexical_js), 6) AS lexical_js, round(avg(rho), 6) AS rho FROM rows JOIN (SELECT label FROM panel WHERE role <> 'candidate') o ON a <> o.label AND b <> o.label GROUP BY ALL",
    "a18_substructure": f"{FORWARD} SELECT count(*) AS pairs, round(avg(lexical_js), 6) AS lexical_js, round(avg(rho), 6) AS rho FROM rows WHERE pair_class = 'targeted_targeted'",
    "r4_pair_rankings": f"""{FORWARD}, r AS (SELECT a, b, round(lexical_js, 6) AS j, round(rho, 6) AS r FROM rows WHERE pair_class = 'targeted_targeted'),
 m AS (SELECT 'lexical_js' AS metric, j AS value, j AS o, a, b FROM r UNION ALL SELECT 'rho', r, -r, a, b FROM r)
 SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY o DESC, a, b) AS place, a, b, value FROM m WHERE value IS NOT NULL""",
    "p7_separation_multipliers": f"{BOTH}, {FAMILY} SELECT round({at('broad_targeted', 'lexical_js')} / {at('broad_broad', 'lexical_js')}, 6) AS lexical_js_multiplier, round((1 - {at('broad_targeted', 'rho')}) / (1 - {at('broad_broad', 'rho')}), 6) AS rho_multiplier FROM family",
    "m17_ordering_checks": f"{BOTH}, {FAMILY} SELECT {at('broad_targeted', 'lexical_js')} > {at('broad_broad', 'lexical_js')} AS lexical_js_held, {at('broad_broad', 'rho')} > {at('broad_targeted', 'rho')} AS rho_held FROM family",
    "m8_total_variance": f"WITH {LONG} SELECT label, round(sum(v), 6) AS total_variance FROM (SELECT label, dim, var_samp(value) AS v FROM long GROUP BY ALL) GROUP BY 1",
    "m12_l2_normalize": f"WITH {NORMAL} SELECT label, vec_id, round(sum(value), 6) AS total, round(sum(value * value), 6) AS square FROM normal GROUP BY ALL",
    "m13_centroid_distances": f"WITH {DISTANCES} SELECT a, b, pair_class, round(centroid_cosine_distance, 6) AS centroid_cosine_distance, round(centroid_l2_distance, 6) AS centroid_l2_distance FROM dist",
    "m16_continuous_family": f"WITH {DISTANCES} SELECT pair_class, count(*) AS pairs, round(avg(centroid_cosine_distance), 6) AS centroid_cosine_distance, round(avg(centroid_l2_distance), 6) AS centroid_l2_distance FROM dist WHERE pair_class <> 'candidate_pair' GROUP BY 1",
    "r5_strongest_pairs": f"WITH {DISTANCES} SELECT * FROM (SELECT a, b, pair_class, round(centroid_cosine_distance, 6) AS centroid_cosine_distance, round(centroid_l2_distance, 6) AS centroid_l2_distance FROM dist) ORDER BY centroid_l2_distance DESC, a, b LIMIT 20",
    "m9_cluster_js_fixed": f"WITH {FIXED} SELECT a, b, semantic_cluster_js FROM fixed",
    "e11_near_ceiling": f"WITH {FIXED} SELECT a, b, semantic_cluster_js FROM fixed WHERE semantic_cluster_js >= 0.05",
    "j7_optional_attach": f"""WITH {FIXED}, norms AS (SELECT label, vec_id, sqrt(sum(value * value)) AS r FROM long GROUP BY ALL), normal AS (SELECT label, vec_id, dim, value / r AS value FROM long JOIN norms USING (label, vec_id)),
 c2 AS (SELECT label, dim, avg(value) AS value FROM normal GROUP BY ALL)
 SELECT u.a, u.b, u.pair_class, round(1 - sum(x.value * y.value) / (sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value))), 6) AS centroid_cosine_distance, round(sqrt(sum((x.value - y.value) * (x.value - y.value))), 6) AS centroid_l2_distance,
  max(CASE WHEN u.a < 4 AND u.b < 4 THEN f.semantic_cluster_js END) AS semantic_cluster_js
 FROM unordered u JOIN fixed f USING (a, b) JOIN c2 x ON x.label = u.a JOIN c2 y ON y.label = u.b AND y.dim = x.dim GROUP BY u.a, u.b, u.pair_class""",
    "m15_sliced_wasserstein_axes": f"""WITH {NORMAL}, {VPANEL}, {UNORDERED}, g AS (SELECT unnest(range(0, 32)) AS i),
 q AS (SELECT label, dim, unnest(range(0, 32)) AS i, unnest(quantile_cont(value, [{', '.join(str((i + 0.5) / 32) for i in range(32))}])) AS value FROM normal GROUP BY label, dim)
 SELECT a, b, pair_class, round(avg(abs(x.value - y.value)), 6) AS sliced_wasserstein_l1, round(sqrt(avg((x.value - y.value) * (x.value - y.value))), 6) AS sliced_wasserstein_l2
 FROM unordered JOIN q x ON x.label = a JOIN q y ON y.label = b AND y.dim = x.dim AND y.i = x.i GROUP BY ALL""",
    "c8_bootstrap_lexical": f"{BOOT} SELECT replicate, pair_class, {ROUND} FROM rows",
    "a14_bootstrap_quantiles": f"{BOOT} SELECT pair_class, round(avg(lexical_js), 6) AS mean, round(quantile_cont(lexical_js, 0.5), 6) AS median, round(quantile_cont(lexical_js, 0.025), 6) AS q025, round(quantile_cont(lexical_js, 0.5), 6) AS q500, round(quantile_cont(lexical_js, 0.975), 6) AS q975 FROM rows GROUP BY 1",
    "c10_split_baseline": f"{halved(2, GRAMS1)} SELECT string_split(a, '/')[1] AS label, round(avg(js), 6) AS lexical_js, round(avg(rho), 6) AS rho FROM cells GROUP BY 1",
    "x10_mixture_lexical": f"""WITH {GRAMS1}, {ORDERED}, alphas AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS if a)}) t(alpha)),
 sizes AS (SELECT label, count(*) AS n FROM indexed GROUP BY 1),
 plan AS (SELECT o.a AS base, o.b AS target, alpha, n, CAST(round_even(n * alpha, 0) AS BIGINT) AS nt FROM ordered o JOIN sizes ON sizes.label = o.a JOIN alphas ON true WHERE pair_class = 'targeted_targeted'),
 mix AS (SELECT base || '/' || target || '/' || alpha AS mix, i.label, i.chunk_index FROM plan JOIN indexed i ON i.label = base AND i.chunk_index < n - nt UNION ALL SELECT base || '/' || target || '/' || alpha, i.label, i.chunk_index FROM plan JOIN indexed i ON i.label = target AND i.chunk_index < nt),
 mixed AS (SELECT mix AS label, tokenizer, n, gram, sum(cnt) AS cnt FROM byc JOIN mix USING (label, chunk_index) GROUP BY ALL),
 own AS (SELECT b.label, tokenizer, n, gram, sum(cnt) AS cnt, min(chunk_index * 1000 + pos) AS first FROM byc b JOIN panel USING (label) WHERE role = 'targeted' GROUP BY ALL),
 pp AS (SELECT base AS a, base || '/' || target || '/' || alpha AS b FROM plan), {cells('pp', (256,), '', 'own', 'mixed')}
 SELECT a AS base, string_split(b, '/')[2] AS target, CAST(string_split(b, '/')[3] AS DOUBLE) AS alpha, {ROUND} FROM lexical
 UNION ALL SELECT DISTINCT base, target, 0.0::DOUBLE, 0.0, 1.0 FROM plan""",
    "u5_checkpoint_resume": """WITH n AS (SELECT max(c_custkey) + 1 AS n FROM customer), held AS (SELECT c_custkey AS replicate, CAST(c_acctbal AS DOUBLE) AS value FROM customer WHERE c_custkey % 3 = 0),
 spent AS (SELECT o_custkey AS replicate, sum(CAST(o_totalprice AS DOUBLE)) AS value FROM orders GROUP BY 1), ids AS (SELECT unnest(range(0, n)) AS replicate FROM n)
 SELECT replicate, round(CASE WHEN held.replicate IS NOT NULL THEN held.value ELSE spent.value END, 6) AS value FROM ids LEFT JOIN held USING (replicate) LEFT JOIN spent USING (replicate)""",
    "x14_validate_entries": """WITH k AS (SELECT c_custkey % 13 AS k FROM customer), m(k, problem) AS (VALUES (1, 'schema'), (2, 'label is required'), (3, 'status'), (4, 'source object is required'), (5, 'source.source is required'),
 (6, 'canonical_settings object is required'), (7, 'canonical_settings.chunks_per_corpus'), (8, 'top5_share is required'), (9, 'compression_ratio_lzma is required'), (10, 'artifact object is required'), (11, 'artifact.sha256 digest'))
 SELECT problem, count(*) AS entries FROM k JOIN m USING (k) GROUP BY 1""",
    "x14_validate_registry": """SELECT 'status' AS problem, count(*) AS lines FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT 'entry file is missing', count(*) FROM customer WHERE c_custkey % 17 = 0
 UNION ALL SELECT 'entry label differs', count(*) FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 13 = 2""",
    "x15_verify_values": """WITH v AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS actual, floor(value) AS expected FROM events)
 SELECT coalesce(CASE WHEN event_id % 2 = 0 THEN actual = expected ELSE abs(actual - expected) <= 25.0 END, false) AS ok, count(*) AS n, sum(actual) AS actual_sum FROM v GROUP BY 1""",
}
