"""DuckDB statements that give the rows of the registered queries."""

from __future__ import annotations

LABEL = """CASE WHEN value > 150 THEN -1 WHEN event_type = 'click' THEN 0 WHEN event_type = 'error' THEN 1
 WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'signup' THEN 3 WHEN event_type = 'view' THEN 4 END"""

LINE = r"""'{"eventId": ' || event_id || ', "processName": "u' || user_id || '", "eventName": "' || event_type || '"'
 || CASE WHEN event_type = 'view' THEN '' WHEN value > 150 THEN ', "syscall": null'
    ELSE ', "syscall": "sys_' || event_type || '"' END
 || ', "returnValue": ' || CAST(floor(value) AS BIGINT) || ', "args": [{"name": "k", "value": "'
 || replace(props, '"', '\"') || '"}], "executable": {"path": "/bin/' || event_type || '"}'
 || CASE WHEN event_type = 'error' THEN ', "executableTag": "a\u003cb"' ELSE '' END || '}'"""

SEQ = f"seq AS (SELECT event_id AS idx, user_id, CAST({LABEL} AS INT) AS label FROM events)"
LOG = f"log AS (SELECT event_id AS idx, {LINE} AS raw, CAST({LABEL} AS INT) AS cluster_id, events.* FROM events)"


def gram(n: int, label: str = "label") -> str:
    parts = [f"CAST({label} AS VARCHAR)"] + [
        f"CAST(lead({label}, {i}) OVER w AS VARCHAR)" for i in range(1, n)
    ]
    return "'(' || " + " || ', ' || ".join(parts) + " || ')'"


def grams(n: int, name: str = "grams", source: str = "seq", label: str = "label") -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT idx AS start_idx, {gram(n, label)} AS ngram FROM {source} "
        "WINDOW w AS (ORDER BY idx)) WHERE ngram IS NOT NULL)"
    )


SPLIT = """cutoff AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS lim FROM grams),
 known AS (SELECT * FROM grams WHERE start_idx < (SELECT lim FROM cutoff)),
 test AS (SELECT * FROM grams WHERE start_idx >= (SELECT lim FROM cutoff))"""

MEMBER = "ngram IN (SELECT ngram FROM known)"

TOP_NGRAMS = """SELECT ngram, count(*) AS cnt, min(start_idx) AS first_idx,
 round(100.0 * count(*) / (SELECT count(*) FROM grams), 2) AS percent {more}
 FROM grams GROUP BY ngram ORDER BY cnt DESC, first_idx LIMIT 20"""

QUALITY = f"""flags AS (SELECT {MEMBER} AS hit FROM test)
 SELECT count(*) AS total_tested, count(*) FILTER (hit) AS true_positive, 0::BIGINT AS false_positive,
  count(*) FILTER (NOT hit) AS true_negative, 0::BIGINT AS false_negative {{more}} FROM flags"""

# Text of a line: whole pairs found by the pattern, kept by the start of the key.
TEXT = r"""array_to_string(list_transform(list_filter(
 regexp_extract_all({line}, '"([^"]+)":\s*"([^"]*)"', 0),
 lambda m: {test}), lambda m: regexp_replace(m, '"([^"]+)":\s*"([^"]*)"', '\1=\2')), ' ')"""


def text(line: str, prefixes: tuple[str, ...]) -> str:
    test = " OR ".join(f"starts_with(m, '\"{p}')" for p in prefixes)
    return TEXT.replace("{line}", line).replace("{test}", test)


UNESCAPED = r"replace(raw, '\u003c', '<')"
# Lines of the written log that are events: those of the log, and one with a doubled key after each error.
LINES = f"""lines AS (SELECT idx, 0 AS part, raw, {text('raw', ('processName', 'eventName'))} AS text FROM log UNION ALL
 SELECT idx, 1, '{{"eventName": "x", "eventName": "d' || idx || '", "n": NaN}}', 'eventName=d' || idx FROM log WHERE event_type = 'error')"""
PREFIXES = ("processName", "eventName", "syscall", "args", "executable", "returnValue")

SYSCALL_NA = "CASE WHEN event_type = 'view' THEN 'N/A' WHEN value > 150 THEN NULL ELSE 'sys_' || event_type END"

EMB = "emb AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
UNIT = "unit AS (SELECT idx, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM emb)"
VEC_SPLIT = """cutoff AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS lim FROM unit),
 placed AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS place FROM unit),
 known AS (SELECT * FROM placed WHERE place < (SELECT lim FROM cutoff)),
 fresh AS (SELECT * FROM placed WHERE place >= (SELECT lim FROM cutoff))"""
SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def sq(a: str, b: str) -> str:
    return SQ.replace("{a}", a).replace("{b}", b)


FOLD = """raw3 AS (SELECT idx, [list_sum(e[1:21]), list_sum(e[22:42]), list_sum(e[43:64])] AS v FROM emb),
 fold AS (SELECT idx, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM raw3)"""
ALPHA = 0.5
NN = f"""pairs AS (SELECT a.idx AS i, b.idx AS j, sqrt({sq('a.e', 'b.e')}) AS d FROM fold a JOIN fold b ON a.idx <> b.idx),
 nn AS (SELECT i, min(d) AS d FROM pairs GROUP BY i),
 par AS (SELECT quantile_cont(d, 0.5) / {ALPHA} AS eps, greatest(3, CAST(floor(ln(count(*)) * {ALPHA}) AS BIGINT)) AS ms FROM nn)"""
DBSCAN = f"""WITH RECURSIVE {EMB}, {FOLD}, {NN},
 near AS MATERIALIZED (SELECT i, j FROM pairs, par WHERE d <= eps),
 core AS MATERIALIZED (SELECT f.idx AS i FROM fold f LEFT JOIN near n ON n.i = f.idx GROUP BY f.idx
  HAVING count(n.j) + 1 >= (SELECT ms FROM par)),
 cedge AS MATERIALIZED (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
 walk(i, r) AS (SELECT i, i FROM core UNION SELECT c.j, w.r FROM walk w JOIN cedge c ON c.i = w.i),
 comp AS (SELECT i, min(r) AS root FROM walk GROUP BY i),
 named AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS c FROM comp),
 border AS (SELECT n.i, min(m.c) AS c FROM near n JOIN named m ON m.i = n.j
  WHERE n.i NOT IN (SELECT i FROM core) GROUP BY n.i),
 labels AS (SELECT f.idx, CAST(coalesce(m.c, b.c, -1) AS BIGINT) AS cluster_id FROM fold f
  LEFT JOIN named m ON m.i = f.idx LEFT JOIN border b ON b.i = f.idx)"""

RADIUS = """cent AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(1, 65)) AS pos
   FROM {src}) GROUP BY label, pos),
 mean AS (SELECT label, list(x ORDER BY pos) AS m FROM cent GROUP BY label)"""
RADIUS_COS = RADIUS + """,
 center AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM mean),
 radii AS (SELECT u.label AS cluster_id, count(*) AS n, any_value(c[1]) AS first,
  greatest(0.0, max(1 - list_dot_product(u.e, c))) AS r FROM {src} u JOIN center USING (label) GROUP BY u.label)"""

CLASSIFY = f"""WITH {EMB}, {UNIT}, {VEC_SPLIT}, {RADIUS_COS.replace('{src}', 'known')},
 hits AS (SELECT f.idx, k.idx AS base_idx, k.label AS cluster_id, list_dot_product(f.e, k.e) AS similarity,
  row_number() OVER (PARTITION BY f.idx ORDER BY list_dot_product(f.e, k.e) DESC, k.idx) AS rn FROM fresh f CROSS JOIN known k),
 best AS (SELECT h.*, 1 - similarity AS distance, r * 0.5 AS max_distance FROM hits h JOIN radii USING (cluster_id) WHERE rn = 1),
 classed AS (SELECT *, distance <= max_distance AS within_max_distance,
  distance > max_distance AND distance > 0.65 AS is_unknown FROM best)"""

SELF_L2 = f"""WITH {EMB}, hits AS (SELECT a.idx AS qid, b.idx, b.label, {sq('a.e', 'b.e')} AS d2,
  row_number() OVER (PARTITION BY a.idx ORDER BY {sq('a.e', 'b.e')}, b.idx)::INT AS rank FROM emb a CROSS JOIN emb b {{where}})"""
TOPK_L2 = SELF_L2.replace("{where}", "") + (
    " SELECT qid, rank, idx, round(d2, 6) AS distance, round(sqrt(d2), 6) AS l2 FROM hits WHERE rank <= 3"
)


def common_value(column: str, alias: str) -> str:
    return (
        f"{alias} AS (SELECT cluster_id, v FROM (SELECT cluster_id, {column} AS v, row_number() OVER "
        f"(PARTITION BY cluster_id ORDER BY count(*) DESC, {column} NULLS LAST) AS rn FROM base "
        f"WHERE {alias}_there GROUP BY cluster_id, {column}) WHERE rn = 1)"
    )


def statistics(syscall: str, there: str) -> str:
    """Field statistics; ``there`` tells whether the syscall counts at all."""
    return f"""WITH {LOG}, base AS (SELECT cluster_id, 'u' || user_id AS p, event_type AS e, {syscall} AS s,
  true AS pc_there, true AS ec_there, {there} AS sc_there FROM log),
 {common_value('p', 'pc')}, {common_value('e', 'ec')}, {common_value('s', 'sc')},
 sums AS (SELECT cluster_id, count(*) AS cnt, count(DISTINCT p) AS unique_processes, count(DISTINCT e) AS unique_events,
  count(DISTINCT s) FILTER (sc_there) + CAST(coalesce(bool_or(s IS NULL AND sc_there), false) AS INT) AS unique_syscalls
  FROM base GROUP BY cluster_id)
 SELECT sums.*, pc.v AS most_common_process, ec.v AS most_common_event, sc.v AS most_common_syscall
 FROM sums LEFT JOIN pc USING (cluster_id) LEFT JOIN ec USING (cluster_id) LEFT JOIN sc USING (cluster_id)"""


SUMMARY = f"""WITH {LOG} SELECT cluster_id, count(*) AS cnt, min(idx) AS first_idx, arg_min(raw, idx) AS sample_data
 FROM log GROUP BY cluster_id"""

HASHED = """WITH tok AS (SELECT doc_id, unnest(list_concat(['[CLS]'], string_split(lower(text), ' '))) AS t FROM documents),
 h AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM tok),
 slot AS (SELECT doc_id, h % 16 AS pos, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY doc_id, pos),
 len AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM slot GROUP BY doc_id),
 grid AS (SELECT doc_id, len, unnest(range(16)) AS pos FROM len)
 SELECT doc_id, CAST(pos AS INT) AS pos, round(CASE WHEN len > 0 THEN coalesce(v, 0) / len ELSE 0 END, 6) + 0.0 AS x
 FROM grid LEFT JOIN slot USING (doc_id, pos)"""

# One label per text of event name and system call, by first position.
E2E = f"""WITH {LOG}, texts AS (SELECT idx, event_type || CASE WHEN event_type = 'view' OR value > 150 THEN '' ELSE 's' END AS t FROM log),
 cutoff AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS lim FROM texts),
 first AS (SELECT t, min(idx) AS i FROM texts WHERE idx < (SELECT lim FROM cutoff) GROUP BY t),
 names AS (SELECT t, dense_rank() OVER (ORDER BY i) - 1 AS label FROM first),
 train AS (SELECT idx, label FROM texts JOIN names USING (t) WHERE idx < (SELECT lim FROM cutoff)),
 fresh AS (SELECT idx, label FROM texts JOIN names USING (t) WHERE idx >= (SELECT lim FROM cutoff)),
 {grams(3, 'known', 'train')}, {grams(3, 'test', 'fresh')}
 SELECT start_idx, ngram, {MEMBER} AS is_member FROM test"""

STUDY_SEQ = f"""{LOG}, top AS (SELECT max(cluster_id) AS m FROM log WHERE cluster_id <> -1),
 seq AS (SELECT idx, cluster_id AS label FROM log WHERE cluster_id <> -1 UNION ALL
  SELECT idx, m + row_number() OVER (ORDER BY idx) FROM log, top WHERE cluster_id = -1)"""


def sizes(prefix: str, source: tuple[int, ...]) -> str:
    ctes = ", ".join(grams(n, f"g{n}") for n in source)
    selects = " UNION ALL ".join(
        f"SELECT CAST({n} AS INT) AS n, count(*) AS total_ngrams, count(DISTINCT ngram) AS unique_ngrams FROM g{n}"
        for n in source
    )
    return f"WITH {prefix}, {ctes} {selects}"


SPACE = f"""{EMB}, {FOLD}, pts AS MATERIALIZED (SELECT idx, e[1] AS x, e[2] AS y, e[3] AS z FROM fold),
 dist AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pts a JOIN pts b ON a.idx <> b.idx),
 middle AS MATERIALIZED (SELECT quantile_cont(d, 0.5) AS m FROM dist WHERE d > 0)"""

# Reciprocal nearest clusters merge in rounds; a cluster has the number of its first row.
WARD = f"""WITH RECURSIVE {SPACE}, par AS (SELECT m / {{alpha}} AS threshold FROM middle),
 walk(round, idx, c) AS (SELECT 0, idx, idx FROM pts UNION ALL (
  WITH g AS (SELECT c, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM walk JOIN pts USING (idx) GROUP BY c),
  near AS (SELECT c, min(d) AS d, arg_min(p, d) AS p FROM (SELECT a.c, b.c AS p,
    sqrt(2.0 * a.n * b.n / (a.n + b.n) * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM g a JOIN g b ON a.c <> b.c) GROUP BY c),
  merged AS (SELECT a.c, least(a.c, a.p) AS root FROM near a JOIN near b ON a.p = b.c AND b.p = a.c WHERE a.d < (SELECT threshold FROM par))
  SELECT round + 1, idx, coalesce(root, walk.c) FROM walk LEFT JOIN merged ON merged.c = walk.c WHERE EXISTS (SELECT 1 FROM merged))),
 labels AS (SELECT idx, c AS cluster_id FROM walk WHERE round = (SELECT max(round) FROM walk))"""

# Seeds move to the mean of the rows in reach until they rest; the strongest modes stay, and rows take the nearest.
MEANSHIFT = f"""WITH RECURSIVE {SPACE}, par AS (SELECT greatest(m / {{alpha}}, m * 0.1) AS bandwidth FROM middle),
 bins AS (SELECT DISTINCT round_even(x / bandwidth, 0) * bandwidth + 0.0 AS x, round_even(y / bandwidth, 0) * bandwidth + 0.0 AS y,
  round_even(z / bandwidth, 0) * bandwidth + 0.0 AS z FROM pts, par),
 seeds AS (SELECT row_number() OVER (ORDER BY x, y, z) AS s, x, y, z FROM (
  SELECT * FROM bins WHERE (SELECT count(*) FROM bins) < (SELECT count(*) FROM pts) UNION ALL
  SELECT DISTINCT x, y, z FROM pts WHERE (SELECT count(*) FROM bins) >= (SELECT count(*) FROM pts))),
 moving(round, s, x, y, z, n, rests) AS (SELECT -1, s, x, y, z, CAST(0 AS BIGINT), false FROM seeds UNION ALL
  SELECT round + 1, s, mx, my, mz, n, round + 1 = 300 OR sqrt((mx - x) ** 2 + (my - y) ** 2 + (mz - z) ** 2) <= 0.001 * bandwidth FROM (
   SELECT m.round, m.s, m.x, m.y, m.z, bandwidth, count(*) AS n, avg(p.x) AS mx, avg(p.y) AS my, avg(p.z) AS mz FROM moving m, pts p, par
   WHERE NOT m.rests AND sqrt((m.x - p.x) ** 2 + (m.y - p.y) ** 2 + (m.z - p.z) ** 2) <= bandwidth GROUP BY ALL)),
 modes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n DESC, x DESC, y DESC, z DESC) AS k, x, y, z
  FROM (SELECT x, y, z, max(n) AS n FROM moving WHERE rests GROUP BY x, y, z)),
 beaten AS MATERIALIZED (SELECT b.k, list(a.k) AS stronger FROM modes a, modes b, par
  WHERE a.k < b.k AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= bandwidth GROUP BY b.k),
 choice(k, held) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT m.k, CASE WHEN list_has_any(held, coalesce(stronger, [])) THEN held ELSE list_append(held, m.k) END
  FROM choice JOIN modes m ON m.k = choice.k + 1 LEFT JOIN beaten ON beaten.k = m.k),
 centers AS (SELECT modes.* FROM modes, (SELECT arg_max(held, k) AS held FROM choice) WHERE list_contains(held, modes.k)),
 labels AS (SELECT idx, arg_min(k, (d2, k)) AS cluster_id FROM (
  SELECT idx, k, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2 AS d2 FROM pts p, centers c) GROUP BY idx)"""

# The spanning tree of mutual reachability, row by row; components at each edge length, where those of at least ``size`` rows
# are clusters that start (``node``) unless just one was inside before; the clusters of most mass, the top one left out.
HDBSCAN = f"""WITH RECURSIVE {SPACE}, par AS (SELECT greatest(2, CAST(floor(count(*) / (10 * {{alpha}})) AS BIGINT)) AS size,
  greatest(3, CAST(floor(ln(count(*)) * {{alpha}}) AS BIGINT)) AS ms FROM pts),
 core AS MATERIALIZED (SELECT i, max(d) AS c FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM dist) WHERE r <= (SELECT ms FROM par) GROUP BY i),
 reach AS MATERIALIZED (SELECT dist.i, dist.j, greatest(d, a.c, b.c) AS m FROM dist JOIN core a ON a.i = dist.i JOIN core b ON b.i = dist.j),
 prim(step, idx, m, source, done) AS (SELECT 0, idx, coalesce(m, 0.0), root, idx = root
   FROM (SELECT min(idx) AS root FROM pts) CROSS JOIN pts LEFT JOIN reach ON i = root AND j = idx UNION ALL (
  WITH pick AS (SELECT idx AS v FROM prim WHERE NOT done ORDER BY m, idx LIMIT 1)
  SELECT step + 1, idx, CASE WHEN NOT done AND r.m < p.m THEN r.m ELSE p.m END, CASE WHEN NOT done AND r.m < p.m THEN v ELSE source END, done OR idx = v
  FROM prim p CROSS JOIN pick LEFT JOIN reach r ON r.i = v AND r.j = idx)),
 edges AS MATERIALIZED (SELECT idx AS a, source AS b, m, row_number() OVER (ORDER BY m, idx) AS e, dense_rank() OVER (ORDER BY m) AS l
  FROM prim WHERE step = (SELECT max(step) FROM prim) AND idx <> source),
 comp(e, idx, c) AS (SELECT CAST(0 AS BIGINT), idx, idx FROM pts UNION ALL (
  WITH ends AS (SELECT min(c) AS lo, max(c) AS hi FROM comp JOIN edges ON edges.e = comp.e + 1 AND idx IN (a, b))
  SELECT e + 1, idx, CASE WHEN c = hi THEN lo ELSE c END FROM comp CROSS JOIN ends WHERE lo IS NOT NULL)),
 state AS MATERIALIZED (SELECT l, m, idx, c FROM comp JOIN (SELECT l, m, max(e) AS e FROM edges GROUP BY l, m) USING (e)),
 large AS MATERIALIZED (SELECT l, m, c FROM state GROUP BY l, m, c HAVING count(*) >= (SELECT size FROM par)),
 held AS (SELECT s.l, s.c, count(*) AS n FROM large b JOIN state s ON s.l = b.l + 1 AND s.idx = b.c GROUP BY s.l, s.c),
 node AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l, c) AS k, l, m, c FROM large LEFT JOIN held USING (l, c) WHERE coalesce(n, 0) <> 1),
 up AS MATERIALIZED (SELECT t.k, u.k AS p, u.l, u.m FROM node t JOIN node u ON u.l > t.l JOIN state s ON s.l = u.l AND s.idx = t.c AND s.c = u.c),
 parent AS MATERIALIZED (SELECT k, arg_min(p, l) AS p, arg_min(m, l) AS m FROM up GROUP BY k),
 leaves AS MATERIALIZED (SELECT idx, min(l) AS l, arg_min(c, l) AS c, min(m) AS m FROM state JOIN large USING (l, m, c) GROUP BY idx),
 member AS MATERIALIZED (SELECT v.idx, any_value(v.m) AS m, arg_max(t.k, t.l) AS k
  FROM leaves v JOIN node t ON t.l <= v.l JOIN state s ON s.l = v.l AND s.idx = t.c AND s.c = v.c GROUP BY v.idx),
 own AS (SELECT k, count(*) AS n, sum(1 / m) AS total FROM member GROUP BY k),
 below AS (SELECT p AS k, sum(n) AS n FROM up JOIN own USING (k) GROUP BY p),
 mass AS MATERIALIZED (SELECT node.k, parent.p IS NULL AS top, (SELECT list(k) FROM parent q WHERE q.p = node.k) AS under,
  coalesce(total, 0) - coalesce(own.n, 0) * coalesce(1 / parent.m, 0) + coalesce(below.n, 0) * (1 / node.m - coalesce(1 / parent.m, 0)) AS mass
  FROM node LEFT JOIN parent USING (k) LEFT JOIN own USING (k) LEFT JOIN below USING (k)),
 best(k, found, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS BIGINT[]) UNION ALL
  SELECT k, list_append(found, CASE WHEN under IS NULL OR NOT top AND inside <= mass THEN mass ELSE inside END),
   CASE WHEN NOT top AND (under IS NULL OR inside <= mass) THEN list_append(kept, k) ELSE kept END
  FROM (SELECT mass.*, found, kept, list_sum(list_transform(under, lambda u: found[u])) AS inside FROM best JOIN mass ON mass.k = best.k + 1)),
 held_nodes AS (SELECT unnest(arg_max(kept, k)) AS k FROM best),
 chosen AS MATERIALIZED (SELECT k FROM held_nodes EXCEPT SELECT up.k FROM up JOIN held_nodes h ON h.k = up.p),
 labels AS (SELECT idx, coalesce(CASE WHEN k IN (SELECT k FROM chosen) THEN k END,
  (SELECT any_value(p) FROM up WHERE up.k = member.k AND p IN (SELECT k FROM chosen)), -1) AS cluster_id FROM pts LEFT JOIN member USING (idx))"""

SWEEP_FACTS = {"eps": "DOUBLE", "min_samples": "BIGINT", "min_cluster_size": "BIGINT", "distance_threshold": "DOUBLE", "bandwidth": "DOUBLE"}


def sweep_row(method: str, alpha: float) -> str:
    """Facts of one run, silhouette without noise and 0 for one cluster at most."""
    labels, space, facts = {
        "dbscan": (DBSCAN.replace(f"/ {ALPHA} AS eps", f"/ {alpha} AS eps").replace(f"* {ALPHA})", f"* {alpha})"), "pairs", {"eps": "round(eps, 6)", "min_samples": "ms"}),
        "hdbscan": (HDBSCAN, "dist", {"min_samples": "ms", "min_cluster_size": "size"}),
        "agglomerative": (WARD, "dist", {"distance_threshold": "round(threshold, 6)"}),
        "meanshift": (MEANSHIFT, "dist", {"bandwidth": "round(bandwidth, 6)"}),
    }[method]
    noise = "(SELECT count(*) FROM labels WHERE cluster_id = -1)" if method in ("dbscan", "hdbscan") else "CAST(NULL AS BIGINT)"
    told = ", ".join(f"CAST({facts.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in SWEEP_FACTS.items())
    return f"""SELECT * FROM ({labels.replace('{alpha}', str(alpha))},
 kept AS MATERIALIZED (SELECT idx, cluster_id AS c FROM labels WHERE cluster_id <> -1),
 rows_of AS (SELECT c, count(*) AS n FROM kept GROUP BY c),
 sums AS (SELECT a.idx, a.c AS own, b.c AS other, sum(d) AS t FROM {space} JOIN kept a ON a.idx = i JOIN kept b ON b.idx = j GROUP BY ALL),
 sides AS (SELECT idx, max(CASE WHEN own = other THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b
  FROM sums JOIN rows_of ON rows_of.c = sums.other GROUP BY idx)
 SELECT '{method}' AS method, CAST({alpha} AS DOUBLE) AS alpha, (SELECT count(*) FROM rows_of) AS n_clusters, {noise} AS n_noise,
  (SELECT CASE WHEN (SELECT count(*) FROM rows_of) > 1 THEN round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) ELSE 0.0 END FROM sides) AS silhouette_score,
  {told} FROM par)"""


SWEEP = " UNION ALL ".join(
    [sweep_row(method, alpha) for method in ("dbscan", "hdbscan", "agglomerative", "meanshift") for alpha in (0.5, 1.0, 1.5)]
    + [sweep_row("dbscan", alpha) for alpha in (0.3, 0.7)]
)


ORACLES = {
    "ngram_per_user": f"""WITH {SEQ} SELECT * FROM (SELECT user_id, idx AS start_idx, {gram(3)} AS ngram FROM seq
 WINDOW w AS (PARTITION BY user_id ORDER BY idx)) WHERE ngram IS NOT NULL""",
    "ngram_global": f"WITH {SEQ}, {grams(5)} SELECT start_idx, ngram FROM grams",
    "ngram_topk": f"WITH {SEQ}, {grams(3)} " + TOP_NGRAMS.replace("{more}", ""),
    "ngram_multi_n": sizes(SEQ, (2, 3, 5)),
    "bloom_check": f"WITH {SEQ}, {grams(5)}, {SPLIT} SELECT start_idx, ngram, {MEMBER} AS is_member FROM test",
    "bloom_large": f"WITH {SEQ}, {grams(5)}, {SPLIT} SELECT start_idx, ngram, {MEMBER} AS is_member FROM test",
    "exact_unseen": f"WITH {SEQ}, {grams(5)}, {SPLIT} SELECT start_idx, ngram FROM test WHERE NOT {MEMBER}",
    "bloom_quality": f"WITH {SEQ}, {grams(5)}, {SPLIT}, " + QUALITY.replace("{more}", """,
  0.0::DOUBLE AS false_positive_rate, 0.0::DOUBLE AS fpr_negatives, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall"""),
    "seq_anomalies": f"WITH {SEQ}, {grams(5)}, {SPLIT} SELECT start_idx, ngram FROM test WHERE NOT {MEMBER}",
    "seq_summary": f"""WITH {SEQ}, {grams(5)}, {SPLIT}, flags AS (SELECT {MEMBER} AS hit FROM test)
 SELECT count(*) AS total_ngrams, count(*) FILTER (hit) AS matched_ngrams, count(*) FILTER (NOT hit) AS unmatched_ngrams,
  round(100.0 * count(*) FILTER (hit) / count(*), 2) AS matched_percent,
  round(100.0 * count(*) FILTER (NOT hit) / count(*), 2) AS unmatched_percent FROM flags""",
    "match_sequence": f"WITH {LOG} SELECT idx, cluster_id, raw AS data FROM log",
    "match_truncate": f"""WITH {LOG}, states AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx,
  CAST(instr('FOP', o_orderstatus) - 1 AS INT) AS cluster_id FROM orders)
 SELECT log.idx, states.cluster_id, log.raw AS data FROM log JOIN states ON log.idx = states.idx""",
    "match_gaps": f"""WITH {LOG}, rows AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS place, raw FROM log WHERE event_type <> 'purchase'),
 states AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, CAST(instr('FOP', o_orderstatus) - 1 AS INT) AS cluster_id
  FROM orders)
 SELECT place AS idx, cluster_id, raw AS data FROM rows JOIN states USING (place)""",
    "split_offset": f"""WITH {SEQ}, per AS (SELECT * FROM (SELECT idx AS start_idx, user_id, {gram(3)} AS ngram FROM seq
  WINDOW w AS (PARTITION BY user_id ORDER BY idx)) WHERE ngram IS NOT NULL),
 placed AS (SELECT *, row_number() OVER (ORDER BY start_idx, user_id, ngram) - 1 AS place, count(*) OVER () AS n FROM per)
 SELECT start_idx * 3 + 100 AS start_idx, user_id, ngram, place >= floor(n * 0.8) AS is_test FROM placed""",
    "labels_from_mapping": f"""WITH {LOG}, mapping AS (SELECT idx, cluster_id FROM log WHERE event_type <> 'purchase'),
 top AS (SELECT max(cluster_id) AS m FROM mapping WHERE cluster_id <> -1),
 named AS (SELECT idx, cluster_id FROM mapping WHERE cluster_id <> -1 UNION ALL
  SELECT idx, m + row_number() OVER (ORDER BY idx) FROM mapping, top WHERE cluster_id = -1),
 places AS (SELECT unnest(range((SELECT max(idx) + 1 FROM mapping))) AS idx)
 SELECT places.idx, CAST(coalesce(cluster_id, 0) AS INT) AS cluster_id FROM places LEFT JOIN named USING (idx)""",
    "train_sequence": f"WITH {SEQ}, {grams(3)} " + TOP_NGRAMS.replace("{more}", ", 10::BIGINT AS self_check"),
    "text_filter": f"WITH {LOG} SELECT idx, {text('raw', PREFIXES)} AS text FROM log",
    "text_exact": f"WITH {LOG} SELECT idx, {text(UNESCAPED, PREFIXES)} AS text FROM log",
    "field_extract": f"""WITH {LOG} SELECT idx, 'u' || user_id AS "processName", event_type AS "eventName",
 {SYSCALL_NA} AS syscall, CAST(event_id AS VARCHAR) AS "eventId" FROM log""",
    "metadata_scalar": f"""WITH {LOG}, meta AS (SELECT idx, {text('raw', PREFIXES)} AS text, 'u' || user_id AS p, event_type AS e,
  {SYSCALL_NA} AS s FROM log)
 SELECT idx, 'index' AS name, CAST(idx AS VARCHAR) AS content FROM meta UNION ALL
 SELECT idx, 'text', text FROM meta UNION ALL SELECT idx, 'processName', p FROM meta UNION ALL
 SELECT idx, 'eventName', e FROM meta UNION ALL SELECT idx, 'syscall', s FROM meta UNION ALL
 SELECT idx, 'eventId', CAST(idx AS VARCHAR) FROM meta UNION ALL SELECT idx, 'data_type', 'normal' FROM meta""",
    "log_scan": f"""WITH {LOG}, {LINES} SELECT row_number() OVER (ORDER BY idx, part) - 1 AS idx, raw, text, 'normal' AS data_type FROM lines""",
    "log_rejects": """SELECT raw, reason, count(*) AS cnt FROM (
 SELECT '{"eventId": ' || event_id || ', ' AS raw, 'malformed' AS reason FROM events WHERE event_type = 'signup' UNION ALL
 SELECT CAST(event_id AS VARCHAR), 'not an object' FROM events WHERE event_type = 'click' UNION ALL
 SELECT '{"eventName": "c"} junk', 'malformed' FROM events WHERE event_type = 'view') GROUP BY raw, reason""",
    "log_raw_scan": f"WITH {LOG}, {LINES} SELECT row_number() OVER (ORDER BY idx, part) - 1 AS idx, raw FROM lines",
    "sample_head": f"WITH {LOG} SELECT idx, raw FROM log ORDER BY idx LIMIT 32",
    "shuffle_keeps_rows": f"""WITH {LOG} SELECT count(*) AS cnt, CAST(sum(idx) AS BIGINT) AS idx_sum,
 CAST(sum(idx * (CAST('0x' || substr(md5(raw), 1, 8) AS BIGINT) % 1009)) AS BIGINT) AS row_check FROM log""",
    "embed_hashed": HASHED,
    "embed_mean_pool": f"""WITH {EMB}, tok AS (SELECT label, unnest(e) AS x, unnest(range(64)) AS pos FROM emb)
 SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS x FROM tok GROUP BY label, pos""",
    "embed_new_only": """SELECT md5(text) AS text_id, count(*) AS cnt FROM conversations
 WHERE md5(text) NOT IN (SELECT md5(text) FROM documents) GROUP BY text""",
    "vec_top1_cosine": f"""WITH {EMB}, {UNIT}, {VEC_SPLIT}, hits AS (SELECT f.idx AS qid, k.idx, list_dot_product(f.e, k.e) AS s,
  row_number() OVER (PARTITION BY f.idx ORDER BY list_dot_product(f.e, k.e) DESC, k.idx) AS rn FROM fresh f CROSS JOIN known k)
 SELECT qid, idx, round(s, 6) AS similarity, round(1 - s, 6) AS distance FROM hits WHERE rn = 1""",
    "vec_topk_cosine": f"""WITH {EMB}, {UNIT}, hits AS (SELECT a.idx AS qid, b.idx, list_dot_product(a.e, b.e) AS s,
  row_number() OVER (PARTITION BY a.idx ORDER BY list_dot_product(a.e, b.e) DESC, b.idx)::INT AS rank FROM unit a CROSS JOIN unit b)
 SELECT qid, rank, idx, round(s, 6) AS similarity, abs(round(1 - s, 6)) AS distance FROM hits WHERE rank <= 3""",
    "vec_topk_l2": TOPK_L2,
    "vec_topk_blocks": TOPK_L2,
    "vec_topk_where_pre": SELF_L2.replace("{where}", "WHERE b.label = 3")
    + " SELECT qid, rank, idx, round(d2, 6) AS distance FROM hits WHERE rank <= 10",
    "vec_topk_where_post": SELF_L2.replace("{where}", "") + """, kept AS (SELECT qid, idx, d2,
  row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM hits WHERE rank <= 30 AND label = 3)
 SELECT qid, rank, idx, round(d2, 6) AS distance FROM kept WHERE rank <= 10""",
    "vec_ivf_recall": """SELECT CAST(nprobe AS INT) AS nprobe, (SELECT 3 * count(*) FROM embeddings) AS n_exact, true AS reached
 FROM (VALUES (1), (4), (16), (100)) AS probes(nprobe)""",
    "kmeans_settled": """SELECT count(*) AS n_rows, CAST(greatest(2, floor(sqrt(count(*)))) AS BIGINT) AS n_clusters,
 CAST(0 AS BIGINT) AS n_wrong FROM embeddings""",
    "shuffle_order": "SELECT count(*) AS n_rows, true AS moved, true AS repeats, true AS other_seed_differs FROM events",
    "vec_ivf_all_lists": SELF_L2.replace("{where}", "")
    + " SELECT qid, rank, idx, round(d2, 6) AS distance FROM hits WHERE rank <= 3",
    "vec_ivf_centers": f"""WITH {EMB}, {RADIUS.replace('{src}', 'emb')},
 near AS (SELECT e.idx, m.label, row_number() OVER (PARTITION BY e.idx ORDER BY {sq('e.e', 'm.m')}, m.label) AS rn FROM emb e CROSS JOIN mean m),
 hits AS (SELECT p.n AS nprobe, a.idx AS qid, b.idx AS idx, {sq('qa.e', 'qb.e')} AS d2,
  row_number() OVER (PARTITION BY p.n, a.idx ORDER BY {sq('qa.e', 'qb.e')}, b.idx) AS rank
  FROM (VALUES (1), (3)) p(n) JOIN near a ON a.rn <= p.n JOIN near b ON b.rn = 1 AND b.label = a.label
  JOIN emb qa ON qa.idx = a.idx JOIN emb qb ON qb.idx = b.idx)
 SELECT nprobe, qid, rank, idx, round(d2, 6) AS distance FROM hits WHERE rank <= 3""",
    "vec_normalize": f"""WITH {EMB}, scaled AS (SELECT idx, list_transform(e, lambda x: x * (label - 4)) AS v FROM emb),
 done AS (SELECT idx, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM scaled)
 SELECT idx, length, pos, round(x, 6) + 0.0 AS x FROM (SELECT idx, round(sqrt(list_dot_product(v, v)), 6) AS length,
  unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM done)""",
    "vec_info": """SELECT 'embeddings' AS collection_name, count(*) AS total_embeddings, max(len(embedding))::INT AS embedding_dim,
 'cosine' AS index_type, 'tables' AS persist_directory FROM embeddings""",
    "collection_roundtrip": f"""WITH {EMB}, {UNIT} SELECT 'known_' || (row_number() OVER (ORDER BY idx) - 1) AS id,
 row_number() OVER (ORDER BY idx) - 1 AS idx, round(list_sum(e), 4) AS total FROM unit""",
    "collection_search": SELF_L2.replace("{where}", "") + """ SELECT qid, rank, 'known_' || idx AS id,
 CAST(label AS VARCHAR) AS label, round(d2, 6) AS distance FROM hits WHERE rank <= 3""",
    "cluster_radius": f"""WITH {EMB}, {UNIT}, {RADIUS_COS.replace('{src}', 'unit')}
, all_c AS (SELECT label, unnest(range(0, len(c))) AS pos, unnest(c) AS x FROM center)
 SELECT cluster_id, n, round(r, 6) AS max_distance, pos, round(x, 6) + 0.0 AS x FROM radii JOIN all_c ON label = cluster_id""",
    "cluster_radius_l2": f"""WITH {EMB}, {RADIUS.replace('{src}', 'emb')} SELECT cluster_id, n, max_distance, pos, round(x, 6) + 0.0 AS x FROM
 (SELECT u.label AS cluster_id, count(*) AS n, round(max(sqrt({sq('u.e', 'm')})), 6) AS max_distance
 FROM emb u JOIN mean USING (label) GROUP BY u.label) JOIN (SELECT label, unnest(range(0, len(m))) AS pos, unnest(m) AS x FROM mean) ON label = cluster_id""",
    "knn_eps": f"WITH {EMB}, {FOLD}, {NN} SELECT round(eps, 6) AS eps, CAST(ms AS INT) AS min_samples FROM par",
    "nearest_other": f"""WITH {EMB} SELECT a.idx AS id, round(sqrt(min({sq('a.e', 'b.e')})), 6) AS d
 FROM emb a JOIN emb b ON a.idx <> b.idx GROUP BY a.idx""",
    "pair_median": f"""WITH {EMB} SELECT round(quantile_cont(sqrt({sq('a.e', 'b.e')}), 0.5), 6) AS median
 FROM emb a JOIN emb b ON a.idx < b.idx""",
    "dbscan_labels": DBSCAN + " SELECT idx, cluster_id FROM labels",
    "cluster_collection": DBSCAN + f""", all3 AS (SELECT f.idx, l.cluster_id AS label, f.e FROM fold f JOIN labels l USING (idx)),
 {RADIUS_COS.replace('{src}', 'all3').replace('range(1, 65)', 'range(1, 4)')}
 SELECT cluster_id, n, round(r, 6) AS max_distance FROM radii""",
    "silhouette_exact": f"""WITH {EMB}, size AS (SELECT label, count(*) AS n FROM emb GROUP BY label),
 sums AS (SELECT a.idx, a.label AS own, b.label AS other, sum(sqrt({sq('a.e', 'b.e')})) AS t FROM emb a CROSS JOIN emb b GROUP BY ALL),
 sides AS (SELECT idx, max(CASE WHEN own = other THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b
  FROM sums JOIN size ON size.label = sums.other GROUP BY idx)
 SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM sides""",
    "silhouette_squared": f"""WITH {EMB}, size AS (SELECT label, count(*) AS n FROM emb GROUP BY label),
 sums AS (SELECT a.idx, a.label AS own, b.label AS other, sum({sq('a.e', 'b.e')}) AS t FROM emb a CROSS JOIN emb b GROUP BY ALL),
 sides AS (SELECT idx, max(CASE WHEN own = other THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b
  FROM sums JOIN size ON size.label = sums.other GROUP BY idx)
 SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM sides""",
    "sweep_alpha": SWEEP,
    "trace_rows": f"WITH {LOG} SELECT idx, raw, cluster_id FROM log WHERE cluster_id = 3",
    "cluster_counts": f"WITH {LOG} SELECT cluster_id, count(*) AS cnt FROM log GROUP BY cluster_id",
    "cluster_summary": SUMMARY,
    "cluster_indices": f"""WITH {LOG} SELECT cluster_id, CAST(idx // 4096 AS BIGINT) AS part,
 string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indices FROM log GROUP BY cluster_id, part""",
    "cluster_topn": SUMMARY + " ORDER BY cnt DESC, first_idx LIMIT 3",
    "largest_cluster_head": f"""WITH {LOG}, top AS (SELECT cluster_id FROM log GROUP BY cluster_id
  ORDER BY count(*) DESC, min(idx) LIMIT 1)
 SELECT cluster_id, idx, raw FROM log WHERE cluster_id = (SELECT cluster_id FROM top) ORDER BY idx LIMIT 3""",
    "cluster_stats": statistics(SYSCALL_NA, "true"),
    "refine_mapping": rf"""WITH {LOG} SELECT cluster_id, idx, 'processName' AS name, 'u' || user_id AS content FROM log UNION ALL
 SELECT cluster_id, idx, 'eventName', event_type FROM log UNION ALL
 SELECT cluster_id, idx, 'syscall', CASE WHEN value > 150 THEN NULL ELSE 'sys_' || event_type END FROM log WHERE event_type <> 'view' UNION ALL
 SELECT cluster_id, idx, 'returnValue', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) FROM log UNION ALL
 SELECT cluster_id, idx, 'args', '[{{"name": "k", "value": "' || replace(props, '"', '\"') || '"}}]' FROM log UNION ALL
 SELECT cluster_id, idx, 'executable', '{{"path": "/bin/' || event_type || '"}}' FROM log UNION ALL
 SELECT cluster_id, idx, 'executableTag', 'a<b' FROM log WHERE event_type = 'error'""",
    "refine_stats": statistics("CASE WHEN value > 150 THEN NULL ELSE 'sys_' || event_type END", "event_type <> 'view'"),
    "refine_flatten": rf"""WITH {LOG} SELECT cluster_id, idx AS index,
 '[{{"name": "k", "value": "' || replace(props, '"', '\"') || '"}}]' AS args, event_type AS "eventName",
 '{{"path": "/bin/' || event_type || '"}}' AS executable,
 CASE WHEN event_type = 'error' THEN 'a<b' END AS "executableTag", 'u' || user_id AS "processName",
 CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS "returnValue",
 CASE WHEN value > 150 OR event_type = 'view' THEN NULL ELSE 'sys_' || event_type END AS syscall FROM log""",
    "mapping_roundtrip": f"WITH {LOG} SELECT cluster_id, idx, raw AS data FROM log",
    "mapping_json_roundtrip": f"WITH {LOG} SELECT cluster_id, idx, raw AS data FROM log",
    "classify": CLASSIFY + """ SELECT idx, base_idx, cluster_id, is_unknown, CASE WHEN NOT is_unknown THEN cluster_id END AS class_id,
 round(similarity, 6) AS similarity, round(distance, 6) AS distance, round(max_distance, 6) AS max_distance,
 within_max_distance FROM classed""",
    "classify_counts": CLASSIFY + """ SELECT CASE WHEN is_unknown THEN 'unknown' ELSE CAST(cluster_id AS VARCHAR) END AS class,
 count(*) AS cnt FROM classed GROUP BY 1""",
    "classify_summary": CLASSIFY + """ SELECT count(*) FILTER (NOT is_unknown) AS classified,
 count(*) FILTER (is_unknown) AS unknown FROM classed""",
    "classify_top_clusters": CLASSIFY + """ SELECT cluster_id, count(*) AS cnt FROM classed WHERE cluster_id <> -1
 GROUP BY cluster_id ORDER BY cnt DESC, cluster_id LIMIT 10""",
    "run_roundtrip": f"""WITH {SEQ}, {grams(3)} SELECT ngram, count(*) AS cnt, count(*) AS stored, min(start_idx) AS first_idx,
 true AS is_member FROM grams GROUP BY ngram""",
    "detect_e2e": E2E,
    "study": f"WITH {STUDY_SEQ}, {grams(3)}, {SPLIT}, " + QUALITY.replace("{more}", ""),
    "study_sizes": sizes(STUDY_SEQ, (2, 3, 5)),
}
