"""The same results in plain SQL, independent of the operators, for the queries SQL can express."""


def _r(expr: str, digits: int = 6) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"


def _distance(a: str, b: str) -> str:
    """L1 between two REAL lists, summed in DOUBLE, stored as REAL."""
    return f"CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST(abs({a}[i] - {b}[i]) AS DOUBLE))) AS REAL)"


def _squares(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _gap(a: str, b: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: {a}[i] - {b}[i])"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


# ---------------------------------------------------------------- spectra views

EMB = """
emb AS (SELECT vec_id AS star_id, p AS pix,
               CAST(CAST(0.75 AS DOUBLE) - CAST(0.5 AS DOUBLE) * CAST(embedding[p + 1] AS DOUBLE) AS REAL) AS flux,
               (vec_id * 7 + p * 13) % 29 <> 0 AS good, CAST(CAST(0.01 AS DOUBLE) * (1 + p % 4) AS REAL) AS err
        FROM embeddings, range(64) t(p)),
chunkings AS (SELECT CAST(chunking AS BIGINT) AS chunking, width FROM (VALUES (0, 16), (1, 8), (2, 4)) k(chunking, width))"""

EVT = """
daily AS (SELECT user_id, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS day,
                 CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mean
          FROM events GROUP BY 1, 2),
evt AS (SELECT u.user_id AS star_id, p AS pix, mean IS NOT NULL AS good,
               CAST(1 - CAST(0.9 AS DOUBLE) * mean / (SELECT max(mean) FROM daily) AS REAL) AS flux
        FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range((SELECT max(day) + 1 FROM daily))) AS p) t
        LEFT JOIN daily d ON d.user_id = u.user_id AND d.day = p)"""

_LETTERS = ", ".join(f"length(text) - length(translate(text, '{c}{c.upper()}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")
DOC = f"""
letters AS (SELECT doc_id AS star_id, [{_LETTERS}] AS n FROM documents),
doc AS (SELECT star_id, list_transform(n, lambda v: CAST(1 - CAST(v AS DOUBLE) / greatest(list_sum(n), 1) AS REAL)) AS v FROM letters)"""


# ---------------------------------------------------------------- distance

def _curves(depth: str, source: str = "emb") -> str:
    return f"""
cells AS (SELECT e.*, chunking, pix // width AS chunk FROM {source} e, chunkings),
weighted AS (SELECT *, CASE WHEN good THEN 1 / greatest(CAST(err AS DOUBLE), 1e-6) ^ 2 ELSE 0 END AS iv FROM cells),
scaled AS (SELECT *, iv / greatest(sum(iv) OVER c / greatest(sum(CAST(good AS INT)) OVER c, 1), 1e-300) AS w FROM weighted
           WINDOW c AS (PARTITION BY star_id, chunking, chunk)),
depths AS (SELECT *, CASE WHEN good THEN {depth} ELSE CAST(0 AS DOUBLE) END AS dep FROM scaled),
runs AS (SELECT *, sum(dep) OVER (PARTITION BY star_id, chunking, chunk ORDER BY pix ROWS UNBOUNDED PRECEDING) AS cdf FROM depths),
ends AS (SELECT *, last_value(cdf) OVER (PARTITION BY star_id, chunking, chunk ORDER BY pix
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tot FROM runs),
curves AS (SELECT star_id, chunking, chunk, pix,
                  CAST(cdf / CASE WHEN abs(tot) < CAST(0.001 AS DOUBLE) THEN CAST(0.001 AS DOUBLE) ELSE tot END AS REAL) AS f FROM ends)"""


PLAIN = "CAST(1 AS DOUBLE) - CAST(flux AS DOUBLE)"
CURVES = _curves(PLAIN)
MEDIANS = f"""
lists AS (SELECT star_id, chunking, chunk, list(f ORDER BY pix) AS v FROM curves GROUP BY ALL),
gaps AS (SELECT a.chunking, a.chunk, {_distance('a.v', 'b.v')} AS d FROM lists a JOIN lists b
         ON a.chunking = b.chunking AND a.chunk = b.chunk AND a.star_id < b.star_id),
medians AS (SELECT chunking, chunk, greatest(CAST(CAST(quantile_cont(CAST(d AS DOUBLE), 0.5) AS REAL) AS DOUBLE), 1e-12) AS median
            FROM gaps GROUP BY ALL)"""
FEATURES = """
phi AS (SELECT star_id, chunking, chunk, pix, CAST(f / CAST(median AS REAL) AS REAL) AS phi FROM curves JOIN medians USING (chunking, chunk)),
vecs AS (SELECT star_id, list(phi ORDER BY chunking, pix) AS v FROM phi GROUP BY star_id)"""


def _knn(k: int, source: str = "vecs", name: str = "knn") -> str:
    return f"""
{name}_d AS (SELECT a.star_id, b.star_id AS nbr_id, {_distance('a.v', 'b.v')} AS dist
             FROM {source} a JOIN {source} b ON a.star_id <> b.star_id),
{name} AS (SELECT star_id, nbr_id, dist, row_number() OVER (PARTITION BY star_id ORDER BY dist, nbr_id) AS rank
           FROM {name}_d QUALIFY rank <= {k})"""


EMB_KNN = (EMB, CURVES, MEDIANS, FEATURES, _knn(10))
KNN_OUT = f"SELECT star_id, rank, nbr_id, {_r('dist', 4)} AS dist FROM knn"


# ---------------------------------------------------------------- graph

def _edges(source: str = "knn") -> str:
    return f"""
edges AS (SELECT src, dst, CAST(max(dist) AS DOUBLE) AS w FROM
          (SELECT star_id AS src, nbr_id AS dst, dist FROM {source} UNION ALL SELECT nbr_id, star_id, dist FROM {source}) GROUP BY src, dst)"""


COMPONENTS = """
reach AS (SELECT star_id AS a, star_id AS b FROM doc UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src),
comps AS (SELECT a AS star_id, min(b) AS comp FROM reach GROUP BY a)"""
BRIDGES = f"""
main AS (SELECT comp FROM comps GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1),
spans AS (SELECT ca.comp, a.star_id AS src, b.star_id AS dst, CAST({_distance('a.v', 'b.v')} AS DOUBLE) AS w
          FROM doc a JOIN comps ca ON ca.star_id = a.star_id AND ca.comp <> (SELECT comp FROM main)
          CROSS JOIN (SELECT d.* FROM doc d JOIN comps c ON c.star_id = d.star_id AND c.comp = (SELECT comp FROM main)) b),
bridge AS (SELECT src, dst, w FROM spans QUALIFY row_number() OVER (PARTITION BY comp ORDER BY w, src, dst) = 1),
joined AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM edges UNION ALL SELECT * FROM bridge
           UNION ALL SELECT dst, src, w FROM bridge) GROUP BY src, dst)"""
GEODESICS = """
marks AS (SELECT star_id AS l FROM doc ORDER BY CAST('0x' || substr(md5('1:' || star_id), 1, 13) AS BIGINT), star_id LIMIT 6),
paths(l, v, d) USING KEY (l, v) AS (
    SELECT l, l, CAST(0 AS DOUBLE) FROM marks
    UNION
    SELECT p.l, e.dst, min(p.d + e.w) FROM paths p JOIN joined e ON e.src = p.v
    LEFT JOIN recurring.paths r ON r.l = p.l AND r.v = e.dst
    WHERE r.d IS NULL OR p.d + e.w < r.d GROUP BY p.l, e.dst)"""
DOC_EDGES = (DOC, _knn(3, "doc"), _edges())
DOC_PATHS = (*DOC_EDGES, COMPONENTS, BRIDGES, GEODESICS)


# ---------------------------------------------------------------- preprocessing

def _local(width: int) -> str:
    x = f"(-1 + CAST(2 AS DOUBLE) * (pix % {width}) / {width - 1})"
    cont = "greatest((c2 * t0 - c1 * t1) / (c0 * c2 - c1 * c1) + (c0 * t1 - c1 * t0) / (c0 * c2 - c1 * c1) * x, CAST(0.2 AS DOUBLE))"
    return _with(EMB, f"""
px AS (SELECT *, pix // {width} AS chunk, CAST(flux AS DOUBLE) AS f, {x} AS x FROM emb),
lim AS (SELECT star_id, chunk, CASE WHEN count(*) FILTER (good) > 10 THEN quantile_cont(f, 0.85) FILTER (good) ELSE CAST('-inf' AS DOUBLE) END AS thr
        FROM px GROUP BY ALL),
fitted AS (SELECT star_id, chunk, count(*) + CAST(1e-6 AS DOUBLE) AS c0, sum(x) AS c1, sum(x * x) + CAST(1e-6 AS DOUBLE) AS c2,
                  sum(f) AS t0, sum(x * f) AS t1 FROM px JOIN lim USING (star_id, chunk) WHERE good AND f >= thr GROUP BY ALL)""") + f"""
SELECT star_id, pix, {_r(f'CAST(f / {cont} AS REAL)', 4)} AS flux, {_r(f'CAST(CAST(err AS DOUBLE) / {cont} AS REAL)', 5)} AS err
FROM px JOIN fitted USING (star_id, chunk)"""


def _running(half: int, first: int, step: int) -> str:
    return f"""
knots AS (SELECT {first} + {step} * i AS knot FROM (SELECT unnest(range((SELECT max(day) + 1 FROM daily))) AS i) t
          WHERE {first} + {step} * i < (SELECT max(day) + 1 FROM daily) - {first}),
levels AS (SELECT star_id, knot, quantile_cont(CAST(flux AS DOUBLE), 0.9) AS y FROM evt JOIN knots
           ON good AND pix >= greatest(0, knot - {half}) AND pix < least((SELECT max(day) + 1 FROM daily), knot + {half})
           GROUP BY star_id, knot HAVING count(*) >= 10 AND y > 0),
sides AS (SELECT e.star_id, e.pix, max(knot) FILTER (knot <= e.pix) AS k0, arg_max(y, knot) FILTER (knot <= e.pix) AS y0,
                 min(knot) FILTER (knot >= e.pix) AS k1, arg_min(y, knot) FILTER (knot >= e.pix) AS y1
          FROM evt e LEFT JOIN levels USING (star_id) GROUP BY ALL),
running AS (SELECT star_id, pix, CASE WHEN k0 IS NULL THEN y1 WHEN k1 IS NULL OR k1 = k0 THEN y0
                   ELSE y0 + (y1 - y0) / (k1 - k0) * (pix - k0) END AS cont FROM sides)"""


def _fold(d: int, j: int) -> str:
    """The sum of every d-th element of a whole vector, from the j-th on."""
    return f"list_sum(CAST(embedding[{j + 1}:len(embedding):{d}] AS DOUBLE[]))"


def _points(d: int) -> str:
    return f"pts AS (SELECT vec_id AS star_id, [{', '.join(_fold(d, j) for j in range(d))}] AS c FROM embeddings)"


COORD3 = _points(3)
LABELS = """
scored AS (SELECT l.doc_id, unnest([CAST(0 AS BIGINT), 1]) AS axis, unnest([CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)]) AS y,
                  unnest([n_chars / CAST(7000 AS DOUBLE), ln(CAST(n_chars AS DOUBLE) + 3) / CAST(11 AS DOUBLE)]) AS p
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
ERR = "(quantile_cont(p - y, 0.84) - quantile_cont(p - y, 0.16)) / 2"

ORACLES: dict[str, str] = {
    "spectra_long": _with(DOC) + f"""SELECT star_id, p AS pix, {_r('v[p + 1]')} AS flux, TRUE AS good, CAST(1 AS DOUBLE) AS err
        FROM doc, range(26) t(p)""",
    "segment_chunks": _with(EMB) + f"""SELECT chunking, pix // width AS chunk, min(pix) AS a, max(pix) + 1 AS b,
        {_r('avg(CAST(good AS INT))')} AS cover FROM emb, chunkings GROUP BY chunking, pix // width""",
    "local_continuum": _local(16),
    "local_continuum_few_good": _local(8),
    "running_continuum": _with(EVT, _running(6, 3, 8)) + f"SELECT star_id, pix, {_r('cont')} AS continuum FROM running",
    "running_continuum_wide": _with(EVT, _running(10, 5, 8)) + f"SELECT star_id, pix, {_r('cont')} AS continuum FROM running",
    "prepare_pixel_cut": _with(EVT, _running(10, 5, 8), """
ratios AS (SELECT star_id, pix, CAST(flux AS DOUBLE) / cont AS ratio, cont,
                  coalesce(good AND flux / cont > 0 AND flux / cont < 1.5, FALSE) AS ok FROM evt JOIN running USING (star_id, pix)),
kept AS (SELECT pix FROM ratios GROUP BY pix HAVING avg(CAST(ok AS INT)) > 0.88)""") + f"""
        SELECT star_id, pix AS day, {_r('CAST(CASE WHEN ok THEN ratio ELSE 1 END AS REAL)', 5)} AS flux, ok AS good,
               {_r('CAST(CASE WHEN ok THEN 1 / cont ELSE 1 END AS REAL)', 5)} AS err FROM ratios JOIN kept USING (pix)""",
    "fill_bad": _with(EVT, "means AS (SELECT pix, coalesce(avg(CAST(flux AS DOUBLE)) FILTER (good), 1) AS mean FROM evt GROUP BY pix)") + f"""
        SELECT star_id, pix, {_r('CASE WHEN good THEN flux ELSE mean END', 5)} AS flux FROM evt JOIN means USING (pix)""",
    "cumulative_curve": _with(EMB, CURVES) + f"SELECT star_id, chunking, chunk, pix, {_r('f', 4)} AS f FROM curves",
    "cumulative_curve_weighted": _with(EMB, _curves(f"({PLAIN}) * w")) + f"SELECT star_id, chunking, chunk, pix, {_r('f', 4)} AS f FROM curves",
    "curve_guard": _with(EMB, """faint AS (SELECT star_id, pix, good, err,
        CAST(1 - CAST(0.00001 AS DOUBLE) * (CAST(0.75 AS DOUBLE) - CAST(flux AS DOUBLE)) AS REAL) AS flux FROM emb)""", _curves(PLAIN, "faint")) + f"""
        SELECT star_id, chunking, chunk, pix, {_r('f', 4)} AS f FROM curves""",
    "chunk_medians": _with(EMB, CURVES, MEDIANS) + f"""SELECT chunking, chunk, chunk * width AS a, (chunk + 1) * width AS b,
        {_r('median')} AS median FROM medians JOIN chunkings USING (chunking)""",
    "features_long": _with(EMB, CURVES, MEDIANS, FEATURES) + f"SELECT star_id, chunking, chunk, pix, {_r('phi', 4)} AS phi FROM phi",
    "l1_pairwise": _with(EMB, CURVES, MEDIANS, FEATURES) + f"""SELECT a.star_id, b.star_id AS other_id, {_r(_distance('a.v', 'b.v'), 4)} AS dist
        FROM vecs a CROSS JOIN vecs b""",
    "rescore_candidates": _with(EMB, CURVES, MEDIANS, FEATURES) + f"""SELECT a.star_id, b.star_id AS nbr_id, {_r(_distance('a.v', 'b.v'), 4)} AS dist
        FROM vecs a, range(1, 9) t(s) JOIN vecs b ON b.star_id = (a.star_id + s) % (SELECT count(*) FROM embeddings)""",
    "w1_pixel": _with(EMB, CURVES) + f"""SELECT a.star_id AS i, b.star_id AS j, a.chunk, {_r('sum(abs(CAST(a.f AS DOUBLE) - CAST(b.f AS DOUBLE)))', 4)} AS w1
        FROM curves a JOIN curves b ON a.chunking = 0 AND b.chunking = 0 AND b.star_id = a.star_id + 1 AND a.chunk = b.chunk AND a.pix = b.pix
        GROUP BY ALL""",
    "knn_exact": _with(*EMB_KNN) + KNN_OUT,
    "knn_nndescent": _with(*EMB_KNN) + KNN_OUT,
    "knn_nndescent_documents": _with(DOC, _knn(10, "doc")) + KNN_OUT,
    "knn_exact_copies": _with(DOC, _knn(3, "doc")) + KNN_OUT,
    "knn_overlap": _with(*EMB_KNN, """
rough_gaps AS (SELECT * FROM lists WHERE chunking = 0),
rough_vecs AS (SELECT star_id, list(phi ORDER BY pix) AS v FROM phi WHERE chunking = 0 GROUP BY star_id)""", _knn(10, "rough_vecs", "rough")) + """
        SELECT k.star_id, count(r.rank) AS shared, max(coalesce(k.rank = 1 AND r.rank = 1, FALSE)) AS same_first
        FROM knn k LEFT JOIN rough r ON r.star_id = k.star_id AND r.nbr_id = k.nbr_id GROUP BY k.star_id""",
    "lattice_edges": _with(*EMB_KNN, _edges()) + f"SELECT src, dst, {_r('w', 4)} AS w FROM edges",
    "degree_stats": _with(*EMB_KNN, _edges()) + f"""SELECT count(*) // 2 AS n_edges,
        {_r('count(*) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE)')} AS mean_degree FROM edges""",
    "components": _with(*DOC_EDGES, COMPONENTS, recursive=True) + "SELECT star_id, comp FROM comps",
    "piece_sizes": _with(*DOC_EDGES, COMPONENTS, recursive=True) + "SELECT comp, count(*) AS size FROM comps GROUP BY comp",
    "bridges": _with(*DOC_EDGES, COMPONENTS, BRIDGES, recursive=True) + f"SELECT src, dst, {_r('w')} AS w FROM bridge",
    "geodesics": _with(*DOC_PATHS, recursive=True) + f"SELECT l AS landmark_id, v AS star_id, {_r('d')} AS d FROM paths",
    "landmark_means": _with(*DOC_PATHS, recursive=True) + f"SELECT l AS landmark_id, {_r('avg(d * d)', 5)} AS mean_sq FROM paths GROUP BY l",
    "mds_centering": _with(EMB, CURVES, MEDIANS, FEATURES, f"""
sq AS (SELECT a.star_id AS i, b.star_id AS j, CAST({_distance('a.v', 'b.v')} AS DOUBLE) ^ 2 AS d2 FROM vecs a CROSS JOIN vecs b)""") + f"""
        SELECT i, j, {_r('-0.5 * (d2 - avg(d2) OVER (PARTITION BY i) - avg(d2) OVER (PARTITION BY j) + avg(d2) OVER ())', 3)} AS b FROM sq""",
    "classical_mds": _with(COORD3, "mid AS (SELECT [avg(c[1]), avg(c[2]), avg(c[3])] AS m FROM pts)") + f"""
        SELECT star_id, {_r(_squares('c', 'm'), 5)} AS norm2 FROM pts, mid""",
    "landmark_mds": _with(COORD3) + f"""SELECT a.star_id, {_r('sqrt(' + _squares('a.c', 'b.c') + ')', 5)} AS separation
        FROM pts a JOIN (SELECT c FROM pts ORDER BY star_id LIMIT 1) b ON TRUE""",
    "pca_norms": _with(EMB, """
means AS (SELECT pix, CAST(avg(CAST(flux AS DOUBLE)) FILTER (good) AS REAL) AS mean FROM emb GROUP BY pix),
filled AS (SELECT star_id, pix, CAST(CASE WHEN good THEN flux ELSE mean END AS DOUBLE) AS f FROM emb JOIN means USING (pix)),
centred AS (SELECT star_id, f - avg(f) OVER (PARTITION BY pix) AS f FROM filled)""") + f"""
        SELECT star_id, {_r('sum(f * f)', 4)} AS norm2 FROM centred GROUP BY star_id""",
    "gram_trace": _with(*EMB_KNN) + f"""SELECT k.star_id, {_r('sum((CAST(b.flux AS DOUBLE) - CAST(a.flux AS DOUBLE)) ^ 2)', 5)} AS trace
        FROM knn k JOIN emb a ON a.star_id = k.star_id JOIN emb b ON b.star_id = k.nbr_id AND b.pix = a.pix GROUP BY k.star_id""",
    "lle_weights": "SELECT vec_id AS star_id, CAST(10 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS total FROM embeddings",
    "lle_weights_two": _with(*EMB_KNN, """
two AS (SELECT p.star_id, p.nbr_id AS n1, s.nbr_id AS n2 FROM knn p JOIN knn s ON s.star_id = p.star_id AND p.rank = 1 AND s.rank = 2),
gram AS (SELECT t.star_id, n1, n2, sum((CAST(b.flux AS DOUBLE) - CAST(a.flux AS DOUBLE)) ^ 2) AS g11,
                sum((CAST(c.flux AS DOUBLE) - CAST(a.flux AS DOUBLE)) ^ 2) AS g22,
                sum((CAST(b.flux AS DOUBLE) - CAST(a.flux AS DOUBLE)) * (CAST(c.flux AS DOUBLE) - CAST(a.flux AS DOUBLE))) AS g12
         FROM two t JOIN emb a ON a.star_id = t.star_id JOIN emb b ON b.star_id = n1 AND b.pix = a.pix
         JOIN emb c ON c.star_id = n2 AND c.pix = a.pix GROUP BY ALL),
raw AS (SELECT *, g22 + CAST(0.001 AS DOUBLE) * (g11 + g22) - g12 AS r1, g11 + CAST(0.001 AS DOUBLE) * (g11 + g22) - g12 AS r2 FROM gram)""") + f"""
        SELECT star_id AS src, n1 AS dst, {_r('r1 / (r1 + r2)')} AS w FROM raw UNION ALL SELECT star_id, n2, {_r('r2 / (r1 + r2)')} FROM raw""",
    "lle_weights_three": _with(*EMB_KNN, f"""
flx AS (SELECT star_id, list(CAST(flux AS DOUBLE) ORDER BY pix) AS v FROM emb GROUP BY star_id),
three AS (SELECT p.star_id, p.nbr_id AS n1, s.nbr_id AS n2, t.nbr_id AS n3 FROM knn p JOIN knn s ON s.star_id = p.star_id AND p.rank = 1 AND s.rank = 2
          JOIN knn t ON t.star_id = p.star_id AND t.rank = 3),
apart AS (SELECT t.star_id, n1, n2, n3, {_gap('b.v', 'a.v')} AS d1, {_gap('c.v', 'a.v')} AS d2, {_gap('e.v', 'a.v')} AS d3
         FROM three t JOIN flx a ON a.star_id = t.star_id JOIN flx b ON b.star_id = n1 JOIN flx c ON c.star_id = n2 JOIN flx e ON e.star_id = n3),
dots AS (SELECT star_id, n1, n2, n3, {_dot('d1', 'd1')} AS p11, {_dot('d2', 'd2')} AS p22, {_dot('d3', 'd3')} AS p33,
                {_dot('d1', 'd2')} AS g12, {_dot('d1', 'd3')} AS g13, {_dot('d2', 'd3')} AS g23 FROM apart),
gram AS (SELECT *, p11 + ridge AS g11, p22 + ridge AS g22, p33 + ridge AS g33 FROM (SELECT *, CAST(0.001 AS DOUBLE) * (p11 + p22 + p33) AS ridge FROM dots)),
raw AS (SELECT star_id, n1, n2, n3, g22 * g33 - g23 * g23 + g13 * g23 - g12 * g33 + g12 * g23 - g13 * g22 AS r1,
               g13 * g23 - g12 * g33 + g11 * g33 - g13 * g13 + g12 * g13 - g11 * g23 AS r2,
               g12 * g23 - g13 * g22 + g12 * g13 - g11 * g23 + g11 * g22 - g12 * g12 AS r3 FROM gram)""") + f"""
        SELECT star_id AS src, unnest([n1, n2, n3]) AS dst, unnest([{_r('r1 / (r1 + r2 + r3)')}, {_r('r2 / (r1 + r2 + r3)')}, {_r('r3 / (r1 + r2 + r3)')}]) AS w FROM raw""",
    "system_diag": _with(*EMB_KNN) + f"""SELECT e.vec_id AS star_id, {_r('1 + count(k.nbr_id) * CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE)')} AS diag
        FROM embeddings e LEFT JOIN knn k ON k.nbr_id = e.vec_id GROUP BY e.vec_id""",
    "anchor_check": _with(DOC, _knn(3, "doc"), _edges(), COMPONENTS, recursive=True) + """SELECT DISTINCT comp FROM comps WHERE comp NOT IN
        (SELECT comp FROM comps JOIN labels ON doc_id = star_id WHERE toxic = 1 AND quality = 1)""",
    "density_spacing": _with(COORD3, """
st AS (SELECT avg(c[1]) AS m1, avg(c[2]) AS m2, avg(c[3]) AS m3, stddev_pop(c[1]) AS s1, stddev_pop(c[2]) AS s2, stddev_pop(c[3]) AS s3 FROM pts),
z AS (SELECT star_id, (c[1] - m1) / s1 AS x, (c[2] - m2) / s2 AS y, (c[3] - m3) / s3 AS w FROM pts, st),
near AS (SELECT a.star_id, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.w - b.w) ^ 2) AS r FROM z a JOIN z b ON a.star_id <> b.star_id)""") + f"""
        SELECT star_id, {_r('r', 5)} AS r FROM near QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY r) = 20""",
    "density_draw": _with(COORD3, """
st AS (SELECT avg(c[1]) AS m1, avg(c[2]) AS m2, avg(c[3]) AS m3, stddev_pop(c[1]) AS s1, stddev_pop(c[2]) AS s2, stddev_pop(c[3]) AS s3 FROM pts),
z AS (SELECT star_id, (c[1] - m1) / s1 AS x, (c[2] - m2) / s2 AS y, (c[3] - m3) / s3 AS w FROM pts, st),
near AS (SELECT a.star_id, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.w - b.w) ^ 2) AS r FROM z a JOIN z b ON a.star_id <> b.star_id),
spacing AS (SELECT star_id, r FROM near QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY r) = 20)""") + """
        SELECT star_id FROM spacing
        ORDER BY -ln((CAST('0x' || substr(md5('0:' || star_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / r ^ 0.75, star_id LIMIT 50""",
    "heldout_rows": "SELECT doc_id AS star_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "label_error": _with(LABELS) + f"SELECT axis, {_r(ERR)} AS err FROM scored GROUP BY axis",
    "label_r2": _with(LABELS) + f"""SELECT axis, {_r(ERR)} AS err, {_r('1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*))')} AS r2
        FROM scored GROUP BY axis""",
    "linear_probe": f"SELECT {_r('regr_r2(label, ' + _fold(1, 0) + ')', 8)} AS r2 FROM embeddings",
    "quadratic_map": _with(f"""
xy AS (SELECT {_fold(1, 0)} AS x, CAST(label AS DOUBLE) AS y FROM embeddings),
lin AS (SELECT regr_slope(y, x) AS slope_y, regr_intercept(y, x) AS at_y, regr_slope(x * x, x) AS slope_q, regr_intercept(x * x, x) AS at_q,
               var_pop(y) * count(*) AS sst FROM xy),
res AS (SELECT y - at_y - slope_y * x AS ry, x * x - at_q - slope_q * x AS rq, sst FROM xy, lin)""") + f"""
        SELECT CAST(3 AS BIGINT) AS terms, {_r('1 - (sum(ry * ry) - sum(ry * rq) ^ 2 / sum(rq * rq)) / max(sst)', 8)} AS r2 FROM res""",
    "design": f"""WITH z AS (SELECT vec_id AS star_id, {_fold(2, 0)} AS a, {_fold(2, 1)} AS b FROM embeddings),
        basis AS (SELECT star_id, [1, a, b, a * a, a * b, b * b, a * a * a, a * a * b, a * b * b, b * b * b] AS t FROM z)
        SELECT star_id, i AS term, {_r('t[i + 1]')} AS v FROM basis, range(10) r(i)""",
    "pair_jitter": _with(_points(4), f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY star_id) - 1 AS rn FROM pts),
jit AS (SELECT sqrt({_squares('a.c', 'b.c')}) / sqrt(2) AS j FROM numbered a JOIN numbered b ON a.rn % 2 = 0 AND b.rn = a.rn + 1),
near AS (SELECT a.star_id, sqrt({_squares('a.c', 'b.c')}) AS r FROM pts a JOIN pts b ON a.star_id <> b.star_id),
tenth AS (SELECT r FROM near QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY r) = 10)""") + f"""
        SELECT {_r('(SELECT quantile_cont(j, 0.5) FROM jit) / (SELECT quantile_cont(r, 0.5) FROM tenth)')} AS jitter""",
    "oriented": f"""WITH s AS (SELECT CASE WHEN corr({_fold(1, 0)}, label) < 0 THEN -1 ELSE 1 END AS sign FROM embeddings)
        SELECT vec_id AS star_id, {_r('sign * ' + _fold(1, 0))} AS c FROM embeddings, s""",
}
