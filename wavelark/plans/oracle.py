"""The catalogue's queries as DuckDB SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from wavelark.operators import vq
from wavelark.plans import catalogue as cat
from wavelark.plans import fixtures as fx

P = fx.ORDER


def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


def _unpivot(source: str, keys: str, columns: list[str], index: str, value: str) -> str:
    values = ", ".join(columns)
    return f"SELECT {keys}, i - 1 AS {index}, v[i] AS {value} FROM (SELECT {keys}, [{values}] AS v, unnest(range(1, {len(columns) + 1})) AS i FROM {source})"


_R = [f"r{i}" for i in range(P + 1)]


def _step_up_raa(ks: list[str], source: str, keys: str, out: str) -> str:
    """CTEs from reflections (columns or expressions) to out(keys, raa0..raaP)."""
    p = len(ks)
    parts = [f"{out}_0 AS (SELECT {keys}, {', '.join(f'{k} AS q{i + 1}' for i, k in enumerate(ks))} FROM {source})"]
    qs = ", ".join(f"q{i}" for i in range(1, p + 1))
    for m in range(1, p + 1):
        new = "".join(f", u{m - 1}_{j} + q{m} * u{m - 1}_{m - j} AS u{m}_{j}" for j in range(1, m)) + f", q{m} AS u{m}_{m}"
        parts.append(f"{out}_{m} AS (SELECT {keys}, {qs}{new} FROM {out}_{m - 1})")
    a = ["CAST(1 AS DOUBLE)"] + [f"u{p}_{j}" for j in range(1, p + 1)]
    raa = ", ".join("(" + " + ".join(f"{a[k]} * {a[k + n]}" for k in range(p + 1 - n)) + f") AS raa{n}" for n in range(p + 1))
    parts.append(f"{out} AS (SELECT {keys}, {raa} FROM {out}_{p})")
    return ", ".join(parts)


def _near(raas, source: str = "norm", keys: str = "vec_id, label") -> str:  # noqa: ANN001
    """CTE near(keys, codeword, d): the least distortion, the lowest codeword on ties."""
    ds = [fx.distortion_sql(raa, source) for raa in raas]
    return f"dist AS (SELECT {keys}, [{', '.join(ds)}] AS ds FROM {source}), near AS (SELECT {keys}, list_position(ds, list_min(ds)) - 1 AS codeword, list_min(ds) AS d FROM dist)"


_NEAR2 = f"{fx.LPC_SQL}, {_near(cat.BOOK2.raa)}"
_SIGNALS = f"WITH {fx.SAMPLES_SQL}, sig AS (SELECT user_id, list(x ORDER BY pos) AS x, count(*) AS n FROM samples GROUP BY user_id), frames AS (SELECT user_id, t, list_slice(x, t * {fx.STEP} + 1, t * {fx.STEP} + {fx.WIDTH}) AS f FROM (SELECT *, unnest(range(0, (n - {fx.WIDTH}) // {fx.STEP} + 1)) AS t FROM sig WHERE n >= {fx.WIDTH}))"
_FRAMES = f"{_SIGNALS} SELECT user_id, CAST(t AS INT) AS t, {_r('f[1]', 'first')}, {_r(f'f[{fx.WIDTH}]', 'last')}, CAST(len(f) AS INT) AS cnt FROM frames"

# --- Markov models: recursion over positions, three states -------------------------------------

_N = 3
_FORWARD = (
    f"WITH RECURSIVE {fx.SEQ_SQL}, {fx.MODELS_SQL}, fw AS (SELECT s.user_id, m.model_id, s.t, m.a, m.b, "
    + ", ".join(f"m.pi[{j + 1}] * m.b[{j + 1}][s.o + 1] AS v{j}" for j in range(_N))
    + ", CAST(0 AS DOUBLE) AS lp FROM seq s, models m WHERE s.t = 0 UNION ALL SELECT s.user_id, f.model_id, s.t, f.a, f.b, "
    + ", ".join("(" + " + ".join(f"f.v{i} / (f.v0 + f.v1 + f.v2) * f.a[{i + 1}][{j + 1}]" for i in range(_N)) + f") * f.b[{j + 1}][s.o + 1]" for j in range(_N))
    + ", f.lp + ln(f.v0 + f.v1 + f.v2) FROM fw f JOIN seq s ON s.user_id = f.user_id AND s.t = f.t + 1), "
    "ends AS (SELECT user_id, max(t) AS t FROM seq GROUP BY user_id), "
    "scored AS (SELECT f.user_id, f.model_id, f.lp + ln(f.v0 + f.v1 + f.v2) AS lp FROM fw f JOIN ends e ON e.user_id = f.user_id AND e.t = f.t)"
)

#: The same without what a Viterbi query defines already.
_FORWARD_CTES = _FORWARD[_FORWARD.index("fw AS (") :].replace("ends AS (SELECT user_id, max(t) AS t FROM seq GROUP BY user_id), ", "")


def _ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) ELSE CAST('-inf' AS DOUBLE) END"


def _arrive(j: int) -> list[str]:
    return [f"f.p{i} + {_ln(f'f.a[{i + 1}][{j + 1}]')}" for i in range(_N)]


def _viterbi_step() -> str:
    ps, paths = [], []
    for j in range(_N):
        a = _arrive(j)
        best = f"greatest({', '.join(a)})"
        ps.append(f"{best} + {_ln(f'f.b[{j + 1}][s.o + 1]')}")
        paths.append(f"CASE WHEN {a[0]} >= {a[1]} AND {a[0]} >= {a[2]} THEN f.s0 WHEN {a[1]} >= {a[2]} THEN f.s1 ELSE f.s2 END || '{j}'")
    return ", ".join(ps + paths)


_VITERBI = (
    f"WITH RECURSIVE {fx.SEQ_SQL}, {fx.MODELS_SQL}, vt AS (SELECT s.user_id, m.model_id, s.t, m.a, m.b, "
    + ", ".join(f"{_ln(f'm.pi[{j + 1}]')} + {_ln(f'm.b[{j + 1}][s.o + 1]')} AS p{j}" for j in range(_N))
    + ", "
    + ", ".join(f"'{j}' AS s{j}" for j in range(_N))
    + f" FROM seq s, models m WHERE s.t = 0 UNION ALL SELECT s.user_id, f.model_id, s.t, f.a, f.b, {_viterbi_step()} FROM vt f JOIN seq s ON s.user_id = f.user_id AND s.t = f.t + 1), "
    "ends AS (SELECT user_id, max(t) AS t FROM seq GROUP BY user_id), "
    "best AS (SELECT v.user_id, v.model_id, greatest(p0, p1, p2) AS lp, CASE WHEN p0 >= p1 AND p0 >= p2 THEN s0 WHEN p1 >= p2 THEN s1 ELSE s2 END AS path FROM vt v JOIN ends e ON e.user_id = v.user_id AND e.t = v.t)"
)
_COUNTS = _VITERBI + ", hits AS (SELECT CAST(substr(b.path, CAST(s.t AS INT) + 1, 1) AS INT) AS state, s.o AS symbol, count(*) AS n FROM best b JOIN seq s ON s.user_id = b.user_id WHERE b.model_id = 1 GROUP BY ALL)"

_CASES = (
    _FORWARD + ", cls AS (SELECT DISTINCT user_id, class_name FROM seq), ranked AS (SELECT s.user_id, c.class_name AS actual, CAST(s.model_id AS VARCHAR) AS name, row_number() OVER (PARTITION BY s.user_id ORDER BY lp DESC, model_id DESC) AS k FROM scored s JOIN cls c ON c.user_id = s.user_id), "
    "cases AS (SELECT user_id, actual, max(CASE WHEN k = 1 THEN name END) AS predicted, max(CASE WHEN k = 1 THEN name END) = actual AS correct, CAST(max(CASE WHEN name = actual THEN k END) AS INT) AS rank, "
    "string_agg(name, '>' ORDER BY k) AS ranked, " + ", ".join(f"max(CASE WHEN k = {k} THEN name END) AS r{k}" for k in (1, 2, 3)) + " FROM ranked GROUP BY user_id, actual)"
)

# --- endpoint detection ------------------------------------------------------------------------

_EPD = (
    "WITH RECURSIVE raw AS (SELECT event_type AS path, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY event_type) AS c, value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), "
    "env AS (SELECT path, n, c, (CASE WHEN n % 3 = 0 THEN -1 ELSE 1 END) * value * (CASE WHEN n BETWEEN 300 AND c - 250 THEN 40 ELSE 1 END) AS x FROM raw WHERE c >= 200), "
    "scaled AS (SELECT path, n, c, CASE WHEN n = 0 OR max(x) OVER (PARTITION BY path) >= 4096 THEN x ELSE CAST(4096 AS DOUBLE) * x / max(x) OVER (PARTITION BY path) END AS x FROM env), "
    "emph AS (SELECT path, n, c, x - 0.95 * coalesce(lag(x) OVER (PARTITION BY path ORDER BY n), 0) AS y FROM scaled), "
    "blocked AS (SELECT path, n // 10 AS block, n % 10 AS k, c // 10 - 1 AS n_blocks, y, lag(y) OVER (PARTITION BY path ORDER BY n) AS before FROM emph), "
    "blocks AS (SELECT path, block, n_blocks, sum(abs(y)) AS mag, sum(CASE WHEN k > 0 AND (y >= 0) <> (before >= 0) THEN 1 ELSE 0 END) AS zc FROM blocked WHERE block < n_blocks GROUP BY path, block, n_blocks), "
    "lead AS (SELECT path, n_blocks, avg(zc) FILTER (block < 10) + 2 * sqrt(greatest(sum(zc * zc) FILTER (block < 10) / 10.0 - pow(avg(zc) FILTER (block < 10), 2), 0)) AS z, "
    "greatest(12, avg(mag) FILTER (block < 10) + 2 * sqrt(greatest(sum(mag * mag) FILTER (block < 10) / 10.0 - pow(avg(mag) FILTER (block < 10), 2), 0))) AS imn, max(mag) FILTER (block >= 10) AS imx FROM blocks GROUP BY path, n_blocks), "
    "lim AS (SELECT path, n_blocks, CAST(least(25, greatest(9, floor(z + 0.5))) AS INT) AS izct, CAST(least(floor(0.03 * (imx - imn) + imn + 0.5), floor(4 * imn + 0.5)) AS INT) AS itl FROM lead), "
    "e AS (SELECT b.path, b.block - 10 AS m, b.mag, b.zc, l.izct, l.itl, 5 * l.itl AS itu, l.n_blocks - 11 AS top FROM blocks b JOIN lim l ON l.path = b.path WHERE b.block >= 10), "
    # forward: the start of the current run of blocks above the lower threshold, kept block by block
    "fwd AS (SELECT path, m, CASE WHEN mag >= itl THEN m END AS run, CASE WHEN mag >= itu THEN m END AS hit FROM e WHERE m = 0 UNION ALL "
    "SELECT e.path, e.m, CASE WHEN e.mag < e.itl THEN NULL ELSE coalesce(f.run, e.m) END, CASE WHEN e.mag >= e.itu THEN e.m END FROM fwd f JOIN e ON e.path = f.path AND e.m = f.m + 1 WHERE f.hit IS NULL), "
    "a AS (SELECT path, CASE WHEN run = hit AND run > 0 THEN run - 1 ELSE run END AS n1 FROM fwd WHERE hit IS NOT NULL), "
    "bwd AS (SELECT path, m, top, CASE WHEN mag >= itl THEN m END AS run, CASE WHEN mag >= itu THEN m END AS hit FROM e WHERE m = top UNION ALL "
    "SELECT e.path, e.m, e.top, CASE WHEN e.mag < e.itl THEN NULL ELSE coalesce(f.run, e.m) END, CASE WHEN e.mag >= e.itu THEN e.m END FROM bwd f JOIN e ON e.path = f.path AND e.m = f.m - 1 WHERE f.hit IS NULL AND e.m > 0), "
    "b AS (SELECT path, CASE WHEN run = hit AND run < top - 1 THEN run + 1 ELSE run END AS n2 FROM bwd WHERE hit IS NOT NULL), "
    "fine AS (SELECT a.path, n1, n2, count(*) FILTER (zc >= izct AND m BETWEEN greatest(n1 - 25, 0) AND n1) AS c1, min(m) FILTER (zc >= izct AND m BETWEEN greatest(n1 - 25, 0) AND n1) AS m1, "
    "count(*) FILTER (zc >= izct AND m BETWEEN n2 AND least(n2 + 25, top)) AS c2, max(m) FILTER (zc >= izct AND m BETWEEN n2 AND least(n2 + 25, top)) AS m2 FROM a JOIN b ON a.path = b.path JOIN e ON e.path = a.path GROUP BY a.path, n1, n2), "
    "ends AS (SELECT path, CASE WHEN c1 >= 3 THEN m1 ELSE n1 END AS s, CASE WHEN c2 >= 3 THEN m2 ELSE n2 END AS t FROM fine), "
    "cut AS (SELECT x.path, CAST(10 * (s + 10) AS BIGINT) AS start, CAST(10 * (t - s) AS BIGINT) AS length, 100.0 * CAST(10 * (t - s) AS DOUBLE) / c AS percent FROM ends x JOIN (SELECT DISTINCT path, c FROM raw) r ON r.path = x.path)"
)

_SEGMENTS = "segs AS (SELECT CAST(event_id + 1 AS INT) AS selection, date_diff('microsecond', (SELECT min(ts) FROM events), ts) / CAST(1000000 AS DOUBLE) AS begin_s, event_type AS type, user_id FROM events)"
_CODE = fx._CASE
_FILE = "regexp_extract(url, '([^/]*)$', 1)"
_CLASS = r"regexp_extract(url, '^(?:.*)/([^/]*)/[^/]*$', 1)"


def _renamed(path: str) -> str:
    return rf"CASE WHEN contains({path}, '.') THEN regexp_extract({path}, '^(.*)\.[^.]*$', 1) || '.prd' ELSE {path} END"


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(rows) + ")"


def _centroids() -> str:
    sums = ", ".join(f"sum(norm.r{i}) AS r{i}" for i in range(P + 1))
    return f"{_NEAR2}, cells AS (SELECT near.codeword, sum(near.d - 1) AS distortion, count(*) AS cardinality, {sums} FROM near JOIN norm ON norm.vec_id = near.vec_id GROUP BY near.codeword), " + fx.levinson_sql("cells", "codeword, distortion, cardinality", "cen")


def _grown() -> str:
    rows = [f"({i}, " + ", ".join(_d(v) for v in raa[:3]) + ")" for i, raa in enumerate(cat.BOOK4.raa)]
    ks = [f"k{i}" for i in range(1, P + 1)]
    base = [f"({c}, {s}, " + ", ".join(f"{_d(v)} * {_d(g)}" for v in rc[1:]) + ")" for c, rc in enumerate(cat.BOOK2.rc) for s, g in enumerate(vq.GROW)]
    del rows
    return f"WITH g(codeword, side, {', '.join(ks)}) AS {_values(base)}, " + _step_up_raa(ks, "g", "codeword, side", "su") + ", " + f"flat AS ({_unpivot('su', 'codeword, side', ['raa0', 'raa1', 'raa2'], 'n', 'raa')}) SELECT CAST(codeword * 2 + side AS INT) AS codeword, CAST(n AS INT) AS n, {_r('raa', 'raa')} FROM flat"


def _classified() -> str:
    parts = []
    for i, book in enumerate(cat.CLASS_BOOKS):
        ds = ", ".join(fx.distortion_sql(raa) for raa in book.raa)
        parts.append(f"SELECT label, {i} AS model_id, avg(least({ds}) - 1) AS score FROM norm GROUP BY label")
    return f"WITH {fx.LPC_SQL}, scores AS ({' UNION ALL '.join(parts)}) SELECT label, model_id, {_r('score', 'score')}, CAST(row_number() OVER (PARTITION BY label ORDER BY score, model_id DESC) AS INT) AS rank FROM scores"


def _reported() -> str:
    """Candidate order of the codebooks as classifiers; a label is a sequence, its remainder the class."""
    parts = []
    for i, book in enumerate(cat.CLASS_BOOKS):
        ds = ", ".join(fx.distortion_sql(raa) for raa in book.raa)
        parts.append(f"SELECT label, {i} AS model_id, avg(least({ds}) - 1) AS score FROM norm GROUP BY label")
    return f"WITH {fx.LPC_SQL}, scores AS ({' UNION ALL '.join(parts)}), ranked AS (SELECT label, model_id, row_number() OVER (PARTITION BY label ORDER BY score, model_id DESC) AS rank FROM scores), mine AS (SELECT CAST(label % 3 AS VARCHAR) AS actual, rank FROM ranked WHERE model_id = label % 3) SELECT coalesce(actual, 'TOTAL') AS class_name, count(*) AS tests, " + ", ".join(f"count(*) FILTER (rank = {k}) AS r{k}" for k in (1, 2, 3)) + " FROM mine GROUP BY ROLLUP (actual)"


def _spectrum(source: str, values: str, length: int, size: int) -> str:
    """CTE spectrum(vec_id, k, m): magnitudes of the discrete Fourier transform by its definition."""
    part = lambda f: f"list_sum(list_transform(range(1, {length + 1}), lambda n: v[n] * {f}(2 * pi() * k * (n - 1) / {size})))"
    return f"bins AS (SELECT vec_id, {values} AS v, unnest(range(0, {size // 2 + 1})) AS k FROM {source}), spectrum AS (SELECT vec_id, k, sqrt(pow({part('cos')}, 2) + pow({part('sin')}, 2)) AS m FROM bins)"


_O = 5


def _first_model() -> str:
    m = fx.MODELS[0]
    cols = [f"{_d(m.trans[i][j])} AS a{i}{j}" for i in range(_N) for j in range(_N)] + [f"{_d(m.emit[i][o])} AS b{i}{o}" for i in range(_N) for o in range(_O)]
    return f"m0 AS (SELECT {', '.join(cols)})"


def _em(k: int) -> str:
    """CTEs from model mk to the expected counts nk(kind, i, j, v): forward and backward by recursion over places."""
    n, pi = range(_N), fx.MODELS[0].pi
    emitted = lambda row, i: f"[{', '.join(f'm.b{i}{o}' for o in range(_O))}][{row}.o + 1]"
    total = "(f.v0 + f.v1 + f.v2)"
    return ", ".join([
        f"fw{k} AS (SELECT s.user_id, s.t, s.o, " + ", ".join(f"{_d(pi[j])} * {emitted('s', j)} AS v{j}" for j in n) + f" FROM seq s, m{k} m WHERE s.t = 0 UNION ALL SELECT s.user_id, s.t, s.o, " + ", ".join("(" + " + ".join(f"f.v{i} / {total} * m.a{i}{j}" for i in n) + f") * {emitted('s', j)}" for j in n) + f" FROM fw{k} f JOIN seq s ON s.user_id = f.user_id AND s.t = f.t + 1, m{k} m)",
        f"al{k} AS MATERIALIZED (SELECT f.user_id, f.t, f.o, {total} AS c, " + ", ".join(f"f.v{j} / {total} AS a{j}" for j in n) + f", max(f.t) OVER (PARTITION BY f.user_id) AS top FROM fw{k} f)",
        f"bw{k} AS (SELECT user_id, t, o, c, CAST(1 AS DOUBLE) AS b0, CAST(1 AS DOUBLE) AS b1, CAST(1 AS DOUBLE) AS b2 FROM al{k} WHERE t = top UNION ALL SELECT p.user_id, p.t, p.o, p.c, " + ", ".join("(" + " + ".join(f"m.a{i}{j} * {emitted('w', j)} * w.b{j} / w.c" for j in n) + ")" for i in n) + f" FROM bw{k} w JOIN al{k} p ON p.user_id = w.user_id AND p.t = w.t - 1, m{k} m)",
        f"be{k} AS MATERIALIZED (SELECT * FROM bw{k})",
        f"tr{k} AS (SELECT " + ", ".join(f"sum(p.a{i} * m.a{i}{j} * {emitted('w', j)} * w.b{j} / w.c) AS t{i}{j}" for i in n for j in n) + f" FROM al{k} p JOIN be{k} w ON w.user_id = p.user_id AND w.t = p.t + 1, m{k} m)",
        f"em{k} AS (SELECT p.o, " + ", ".join(f"sum(p.a{i} * w.b{i}) AS e{i}" for i in n) + f" FROM al{k} p JOIN be{k} w ON w.user_id = p.user_id AND w.t = p.t GROUP BY p.o)",
        f"n{k} AS MATERIALIZED (" + " UNION ALL ".join([f"SELECT 'a' AS kind, {i} AS i, {j} AS j, t{i}{j} AS v FROM tr{k}" for i in n for j in n] + [f"SELECT 'b', {i}, {o}, coalesce(sum(e{i}), 0) FROM em{k} WHERE o = {o}" for i in n for o in range(_O)] + [f"SELECT 'lp', 0, 0, sum(ln(c)) FROM al{k}", "SELECT 'dead', 0, 0, CAST(0 AS DOUBLE)"]) + ")",
    ])


def _learned(steps: int) -> str:
    """Sum of log P before each step. A step's rows are its counts over their sums, emissions with the floor (which none meets here)."""
    parts = [f"WITH RECURSIVE {fx.SEQ_SQL}, {_first_model()}"]
    for k in range(steps):
        parts.append(_em(k))
        share = lambda kind, i, j: f"max(CASE WHEN kind = '{kind}' AND i = {i} AND j = {j} THEN v END) / sum(CASE WHEN kind = '{kind}' AND i = {i} THEN v END)"
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT " + ", ".join([f"{share('a', i, j)} AS a{i}{j}" for i in range(_N) for j in range(_N)] + [f"{share('b', i, o)} AS b{i}{o}" for i in range(_N) for o in range(_O)]) + f" FROM n{k})")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS iteration, {_r('v', 'sum_log_prob')} FROM n{k} WHERE kind = 'lp'" for k in range(steps))


def _floored() -> str:
    rows = ", ".join(f"({i}, {fx._list(r)})" for i, r in enumerate(cat.FLOOR_ROWS))
    return (
        f"WITH b(state, p) AS (VALUES {rows}), q AS (SELECT state, p, list_sum(list_transform(p, lambda v: greatest({_d(0.01)} - v, 0))) AS low, list_sum(list_transform(p, lambda v: greatest(v - {_d(0.01)}, 0))) AS spare FROM b) "
        f"SELECT state, CAST(i - 1 AS INT) AS symbol, {_r(f'CASE WHEN p[i] <= {_d(0.01)} THEN {_d(0.01)} ELSE p[i] - (p[i] - {_d(0.01)}) * (CASE WHEN spare > 0 THEN low / spare ELSE 0 END) END', 'p')} FROM (SELECT *, unnest(range(1, 5)) AS i FROM q)"
    )


def oracle_sql() -> dict[str, str]:
    ks = ", ".join(f"k{i}" for i in range(1, P + 1))
    as_ = ", ".join(f"a{i}" for i in range(1, P + 1))
    empty = vq.Codebook.of([*cat.BOOK2.rc, [0.999 if i == 1 else 0.0 for i in range(P + 1)]])
    colors = ["lightgreen", "lightblue", "blue", "yellow", "orange", "red"]
    frames_pre = (
        f"{_SIGNALS}, mean0 AS (SELECT user_id, t, list_transform(f, lambda v: v - list_sum(f) / {fx.WIDTH}) AS f FROM frames), "
        f"pre AS (SELECT user_id, t, list_transform(range(1, {fx.WIDTH + 1}), lambda i: (f[i] - 0.95 * (CASE WHEN i = 1 THEN 0 ELSE f[i - 1] END)) * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / {fx.WIDTH - 1}))) AS y FROM mean0) "
        f"SELECT user_id, CAST(t AS INT) AS t, {_r('list_sum(y)', 'total')}, {_r('list_sum(list_transform(y, lambda v: v * v))', 'energy')} FROM pre"
    )
    durations = ", ".join(f"({i}, '{t}')" for i, t in enumerate(cat.DURATIONS))
    pattern = r"'^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+(?:\.\d+)?)s)?$'"
    text10 = lambda e: f"CASE WHEN len({e}) > 40 THEN array_to_string({e}[1:10], ', ') || ', ..., ' || array_to_string({e}[-10:], ', ') ELSE array_to_string({e}, ', ') END"
    sql = {
        "lpc_show": f"WITH {fx.LPC_SQL} SELECT vec_id, {', '.join(f"printf('%.5f', r{i}) AS r{i}" for i in range(3))} FROM norm",
        "vq_show": "SELECT * FROM " + _values([f"({c * 2 + side}, '{k}', '0', '0')" for c, ks_ in enumerate((("-0.495", "-0.505"), ("0.495", "0.505"))) for side, k in enumerate(ks_)]) + " AS t(codeword, k1, k2, k3)",
        "sel_title": _CASES + " SELECT user_id, CASE rank WHEN 1 THEN r1 WHEN 2 THEN r1 || ', ' || r2 ELSE r1 || ', ' || r2 || ', ' || r3 END AS title FROM cases",
        "sel_signal_interval": f"WITH {fx.SAMPLES_SQL}, n AS (SELECT user_id, count(*) AS c, (user_id % 20) * 2 AS b FROM samples GROUP BY user_id) SELECT s.user_id, CAST(count(*) AS INT) AS n, {_r('sum(x)', 'total')} FROM samples s JOIN n ON n.user_id = s.user_id WHERE s.pos >= b AND s.pos < b + 45 AND b + 45 < c GROUP BY s.user_id",
        "hmm_show": f"WITH {fx.MODELS_SQL}, rows_ AS (SELECT model_id, 'pi' AS part, 0 AS row, pi AS p FROM models UNION ALL SELECT model_id, 'A', i - 1, a[i] FROM (SELECT *, unnest(range(1, 4)) AS i FROM models) UNION ALL SELECT model_id, 'B', i - 1, b[i] FROM (SELECT *, unnest(range(1, 4)) AS i FROM models)) SELECT model_id, part, CAST(row AS INT) AS row, array_to_string(list_transform(p, lambda v: printf('%.3f ', v)), '') AS text FROM rows_",
        "seq_show": _VITERBI + f", {_FORWARD_CTES}, l AS (SELECT user_id, list(CAST(o AS VARCHAR) ORDER BY t) AS o FROM seq GROUP BY user_id) SELECT l.user_id, {text10('l.o')} AS text, {_r('s.lp', 'lp')}, {text10("string_split(b.path, '')")} AS states FROM l JOIN best b ON b.user_id = l.user_id AND b.model_id = 1 JOIN scored s ON s.user_id = l.user_id AND s.model_id = 1",
        "lpc_autocorr": f"WITH {fx.autocorrelation_sql()}, flat AS ({_unpivot('ac', 'vec_id', _R, 'i0', 'r0')}) SELECT vec_id, CAST(i0 AS INT) AS i, {_r('r0', 'r')} FROM flat",
        "lpc_levinson": f"WITH {fx.LPC_SQL} SELECT vec_id, CAST(i AS INT) AS k, {_r('k[i]', 'rc')}, {_r('a[i]', 'a')}, {_r('pe', 'pe')} FROM (SELECT vec_id, pe, [{ks}] AS k, [{as_}] AS a, unnest(range(1, {P + 1})) AS i FROM lp)",
        "lpc_stepup_raa": f"WITH {fx.LPC_SQL}, {_step_up_raa([f'k{i}' for i in range(1, P + 1)], 'lp', 'vec_id', 'su')}, flat AS ({_unpivot('su', 'vec_id', [f'raa{i}' for i in range(P + 1)], 'n', 'raa')}) SELECT vec_id, CAST(n AS INT) AS n, {_r('raa', 'raa')} FROM flat",
        "lpc_gain_norm": f"WITH {fx.LPC_SQL}, flat AS ({_unpivot('norm', 'vec_id', _R, 'n', 'v')}) SELECT vec_id, CAST(n AS INT) AS n, {_r('v', 'v')} FROM flat",
        "frame_sliding": _FRAMES,
        "frame_sliding_window_fn": _FRAMES,
        "frame_preprocess": frames_pre,
        "preemphasis_lag": f"WITH {fx.SAMPLES_SQL} SELECT event_id, {_r('x - 0.95 * coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY pos), 0)', 'y')} FROM samples",
        "vq_distortion": f"WITH {fx.LPC_SQL}, d AS (SELECT vec_id, [{', '.join(fx.distortion_sql(r) for r in cat.BOOK2.raa)}] AS ds, unnest(range(1, 3)) AS i FROM norm) SELECT vec_id, CAST(i - 1 AS INT) AS codeword, {_r('ds[i]', 'd')} FROM d",
        "vq_initial_assign": f"WITH {_NEAR2} SELECT CAST(codeword AS INT) AS codeword, count(*) AS cardinality, {_r('sum(d - 1)', 'distortion')} FROM near GROUP BY codeword",
        "vq_min_dists": f"WITH {_NEAR2} SELECT vec_id, CAST(codeword AS INT) AS codeword, {_r('d - 1', 'min_distortion')} FROM near",
        "vq_quantize_seq": f"WITH {_NEAR2}, s AS (SELECT label, string_agg(CAST(codeword AS VARCHAR), '' ORDER BY vec_id) AS symbols, avg(d - 1) AS a FROM near GROUP BY label) SELECT CAST(label AS VARCHAR) AS label, symbols, {_r('a', 'avg_distortion')} FROM s UNION ALL SELECT 'all', '', {_r('avg(a)', 'avg_distortion')} FROM s",
        "vq_cell_stats": f"WITH {fx.LPC_SQL}, {_near(empty.raa)}, c AS (SELECT codeword, count(*) AS n, avg(d - 1) AS a FROM near GROUP BY codeword) SELECT CAST(i AS INT) AS index, coalesce(n, 0) AS cardinality, {_r('a', 'distortion')} FROM (SELECT unnest(range(0, 3)) AS i) g LEFT JOIN c ON c.codeword = g.i",
        "vq_centroid_update": f"WITH {_centroids()} SELECT CAST(codeword AS INT) AS codeword, CAST(i AS INT) AS k, {_r('k[i]', 'rc')} FROM (SELECT codeword, [{ks}] AS k, unnest(range(1, {P + 1})) AS i FROM cen)",
        "vq_grow": _grown(),
        "vq_sigma": f"WITH {_centroids()}, v AS (SELECT codeword, {', '.join(f'r{i} / pe AS r{i}' for i in range(P + 1))} FROM cen), {_step_up_raa([f'k{i}' for i in range(1, P + 1)], 'cen', 'codeword', 'su')}, pairs AS (SELECT v.r0 * su.raa0 + 2 * ({' + '.join(f'v.r{i} * su.raa{i}' for i in range(1, P + 1))}) - 1 AS d FROM v JOIN su ON v.codeword <> su.codeword) SELECT count(*) AS pairs, {_r('avg(d) / (SELECT sum(distortion) / sum(cardinality) FROM cells)', 'sigma')} FROM pairs",
        "vq_inertia": f"WITH {_NEAR2} SELECT {_r('sum(d * d)', 'inertia')} FROM near",
        "vq_classify": _classified(),
        "seq_symbols": f"WITH {fx.SEQ_SQL} SELECT user_id, class_name, string_agg(CAST(o AS VARCHAR), '' ORDER BY t) AS symbols FROM seq GROUP BY ALL",
        "hmm_forward": _FORWARD + f" SELECT user_id, {', '.join(_r(f'max(CASE WHEN model_id = {i} THEN lp END)', f'lp{i}') for i in range(3))} FROM scored GROUP BY user_id",
        "hmm_viterbi": _VITERBI + f" SELECT user_id, model_id, {_r('lp', 'lp')}, path FROM best",
        "hmm_state_symbol_counts": _COUNTS + " SELECT * FROM hits",
        "hmm_estimate_b": _COUNTS + f", grid AS (SELECT s AS state, o AS symbol FROM (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest([0, 1, 2, 3, 4]) AS o)), full_ AS (SELECT g.state, g.symbol, coalesce(n, 0) AS n FROM grid g LEFT JOIN hits h ON h.state = g.state AND h.symbol = g.symbol) SELECT state, symbol, {_r('CASE WHEN sum(n) OVER (PARTITION BY state) = 0 THEN 0.2 ELSE n / sum(n) OVER (PARTITION BY state) END', 'p')} FROM full_",
        "hmm_floor_b": _floored(),
        "hmm_check_stochastic": f"WITH {fx.MODELS_SQL}, rows_ AS (SELECT model_id, 'pi' AS part, 0 AS row, pi AS p FROM models UNION ALL SELECT model_id, 'A', i - 1, a[i] FROM (SELECT *, unnest(range(1, 4)) AS i FROM models) UNION ALL SELECT model_id, 'B', i - 1, b[i] FROM (SELECT *, unnest(range(1, 4)) AS i FROM models)) SELECT model_id, part, CAST(row AS INT) AS row, {_r('list_sum(p)', 'total')}, abs(list_sum(p) - 1) > 1e-10 AS bad FROM rows_",
        "hmm_classify": _CASES + " SELECT user_id, actual, predicted, correct, rank, ranked FROM cases",
        "eval_confusion": _CASES + ", t AS (SELECT actual, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS as_{c}" for c in cat.CLASSES) + ", count(*) AS tests, count(*) FILTER (predicted <> actual AND predicted IN (SELECT actual FROM cases)) AS errors FROM cases GROUP BY actual) SELECT * FROM t",
        "eval_candidate_order": _CASES + " SELECT coalesce(actual, 'TOTAL') AS class_name, count(*) AS tests, " + ", ".join(f"count(*) FILTER (rank = {k}) AS r{k}" for k in (1, 2, 3)) + " FROM cases GROUP BY ROLLUP (actual)",
        "eval_accuracy": _CASES + f", per AS (SELECT actual, count(*) AS tests, count(*) FILTER (correct) AS hits FROM cases GROUP BY actual), tot AS (SELECT CAST(sum(tests) AS BIGINT) AS tests, CAST(sum(hits) AS BIGINT) AS hits, avg(100.0 * CAST(hits AS DOUBLE) / tests) AS m FROM per) SELECT actual AS class_name, tests, hits, {_r('100.0 * CAST(hits AS DOUBLE) / tests', 'accuracy')}, '' AS json FROM per UNION ALL SELECT 'TOTAL', tests, hits, {_r('m', 'accuracy')}, printf('{{\"accuracy\": %.2f, \"avg_accuracy\": %.2f}}', 100.0 * CAST(hits AS DOUBLE) / tests, m) FROM tot",
        "eval_ranked_misses": _CASES + " SELECT user_id, actual, rank, CASE rank WHEN 2 THEN r1 || '>' || r2 ELSE ranked END AS candidates FROM cases WHERE NOT correct",
        "eval_c12n": _CASES + " SELECT CAST(user_id AS VARCHAR) AS seq_filename, actual AS seq_class_name, CASE WHEN correct THEN '*' ELSE '!' END AS correct, rank, r1, r2, r3 FROM cases",
        "eval_unmatched": "SELECT DISTINCT CAST(user_id % 5 AS VARCHAR) AS class_name FROM events WHERE user_id % 5 > 2",
        "split_train_test": "WITH r AS (SELECT vec_id, CAST(label AS VARCHAR) AS class_name, row_number() OVER (PARTITION BY label ORDER BY md5('s|' || vec_id)) - 1 AS j, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT class_name, CASE WHEN floor(0.7 * n) = 0 THEN 'predictors' WHEN j <= floor(0.7 * n) THEN 'TRAIN' ELSE 'TEST' END AS split, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM r WHERE n >= 5 GROUP BY 1, 2",
        "epd_blocks": _EPD + f" SELECT path, CAST(block AS INT) AS block, {_r('mag', 'mag')}, CAST(zc AS INT) AS zc FROM blocks",
        "epd_thresholds": _EPD + " SELECT path, izct, itl, 5 * itl AS itu FROM lim",
        "endpoint_detection": _EPD + f" SELECT path, start, length, {_r('percent', 'percent')} FROM cut",
        "epd_summary": _EPD + f" SELECT count(*) AS n, {_r('avg(percent)', 'avg_percent')}, {_r('min(percent)', 'min_percent')}, {_r('max(percent)', 'max_percent')} FROM cut",
        "signal_stats": f"WITH {fx.SAMPLES_SQL} SELECT user_id, {_r('sum(x) FILTER (pos BETWEEN 5 AND 30) / count(*)', 'mean')}, {_r('max(x) FILTER (pos BETWEEN 5 AND 30)', 'max')}, {_r('min(x) FILTER (pos BETWEEN 5 AND 30)', 'min')} FROM samples GROUP BY user_id HAVING count(*) > 5",
        "sel_codeword_counts": f"SELECT {_CODE} AS codeword, count(*) AS n FROM events GROUP BY 1",
        "sel_interval_frames": f"SELECT event_id AS idx, {_CODE} AS codeword, CAST(1234 + (event_id - 82) * 15 AS BIGINT) AS ms FROM events WHERE event_id BETWEEN 82 AND 82 + 40",
        "sel_mask_samples": f"WITH {fx.SAMPLES_SQL}, f AS (SELECT user_id, pos // 4 AS idx FROM samples WHERE pos % 4 = 0 AND event_type IN ('error', 'signup')), m AS (SELECT s.user_id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.user_id = s.user_id AND s.pos >= 4 * f.idx AND s.pos < 4 * f.idx + 6) THEN s.x ELSE 0 END AS x FROM samples s) SELECT user_id, {_r('sum(x)', 'total')}, count(*) FILTER (x = 0) AS zeros FROM m GROUP BY user_id",
        "sel_segments_join": _CASES + f", {_SEGMENTS} SELECT c.user_id, CAST(c.user_id * 7 AS INT) AS selection, c.rank, s.type, {_r('s.begin_s', 'begin_s')} FROM cases c LEFT JOIN segs s ON s.selection = c.user_id * 7",
        "sel_cover": f"WITH {_SEGMENTS}, s AS (SELECT * FROM segs) SELECT min(selection) AS min_selection, max(selection) AS max_selection, {_r('arg_min(begin_s, selection)', 'begin_s')}, {_r('arg_max(begin_s + 1, selection)', 'end_s')}, {_r('arg_max(begin_s + 1, selection) - arg_min(begin_s, selection)', 'duration_s')} FROM s",
        "sel_contained": f"WITH {_SEGMENTS} SELECT selection, {_r('begin_s', 'begin_s')} FROM segs WHERE begin_s >= 3600 AND begin_s + 1 <= 864000",
        "sel_interval_join": f"WITH {fx.SAMPLES_SQL} SELECT f.user_id, m.pos AS mark, f.pos AS idx, f.event_type FROM samples f JOIN samples m ON m.user_id = f.user_id AND m.pos < 5 AND f.pos * 10 >= m.pos * 50 AND f.pos * 10 < m.pos * 50 + 123",
        "eval_error_rate": _CASES + f", per AS (SELECT actual, avg(CASE WHEN correct THEN 100.0 ELSE 0 END) AS a FROM cases GROUP BY actual) SELECT {_r('100 - avg(a)', 'error_rate')} FROM per",
        "vq_report": _reported(),
        "lpc_envelope": f"WITH {fx.LPC_SQL}, {_spectrum('lp', '[CAST(1 AS DOUBLE), ' + as_ + ']', P + 1, 16)} SELECT vec_id, CAST(k AS INT) AS bin, {_r('-20 * log10(greatest(m, 1e-12))', 'db')} FROM spectrum",
        "frame_spectrum": f"WITH {fx.autocorrelation_sql()}, {_spectrum('emb', 'x', 64, 64)} SELECT vec_id, CAST(k AS INT) AS bin, {_r('20 * log10(greatest(m, 1e-12))', 'db')} FROM spectrum",
        "hmm_em_step": f"WITH RECURSIVE {fx.SEQ_SQL}, {_first_model()}, {_em(0)} SELECT kind, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_r('v', 'v')} FROM n0",
        "hmm_learn": _learned(6),
        "sel_times": f"WITH {_SEGMENTS} SELECT selection, {_r('coalesce(sum(begin_s + 1 - begin_s) OVER (PARTITION BY user_id ORDER BY selection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 'concat_s')}, {_r('begin_s - first_value(begin_s) OVER (PARTITION BY user_id ORDER BY selection)', 'offset_s')} FROM segs",
        "sel_label": _CASES + f" SELECT actual, user_id AS selection, rank, CASE WHEN rank <= 6 THEN {colors}[rank] ELSE 'brown' END AS color, max(rank) OVER (PARTITION BY actual) - rank + 1 AS height, CASE WHEN count(*) OVER (PARTITION BY actual) > 140 THEN '' WHEN rank = 1 THEN actual || '#' || user_id ELSE predicted || '>' || rank || ':' || actual || '#' || user_id END AS label FROM cases",
        "sel_hist": "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM events, e GROUP BY 1",
        "sel_dense_ranks": _CASES + ", r AS (SELECT CAST(user_id % 50 AS INT) AS selection, arg_max(rank, user_id) AS rank FROM cases GROUP BY 1) SELECT CAST(g.i AS INT) AS selection, coalesce(r.rank, 0) AS rank FROM (SELECT unnest(range(0, 61)) AS i) g LEFT JOIN r ON r.selection = g.i",
        "pos_join": f"WITH {_NEAR2} SELECT n.vec_id AS ordinal, {_r('lp.k1', 'k1')}, {_r('lp.k2', 'k2')}, CAST(n.codeword AS INT) AS codeword FROM near n JOIN lp ON lp.vec_id = n.vec_id WHERE n.d - 1 <= 0.25",
        "path_functions": f"SELECT page_id, {_CLASS} AS class_name, {_FILE} AS simple, {_renamed('url')} AS renamed, 'data/predictors/P8/' || CASE WHEN {_CLASS} = '' THEN '_' ELSE {_CLASS} END || '/' || {_renamed(_FILE)} AS out FROM pages",
        "duration_parse": f"WITH t(i, text) AS (VALUES {durations}), p AS (SELECT i, text, nullif(regexp_extract(text, {pattern}, 1), '') AS h, nullif(regexp_extract(text, {pattern}, 2), '') AS m, nullif(regexp_extract(text, {pattern}, 3), '') AS s FROM t), q AS (SELECT i, text, CASE WHEN h IS NOT NULL OR m IS NOT NULL OR s IS NOT NULL THEN CAST(coalesce(CAST(h AS BIGINT), 0) * 3600000 + coalesce(CAST(m AS BIGINT), 0) * 60000 + floor(coalesce(CAST(s AS DOUBLE), 0) * 1000 + 0.5) AS BIGINT) END AS ms FROM p) SELECT i, text, ms, CASE WHEN ms >= 60000 THEN printf('%dm:%.1fs', CAST(floor(ms / 60000.0) AS INT), ms / 1000.0 - floor(ms / 60000.0) * 60.0) ELSE printf('%.3fs', ms / 1000.0) END AS elapsed FROM q",
        "seq_render": f"WITH {fx.SEQ_SQL}, l AS (SELECT user_id, list(CAST(o AS VARCHAR) ORDER BY t) AS o FROM seq GROUP BY user_id) SELECT user_id, CASE WHEN len(o) > 40 THEN array_to_string(o[1:10], ', ') || ', ..., ' || array_to_string(o[-10:], ', ') ELSE array_to_string(o, ', ') END AS text FROM l",
    }
    return sql
