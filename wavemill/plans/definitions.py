"""DuckDB SQL of the engine's building blocks, from their definitions alone: random
streams, filter banks and the scattering cascade. Nothing here is taken from what the
engine computes, so a query that agrees with it has been checked on its own.
"""

from __future__ import annotations

from .registry import X

# SplitMix64 and Philox4x32-10.
T64, T32 = "18446744073709551616::UHUGEINT", "4294967296::UHUGEINT"
GAMMA, MIX_1, MIX_2 = (f"{v}::UHUGEINT" for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
M0, M1, W0, W1 = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85


def splitmix(name: str, seed: int, n: int) -> str:
    """{name}(k, z): the first n outputs."""
    return f"""{name} AS (SELECT k, xor(z, z // 2147483648::UHUGEINT) AS z FROM (
  SELECT k, (xor(z, z // 134217728::UHUGEINT) * {MIX_2}) % {T64} AS z FROM (
    SELECT k, (xor(z, z // 1073741824::UHUGEINT) * {MIX_1}) % {T64} AS z FROM (
      SELECT k, ({seed}::UHUGEINT + (k + 1)::UHUGEINT * {GAMMA}) % {T64} AS z FROM range({n}) r(k)))))"""


def words(name: str, seed: int, stream: int, n: int) -> str:
    """{name}(i, word): the first n words of a stream; {name}64(i, v): pairs of them,
    low word first; {name}u(i, u): these as units."""
    out = [splitmix(f"{name}s", seed, 1), f"{name}0 AS (SELECT b, b::UHUGEINT AS c0, 0::UHUGEINT AS c1, {stream & 0xFFFFFFFF}::UHUGEINT AS c2, {stream >> 32}::UHUGEINT AS c3, z % {T32} AS k0, z // {T32} AS k1 FROM range({-(-n // 4)}) r(b), {name}s)"]
    for r in range(10):
        a, b = (f"(({k} + {r * w}::UHUGEINT) % {T32})" for k, w in (("k0", W0), ("k1", W1)))
        out.append(f"{name}{r + 1} AS (SELECT b, k0, k1, xor(xor(p1 // {T32}, c1), {a}) AS c0, p1 % {T32} AS c1, xor(xor(p0 // {T32}, c3), {b}) AS c2, p0 % {T32} AS c3 FROM (SELECT *, c0 * {M0}::UHUGEINT AS p0, c2 * {M1}::UHUGEINT AS p1 FROM {name}{r}))")
    out.append(f"{name} AS (SELECT CAST(b * 4 + l AS BIGINT) AS i, CAST(CASE l WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS BIGINT) AS word FROM {name}10, range(4) q(l))")
    out.append(f"{name}64 AS (SELECT a.i // 2 AS i, a.word::UHUGEINT + b.word::UHUGEINT * {T32} AS v FROM {name} a JOIN {name} b ON b.i = a.i + 1 WHERE a.i % 2 = 0)")
    out.append(f"{name}u AS (SELECT i, CAST(v // 2048::UHUGEINT AS DOUBLE) * pow(2.0, -53) AS u FROM {name}64)")
    return ", ".join(out)


def normals(name: str, source: str) -> str:
    """{name}(i, z): Box and Muller's cosines of pairs of units."""
    return f"{name} AS (SELECT a.i // 2 AS i, sqrt(-2 * ln(1 - a.u)) * cos(2 * pi() * b.u) AS z FROM {source}u a JOIN {source}u b ON b.i = a.i + 1 WHERE a.i % 2 = 0)"


def directions(name: str, dim: int, count: int) -> str:
    """{name}(k, c, w): random unit vectors."""
    return f"{words(name + 'w', 0, 0x40001, 4 * dim * count)}, {normals(name + 'n', name + 'w')}, {name} AS (SELECT CAST(i // {dim} AS INTEGER) AS k, CAST(i % {dim} AS INTEGER) AS c, z / sqrt(sum(z * z) OVER (PARTITION BY i // {dim})) AS w FROM {name}n WHERE i < {dim * count})"


# -------------------------------------------------------------- scattering, 1-D


def bank_1d(n: int, J: int) -> str:
    """phi(n, h) and psi(f, n, re, im): taps of the bank of quality 1, periodic; par(f,
    xi, sigma, j); hat(f, k, h): the filters themselves (f = -1: phi)."""
    least = f"(0.1 * pow(2.0, -{J}))"
    return f"""s0 AS (SELECT 0.35 * ((1 - 0.5) / (1 + 0.5)) / sqrt(2 * ln(1 / sqrt(0.5))) AS s),
par AS (SELECT f, xi, sigma, CAST(floor(-log2(least(xi + 5 * sigma, 0.5))) AS INTEGER) - 1 AS j FROM (SELECT CAST(i AS INTEGER) AS f, 0.35 / pow(2.0, i) AS xi, s / pow(2.0, i) AS sigma FROM range(12) r(i), s0 WHERE i = 0 OR s / pow(2.0, i - 1) > 2 * {least})),
every AS (SELECT f, xi, sigma FROM par UNION ALL SELECT -1, 0.0, {least}),
period AS (SELECT *, least(ceil(sqrt(-2 * sigma * sigma * ln(1e-7)) + 1), 5) AS p FROM every),
k AS (SELECT CAST(i AS INTEGER) AS k FROM range({n}) r(i)),
gauss AS (SELECT f, k, avg(exp(-pow(1 - p + i + k / {n}.0 - xi, 2) / (2 * sigma * sigma))) AS gx, avg(exp(-pow(1 - p + i + k / {n}.0, 2) / (2 * sigma * sigma))) AS g0 FROM period, k, range(9) r(i) WHERE i <= 2 * p - 2 GROUP BY f, k),
raw AS (SELECT g.f, g.k, CASE WHEN g.f < 0 THEN g.g0 ELSE g.gx - (z.gx / z.g0) * g.g0 END AS m FROM gauss g JOIN gauss z ON z.f = g.f AND z.k = 0),
norm AS (SELECT f, sum(a) AS total FROM (SELECT f, t.k, sqrt(pow(sum(m * cos(2 * pi() * (raw.k * t.k % {n}) / {n})), 2) + pow(sum(m * sin(2 * pi() * (raw.k * t.k % {n}) / {n})), 2)) / {n} AS a FROM raw, k t GROUP BY f, t.k) GROUP BY f),
unit AS (SELECT raw.f, k, m / total AS h FROM raw JOIN norm ON norm.f = raw.f),
hat AS (SELECT f, k, CAST(CAST(CASE WHEN abs(h) < pow(2.0, -40) * max(abs(h)) OVER (PARTITION BY f) THEN 0 ELSE h END AS FLOAT) AS DOUBLE) AS h FROM unit),
tap AS (SELECT f, t.k AS n, sum(h * cos(2 * pi() * (hat.k * t.k % {n}) / {n})) / {n} AS re, sum(h * sin(2 * pi() * (hat.k * t.k % {n}) / {n})) / {n} AS im FROM hat, k t GROUP BY f, t.k),
phi AS (SELECT n, re AS h FROM tap WHERE f < 0), psi AS (SELECT * FROM tap WHERE f >= 0)"""


def scatter_1d(n: int, J: int) -> str:
    """s(vec_id, label, path_id, pos, v): the cascade by circular convolutions; p2
    (f1, f2, path_id): the second-order paths."""
    step = 1 << J
    return f"""WITH {X}, {bank_1d(n, J)},
p2 AS (SELECT a.f AS f1, b.f AS f2, (SELECT count(*) FROM par) + row_number() OVER (ORDER BY a.f, b.f) AS path_id FROM par a JOIN par b ON b.j > a.j),
u1 AS (SELECT vec_id, label, f, (pos + n) % {n} AS pos, sqrt(pow(sum(x * re), 2) + pow(sum(x * im), 2)) AS u FROM x, psi GROUP BY ALL),
u2 AS (SELECT vec_id, label, path_id, (pos + n) % {n} AS pos, sqrt(pow(sum(u * re), 2) + pow(sum(u * im), 2)) AS u FROM u1 JOIN p2 ON f1 = u1.f JOIN psi ON psi.f = f2 GROUP BY ALL),
u AS (SELECT vec_id, label, 0 AS path_id, pos, x AS u FROM x UNION ALL SELECT vec_id, label, f + 1, pos, u FROM u1 UNION ALL SELECT vec_id, label, path_id, pos, u FROM u2),
s AS (SELECT vec_id, label, CAST(path_id AS INTEGER) AS path_id, CAST(((pos + n) % {n}) // {step} AS INTEGER) AS pos, sum(u * h) AS v FROM u, phi WHERE (pos + n) % {n} % {step} = 0 GROUP BY ALL)
"""


# -------------------------------------------------------------- scattering, 2-D


def scatter_2d(side: int, J: int, L: int) -> str:
    """The same for square images (rows first) and oriented filters."""
    area, step = side * side, 1 << J
    out = side // step
    turn = lambda a, b: f"2 * pi() * (({a}.r * {b}.r + {a}.c * {b}.c) % {side}) / {side}"
    move = f"((a.pos // {side} + t.r) % {side}) * {side} + (a.pos + t.c) % {side}"
    return f"""WITH {X}, cell AS (SELECT CAST(i AS INTEGER) AS i, CAST(i // {side} AS INTEGER) AS r, CAST(i % {side} AS INTEGER) AS c FROM range({area}) q(i)),
par AS (SELECT CAST(j * {L} + l AS INTEGER) AS f, CAST(j AS INTEGER) AS j, CAST(l AS INTEGER) AS l, 0.8 * pow(2.0, j) AS sigma, l * pi() / {L} AS theta, 0.75 * pi() / pow(2.0, j) AS xi, 4.0 / {L} AS slant FROM range({J}) a(j), range({L}) b(l)
  UNION ALL SELECT -1, 0, 0, 0.8 * pow(2.0, {J} - 1), 0.0, 0.0, 1.0),
grid AS (SELECT par.*, i, r + {side} * ex AS gx, c + {side} * ey AS gy FROM par, cell, range(-2, 3) a(ex), range(-2, 3) b(ey)),
wave AS (SELECT f, i, exp(-((pow(cos(theta), 2) + slant * slant * pow(sin(theta), 2)) * gx * gx + 2 * cos(theta) * sin(theta) * (1 - slant * slant) * gx * gy + (pow(sin(theta), 2) + slant * slant * pow(cos(theta), 2)) * gy * gy) / (2 * sigma * sigma)) / (2 * pi() * sigma * sigma / slant) AS e, gx * xi * cos(theta) + gy * xi * sin(theta) AS phase FROM grid),
gabor AS (SELECT f, i, sum(e * cos(phase)) AS re, sum(e * sin(phase)) AS im, sum(e) AS env FROM wave GROUP BY f, i),
mean AS (SELECT f, sum(re) / sum(env) AS kr, sum(im) / sum(env) AS ki FROM gabor GROUP BY f),
morlet AS (SELECT g.f, i, CASE WHEN g.f < 0 THEN env ELSE re - kr * env END AS re, CASE WHEN g.f < 0 THEN 0 ELSE im - ki * env END AS im FROM gabor g JOIN mean m ON m.f = g.f),
spectrum AS (SELECT f, w.i, sum(m.re * cos({turn("a", "w")}) + m.im * sin({turn("a", "w")})) AS h FROM morlet m JOIN cell a ON a.i = m.i, cell w GROUP BY f, w.i),
hat AS (SELECT f, i, CAST(CAST(CASE WHEN abs(h) < pow(2.0, -40) * max(abs(h)) OVER (PARTITION BY f) THEN 0 ELSE h END AS FLOAT) AS DOUBLE) AS h FROM spectrum),
tap AS (SELECT f, w.r, w.c, sum(h * cos({turn("a", "w")})) / {area} AS re, sum(h * sin({turn("a", "w")})) / {area} AS im FROM hat JOIN cell a ON a.i = hat.i, cell w GROUP BY f, w.r, w.c),
p2 AS (SELECT a.f AS f1, b.f AS f2, a.j AS j1, b.j AS j2, (b.l - a.l + {L}) % {L} AS d, {J * L} + row_number() OVER (ORDER BY a.f, b.f) AS path_id FROM par a JOIN par b ON b.j > a.j WHERE a.f >= 0 AND b.f >= 0),
u1 AS (SELECT vec_id, label, f, {move} AS pos, sqrt(pow(sum(x * re), 2) + pow(sum(x * im), 2)) AS u FROM x a, tap t WHERE f >= 0 GROUP BY ALL),
u2 AS (SELECT vec_id, label, path_id, {move} AS pos, sqrt(pow(sum(u * re), 2) + pow(sum(u * im), 2)) AS u FROM u1 a JOIN p2 ON f1 = a.f JOIN tap t ON t.f = f2 GROUP BY ALL),
u AS (SELECT vec_id, label, 0 AS path_id, pos, x AS u FROM x UNION ALL SELECT vec_id, label, f + 1, pos, u FROM u1 UNION ALL SELECT vec_id, label, path_id, pos, u FROM u2),
low AS (SELECT vec_id, label, path_id, {move} AS pos, u * re AS v FROM u a, tap t WHERE f = -1 AND (a.pos // {side} + t.r) % {side} % {step} = 0 AND (a.pos + t.c) % {side} % {step} = 0),
s AS (SELECT vec_id, label, CAST(path_id AS INTEGER) AS path_id, CAST((pos // {side} // {step}) * {out} + pos % {side} // {step} AS INTEGER) AS pos, sum(v) AS v FROM low GROUP BY ALL)
"""


def pooled_2d(J: int, L: int) -> str:
    """To follow `scatter_2d`: t(vec_id, label, path_id, pos, v), averaged over the
    first orientation at fixed relative orientation."""
    return f""", home AS (SELECT 0 AS path_id, 0 AS pooled UNION ALL SELECT f + 1, 1 + j FROM par WHERE f >= 0
  UNION ALL SELECT path_id, {J} + dense_rank() OVER (ORDER BY j1, j2, d) FROM p2),
t AS (SELECT vec_id, label, CAST(pooled AS INTEGER) AS path_id, pos, avg(v) AS v FROM s JOIN home ON home.path_id = s.path_id GROUP BY vec_id, label, pooled, pos)
"""
