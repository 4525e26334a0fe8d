"""SQL that works out features of the embeddings raster independently, for DuckDB.

Kernels and transform matrices are written out as values; borders, neighbourhoods, sums and statistics are SQL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from prismloom.functions.filters import filter_bank
from prismloom.functions.wavelets import transform_matrix
from prismloom.operators.moment import geometric_kernels, legendre_kernels, zernike_kernels
from prismloom.operators.texture import EPS, GaborExtractor
from prismloom.sources.cube import BANDS, WIDTH

#: Bands of the false-colour image: those nearest to 650, 550 and 450 nm.
RGB = (26, 16, 5)

PIXELS = f"""px AS (SELECT CAST(vec_id // {WIDTH} AS INTEGER) AS row, CAST(vec_id % {WIDTH} AS INTEGER) AS col,
  list_transform(embedding, lambda x: CAST(0.5 AS FLOAT) + CAST(0.5 AS FLOAT) * x) AS s FROM embeddings),
dims AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM px)"""


def cells_of(bands: Sequence[int]) -> str:
    """The values v of chosen bands, c counting them."""
    chosen = ", ".join(f"({i}, {b})" for i, b in enumerate(bands))
    return f"{PIXELS},\nch AS (SELECT * FROM (VALUES {chosen}) t(c, band)),\ncells AS (SELECT row, col, c, CAST(s[band + 1] AS DOUBLE) AS v FROM px, ch)"


CELLS = cells_of(RGB)


def mod(x: str, n: str) -> str:
    return f"((({x}) % ({n})) + ({n})) % ({n})"


def shown(x: str, n: str, rule: str) -> str:
    if rule == "wrap":
        return mod(x, n)
    if rule == "repeat":
        m = mod(x, f"2 * {n}")
        return f"least({m}, 2 * {n} - 1 - ({m}))"
    return f"({n} - 1) - abs(({n} - 1) - ({mod(x, f'2 * ({n} - 1)')}))"


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def band(i: int) -> str:
    return f"CAST(s[{i + 1}] AS DOUBLE)"


def index(value: str) -> str:
    return f"WITH {PIXELS}\nSELECT row, col, {rounded(value)} AS value FROM px"


def stencil(kernels: list[np.ndarray], rule: str, magnitudes: bool = False, bands: Sequence[int] = RGB, differences: bool = False) -> str:
    """Sums of neighbourhoods of the bands (the false-colour image) times kernels, in the order of the list.

    After them come, if asked for, the ``differences`` of each two bands' sums.

    With ``magnitudes`` two kernels at a time are the parts of a complex number.
    """
    rows, k = [], 0
    for stack in kernels:
        half = stack.shape[1] // 2
        for kernel in stack:
            rows += [f"({k}, {r - half}, {c - half}, {float(x)!r}::DOUBLE)" for (r, c), x in np.ndenumerate(kernel) if x]
            k += 1
    each = k // 2 if magnitudes else k
    sums = f"""WITH {cells_of(bands)},
k AS (SELECT * FROM (VALUES {", ".join(rows)}) t(k, dr, dc, x)),
d AS (SELECT DISTINCT dr, dc FROM k),
near AS (SELECT p.row, p.col, dr, dc, {shown("p.row + dr", "h", rule)} AS r2, {shown("p.col + dc", "w", rule)} AS c2 FROM px p, d, dims),
sums AS (SELECT n.row, n.col, z.c, k.k, sum(k.x * z.v) AS v FROM near n JOIN cells z ON z.row = n.r2 AND z.col = n.c2 JOIN k ON k.dr = n.dr AND k.dc = n.dc GROUP BY ALL)
"""
    if magnitudes:
        return sums + f"SELECT row, col, CAST(c * {each} + k // 2 AS INTEGER) AS k, {rounded('sqrt(sum(v * v))')} AS value FROM sums GROUP BY row, col, c, k // 2"
    plain = f"SELECT row, col, CAST(c * {each} + k AS INTEGER) AS k, {rounded('v')} AS value FROM sums"
    if differences:
        n = len(bands)
        # Pairs of bands in order: those of the first band come first.
        pair = f"a.c * {n} - a.c * (a.c + 1) // 2 + b.c - a.c - 1"
        plain += f" UNION ALL SELECT a.row, a.col, CAST(({n} + {pair}) * {each} + a.k AS INTEGER), {rounded('a.v - b.v')} FROM sums a JOIN sums b ON a.row = b.row AND a.col = b.col AND a.k = b.k AND a.c < b.c"
    return sums + plain


def gabor(bands: Sequence[int] = RGB, opponent: bool = False) -> str:
    return stencil([GaborExtractor.kernel(*f)[None] for f in GaborExtractor().filters()], "repeat", bands=bands, differences=opponent)


def geometric(order: int, sizes: tuple[int, ...]) -> str:
    return stencil([geometric_kernels(w, order, True) for w in sizes], "reflect")


def legendre(order: int, sizes: tuple[int, ...]) -> str:
    return stencil([legendre_kernels(w, order) for w in sizes], "reflect")


def zernike(order: int, sizes: tuple[int, ...]) -> str:
    # Terms of 0 would drop out of the sums of a kernel that is 0 everywhere, such as the imaginary part at q = 0.
    return stencil([np.where(zernike_kernels(w, order) == 0, 1e-300, zernike_kernels(w, order)) for w in sizes], "reflect", magnitudes=True)


def dwt1d(wavelet: str = "db4", mode: str = "symmetric", levels: int = 3) -> str:
    matrix = transform_matrix(BANDS, wavelet, mode, levels)
    rows = ", ".join(f"({k}, {b}, {float(x)!r}::DOUBLE)" for (k, b), x in np.ndenumerate(matrix) if x)
    return f"""WITH {PIXELS}, m AS (SELECT * FROM (VALUES {rows}) t(k, band, x)),
b AS (SELECT row, col, unnest(range(0, {BANDS})) AS band, CAST(unnest(s) AS DOUBLE) AS v FROM px)
SELECT row, col, CAST(k AS INTEGER) AS k, {rounded("sum(x * v)")} AS value FROM b JOIN m USING (band) GROUP BY row, col, k"""


def _beyond(t: str, n: int, mode: str) -> str:
    """What stands at place t of n samples s, by mode."""
    x = lambda at: f"s[CAST({at} AS INTEGER) + 1]"
    if mode == "smooth":
        line = f"WHEN {t} < 0 THEN {x('0')} - {t} * ({x('0')} - {x('1')}) WHEN {t} >= {n} THEN {x(n - 1)} + ({t} - {n - 1}) * ({x(n - 1)} - {x(n - 2)})"
    elif mode == "antireflect":  # as often as it takes
        line = f"WHEN {t} < -{n - 1} THEN 2 * {x('0')} - (2 * {x(n - 1)} - {x(f'{2 * (n - 1)} + {t}')}) WHEN {t} < 0 THEN 2 * {x('0')} - {x(f'-({t})')} WHEN {t} >= {2 * n - 1} THEN 2 * {x(n - 1)} - (2 * {x('0')} - {x(f'{t} - {2 * (n - 1)}')}) WHEN {t} >= {n} THEN 2 * {x(n - 1)} - {x(f'{2 * (n - 1)} - {t}')}"
    elif mode == "periodization":
        line = f"WHEN {t} < 0 OR {t} >= {n} THEN {x(f'least({mod(t, str(n + n % 2))}, {n - 1})')}"
    else:
        raise ValueError(mode)
    return f"CASE {line} ELSE {x(t)} END"


def dwt1d_by_extension(wavelet: str, mode: str, levels: int) -> str:
    """The transform by extending the samples of each level and filtering them."""
    bank, n = filter_bank(wavelet), BANDS
    taps = len(bank)
    listed = lambda f: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in f) + "]"
    steps, parts = "", []
    for level in range(levels):
        size, first = (-(-n // 2), taps // 2) if mode == "periodization" else ((n + taps - 1) // 2, 1)
        low = first - taps + 1
        steps += f""",
e{level} AS (SELECT row, col, list_transform(range({low}, {2 * (size - 1) + first + 1}), lambda t: {_beyond("t", n, mode)}) AS e FROM a{level}),
f{level} AS (SELECT row, col, k, {", ".join(f"list_sum(list_transform(range(0, {taps}), lambda j: {listed(f)}[CAST(j AS INTEGER) + 1] * e[CAST(2 * k + {first} - j - ({low}) AS INTEGER) + 1])) AS {name}" for name, f in (("lo", bank.low), ("hi", bank.high)))} FROM e{level}, (SELECT unnest(range(0, {size})) AS k)),
a{level + 1} AS MATERIALIZED (SELECT row, col, list(lo ORDER BY k) AS s, list(hi ORDER BY k) AS d FROM f{level} GROUP BY row, col)"""
        parts.append(f"(SELECT row, col, {levels - level} AS part, d AS v FROM a{level + 1})")
        n = size
    parts.append(f"(SELECT row, col, 0 AS part, s AS v FROM a{levels})")
    return f"""WITH {PIXELS}, a0 AS MATERIALIZED (SELECT row, col, list_transform(s, lambda x: CAST(x AS DOUBLE)) AS s FROM px){steps},
every AS (SELECT row, col, flatten(list(v ORDER BY part)) AS v FROM ({" UNION ALL ".join(p[1:-1] for p in parts)}) GROUP BY row, col)
SELECT row, col, CAST(unnest(range(0, len(v))) AS INTEGER) AS k, {rounded("unnest(v)")} AS value FROM every"""


def undecimated(wavelet: str, levels: int, three: bool) -> str:
    """The undecimated transform, an axis at a time, of planes or of the whole cube."""
    bank, m = filter_bank(wavelet), 1 << levels
    taps = ", ".join(f"({k}, {j}, {float(x)!r}::DOUBLE)" for k, f in enumerate((bank.low, bank.high)) for j, x in enumerate(f))
    bands = BANDS + (-BANDS % m if three else 0)
    axes = (("r", "hh"), ("c", "ww"), ("b", str(bands)))[: 3 if three else 2]
    steps, sizes = "", "(SELECT h, w, CAST(ceil(h / {m}) * {m} AS INTEGER) AS hh, CAST(ceil(w / {m}) * {m} AS INTEGER) AS ww FROM dims)".format(m=m)
    every, source = [], "g"
    for level in range(levels):
        spacing = 1 << level
        for i, (axis, size) in enumerate(axes):
            # What is filtered sends its value to all places that it counts for.
            to = mod(f"x.{axis} - {len(bank) // 2 * spacing} + t.j * {spacing}", size)
            place = ", ".join(f"{to} AS {a}" if a == axis else f"x.{a}" for a in ("r", "c", "b"))
            keys = ", ".join(["x.key * 2 + t.k AS key"])
            steps += f",\nl{level}_{i} AS MATERIALIZED (SELECT {place}, {keys}, sum(t.f * x.v) AS v FROM {source} x, t, {sizes} GROUP BY ALL)"
            source = f"l{level}_{i}"
        every.append(f"SELECT r, c, b, key, {level} AS level, v FROM {source}")
        steps += f",\ng{level} AS (SELECT r, c, b, key, v FROM {source} WHERE key = 0)"
        source = f"g{level}"
    order = f"(level * 8 + key) * {BANDS} + b" if three else f"b * {4 * levels} + level * 4 + CASE key WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE key END"
    return f"""WITH {PIXELS}, t AS (SELECT * FROM (VALUES {taps}) t(k, j, f)),
places AS (SELECT r, c, h, w FROM {sizes}, (SELECT unnest(range(0, hh)) AS r FROM {sizes}), (SELECT unnest(range(0, ww)) AS c FROM {sizes})),
g AS MATERIALIZED (SELECT r, c, b, 0 AS key, CAST(s[{shown("b", str(BANDS), "reflect")} + 1] AS DOUBLE) AS v FROM (SELECT p.r, p.c, s, unnest(range(0, {bands})) AS b FROM places p JOIN px ON px.row = {shown("p.r", "p.h", "reflect")} AND px.col = {shown("p.c", "p.w", "reflect")})){steps}
SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST({order} AS INTEGER) AS k, {rounded("v")} AS value
FROM ({" UNION ALL ".join(every)}), dims WHERE r < h AND c < w AND b < {BANDS}"""


def _inside(shape: str) -> str:
    """Whether place b lies in a structuring element of a's radius about a."""
    return {"square": "true", "disk": "(a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= a.radius * a.radius", "diamond": "abs(a.row - b.row) + abs(a.col - b.col) <= a.radius", "line": "a.row = b.row"}[shape]


def morphology(radii: tuple[int, ...], shapes: tuple[str, ...] = ("square",), reconstruct: bool = False) -> str:
    """Openings and closings; pixels beyond the image don't count. By reconstruction, single steps of 3 x 3 go on until none changes."""
    n, each = len(radii), 2 * len(radii) + 1
    names = list(enumerate(shapes))

    def around(name: str, source: str, pick: str) -> str:
        of = " OR ".join(f"a.shape = {i} AND {_inside(shape)}" for i, shape in names)
        return f"{name} AS MATERIALIZED (SELECT a.row, a.col, a.c, a.shape, a.radius, {pick}(b.v) AS v FROM {source} a JOIN {source} b ON a.c = b.c AND a.shape = b.shape AND a.radius = b.radius AND abs(a.row - b.row) <= a.radius AND abs(a.col - b.col) <= a.radius AND ({of}) GROUP BY ALL)"

    if reconstruct:
        near = lambda v: f"max({v}) OVER (PARTITION BY c, shape, radius, side, {{}} ORDER BY {{}} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
        steps = ", ".join([around("er", "f", "min"), around("di", "f", "max")]) + f""",
grow(row, col, c, shape, radius, side, v, most, step, going) AS (
  SELECT er.row, er.col, er.c, shape, radius, 0, er.v, z.v, 0, true FROM er JOIN cells z ON z.row = er.row AND z.col = er.col AND z.c = er.c
  UNION ALL SELECT di.row, di.col, di.c, shape, radius, 1, -di.v, -z.v, 0, true FROM di JOIN cells z ON z.row = di.row AND z.col = di.col AND z.c = di.c
  UNION ALL SELECT row, col, c, shape, radius, side, new, most, step + 1, bool_or(new <> v) OVER () FROM (
    SELECT *, least(most, {near("wide").format("col", "row")}) AS new FROM (SELECT *, {near("v").format("row", "col")} AS wide FROM grow WHERE going))),
done AS (SELECT * FROM grow WHERE step = (SELECT max(step) FROM grow)),
op AS (SELECT row, col, c, shape, radius, v FROM done WHERE side = 0), cl AS (SELECT row, col, c, shape, radius, -v AS v FROM done WHERE side = 1)"""
    else:
        steps = ", ".join([around("er", "f", "min"), around("op", "er", "max"), around("di", "f", "max"), around("cl", "di", "min")])
    rank = "CASE radius " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(sorted(radii))) + " END"
    return f"""WITH RECURSIVE {CELLS}, f AS (SELECT row, col, c, shape, radius, v FROM cells, (SELECT unnest({list(radii)}) AS radius), (SELECT unnest({[i for i, _ in names]}) AS shape)), {steps},
every AS (SELECT row, col, c, shape, {n - 1} - {rank} AS i, v FROM op UNION ALL SELECT row, col, c, shape, {n}, v FROM cells, (SELECT unnest({[i for i, _ in names]}) AS shape) UNION ALL SELECT row, col, c, shape, {n + 1} + {rank}, v FROM cl)
SELECT row, col, CAST((c * {len(shapes)} + shape) * {each} + i AS INTEGER) AS k, {rounded("v")} AS value FROM every"""


def lbp() -> str:
    """Radius 1, four points, method default, beyond the image 0."""
    points = [(0, 1), (-1, 0), (0, -1), (1, 0)]
    bits = " + ".join(f"CASE WHEN coalesce((SELECT q.v FROM g q WHERE q.c = p.c AND q.row = p.row + ({r}) AND q.col = p.col + ({c})), 0) >= p.v THEN {1 << i} ELSE 0 END" for i, (r, c) in enumerate(points))
    return f"""WITH {CELLS}, g AS (SELECT row, col, c, floor(255 * (v - min(v) OVER (PARTITION BY c)) / (max(v) OVER (PARTITION BY c) - min(v) OVER (PARTITION BY c) + 1e-8)) AS v FROM cells)
SELECT row, col, CAST(c AS INTEGER) AS k, CAST({bits} AS DOUBLE) AS value FROM g p"""


def lbp_turned(radius: int = 3, points: int = 24) -> str:
    """Method ror: points on the circle between four pixels each, the least of all turned codes; beyond the image 0."""
    places = []
    for p in range(points):
        r, q = round(-radius * math.sin(2 * math.pi * p / points), 5), round(radius * math.cos(2 * math.pi * p / points), 5)
        r0, q0 = math.floor(r), math.floor(q)
        places.append(f"({p}, {r0}, {q0}, {', '.join(f'{x!r}::DOUBLE' for x in (1 - r + r0, r - r0, 1 - q + q0, q - q0))})")
    corners = [("a", 0, 0), ("b", 0, 1), ("d", 1, 0), ("e", 1, 1)]
    joins = " ".join(f"LEFT JOIN g {n} ON {n}.c = g.c AND {n}.row = g.row + r0 + {i} AND {n}.col = g.col + q0 + {j}" for n, i, j in corners)
    a, b, d, e = (f"coalesce({n}.v, 0)" for n, _, _ in corners)
    return f"""WITH {CELLS}, g AS (SELECT row, col, c, floor(255 * (v - min(v) OVER (PARTITION BY c)) / (max(v) OVER (PARTITION BY c) - min(v) OVER (PARTITION BY c) + 1e-8)) AS v FROM cells),
t AS (SELECT * FROM (VALUES {", ".join(places)}) t(p, r0, q0, up, down, near, far)),
bits AS (SELECT g.row, g.col, g.c, p, up * (near * {a} + far * {b}) + down * (near * {d} + far * {e}) >= g.v AS bit FROM g CROSS JOIN t {joins}),
codes AS (SELECT row, col, c, CAST(sum(CASE WHEN bit THEN 1::BIGINT << p ELSE 0 END) AS BIGINT) AS code FROM bits GROUP BY row, col, c)
SELECT row, col, CAST(c AS INTEGER) AS k, CAST(list_min(list_transform(range(0, {points}), lambda s: (code >> s) + ((code & ((1::BIGINT << s) - 1)) << ({points} - s)))) AS DOUBLE) AS value FROM codes"""


def _levels(levels: int, equalize: bool) -> str:
    """q: grey levels by each channel's range, or by its cumulated histogram of 256 bins between their centres."""
    ends = "ends AS (SELECT c, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 256 AS width, count(*) AS n FROM cells GROUP BY c)"
    if not equalize:
        return f"{ends}, q AS (SELECT row, col, c, floor((v - lo) / (hi - lo) * {levels - 1}) AS v FROM cells JOIN ends USING (c))"
    return f"""{ends}, bins AS (SELECT c, least(floor((v - lo) / width), 255) AS bin, count(*) AS k FROM cells JOIN ends USING (c) GROUP BY ALL),
every AS (SELECT c, bin, coalesce(k, 0) AS k FROM ends CROSS JOIN (SELECT unnest(range(0, 256)) AS bin) LEFT JOIN bins USING (c, bin)),
curve AS (SELECT c, bin, sum(k) OVER (PARTITION BY c ORDER BY bin) / n AS share FROM every JOIN ends USING (c)),
place AS (SELECT row, col, c, (v - lo) / width - 0.5 AS pos, least(greatest(floor((v - lo) / width - 0.5), 0), 255) AS low FROM cells JOIN ends USING (c)),
q AS (SELECT row, col, p.c, floor((a.share + least(greatest(pos - low, 0), 1) * (b.share - a.share)) * {levels - 1}) AS v
      FROM place p JOIN curve a ON a.c = p.c AND a.bin = low JOIN curve b ON b.c = p.c AND b.bin = least(low + 1, 255))"""


def glcm(levels: int = 16, size: int = 7, equalize: bool = False) -> str:
    """All statistics at distance 1, the mean of four angles."""
    half, e = size // 2, repr(EPS)
    return f"""WITH {CELLS},
{_levels(levels, equalize)},
o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) t(o, dr, dc)),
pair AS (SELECT a.row, a.col, a.c, o.o, CAST(a.v AS INTEGER) AS i, CAST(b.v AS INTEGER) AS j FROM q a CROSS JOIN o CROSS JOIN dims JOIN q b ON a.c = b.c AND b.row = {mod("a.row + o.dr", "h")} AND b.col = {mod("a.col + o.dc", "w")}),
win AS (SELECT p.row, p.col, {shown("p.row + dr", "h", "repeat")} AS r2, {shown("p.col + dc", "w", "repeat")} AS c2
        FROM px p, dims, (SELECT unnest(range(-{half}, {half + 1})) AS dr), (SELECT unnest(range(-{half}, {half + 1})) AS dc)),
p AS (SELECT w.row, w.col, c, o, i, j, count(*) / {size * size}.0::DOUBLE / (1 + {e}) AS p FROM win w JOIN pair ON pair.row = w.r2 AND pair.col = w.c2 GROUP BY ALL),
mi AS (SELECT row, col, c, o, sum(x * s) AS ux, -sum(s * ln(s + {e})) AS hx, sum(x * x * s) AS xx FROM (SELECT row, col, c, o, i AS x, sum(p) AS s FROM p GROUP BY ALL) GROUP BY ALL),
mj AS (SELECT row, col, c, o, sum(x * s) AS uy, -sum(s * ln(s + {e})) AS hy FROM (SELECT row, col, c, o, j AS x, sum(p) AS s FROM p GROUP BY ALL) GROUP BY ALL),
spread AS (SELECT p.row, p.col, p.c, p.o, sqrt(sum((i - ux) * (i - ux) * p)) + {e} AS sx, sqrt(sum((j - uy) * (j - uy) * p)) + {e} AS sy FROM p JOIN mi USING (row, col, c, o) JOIN mj USING (row, col, c, o) GROUP BY ALL),
ps AS (SELECT row, col, c, o, i + j AS k, sum(p) AS s FROM p GROUP BY ALL),
se AS (SELECT row, col, c, o, -sum(s * ln(s + {e})) AS sent, sum(k * s) AS savg FROM ps GROUP BY ALL),
sv AS (SELECT ps.row, ps.col, ps.c, ps.o, sum((k - sent) * (k - sent) * s) AS svar FROM ps JOIN se USING (row, col, c, o) GROUP BY ALL),
pd AS (SELECT row, col, c, o, -sum(s * ln(s + {e})) AS dent, sum(s * s) / {levels} - (sum(s) / {levels}) * (sum(s) / {levels}) AS dvar FROM (SELECT row, col, c, o, abs(i - j) AS k, sum(p) AS s FROM p GROUP BY ALL) GROUP BY ALL),
base AS (SELECT row, col, c, o, sum(p * p) AS asm, sum((i - j) * (i - j) * p) AS con, sum(i * j * p) AS ij, sum(p / (1 + (i - j) * (i - j))) AS idm, -sum(p * ln(p + {e})) AS hxy FROM p GROUP BY ALL),
f AS (SELECT row, col, c, o, [asm, con, (ij - ux * uy) / (sx * sy + {e}), (sx - {e}) * (sx - {e}), idm, savg, svar, sent, hxy, dvar, dent,
        (hxy - (hx + hy)) / (greatest(hx, hy) + {e}), sqrt(greatest(0, 1 - exp(-2 * (hx + hy - hxy))))] AS f
      FROM base JOIN mi USING (row, col, c, o) JOIN mj USING (row, col, c, o) JOIN spread USING (row, col, c, o) JOIN se USING (row, col, c, o) JOIN sv USING (row, col, c, o) JOIN pd USING (row, col, c, o)),
long AS (SELECT row, col, c, o, unnest(range(0, 13)) AS k, unnest(f) AS v FROM f)
SELECT row, col, CAST(c * 13 + k AS INTEGER) AS k, {rounded("avg(v)", 5)} AS value FROM long GROUP BY row, col, c, k"""


def noise_covariance() -> str:
    """Covariance of the differences of neighbours, halved."""
    return f"""WITH {PIXELS}, b AS (SELECT row, col, unnest(range(0, {BANDS})) AS band, CAST(unnest(s) AS DOUBLE) AS v FROM px),
d AS (SELECT 0 AS way, row, col, band, v - lag(v) OVER (PARTITION BY col, band ORDER BY row) AS v FROM b
      UNION ALL SELECT 1, row, col, band, v - lag(v) OVER (PARTITION BY row, band ORDER BY col) FROM b)
SELECT CAST(x.band AS INTEGER) AS i, CAST(y.band AS INTEGER) AS j, {rounded("covar_samp(x.v, y.v) / 2", 8)} AS value
FROM d x JOIN d y ON x.way = y.way AND x.row = y.row AND x.col = y.col WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY x.band, y.band"""


def covariance() -> str:
    return f"""WITH {PIXELS}, b AS (SELECT row, col, unnest(range(0, {BANDS})) AS band, CAST(unnest(s) AS DOUBLE) AS v FROM px)
SELECT CAST(x.band AS INTEGER) AS i, CAST(y.band AS INTEGER) AS j, {rounded("covar_samp(x.v, y.v)", 8)} AS value
FROM b x JOIN b y ON x.row = y.row AND x.col = y.col GROUP BY x.band, y.band"""


def identity(n: int) -> str:
    """(i, j, value) of what covariances of whitened features are."""
    return f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM (SELECT unnest(range(0, {n})) AS i), (SELECT unnest(range(0, {n})) AS j)"


def spectrum() -> str:
    """Traces of the first three powers of the covariance, which are the sums of powers of its eigenvalues."""
    return f"""WITH {PIXELS}, b AS (SELECT row, col, unnest(range(0, {BANDS})) AS band, CAST(unnest(s) AS DOUBLE) AS v FROM px),
c AS MATERIALIZED (SELECT x.band AS i, y.band AS j, covar_samp(x.v, y.v) AS v FROM b x JOIN b y ON x.row = y.row AND x.col = y.col GROUP BY x.band, y.band)
SELECT 1 AS power, {rounded("sum(v)")} AS value FROM c WHERE i = j
UNION ALL SELECT 2, {rounded("sum(v * v)", 8)} FROM c
UNION ALL SELECT 3, {rounded("sum(x.v * y.v * z.v)", 9)} FROM c x JOIN c y ON x.j = y.i JOIN c z ON y.j = z.i AND z.j = x.i"""
