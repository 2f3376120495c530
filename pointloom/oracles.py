"""DuckDB SQL of the registered queries, written from their definitions."""

from __future__ import annotations

from pointloom.operators.metrics import bootstrap_draws

DEPTH = 14

VEC = """
vp AS (SELECT CAST(vec_id % 4 AS BIGINT) AS scene, vec_id AS pid, vec_id % 50 AS seg, label AS gt, vec_id % 20 <> 7 AS valid,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  embedding[4]::DOUBLE / nl AS nx, embedding[5]::DOUBLE / nl AS ny, embedding[6]::DOUBLE / nl AS nz,
  (embedding[7]::DOUBLE + 1) / 2 AS r, (embedding[8]::DOUBLE + 1) / 2 AS g, (embedding[9]::DOUBLE + 1) / 2 AS b
  FROM (SELECT *, greatest(sqrt(embedding[4]::DOUBLE * embedding[4] + embedding[5]::DOUBLE * embedding[5] + embedding[6]::DOUBLE * embedding[6]), 1e-12) AS nl FROM embeddings)),
vl AS (SELECT vec_id AS pid, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
vu AS (SELECT pid, label, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY pid)), 1e-12) AS v FROM vl)"""
CLS = """
cs AS (SELECT label AS cls, d, sum(v) AS v FROM vl GROUP BY 1, 2),
cls AS (SELECT cls, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY cls)), 1e-12) AS v FROM cs)"""
BIG = """
bp AS (SELECT l_linenumber AS scene, ((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 4096 + l_suppkey AS pid, l_suppkey AS seg,
  CAST(CASE WHEN l_linestatus = 'F' THEN 255 ELSE l_partkey % 10 END AS INTEGER) AS gt, l_quantity / 50 AS x, l_extendedprice / 105000 AS y,
  l_discount * 10 AS z, l_returnflag <> 'N' AS valid, l_partkey AS partkey FROM lineitem)"""


def argmax(rows: str, classes: str, key: str, cls: str = "cls") -> str:
    """sim/best CTEs of long vectors `rows` (key, d, v) against `classes`."""
    keys = ", ".join(f"r.{k}" for k in key.split(", "))
    return f"""
sim AS (SELECT {keys}, c.{cls} AS cls, sum(r.v * c.v) AS sim FROM {rows} r JOIN {classes} c USING (d) GROUP BY ALL),
best AS (SELECT {key}, cls AS pred, sim FROM sim QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY sim DESC, cls) = 1)"""


POOL_BIG = f"""{VEC}, {CLS}, {BIG},
nv AS (SELECT count(*) AS n FROM embeddings),
reg AS (SELECT scene, seg, partkey % n AS fid, count(*) FILTER (WHERE valid) AS w FROM bp, nv GROUP BY ALL),
zs AS (SELECT scene, seg, d, sum(w * v) AS v FROM reg JOIN vu ON vu.pid = reg.fid GROUP BY ALL),
zu AS (SELECT scene, seg, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY scene, seg)), 1e-12) AS v FROM zs), {argmax("zu", "cls", "scene, seg")},
conf AS (SELECT scene, gt, CAST(pred AS INTEGER) AS pred, count(*) AS n FROM bp JOIN best USING (scene, seg) WHERE gt BETWEEN 0 AND 9 GROUP BY ALL)"""


def metrics(conf: str, keys: str = "") -> str:
    k, using = (f"{keys}, ", f"USING ({keys}, cls)") if keys else ("", "USING (cls)")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
gtn AS (SELECT {k}gt AS cls, sum(n) AS g, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM {conf} GROUP BY ALL),
prn AS (SELECT {k}pred AS cls, sum(n) AS p FROM {conf} GROUP BY ALL),
per AS (SELECT {k}cls, tp, g, tp / greatest(g + coalesce(p, 0) - tp, 1) AS iou, tp / greatest(g, 1) AS acc FROM gtn LEFT JOIN prn {using}),
res AS (SELECT {k}avg(iou) AS miou, avg(acc) AS macc, sum(tp) / sum(g) AS oa, count(*) AS present FROM per {group})"""


def interleave(x: str, y: str, z: str, depth: int = DEPTH, first_high: bool = True) -> str:
    high, low = (x, z) if first_high else (z, x)
    return " | ".join(f"((({v} >> {i}) & 1) << {3 * i + at})" for i in range(depth) for v, at in ((high, 2), (y, 1), (low, 0)))


def hilbert(source: str, name: str, x: str, y: str, z: str, depth: int = DEPTH) -> str:
    """CTEs that end in `name`: all columns of source and `code`."""
    out, last = [f"{name}_0 AS (SELECT *, {x} AS h0, {y} AS h1, {z} AS h2 FROM {source})"], f"{name}_0"
    n = 0
    for bit in range(depth - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(3):
            n += 1
            t = f"(xor(h0, h{i}) & {p})"
            sets = [f"CASE WHEN h{i} & {q} <> 0 THEN xor(h0, {p}) ELSE xor(h0, {t}) END AS h0"]
            if i:
                sets.append(f"CASE WHEN h{i} & {q} <> 0 THEN h{i} ELSE xor(h{i}, {t}) END AS h{i}")
            out.append(f"{name}_{n} AS (SELECT * REPLACE ({', '.join(sets)}) FROM {last})")
            last = f"{name}_{n}"
    out.append(f"{name}_g1 AS (SELECT * REPLACE (xor(h1, h0) AS h1) FROM {last})")
    out.append(f"{name}_g2 AS (SELECT * REPLACE (xor(h2, h1) AS h2), FROM {name}_g1)")
    t = " # ".join(f"CASE WHEN h2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END" for b in range(1, depth)).split(" # ")
    fold = t[0]
    for one in t[1:]:
        fold = f"xor({fold}, {one})"
    out.append(f"{name}_t AS (SELECT *, {fold} AS t FROM {name}_g2)")
    out.append(f"{name}_u AS (SELECT * REPLACE (xor(h0, t) AS h0, xor(h1, t) AS h1, xor(h2, t) AS h2) FROM {name}_t)")
    out.append(f"{name} AS (SELECT * EXCLUDE (h0, h1, h2, t), CAST({interleave('h0', 'h1', 'h2', depth)} AS BIGINT) AS code FROM {name}_u)")
    return ",\n".join(out)


def cells(source: str, name: str, voxel: float, shift: float = 0.0) -> str:
    top = (1 << DEPTH) - 1
    g = ", ".join(f"CAST(least(greatest(floor(({c} - min({c}) OVER (PARTITION BY scene)) / {voxel} + {shift}), 0), {top}) AS BIGINT) AS g{c}" for c in "xyz")
    return f"{name} AS (SELECT scene, pid, x, y, z, {g} FROM {source})"


def code_query(order: str) -> str:
    x, y = ("gy", "gx") if order.endswith("-trans") else ("gx", "gy")
    if order.startswith("z"):
        return f"WITH {BIG}, {cells('bp', 'gc', 0.02)} SELECT scene, pid, CAST({interleave(x, y, 'gz')} AS BIGINT) AS code FROM gc"
    return f"WITH {BIG}, {cells('bp', 'gc', 0.02)}, {hilbert('gc', 'hc', x, y, 'gz')} SELECT scene, pid, code FROM hc"


def votes_ctes(voxel: float, window: int, min_votes: int, max_dist: float, cloud: str = "vp") -> str:
    out, names = [VEC, BIG], []
    for s, shift in enumerate((0.0, 0.5)):
        out.append(cells(cloud, f"gc{s}", voxel, shift))
        for t, (x, y) in enumerate((("gx", "gy"), ("gy", "gx"))):
            out.append(f"k{s}{t}z AS (SELECT scene, pid, x, y, z, CAST({interleave(x, y, 'gz')} AS BIGINT) AS code FROM gc{s})")
            out.append(hilbert(f"gc{s}", f"k{s}{t}h", x, y, "gz"))
            names += [f"k{s}{t}z", f"k{s}{t}h"]
    for n in names:
        out.append(f"o{n} AS MATERIALIZED (SELECT scene, pid, x, y, z, row_number() OVER (PARTITION BY scene ORDER BY code, pid) AS at FROM {n})")
    pairs = " UNION ALL ".join(f"SELECT a.scene, least(a.pid, b.pid) AS i, greatest(a.pid, b.pid) AS j, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2 FROM o{n} a CROSS JOIN range(1, {window + 1}) t(s) JOIN o{n} b ON a.scene = b.scene AND b.at = a.at + s" for n in names)
    out.append(f"pairs AS ({pairs})")
    out.append(f"votes AS (SELECT scene, i, j, count(*) AS votes, min(d2) AS d2 FROM pairs WHERE d2 <= {max_dist**2!r} GROUP BY ALL HAVING count(*) >= {min_votes})")
    return ",\n".join(out)


KNN = f"""{VEC},
near AS (SELECT a.scene, a.pid AS i, b.pid AS j, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2 FROM vp a JOIN vp b ON a.scene = b.scene AND a.pid <> b.pid),
knn AS (SELECT scene, i, j, d2 FROM near WHERE d2 <= 0.2 * 0.2 QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY d2, j) <= 8)"""
BOUND = f"""{KNN},
bnd AS (SELECT e.scene, p.seg AS m, q.seg AS n, count(*) AS cnt, sum(abs(p.nx*q.nx + p.ny*q.ny + p.nz*q.nz)) AS bsum
  FROM knn e JOIN vp p ON p.scene = e.scene AND p.pid = e.i JOIN vp q ON q.scene = e.scene AND q.pid = e.j WHERE p.seg <> q.seg GROUP BY ALL)"""


def merge_sql(rounds: int, th_f: float) -> str:
    """Rounds with th_n = 0, where normals admit every pair."""
    out = [BOUND, "base AS (SELECT scene, seg, d, sum(CASE WHEN valid THEN v ELSE 0 END) AS v FROM vp JOIN vu USING (pid) GROUP BY ALL)", "par0 AS (SELECT DISTINCT scene, seg, seg AS root FROM vp)"]
    for r in range(rounds):
        p = f"par{r}"
        out.append(f"zr{r} AS (SELECT b.scene, root, d, sum(v) AS v FROM base b JOIN {p} USING (scene, seg) GROUP BY ALL)")
        out.append(f"zn{r} AS (SELECT scene, root, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY scene, root)), 1e-12) AS v FROM zr{r})")
        out.append(f"ed{r} AS (SELECT DISTINCT b.scene, x.root AS rm, y.root AS rn FROM bnd b JOIN {p} x ON x.scene = b.scene AND x.seg = b.m JOIN {p} y ON y.scene = b.scene AND y.seg = b.n WHERE x.root <> y.root)")
        out.append(f"sm{r} AS (SELECT e.scene, rm, rn, sum(a.v * b.v) AS sim FROM ed{r} e JOIN zn{r} a ON a.scene = e.scene AND a.root = rm JOIN zn{r} b ON b.scene = e.scene AND b.root = rn AND b.d = a.d GROUP BY ALL HAVING sum(a.v * b.v) >= {th_f})")
        out.append(f"bt{r} AS (SELECT scene, rm, min(rn) AS rn FROM (SELECT *, max(sim) OVER (PARTITION BY scene, rm) AS top FROM sm{r}) WHERE sim >= top - 1e-6 GROUP BY ALL)")
        out.append(f"mv{r} AS (SELECT a.scene, a.rm AS root, a.rn AS into_ FROM bt{r} a JOIN bt{r} b ON a.scene = b.scene AND a.rn = b.rm AND b.rn = a.rm WHERE a.rn < a.rm)")
        out.append(f"par{r + 1} AS (SELECT p.scene, p.seg, coalesce(into_, p.root) AS root FROM {p} p LEFT JOIN mv{r} m ON m.scene = p.scene AND m.root = p.root)")
    return ",\n".join(out)


def draws_sql(kind: str) -> str:
    mult, half = bootstrap_draws(4, 20, 0, 20)
    rows = ", ".join(f"({b}, {s}, {int(m)})" for b, line in enumerate(mult if kind == "boot" else half) for s, m in enumerate(line) if m)
    return f"draws(b, scene, mult) AS (VALUES {rows})"


METHODS = f"""{VEC}, {CLS}, {argmax("vu", "cls", "pid")},
seg_l AS (SELECT scene, seg, d, sum(CASE WHEN valid THEN v ELSE 0 END) AS v FROM vp JOIN vu USING (pid) GROUP BY ALL),
seg_s AS (SELECT s.scene, s.seg, c.cls, sum(s.v * c.v) AS sim FROM seg_l s JOIN cls c USING (d) GROUP BY ALL),
seg_b AS (SELECT scene, seg, cls AS pred FROM seg_s QUALIFY row_number() OVER (PARTITION BY scene, seg ORDER BY sim DESC, cls) = 1),
tabs AS (SELECT scene, 'point' AS method, gt, pred, count(*) AS n FROM vp JOIN best USING (pid) GROUP BY ALL
  UNION ALL SELECT scene, 'pool', gt, pred, count(*) FROM vp JOIN seg_b USING (scene, seg) GROUP BY ALL)"""


def resample_sql(kind: str) -> str:
    return f"""WITH {METHODS}, {draws_sql(kind)},
drawn AS (SELECT b, method, gt, pred, sum(n * mult) AS n FROM tabs JOIN draws USING (scene) GROUP BY ALL), {metrics("drawn", "b, method")}
SELECT b, round(max(miou) FILTER (WHERE method = 'pool') - max(miou) FILTER (WHERE method = 'point'), 6) AS delta FROM res GROUP BY b"""


def lab() -> str:
    lin = lambda c: f"CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END"
    f = lambda t: f"CASE WHEN {t} > 216.0 / 24389 THEN cbrt({t}) ELSE {t} * (841.0 / 108) + 4.0 / 29 END"
    return f"""WITH {VEC}, l AS (SELECT pid, {lin('r')} AS r, {lin('g')} AS g, {lin('b')} AS b FROM vp),
m AS (SELECT pid, (0.4124564*r + 0.3575761*g + 0.1804375*b) / 0.95047 AS x, 0.2126729*r + 0.7151522*g + 0.0721750*b AS y, (0.0193339*r + 0.1191920*g + 0.9503041*b) / 1.08883 AS z FROM l),
t AS (SELECT pid, {f('x')} AS fx, {f('y')} AS fy, {f('z')} AS fz FROM m)
SELECT pid, round(116 * fy - 16, 6) AS l, round(500 * (fx - fy), 6) AS a, round(200 * (fy - fz), 6) AS b FROM t"""


def eigen(source: str, name: str, keys: str, largest: bool = True, steps: int = 24) -> str:
    """CTEs that end in `name` (keys, ex, ey, ez): the unit eigenvector by repeated squaring, its largest component positive."""
    shift = "" if largest else "(cxx + cyy + czz) - "
    off = "" if largest else "-"
    out = [f"{name}_0 AS (SELECT {keys}, {shift}cxx AS a, {off}cxy AS b, {off}cxz AS c, {shift}cyy AS d, {off}cyz AS e, {shift}czz AS f FROM {source})"]
    for i in range(1, steps + 1):
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT {keys}, (a*a+b*b+c*c)/t AS a, (a*b+b*d+c*e)/t AS b, (a*c+b*e+c*f)/t AS c, (b*b+d*d+e*e)/t AS d, (b*c+d*e+e*f)/t AS e, (c*c+e*e+f*f)/t AS f FROM (SELECT *, greatest(a*a+2*b*b+2*c*c+d*d+2*e*e+f*f, 1e-300) AS t FROM {name}_{i - 1}))")
    out.append(f"{name}_c AS (SELECT {keys}, CASE WHEN a >= d AND a >= f THEN a WHEN d >= f THEN b ELSE c END AS x, CASE WHEN a >= d AND a >= f THEN b WHEN d >= f THEN d ELSE e END AS y, CASE WHEN a >= d AND a >= f THEN c WHEN d >= f THEN e ELSE f END AS z FROM {name}_{steps})")
    out.append(f"{name} AS MATERIALIZED (SELECT {keys}, x / l AS ex, y / l AS ey, z / l AS ez FROM (SELECT *, sqrt(x*x+y*y+z*z) AS l FROM {name}_c))")
    return ",\n".join(out)


PRODUCTS = ", ".join(f"sum(n{a}*n{b}) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


def covariance(source: str) -> str:
    """(scene, pid, cnt, cxx..czz) from rows (scene, pid, x, y, z) of neighbours."""
    return f"SELECT scene, pid, count(*) AS cnt, {', '.join(f'(sum({a}*{b}) - count(*)*avg({a})*avg({b})) / count(*)' + (' + 1e-9' if a == b else '') + f' AS c{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM {source} GROUP BY ALL"


def normals_sql(neighbours: str) -> str:
    return f"""WITH {KNN}, nb AS ({neighbours}), cov AS ({covariance('nb')}), {eigen('cov', 'eg', 'scene, pid', False)}
SELECT p.scene, p.pid, {', '.join(f"round(CASE WHEN c.cnt IS NULL OR c.cnt < 3 THEN {1.0 if a == 'z' else 0.0} ELSE e{a} END, 4) + 0.0 AS n{a}" for a in 'xyz')}
FROM vp p LEFT JOIN cov c USING (scene, pid) LEFT JOIN eg USING (scene, pid)"""


FPFH = f"""fe AS MATERIALIZED (SELECT scene, i, j, d2 FROM near WHERE d2 <= {0.3**2!r} QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY d2, j) <= 30),
f0 AS (SELECT e.scene, e.i, e.j, e.d2, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz, p.nx AS px, p.ny AS py, p.nz AS pz, q.nx AS qx, q.ny AS qy, q.nz AS qz
  FROM fe e JOIN vp p ON p.scene = e.scene AND p.pid = e.i JOIN vp q ON q.scene = e.scene AND q.pid = e.j),
f1 AS (SELECT *, (px*dx + py*dy + pz*dz) / greatest(sqrt(d2), 1e-300) AS ap, (qx*dx + qy*dy + qz*dz) / greatest(sqrt(d2), 1e-300) AS aq FROM f0),
f2 AS (SELECT *, abs(ap) < abs(aq) AS sw FROM f1),
f3 AS (SELECT scene, i, j, d2, {", ".join(f"CASE WHEN sw THEN q{c} ELSE p{c} END AS u{c}, CASE WHEN sw THEN p{c} ELSE q{c} END AS t{c}, CASE WHEN sw THEN -d{c} ELSE d{c} END AS e{c}" for c in "xyz")}, CASE WHEN sw THEN -aq ELSE ap END AS h3 FROM f2),
f4 AS (SELECT *, ey*uz - ez*uy AS vx, ez*ux - ex*uz AS vy, ex*uy - ey*ux AS vz FROM f3),
f5 AS (SELECT * REPLACE (vx / greatest(vl, 1e-300) AS vx, vy / greatest(vl, 1e-300) AS vy, vz / greatest(vl, 1e-300) AS vz) FROM (SELECT *, sqrt(vx*vx + vy*vy + vz*vz) AS vl FROM f4)),
f6 AS (SELECT scene, i, j, d2, vl, atan2((uy*vz - uz*vy)*tx + (uz*vx - ux*vz)*ty + (ux*vy - uy*vx)*tz, ux*tx + uy*ty + uz*tz) AS h1, vx*tx + vy*ty + vz*tz AS h2, h3 FROM f5),
f7 AS MATERIALIZED (SELECT scene, i, j, d2, unnest([{", ".join(f"least(greatest(floor({v} * 11), 0), 10) + {11 * k}" for k, v in enumerate(("((CASE WHEN vl = 0 OR d2 = 0 THEN 0 ELSE h1 END + pi()) / (2 * pi()))", "((CASE WHEN vl = 0 OR d2 = 0 THEN 0 ELSE h2 END + 1) * 0.5)", "((CASE WHEN vl = 0 OR d2 = 0 THEN 0 ELSE h3 END + 1) * 0.5)")))}]) AS b FROM f6),
sp AS MATERIALIZED (SELECT scene, i, b, 100 * count(*) / max(k) AS v FROM f7 JOIN (SELECT scene, i, count(*) AS k FROM fe GROUP BY ALL) USING (scene, i) GROUP BY scene, i, b),
fr AS (SELECT e.scene, e.i, s.b, sum(s.v / e.d2) AS v FROM fe e JOIN sp s ON s.scene = e.scene AND s.i = e.j WHERE e.d2 > 0 GROUP BY ALL),
fs AS (SELECT scene, i, b, v * 100 / sum(v) OVER (PARTITION BY scene, i, floor(b / 11)) AS v FROM fr),
fa AS (SELECT p.scene, p.pid, CAST(t.b AS INTEGER) AS b, coalesce(sp.v, 0) + coalesce(fs.v, 0) AS v FROM vp p CROSS JOIN range(33) t(b) LEFT JOIN sp ON sp.scene = p.scene AND sp.i = p.pid AND sp.b = t.b LEFT JOIN fs ON fs.scene = p.scene AND fs.i = p.pid AND fs.b = t.b),
fp AS MATERIALIZED (SELECT scene, pid, b, v / greatest(sum(abs(v)) OVER (PARTITION BY scene, pid), 1e-6) AS v FROM fa)"""
#: Structural confidence q of every point, over regions `seg`.
CONFIDENCE = f"""cm AS (SELECT scene, seg, {PRODUCTS} FROM vp GROUP BY ALL), {eigen('cm', 'cn', 'scene, seg')},
ca AS (SELECT scene, seg, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, avg(r) AS cr, avg(g) AS cg, avg(b) AS cb FROM vp GROUP BY ALL),
cg0 AS (SELECT p.scene, p.seg, f.b, avg(f.v) AS v FROM fp f JOIN vp p USING (scene, pid) GROUP BY ALL),
cgb AS (SELECT scene, seg, b, v / greatest(sqrt(sum(v*v) OVER (PARTITION BY scene, seg)), 1e-12) AS v FROM cg0),
cfu AS (SELECT scene, pid, b, v / greatest(sqrt(sum(v*v) OVER (PARTITION BY scene, pid)), 1e-12) AS v FROM fp),
cd3 AS (SELECT u.scene, u.pid, greatest(0, 1 - sum(u.v * g.v)) AS d3 FROM cfu u JOIN vp p USING (scene, pid) JOIN cgb g ON g.scene = p.scene AND g.seg = p.seg AND g.b = u.b GROUP BY ALL),
cd AS MATERIALIZED (SELECT p.scene, p.seg, p.pid, abs((x-ax)*ex + (y-ay)*ey + (z-az)*ez) AS d1, greatest(0, 1 - abs(nx*ex + ny*ey + nz*ez)) AS d2, d3, sqrt((r-cr)**2 + (g-cg)**2 + (b-cb)**2) AS d4
  FROM vp p JOIN cn USING (scene, seg) JOIN ca USING (scene, seg) JOIN cd3 ON cd3.scene = p.scene AND cd3.pid = p.pid),
cs_ AS (SELECT r.scene, r.seg, {", ".join(f"greatest(r.d{k}, 0.01 * w.d{k}, 1e-8) AS s{k}" for k in (1, 2, 3, 4))} FROM (SELECT scene, seg, avg(d1) AS d1, avg(d2) AS d2, avg(d3) AS d3, avg(d4) AS d4 FROM cd GROUP BY ALL) r JOIN (SELECT scene, avg(d1) AS d1, avg(d2) AS d2, avg(d3) AS d3, avg(d4) AS d4 FROM cd GROUP BY ALL) w USING (scene)),
conf_q AS MATERIALIZED (SELECT scene, seg, pid, exp(-({" + ".join(f"least(d{k} / s{k}, 10)" for k in (1, 2, 3, 4))}) / 4) AS q FROM cd JOIN cs_ USING (scene, seg))"""


def attention(of: str) -> str:
    """CTEs to `gated` (scene, reg, d, z, z2, gate), over the regions `reg` that table `of` (scene, pid, reg) gives points."""
    return f"""ap_ AS MATERIALIZED (SELECT p.*, o.reg FROM vp p JOIN {of} o USING (scene, pid)),
az0 AS (SELECT scene, reg, d, sum(CASE WHEN valid THEN v ELSE 0 END) AS v FROM ap_ JOIN vu USING (pid) GROUP BY ALL),
azl AS MATERIALIZED (SELECT scene, reg, d, v / greatest(sqrt(sum(v*v) OVER (PARTITION BY scene, reg)), 1e-12) AS v FROM az0),
am AS (SELECT scene, reg, {PRODUCTS} FROM ap_ GROUP BY ALL), {eigen('am', 'an', 'scene, reg')},
ac AS (SELECT scene, reg, avg(r) AS cr, avg(g) AS cg, avg(b) AS cb FROM ap_ GROUP BY ALL),
ag0 AS (SELECT p.scene, p.reg, f.b, avg(f.v) AS v FROM fp f JOIN ap_ p USING (scene, pid) GROUP BY ALL),
agb AS MATERIALIZED (SELECT scene, reg, b, v / greatest(sqrt(sum(v*v) OVER (PARTITION BY scene, reg)), 1e-12) AS v FROM ag0),
ab AS (SELECT e.scene, p.reg AS m, q.reg AS n, count(*) AS cnt, sum(abs(p.nx*q.nx + p.ny*q.ny + p.nz*q.nz)) AS bsum FROM knn e JOIN ap_ p ON p.scene = e.scene AND p.pid = e.i JOIN ap_ q ON q.scene = e.scene AND q.pid = e.j WHERE p.reg <> q.reg GROUP BY ALL),
ae AS MATERIALIZED (SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY scene, m ORDER BY cnt DESC, n) <= 12),
asf AS (SELECT e.scene, m, n, sum(x.v * y.v) AS sf FROM ae e JOIN azl x ON x.scene = e.scene AND x.reg = m JOIN azl y ON y.scene = e.scene AND y.reg = n AND y.d = x.d GROUP BY ALL),
asg AS (SELECT e.scene, m, n, sum(x.v * y.v) AS sg FROM ae e JOIN agb x ON x.scene = e.scene AND x.reg = m JOIN agb y ON y.scene = e.scene AND y.reg = n AND y.b = x.b GROUP BY ALL),
al AS MATERIALIZED (SELECT e.scene, e.m, e.n, sf, sg, abs(x.ex*y.ex + x.ey*y.ey + x.ez*y.ez) AS sn, bsum / greatest(cnt, 1) * exp(-((u.cr-w.cr)**2 + (u.cg-w.cg)**2 + (u.cb-w.cb)**2) / {0.25**2!r}) AS near_
  FROM ae e JOIN asf USING (scene, m, n) JOIN asg USING (scene, m, n) JOIN an x ON x.scene = e.scene AND x.reg = e.m JOIN an y ON y.scene = e.scene AND y.reg = e.n JOIN ac u ON u.scene = e.scene AND u.reg = e.m JOIN ac w ON w.scene = e.scene AND w.reg = e.n),
at_ AS (SELECT scene, greatest(avg(1 - sf), 1e-8) AS tf, greatest(avg(1 - sg), 1e-8) AS tg, greatest(avg(1 - sn), 1e-8) AS tn FROM al GROUP BY ALL),
ax_ AS (SELECT scene, m, n, sf/tf + sg/tg + sn/tn + ln(near_ + 1e-8) AS e FROM al JOIN at_ USING (scene)),
aw AS MATERIALIZED (SELECT scene, m, n, exp(e - mx) / sum(exp(e - mx)) OVER (PARTITION BY scene, m) AS a FROM (SELECT *, max(e) OVER (PARTITION BY scene, m) AS mx FROM ax_)),
agate AS (SELECT scene, m AS reg, 0.5 * least(greatest(1 + sum(a * ln(a + 1e-8)) / ln(greatest(count(*), 2)), 0), 1) AS gate FROM aw GROUP BY ALL),
ad AS (SELECT w.scene, w.m AS reg, x.d, sum(a * (y.v - x.v)) AS v FROM aw w JOIN azl x ON x.scene = w.scene AND x.reg = w.m JOIN azl y ON y.scene = w.scene AND y.reg = w.n AND y.d = x.d GROUP BY ALL),
amv AS (SELECT z.scene, z.reg, z.d, z.v AS z, z.v + coalesce(gate, 0) * coalesce(ad.v, 0) AS y, coalesce(gate, 0) AS gate FROM azl z LEFT JOIN agate USING (scene, reg) LEFT JOIN ad ON ad.scene = z.scene AND ad.reg = z.reg AND ad.d = z.d),
gated AS MATERIALIZED (SELECT scene, reg, d, z, y / greatest(sqrt(sum(y*y) OVER (PARTITION BY scene, reg)), 1e-12) AS z2, gate FROM amv)"""


#: Recovered features rl (scene, pid, d, v) from `gated`, `conf_q` and regions `reg` of ap_, with alpha_min 0.5.
RECOVERED = """rm AS (SELECT p.scene, p.reg, avg(q) AS mq FROM ap_ p JOIN conf_q c ON c.scene = p.scene AND c.pid = p.pid GROUP BY ALL),
ra AS (SELECT p.scene, p.pid, p.reg, CASE WHEN valid THEN 0.5 + 0.5 * least(greatest(q / greatest(mq, 1e-8), 0), 1) ELSE 1 END AS a FROM ap_ p JOIN conf_q c ON c.scene = p.scene AND c.pid = p.pid JOIN rm ON rm.scene = p.scene AND rm.reg = p.reg),
rx AS (SELECT ra.scene, ra.pid, u.d, u.v + a * (z - u.v) + CASE WHEN gate > 0 THEN a ELSE 0 END * (z2 - z) AS v FROM ra JOIN vu u USING (pid) JOIN gated g ON g.scene = ra.scene AND g.reg = ra.reg AND g.d = u.d),
rl AS MATERIALIZED (SELECT scene, pid, d, v / greatest(sqrt(sum(v*v) OVER (PARTITION BY scene, pid)), 1e-12) AS v FROM rx)"""


def merged_ctes(rounds: int, th_f: float, th_n: float) -> str:
    """par{rounds}: roots after rounds with normals in play."""
    out = ["base AS MATERIALIZED (SELECT scene, seg, d, sum(CASE WHEN valid THEN v ELSE 0 END) AS v FROM vp JOIN vu USING (pid) GROUP BY ALL)", f"basem AS MATERIALIZED (SELECT scene, seg, {PRODUCTS} FROM vp GROUP BY ALL)", "mbnd AS MATERIALIZED (SELECT * FROM bnd)", "par0 AS MATERIALIZED (SELECT DISTINCT scene, seg, seg AS root FROM vp)"]
    c = ", ".join(f"sum(c{a}) AS c{a}" for a in ("xx", "xy", "xz", "yy", "yz", "zz"))
    for r in range(rounds):
        p = f"par{r}"
        out += [
            f"zr{r} AS (SELECT b.scene, root, d, sum(v) AS v FROM base b JOIN {p} USING (scene, seg) GROUP BY ALL)",
            f"zn{r} AS MATERIALIZED (SELECT scene, root, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY scene, root)), 1e-12) AS v FROM zr{r})",
            f"mo{r} AS (SELECT scene, root, {c} FROM basem JOIN {p} USING (scene, seg) GROUP BY ALL)",
            eigen(f"mo{r}", f"mv{r}e", "scene, root"),
            f"ed{r} AS MATERIALIZED (SELECT b.scene, x.root AS rm, y.root AS rn FROM mbnd b JOIN {p} x ON x.scene = b.scene AND x.seg = b.m JOIN {p} y ON y.scene = b.scene AND y.seg = b.n WHERE x.root <> y.root GROUP BY ALL HAVING sum(bsum) / sum(cnt) >= {th_n})",
            f"sm{r} AS MATERIALIZED (SELECT e.scene, rm, rn, sum(a.v * b.v) AS sim FROM ed{r} e JOIN zn{r} a ON a.scene = e.scene AND a.root = rm JOIN zn{r} b ON b.scene = e.scene AND b.root = rn AND b.d = a.d GROUP BY ALL HAVING sum(a.v * b.v) >= {th_f})",
            f"so{r} AS MATERIALIZED (SELECT s.* FROM sm{r} s JOIN mv{r}e a ON a.scene = s.scene AND a.root = rm JOIN mv{r}e b ON b.scene = s.scene AND b.root = rn WHERE abs(a.ex*b.ex + a.ey*b.ey + a.ez*b.ez) >= {th_n})",
            f"bt{r} AS MATERIALIZED (SELECT scene, rm, min(rn) AS rn FROM (SELECT *, max(sim) OVER (PARTITION BY scene, rm) AS top FROM so{r}) WHERE sim >= top - 1e-6 GROUP BY ALL)",
            f"mw{r} AS (SELECT a.scene, a.rm AS root, a.rn AS into_ FROM bt{r} a JOIN bt{r} b ON a.scene = b.scene AND a.rn = b.rm AND b.rn = a.rm WHERE a.rn < a.rm)",
            f"par{r + 1} AS MATERIALIZED (SELECT p.scene, p.seg, coalesce(into_, p.root) AS root FROM {p} p LEFT JOIN mw{r} m ON m.scene = p.scene AND m.root = p.root)",
        ]
    return ",\n".join(out)


def pooled_pred(name: str, of: str, classes: str = "cls", cls: str = "cls") -> str:
    """`name` (scene, reg, pred): the class of each region `reg` of table `of` (scene, pid, reg)."""
    return f"""{name}_l AS (SELECT p.scene, o.reg, d, sum(CASE WHEN valid THEN v ELSE 0 END) AS v FROM vp p JOIN {of} o USING (scene, pid) JOIN vu USING (pid) GROUP BY ALL),
{name}_s AS (SELECT s.scene, s.reg, c.{cls} AS cls, sum(s.v * c.v) AS sim FROM {name}_l s JOIN {classes} c USING (d) GROUP BY ALL),
{name} AS (SELECT scene, reg, cls AS pred FROM {name}_s QUALIFY row_number() OVER (PARTITION BY scene, reg ORDER BY sim DESC, cls) = 1)"""


MERGED = f"{BOUND}, {CLS}, {merged_ctes(6, 0.2, 0.3)}, ofm AS MATERIALIZED (SELECT p.scene, p.pid, root AS reg FROM vp p JOIN par6 USING (scene, seg)), ofs AS (SELECT scene, pid, seg AS reg FROM vp)"
ND = "nd AS (SELECT * FROM vp QUALIFY row_number() OVER (PARTITION BY scene, floor(x / 0.25), floor(y / 0.25), floor(z / 0.25) ORDER BY pid) = 1)"
VOXELS = """vm0 AS (SELECT scene, CAST(floor(x / {s}) AS BIGINT) AS cx, CAST(floor(y / {s}) AS BIGINT) AS cy, CAST(floor(z / {s}) AS BIGINT) AS cz, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz FROM vp GROUP BY ALL),
vm AS (SELECT * REPLACE (nx / l AS nx, ny / l AS ny, nz / l AS nz) FROM (SELECT *, greatest(sqrt(nx*nx + ny*ny + nz*nz), 1e-8) AS l FROM vm0))"""


def views_sql() -> str:
    from pointloom.operators.projection import SHIFT, view_matrices

    rows = ", ".join(f"({v}, {', '.join(repr(float(c)) + '::DOUBLE' for c in m.ravel())})" for v, m in enumerate(view_matrices()))
    names = ", ".join(f"m{i}{j}" for i in range(3) for j in range(3))
    turned = ", ".join(f"x*m0{j} + y*m1{j} + z*m2{j} - ({SHIFT[j]}) AS {c}" for j, c in enumerate("xyz"))
    at = {c: f"(({c} - (hi{c} + lo{c}) / 2) / wide * 2)" for c in "xyz"}
    pixel = lambda c: f"CAST(least(greatest(ceil(({at[c]} * 0.7::DOUBLE + 1) / 2 * 224), 1), 222) AS INTEGER)"
    z = f"((({at['z']} + 1) / 2 + 0.3::DOUBLE) / 1.3::DOUBLE * 110)"
    return f"""WITH {VEC}, m(view, {names}) AS (VALUES {rows}), t AS (SELECT scene AS shape_id, view, pid, {turned} FROM vp CROSS JOIN m),
b AS (SELECT shape_id, view, {', '.join(f'min({c}) AS lo{c}, max({c}) AS hi{c}' for c in 'xyz')} FROM t GROUP BY ALL),
w AS (SELECT *, greatest(hix - lox, hiy - loy, hiz - loz, 1e-12) AS wide FROM b)
SELECT shape_id, CAST(view AS INTEGER) AS view, pid, {pixel('x')} AS xx, {pixel('y')} AS yy, CAST(ceil({z}) AS INTEGER) AS zi, round(least(greatest({z}, 1), 110), 5) + 0.0 AS zz FROM t JOIN w USING (shape_id, view)"""


INTRA = f"""WITH {VEC}, ok AS MATERIALIZED (SELECT * FROM vp WHERE valid),
pf AS (SELECT a.scene, a.seg, a.pid AS a, i.pid AS i, sum(u.v * w.v) AS c FROM ok a JOIN ok i USING (scene, seg) JOIN vu u ON u.pid = a.pid JOIN vu w ON w.pid = i.pid AND w.d = u.d GROUP BY ALL),
pg AS MATERIALIZED (SELECT f.scene, f.seg, f.a, f.i, greatest(1 - c, 0) AS g1, greatest(1 - abs(p.nx*q.nx + p.ny*q.ny + p.nz*q.nz), 0) AS g2, (p.r-q.r)**2 + (p.g-q.g)**2 + (p.b-q.b)**2 AS g3, (p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2 AS g4 FROM pf f JOIN vp p ON p.pid = f.a JOIN vp q ON q.pid = f.i),
pt AS (SELECT scene, seg, {", ".join(f"greatest(avg(g{k}), 1e-8) AS t{k}" for k in (1, 2, 3, 4))} FROM pg GROUP BY ALL),
pe AS (SELECT scene, seg, a, i, -({" + ".join(f"least(g{k} / t{k}, 50)" for k in (1, 2, 3, 4))}) AS e FROM pg JOIN pt USING (scene, seg)),
pr AS (SELECT scene, seg, i, sum(s) / max(n) AS r FROM (SELECT *, exp(e - mx) / sum(exp(e - mx)) OVER (PARTITION BY scene, seg, a) AS s FROM (SELECT *, max(e) OVER (PARTITION BY scene, seg, a) AS mx, count(*) OVER (PARTITION BY scene, seg, a) AS n FROM pe)) GROUP BY scene, seg, i),
pw AS MATERIALIZED (SELECT scene, seg, i, r / greatest(sum(r) OVER (PARTITION BY scene, seg), 1e-8) AS w FROM pr),
ph AS (SELECT scene, seg, least(greatest(1 + sum(w * ln(w + 1e-8)) / ln(greatest(count(*), 2)), 0), 1) AS eta FROM pw GROUP BY ALL),
pz AS (SELECT scene, seg, d, sum(w * v) AS v FROM pw JOIN vu ON vu.pid = pw.i GROUP BY ALL),
pzu AS MATERIALIZED (SELECT scene, seg, d, v / greatest(sqrt(sum(v*v) OVER (PARTITION BY scene, seg)), 1e-12) AS v FROM pz),
pc AS MATERIALIZED (SELECT w.scene, w.seg, w.i, sum(u.v * z.v) AS c FROM pw w JOIN vu u ON u.pid = w.i JOIN pzu z ON z.scene = w.scene AND z.seg = w.seg AND z.d = u.d GROUP BY ALL),
ps AS (SELECT scene, seg, i, c / greatest(avg(1 - c) OVER (PARTITION BY scene, seg), 1e-8) AS s FROM pc),
px AS MATERIALIZED (SELECT scene, seg, i, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY scene, seg) AS s FROM (SELECT *, max(s) OVER (PARTITION BY scene, seg) AS mx FROM ps)),
pa AS (SELECT scene, seg, d, sum(s * v) AS att, sum(v) AS mean FROM px JOIN vu ON vu.pid = px.i GROUP BY ALL),
pu AS (SELECT scene, seg, d, (1 - eta) * mean / greatest(sqrt(sum(mean*mean) OVER w), 1e-12) + eta * att / greatest(sqrt(sum(att*att) OVER w), 1e-12) AS v, eta FROM pa JOIN ph USING (scene, seg) WINDOW w AS (PARTITION BY scene, seg)),
pv AS (SELECT scene, seg, eta, sqrt(sum(v*v)) AS l, sum(v) FILTER (WHERE d = 1) AS v0, sum(v) FILTER (WHERE d = 64) AS v63 FROM pu GROUP BY ALL)
SELECT r.scene, r.seg, round(coalesce(v0 / greatest(l, 1e-12), 0), 5) + 0.0 AS z0, round(coalesce(v63 / greatest(l, 1e-12), 0), 5) + 0.0 AS z63, round(coalesce(eta, 0), 5) + 0.0 AS eta FROM (SELECT DISTINCT scene, seg FROM vp) r LEFT JOIN pv USING (scene, seg)"""


def more() -> dict[str, str]:
    """Queries that chain several operators."""
    score = "round(miou, 6) AS miou, round(macc, 6) AS macc, round(oa, 6) AS oa, present"
    det = "ds AS (SELECT CAST(label * 4 + pid % 4 AS INTEGER) AS idx, d, sum(v) AS v FROM vl GROUP BY ALL), det AS (SELECT idx, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY idx)), 1e-12) AS v FROM ds)"
    best = lambda name, table, cls: f"{name}_s AS (SELECT u.pid, c.{cls} AS cls, sum(u.v * c.v) AS sim FROM vu u JOIN {table} c USING (d) GROUP BY ALL), {name} AS (SELECT pid, cls AS pred FROM {name}_s QUALIFY row_number() OVER (PARTITION BY pid ORDER BY sim DESC, cls) = 1)"
    return {
        "region_normals": f"WITH {VEC}, mo AS (SELECT scene, seg, {PRODUCTS}, count(*) AS n FROM vp GROUP BY ALL), {eigen('mo', 'eg', 'scene, seg')} SELECT scene, seg, {', '.join(f'round(e{c}, 5) + 0.0 AS n{c}' for c in 'xyz')}, n FROM mo JOIN eg USING (scene, seg)",
        "point_normals": normals_sql("SELECT e.scene, e.i AS pid, p.x, p.y, p.z FROM knn e JOIN vp p ON p.scene = e.scene AND p.pid = e.j"),
        "knn_normals": normals_sql("SELECT e.scene, e.i AS pid, p.x, p.y, p.z FROM (SELECT scene, i, j FROM near QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY d2, j) <= 19 UNION ALL SELECT scene, pid, pid FROM vp) e JOIN vp p ON p.scene = e.scene AND p.pid = e.j"),
        "fpfh": f"WITH {KNN}, {FPFH} SELECT scene, pid, b AS bin, round(v, 6) AS v FROM fp",
        "structural_confidence": f"WITH {KNN}, {FPFH}, {CONFIDENCE} SELECT scene, seg, pid, round(q, 5) + 0.0 AS q FROM conf_q",
        "inter_attention": f"WITH {KNN}, {FPFH}, ofs AS (SELECT scene, pid, seg AS reg FROM vp), {attention('ofs')} SELECT scene, reg AS seg, round(max(z2) FILTER (WHERE d = 1), 5) AS z0, round(max(z2) FILTER (WHERE d = 64), 5) AS z63, round(max(gate), 5) AS gate FROM gated GROUP BY ALL",
        "recovered_points": f"WITH {KNN}, {FPFH}, {CONFIDENCE}, ofs AS (SELECT scene, pid, seg AS reg FROM vp), {attention('ofs')}, {RECOVERED} SELECT scene, pid, round(max(v) FILTER (WHERE d = 1), 5) AS o0, round(max(v) FILTER (WHERE d = 64), 5) AS o63 FROM rl GROUP BY ALL",
        "merged_regions": f"WITH {MERGED} SELECT scene, seg, root FROM par6",
        "merged_metrics": f"WITH {MERGED}, {pooled_pred('mp', 'ofm')}, mc AS (SELECT gt, pred, count(*) AS n FROM vp JOIN ofm USING (scene, pid) JOIN mp USING (scene, reg) GROUP BY ALL), {metrics('mc')} SELECT {score} FROM res",
        "scene_run": f"""WITH {MERGED}, {pooled_pred('mp', 'ofm')}, {pooled_pred('sp_', 'ofs')}, {best('bp_', 'cls', 'cls')},
rc AS (SELECT scene, 'refined' AS method, gt, pred, count(*) AS n FROM vp JOIN ofm USING (scene, pid) JOIN mp USING (scene, reg) GROUP BY ALL
  UNION ALL SELECT p.scene, 'pooled', gt, pred, count(*) FROM vp p JOIN ofs USING (scene, pid) JOIN sp_ USING (scene, reg) GROUP BY ALL
  UNION ALL SELECT scene, 'point', gt, pred, count(*) FROM vp JOIN bp_ USING (pid) GROUP BY ALL), {metrics('rc', 'scene, method')},
ct AS (SELECT scene, count(DISTINCT seg) AS regions, count(DISTINCT root) AS merged FROM par6 GROUP BY ALL)
SELECT scene, method, {score}, regions, merged FROM res JOIN ct USING (scene)""",
        "refined_metrics": f"""WITH {MERGED}, {FPFH}, {CONFIDENCE}, {attention('ofm')}, {RECOVERED}, rs AS (SELECT r.scene, r.pid, c.cls, sum(r.v * c.v) AS sim FROM rl r JOIN cls c USING (d) GROUP BY ALL),
rb AS (SELECT scene, pid, cls AS pred FROM rs QUALIFY row_number() OVER (PARTITION BY scene, pid ORDER BY sim DESC, cls) = 1), rc AS (SELECT gt, pred, count(*) AS n FROM vp JOIN rb USING (scene, pid) GROUP BY ALL), {metrics('rc')} SELECT {score} FROM res""",
        "vocabulary_probe": f"""WITH {VEC}, {CLS}, {det}, ofs AS (SELECT scene, pid, seg AS reg FROM vp), {best('b1', 'cls', 'cls')}, {best('b2', 'det', 'idx')}, {pooled_pred('r1', 'ofs')}, {pooled_pred('r2', 'ofs', 'det', 'idx')},
rc AS (SELECT 'plain' AS vocab, 'point' AS pooling, gt, pred, count(*) AS n FROM vp JOIN b1 USING (pid) GROUP BY ALL
  UNION ALL SELECT 'plain', 'region', gt, pred, count(*) FROM vp JOIN ofs USING (scene, pid) JOIN r1 USING (scene, reg) GROUP BY ALL
  UNION ALL SELECT 'detail', 'point', gt, pred // 4, count(*) FROM vp JOIN b2 USING (pid) GROUP BY ALL
  UNION ALL SELECT 'detail', 'region', gt, pred // 4, count(*) FROM vp JOIN ofs USING (scene, pid) JOIN r2 USING (scene, reg) GROUP BY ALL), {metrics('rc', 'vocab, pooling')}
SELECT vocab, pooling, {score} FROM res""",
        "curve_knn_large": f"""WITH {votes_ctes(0.02, 8, 4, 0.3, 'bp')}, both_ AS (SELECT * FROM votes UNION ALL SELECT scene, j, i, votes, d2 FROM votes)
SELECT scene, i, j, votes FROM both_ QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY votes DESC, d2, j) <= 8""",
        "bootstrap_summary": f"WITH dl AS ({resample_sql('boot')}) SELECT round(avg(delta), 5) + 0.0 AS mean, round(stddev_pop(delta), 5) + 0.0 AS sd, round(quantile_cont(delta, 0.025), 5) + 0.0 AS lo, round(quantile_cont(delta, 0.975), 5) + 0.0 AS hi, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END), 5) + 0.0 AS p_above FROM dl",
        "patch_groups": f"""WITH {VEC}, {ND}, d AS (SELECT a.scene AS shape_id, a.pid AS i, b.pid AS j, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.scene, a.pid ORDER BY (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, b.pid) - 1 AS slot FROM nd a JOIN vp b ON a.scene = b.scene)
SELECT shape_id, i, CAST(slot AS INTEGER) AS slot, j, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM d WHERE slot < 12
UNION ALL SELECT n.scene, n.pid, 12, -1, round(c.x, 6) + 0.0, round(c.y, 6) + 0.0, round(c.z, 6) + 0.0 FROM nd n JOIN (SELECT scene, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vp GROUP BY ALL) c ON c.scene = n.scene""",
        "idw_interp": f"""WITH {VEC}, {ND},
d AS (SELECT a.scene AS shape_id, a.pid AS i, b.pid AS j, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2 FROM vp a JOIN nd b ON a.scene = b.scene),
k AS (SELECT *, 1 / (sqrt(d2) + 1e-8) AS w FROM d QUALIFY row_number() OVER (PARTITION BY shape_id, i ORDER BY d2, j) <= 8)
SELECT k.shape_id, k.i AS pid, round(sum(w * v) FILTER (WHERE d = 1) / sum(w) FILTER (WHERE d = 1), 6) AS f0 FROM k JOIN vl ON vl.pid = k.j GROUP BY ALL""",
        "ball_query": f"""WITH {VEC}, d AS (SELECT a.scene AS shape_id, a.pid AS i, b.pid AS j FROM vp a JOIN vp b ON a.scene = b.scene WHERE (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= {0.25**2!r}),
k AS (SELECT *, row_number() OVER (PARTITION BY shape_id, i ORDER BY j) - 1 AS at, min(j) OVER (PARTITION BY shape_id, i) AS j0 FROM d), f AS (SELECT shape_id, i, min(j) AS j0 FROM d GROUP BY ALL)
SELECT f.shape_id, f.i, CAST(slot AS INTEGER) AS slot, coalesce(k.j, f.j0) AS j FROM f CROSS JOIN range(6) t(slot) LEFT JOIN k ON k.shape_id = f.shape_id AND k.i = f.i AND k.at = slot""",
        "hist_distance": f"""WITH {VEC}, h AS (SELECT scene, seg, pid, d, abs(v) AS v FROM vp JOIN vl USING (pid)), m AS (SELECT scene, seg, d, avg(v) AS m FROM h GROUP BY ALL)
SELECT pid, round(1 - sum(least(v, m)) / least(sum(v), sum(m)), 6) AS dist FROM h JOIN m USING (scene, seg, d) GROUP BY pid""",
        "angles": f"WITH {KNN} SELECT e.scene, e.i, e.j, round(acos(least(greatest(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz, -1), 1)), 6) AS angle FROM knn e JOIN vp a ON a.scene = e.scene AND a.pid = e.i JOIN vp b ON b.scene = e.scene AND b.pid = e.j",
        "mixture_moments": f"""WITH {VEC}, g AS (SELECT scene AS shape_id, pid, k, ((pid * (k + 1)) % 13 + 1) / 13.0 AS gamma FROM vp, range(3) t(k)),
n AS (SELECT shape_id, count(DISTINCT pid) AS n FROM g GROUP BY ALL), s AS (SELECT shape_id, k, sum(gamma) AS g FROM g GROUP BY ALL),
m AS (SELECT g.shape_id, g.k, sum(gamma * v) FILTER (WHERE d = 1) / (max(s.g) + 1e-5) AS mu FROM g JOIN vl USING (pid) JOIN s ON s.shape_id = g.shape_id AND s.k = g.k GROUP BY ALL),
q AS (SELECT g.shape_id, g.k, sum(gamma * (v - mu)**2) FILTER (WHERE d = 1) AS q FROM g JOIN vl USING (pid) JOIN m ON m.shape_id = g.shape_id AND m.k = g.k GROUP BY ALL)
SELECT shape_id, CAST(k AS BIGINT) AS k, round(g / n, 6) AS pi, round(mu, 6) AS mu0, round(q / (g + 1e-5), 6) AS sigma0 FROM s JOIN n USING (shape_id) JOIN m USING (shape_id, k) JOIN q USING (shape_id, k)""",
        "intra_consensus": INTRA,
        "normal_variance": f"""WITH {VEC}, {VOXELS.format(s=0.1)}, a AS (SELECT v.scene, v.cx, v.cy, v.cz, avg(o.nx*o.nx) - avg(o.nx)**2 + avg(o.ny*o.ny) - avg(o.ny)**2 + avg(o.nz*o.nz) - avg(o.nz)**2 AS var FROM vm v JOIN vm o ON v.scene = o.scene AND abs(v.cx-o.cx) <= 1 AND abs(v.cy-o.cy) <= 1 AND abs(v.cz-o.cz) <= 1 AND NOT (v.cx = o.cx AND v.cy = o.cy AND v.cz = o.cz) GROUP BY ALL)
SELECT scene, cx, cy, cz, round(var, 6) AS var FROM vm LEFT JOIN a USING (scene, cx, cy, cz)""",
        "stride_seeds": f"""WITH {BIG}, v AS (SELECT scene, CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, CAST(floor(z / 0.1) AS BIGINT) AS cz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM bp GROUP BY ALL),
g AS (SELECT scene, cx, cy, cz, count(*) OVER (PARTITION BY scene) AS m, {', '.join(f'CAST(floor(({c} - min({c}) OVER (PARTITION BY scene)) / greatest(max({c}) OVER (PARTITION BY scene) - min({c}) OVER (PARTITION BY scene), 1e-12) * 1023) AS BIGINT) AS g{c}' for c in 'xyz')} FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {interleave('gx', 'gy', 'gz', 10, False)}, cx, cy, cz) - 1 AS pos FROM g)
SELECT scene, cx, cy, cz, CAST(pos // greatest(m // 8, 1) AS BIGINT) AS rank FROM o WHERE pos % greatest(m // 8, 1) = 0 AND pos // greatest(m // 8, 1) < 8""",
        "scene_list": f"WITH {BIG}, s AS (SELECT scene, row_number() OVER (ORDER BY scene) - 1 AS pos FROM (SELECT DISTINCT scene FROM bp)) SELECT scene FROM s WHERE pos % 2 = 0 AND pos < 6",
        "grid_seeds": f"""WITH {VEC}, {VOXELS.format(s=0.05)}, b AS (SELECT scene, {', '.join(f'min({c}) AS lo{c}, max({c}) AS hi{c}' for c in 'xyz')} FROM vm GROUP BY ALL),
g AS (SELECT b.*, sx, sy, sz FROM b CROSS JOIN range(40) a(sx) CROSS JOIN range(40) c(sy) CROSS JOIN range(40) d(sz) WHERE {' AND '.join(f'lo{c} + s{c} * 0.25 < hi{c} + 0.25' for c in 'xyz')}),
n AS (SELECT g.scene, sx, sy, sz, cx, cy, cz, {' + '.join(f'({c} - lo{c} - s{c} * 0.25)**2' for c in 'xyz')} AS d2 FROM g JOIN vm USING (scene)),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY scene, sx, sy, sz ORDER BY d2, cx, cy, cz) = 1)
SELECT DISTINCT scene, cx, cy, cz FROM f WHERE d2 < {0.125**2!r}""",
        "seed_size": f"WITH {VEC}, {VOXELS.format(s=0.05)} SELECT scene, round(greatest(0.05, cbrt({' * '.join(f'greatest(max({c}) - min({c}), 1e-6)' for c in 'xyz')} / least(count(*), 20))), 6) + 0.0 AS size FROM vm GROUP BY ALL",
        "class_colours": f"WITH {BIG} SELECT DISTINCT gt, CASE WHEN gt BETWEEN 0 AND 7 THEN printf('%02x%02x%02x', 20 * gt, 255 - 20 * gt, 7 * gt) ELSE '3c3c3c' END AS colour FROM bp",
        "rich_scene_pick": f"""WITH {BIG}, g AS (SELECT seg AS scene, avg(x) AS gain, count(DISTINCT gt) FILTER (WHERE gt BETWEEN 0 AND 9) AS c FROM bp GROUP BY ALL),
k AS (SELECT * FROM g WHERE c >= 9 OR (SELECT count(*) FROM g WHERE c >= 9) < 3), r AS (SELECT *, row_number() OVER (ORDER BY gain, scene) - 1 AS pos, count(*) OVER () AS n FROM k)
SELECT scene, CASE WHEN pos = n // 6 THEN 1 WHEN pos = n // 2 THEN 2 ELSE 3 END AS pick FROM r WHERE pos IN (n // 6, n // 2, n - 1 - n // 8)""",
        "image_cells": views_sql(),
    }


def sql() -> dict[str, str]:
    cov = ", ".join(f"round(sum(n{a}*n{b}), 6) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    cell = lambda s: ", ".join(f"CAST(floor({c} / {s}) AS BIGINT) AS c{c}" for c in "xyz")
    shp = f"{BIG}, sp AS (SELECT seg AS shape_id, CAST(seg % 4 AS INTEGER) AS category, pid, x, y, z, CAST(scene % 4 AS INTEGER) AS part, CAST(partkey % 4 AS INTEGER) AS pred FROM bp)"
    return {
        "point_argmax": f"WITH {VEC}, {CLS}, {argmax('vu', 'cls', 'pid')} SELECT pid, pred, round(sim, 6) AS sim FROM best",
        "region_meanpool": f"WITH {POOL_BIG} SELECT gt, pred, CAST(sum(n) AS BIGINT) AS n FROM conf GROUP BY ALL",
        "region_meanpool_metrics": f"WITH {POOL_BIG}, {metrics('conf')} SELECT round(miou, 6) AS miou, round(macc, 6) AS macc, round(oa, 6) AS oa, present FROM res",
        "per_scene_metrics": f"WITH {POOL_BIG}, {metrics('conf', 'scene')} SELECT scene, round(miou, 6) AS miou, round(macc, 6) AS macc, round(oa, 6) AS oa, present FROM res",
        "vocab_remap": f"""WITH {VEC}, ds AS (SELECT CAST(label * 4 + pid % 4 AS INTEGER) AS idx, d, sum(v) AS v FROM vl GROUP BY ALL),
det AS (SELECT idx, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY idx)), 1e-12) AS v FROM ds), {argmax('vu', 'det', 'pid', 'idx')}
SELECT gt, CAST(pred // 4 AS INTEGER) AS pred, count(*) AS n FROM vp JOIN best USING (pid) GROUP BY ALL""",
        "class_scores": f"""WITH {METHODS}, t AS (SELECT gt, pred, sum(n) AS n FROM tabs WHERE method = 'point' GROUP BY ALL), {metrics('t')}
SELECT CAST(cls AS INTEGER) AS cls, CAST(tp AS BIGINT) AS tp, CAST(g AS BIGINT) AS gt_n, round(iou, 6) AS iou, round(acc, 6) AS acc FROM per""",
        "morton_codes": code_query("z"),
        "morton_codes_trans": code_query("z-trans"),
        "hilbert_codes": code_query("hilbert"),
        "hilbert_codes_trans": code_query("hilbert-trans"),
        "morton_decoded": f"WITH {BIG}, {cells('bp', 'gc', 0.02)} SELECT scene, pid, gx, gy, gz FROM gc",
        "hilbert_decoded": f"WITH {BIG}, {cells('bp', 'gc', 0.02)} SELECT scene, pid, gx, gy, gz FROM gc",
        "gray_codes": "SELECT vec_id AS pid, xor(vec_id, vec_id >> 1) AS gray, vec_id AS back FROM embeddings",
        "curve_votes": f"WITH {votes_ctes(0.02, 8, 3, 0.3)} SELECT scene, i, j, votes, round(d2, 6) AS d2 FROM votes",
        "curve_knn": f"""WITH {votes_ctes(0.02, 8, 3, 0.3)}, both_ AS (SELECT * FROM votes UNION ALL SELECT scene, j, i, votes, d2 FROM votes)
SELECT scene, i, j, votes FROM both_ QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY votes DESC, d2, j) <= 4""",
        "grid_knn": f"WITH {KNN} SELECT scene, i, j, round(d2, 6) AS d2 FROM knn",
        "exact_knn": f"WITH {KNN} SELECT scene, i, j, round(d2, 6) AS d2 FROM near QUALIFY row_number() OVER (PARTITION BY scene, i ORDER BY d2, j) <= 8",
        "boundary_stats": f"WITH {BOUND} SELECT scene, m, n, cnt, round(bsum, 6) AS bsum FROM bnd",
        "degree_cap": f"WITH {BOUND} SELECT scene, m, n, cnt FROM bnd QUALIFY row_number() OVER (PARTITION BY scene, m ORDER BY cnt DESC, n) <= 3",
        "merge_round1": f"WITH {merge_sql(1, 0.2)} SELECT scene, seg, root FROM par1",
        "merge_round2": f"WITH {merge_sql(2, 0.2)} SELECT scene, seg, root FROM par2",
        "merge_round3": f"WITH {merge_sql(3, 0.2)} SELECT scene, seg, root FROM par3",
        "segment_softmax": f"WITH {KNN} SELECT scene, i, j, round(exp(-d2) / sum(exp(-d2)) OVER (PARTITION BY scene, i), 6) AS a FROM knn",
        "segment_cov": f"WITH {VEC} SELECT scene, seg, {cov}, count(*) AS n FROM vp GROUP BY ALL",
        "neighbour_cov": f"""WITH {KNN}, t AS (SELECT e.scene, e.i AS pid, p.x, p.y, p.z FROM knn e JOIN vp p ON p.scene = e.scene AND p.pid = e.j)
SELECT scene, pid, count(*) AS cnt, {', '.join(f"round((sum({a}*{b}) - count(*)*avg({a})*avg({b})) / count(*){' + 1e-9' if a == b else ''}, 6) + 0.0 AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM t GROUP BY ALL""",
        "voxel_mean": f"WITH {BIG} SELECT scene, {cell(0.1)}, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM bp GROUP BY scene, 2, 3, 4",
        "voxel_first": f"WITH {BIG} SELECT scene, {cell(0.1)}, min(pid) AS pid, count(*) AS n FROM bp GROUP BY scene, 2, 3, 4",
        "voxel_adjacency26": f"""WITH {BIG}, v AS (SELECT DISTINCT scene, {cell(0.1)} FROM bp)
SELECT a.scene, a.cx, a.cy, a.cz, b.cx AS ox, b.cy AS oy, b.cz AS oz FROM v a JOIN v b ON a.scene = b.scene AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1
WHERE NOT (a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz)""",
        "rgb_to_lab": lab(),
        "bootstrap_delta": resample_sql("boot"),
        "split_half": resample_sql("half"),
        "shape_iou": f"""WITH {shp}, parts AS (SELECT DISTINCT category, part FROM sp), every AS (SELECT DISTINCT shape_id, category FROM sp),
c AS (SELECT e.shape_id, e.category, p.part, count(*) FILTER (WHERE s.part = p.part AND s.pred = p.part) AS tp, count(*) FILTER (WHERE s.part = p.part OR s.pred = p.part) AS u
  FROM every e JOIN parts p USING (category) JOIN sp s ON s.shape_id = e.shape_id GROUP BY ALL)
SELECT shape_id, category, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE tp / u END), 6) AS iou FROM c GROUP BY ALL""",
        "shape_accuracy": f"WITH {shp}, a AS (SELECT shape_id, avg(CASE WHEN part = pred THEN 1.0 ELSE 0 END) AS a FROM sp GROUP BY ALL) SELECT round(100 * avg(a), 6) AS accuracy FROM a",
        "view_mean": f"""WITH {VEC}, {BIG}, nv AS (SELECT count(*) AS n FROM embeddings),
s AS (SELECT seg AS shape_id, scene AS pid, partkey % n AS fid, (scene % 3 + 1) / 4.0 AS w, CASE WHEN valid THEN 1.0 ELSE 0 END AS seen FROM bp, nv),
f AS (SELECT shape_id, s.pid, d, sum(v * w * seen) / 10 AS v FROM s JOIN vl ON vl.pid = s.fid GROUP BY ALL)
SELECT shape_id, CAST(pid AS BIGINT) AS pid, round(sum(v) FILTER (WHERE d = 1), 6) AS f0, round(sum(v) FILTER (WHERE d = 64), 6) AS f63, round(sum(v * v), 6) AS sq FROM f GROUP BY ALL""",
        "topk_prototype": f"""WITH {VEC}, g AS (SELECT scene AS shape_id, pid, seg % 5 AS k, (pid % 17 + 1) / 17.0 AS gamma FROM vp),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY shape_id, k ORDER BY gamma DESC, pid) <= 6),
w AS (SELECT shape_id, k, greatest(sum(gamma), 1e-4) AS w FROM b GROUP BY ALL),
p AS (SELECT b.shape_id, b.k, d, sum(gamma * v) AS v FROM b JOIN vl USING (pid) GROUP BY ALL)
SELECT p.shape_id, CAST(p.k AS BIGINT) AS k, round(sum(v / w) FILTER (WHERE d = 1), 6) AS p0, round(sum(v * v / w / w), 6) AS sq, round(max(w) / max(t), 6) AS mass
FROM p JOIN w USING (shape_id, k) JOIN (SELECT shape_id, sum(w) AS t FROM w GROUP BY ALL) USING (shape_id) GROUP BY ALL""",
        "minmax_quantise": f"""WITH {BIG}, e AS (SELECT scene, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) / 32000 AS s, {', '.join(f'(max({c})+min({c}))/2 AS m{c}' for c in 'xyz')} FROM bp GROUP BY ALL)
SELECT scene, pid, {', '.join(f'CAST(round_even(({c} - m{c}) / s, 0) AS INTEGER) AS q{c}' for c in 'xyz')} FROM bp JOIN e USING (scene)""",
        "region_colour": f"WITH {BIG} SELECT DISTINCT seg, lpad(lower(hex((seg * 2654435761) % 16777216)), 6, '0') AS colour FROM bp",
        "legend_top12": f"WITH {BIG} SELECT gt AS cls, count(*) AS n FROM bp WHERE gt <> 255 GROUP BY ALL ORDER BY n DESC, cls LIMIT 12",
        "per_scene_classes": f"WITH {BIG} SELECT scene, count(DISTINCT gt) AS n_classes, count(*) AS n FROM bp WHERE gt BETWEEN 0 AND 9 GROUP BY ALL",
        "scene_pick": f"""WITH {BIG}, g AS (SELECT seg AS scene, avg(x) AS gain FROM bp GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY gain, scene) - 1 AS pos, count(*) OVER () AS n FROM g)
SELECT scene, CASE WHEN pos = n // 6 THEN 1 WHEN pos = n // 2 THEN 2 ELSE 3 END AS pick FROM r WHERE pos IN (n // 6, n // 2, n - 1 - n // 8)""",
        "robust_scale_mean": f"WITH {BIG} SELECT scene, seg, round(greatest(avg(y), 0.01 * (SELECT avg(y) FROM bp), 1e-8), 6) AS scale FROM bp GROUP BY ALL",
        "robust_scale_median": f"WITH {BIG}, l AS (SELECT scene, seg, list_sort(list(y)) AS a FROM bp GROUP BY ALL) SELECT scene, seg, round(greatest(a[len(a) // 2 + 1], 0.01 * (SELECT avg(y) FROM bp), 1e-8), 6) AS scale FROM l",
        "dense_labels": f"WITH {BIG} SELECT scene, pid, CAST(dense_rank() OVER (PARTITION BY scene ORDER BY seg) - 1 AS INTEGER) AS dense FROM bp",
        "prompt_ensemble": f"""WITH {VEC}, s AS (SELECT label AS cls, d, sum(v) AS v FROM vu GROUP BY ALL) SELECT CAST(cls AS INTEGER) AS cls, round(max(v) FILTER (WHERE d = 1) / sqrt(sum(v * v)), 6) AS e0 FROM s GROUP BY ALL""",
        "clean_text": "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM documents",
    } | more()
