"""The registered queries as DuckDB SQL on the given tables.

The text is written from the definitions of the queries and shares no code with the operators;
regions are found pixel by pixel and groups by recursive queries.
"""

from __future__ import annotations

# name: (tables it needs, body).  Bodies are joined to one WITH RECURSIVE list.
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: str, body: str, columns: str = "") -> None:
    CTES[name] = (needs.split(), f"{name}{columns} AS ({body.strip()})")


def with_tables(needs: str, final: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for inner in CTES[name][0]:
            add(inner)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    return "WITH RECURSIVE " + ",\n".join(CTES[name][1] for name in order) + "\n" + final.strip()


# --- inputs --------------------------------------------------------------------------------------

cte("base_px", "", """
SELECT vec_id, (i - 1)::INTEGER AS x,
       greatest(0, least(65535, floor((embedding[i]::DOUBLE + 0.6::DOUBLE) * 20000)))::INTEGER AS pix
FROM embeddings, range(1, 65) r(i)""")

cte("px", "base_px", """
SELECT imageid, ((y // 10) * 1000 + x // 10)::INTEGER AS tile, x, y, pix,
       trunc(sqrt(pix))::INTEGER AS var,
       (CASE WHEN pix % 17 <> 0 THEN 1 ELSE 0 END)::INTEGER AS valid,
       (CASE WHEN pix >= 15000 THEN 1 ELSE 0 END)::INTEGER AS sat,
       greatest(0, trunc((pix - 3000) * 65535.0::DOUBLE / 62535))::INTEGER AS v0,
       pix + x AS v1, pix + y AS v2, pix - 30000 AS v3, x - y AS v4, imageid AS v5,
       (pix % 2)::INTEGER AS v6
FROM (SELECT (vec_id // 100)::INTEGER AS imageid, (vec_id % 100)::INTEGER AS y, x, pix FROM base_px)""")

cte("images", "", """
SELECT imageid, imageid * 37 AS xstart, imageid * 23 AS ystart, imageid * 37 + 64 AS xend,
       imageid * 23 + 100 AS yend, imageid AS time, (imageid // 2)::INTEGER AS cycle,
       'bench_' || CASE WHEN imageid < 10000 THEN lpad(imageid::VARCHAR, 4, '0') ELSE imageid::VARCHAR END AS tablename
FROM (SELECT DISTINCT (vec_id // 100)::INTEGER AS imageid FROM embeddings)""")

cte("obs", "", """
SELECT obsid, day AS imageid, day AS time, (day // 5)::INTEGER AS cycle, averageDist, pixelSum,
       x AS centerx, y AS centery, x - h AS boxxstart, y - h AS boxystart, x + h AS boxxend, y + h AS boxyend
FROM (SELECT event_id + 1 AS obsid,
             date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS day,
             (event_id % 1000)::DOUBLE / 100 AS averageDist,
             floor(value * 100)::BIGINT AS pixelSum,
             ((user_id * 7919) % 10000 + 500 + (event_id * 31) % 41 - 20)::INTEGER AS x,
             ((user_id * 104729) % 10000 + 500 + (event_id * 17) % 43 - 21)::INTEGER AS y,
             (event_id % 5 * 40 + 1)::INTEGER AS h
      FROM events)""")

cte("verts", "obs", """
SELECT obsid, 0 AS ord, boxxstart AS x, boxystart AS y FROM obs
UNION ALL SELECT obsid, 1, boxxend, boxystart FROM obs
UNION ALL SELECT obsid, 2, boxxend, boxyend FROM obs
UNION ALL SELECT obsid, 3, boxxstart, boxyend FROM obs""")

cte("narrow_frames", "obs", """
SELECT imageid, xs AS xstart, ys AS ystart, xs + 3000 AS xend, ys + 3000 AS yend, time, cycle
FROM (SELECT DISTINCT time AS imageid, (time * 317) % 7000 + 500 AS xs, (time * 211) % 7000 + 500 AS ys, time, cycle
      FROM obs)""")

# --- pairs and groups of the observations ------------------------------------------------------------


def pair_body(table: str, d2: int, t: int) -> str:
    return f"""
SELECT n.obsid AS new_obsid, e.obsid AS existing_obsid, n.time AS new_time, e.time AS existing_time
FROM (SELECT *, back.b AS b FROM {table}, range(1, {t} + 1) back(b)) n JOIN {table} e
  ON e.time = n.time - n.b
 AND abs(n.centerx - e.centerx) <= {d2} * n.b AND abs(n.centery - e.centery) <= {d2} * n.b
 AND (n.centerx - e.centerx)::BIGINT * (n.centerx - e.centerx)
   + (n.centery - e.centery)::BIGINT * (n.centery - e.centery) <= ({d2} * n.b) * ({d2} * n.b)"""


def group_body(name: str, pairs: str, roots: str = "") -> str:
    roots = roots or f"SELECT existing_obsid FROM {pairs}"
    return f"""
SELECT obsid AS obsgroupid, obsid
FROM (SELECT DISTINCT obsid FROM ({roots}) r(obsid)) WHERE obsid NOT IN (SELECT new_obsid FROM {pairs})
UNION
SELECT g.obsgroupid, p.new_obsid FROM {name} g JOIN {pairs} p ON p.existing_obsid = g.obsid"""


cte("pairs", "obs", pair_body("obs", 3, 3))
cte("members", "pairs", group_body("members", "pairs"))
cte("members_all", "pairs obs", group_body("members_all", "pairs", "SELECT obsid FROM obs"))


def summary_body(members: str, obs: str) -> str:
    return f"""
SELECT obsgroupid, arg_min(m.obsid, o.time * 1000000000000 + m.obsid) AS first_obsid, count(*) AS n_obs,
       floor(sum(centerx) / count(*))::INTEGER AS centroidx, floor(sum(centery) / count(*))::INTEGER AS centroidy,
       min(centerx) AS minx, min(centery) AS miny, max(centerx) AS maxx, max(centery) AS maxy
FROM {members} m JOIN {obs} o USING (obsid) GROUP BY obsgroupid"""


def step_member_body(members: str, obs: str) -> str:
    return f"""
SELECT s.obsgroupid, fromtime, totime, part, o.obsid, boxxstart, boxystart, boxxend, boxyend
FROM (SELECT obsgroupid, time AS fromtime, lead(time) OVER (PARTITION BY obsgroupid ORDER BY time) AS totime
      FROM (SELECT DISTINCT obsgroupid, time FROM {members} JOIN {obs} USING (obsid))) s,
     (VALUES (0), (1)) p(part), {members} m, {obs} o
WHERE totime IS NOT NULL AND m.obsgroupid = s.obsgroupid AND o.obsid = m.obsid
  AND o.time = CASE part WHEN 0 THEN fromtime ELSE totime END"""


cte("summary", "members obs", summary_body("members", "obs"))
cte("step_members", "members obs", step_member_body("members", "obs"))
cte("steps_ordered", "step_members verts", """
SELECT obsgroupid, fromtime, totime, x, y,
       (row_number() OVER (PARTITION BY obsgroupid, fromtime ORDER BY part, obsid, ord) - 1)::INTEGER AS ord
FROM step_members JOIN verts USING (obsid)""")
cte("step_polygons", "steps_ordered", """
SELECT obsgroupid, fromtime, totime, ord, x, y FROM steps_ordered
UNION ALL
SELECT obsgroupid, fromtime, totime, n::INTEGER, x, y
FROM (SELECT obsgroupid, fromtime, totime, count(*) AS n, arg_min(x, ord) AS x, arg_min(y, ord) AS y
      FROM steps_ordered GROUP BY ALL)""")
cte("traj", "members obs", """
SELECT obsgroupid, (row_number() OVER (PARTITION BY obsgroupid ORDER BY time, obsid) - 1)::INTEGER AS ord,
       time, obsid, centerx AS x, centery AS y
FROM members JOIN obs USING (obsid)""")

# --- bright regions ----------------------------------------------------------------------------------

cte("offs", "", """
SELECT * FROM (VALUES (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1)) d(k, dx, dy)""")


def define_regions(suffix: str, threshold: int) -> None:
    cte(f"bright{suffix}", "px", f"SELECT imageid, x, y, pix FROM px WHERE pix >= {threshold}")
    cte(f"adj{suffix}", f"bright{suffix} offs", f"""
SELECT a.imageid, a.x, a.y, k, b.x AS bx, b.y AS by
FROM bright{suffix} a, offs, bright{suffix} b WHERE b.imageid = a.imageid AND b.x = a.x + dx AND b.y = a.y + dy""")
    cte(f"reach{suffix}", f"bright{suffix} adj{suffix}", f"""
SELECT imageid, x, y, y * 100000 + x AS root FROM bright{suffix}
UNION
SELECT r.imageid, a.bx, a.by, r.root FROM reach{suffix} r JOIN adj{suffix} a USING (imageid, x, y)""")
    cte(f"lab{suffix}", f"reach{suffix} bright{suffix}", f"""
SELECT b.imageid, root, b.x, b.y, b.pix
FROM bright{suffix} b JOIN (SELECT imageid, x, y, min(root) AS root FROM reach{suffix} GROUP BY ALL) USING (imageid, x, y)""")
    cte(f"sums{suffix}", f"lab{suffix}", f"""
SELECT imageid, root, sum(pix)::BIGINT AS pixelSum, count(*) AS n,
       sum(pix::BIGINT * x)::DOUBLE / sum(pix)::DOUBLE AS cx, sum(pix::BIGINT * y)::DOUBLE / sum(pix)::DOUBLE AS cy,
       min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy
FROM lab{suffix} GROUP BY imageid, root""")
    cte(f"stats{suffix}", f"sums{suffix} lab{suffix}", f"""
SELECT s.*, averageDist FROM sums{suffix} s JOIN (
  SELECT imageid, root, sum(pix * sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) / any_value(pixelSum) AS averageDist
  FROM lab{suffix} JOIN sums{suffix} USING (imageid, root) GROUP BY imageid, root) USING (imageid, root)""")
    # For a pixel entered in direction kin: the first neighbour clockwise from the search start.
    cte(f"turn{suffix}", f"adj{suffix}", f"""
SELECT imageid, x, y, kin, arg_min(k, (k - kin + CASE WHEN kin % 2 = 1 THEN 2 ELSE 1 END + 8) % 8) AS kout
FROM adj{suffix}, range(0, 8) t(kin) GROUP BY ALL""")
    cte(f"start{suffix}", f"lab{suffix} turn{suffix}", f"""
SELECT s.imageid, root, s.x, s.y, kout AS k, n
FROM (SELECT imageid, root, min(x) AS x, arg_min(y, x * 100000 + y) AS y, count(*) AS n FROM lab{suffix} GROUP BY ALL) s
LEFT JOIN turn{suffix} t ON t.imageid = s.imageid AND t.x = s.x AND t.y = s.y AND kin = 7""")
    cte(f"walk{suffix}", f"start{suffix} turn{suffix} offs", f"""
SELECT imageid, root, 0 AS ord, x, y, k, x AS sx, y AS sy, k AS sk, n FROM start{suffix}
UNION ALL
SELECT w.imageid, root, ord + 1, t.x, t.y, kout, sx, sy, sk, n
FROM walk{suffix} w JOIN offs o ON o.k = w.k
JOIN turn{suffix} t ON t.imageid = w.imageid AND t.x = w.x + dx AND t.y = w.y + dy AND t.kin = w.k
WHERE NOT (t.x = sx AND t.y = sy AND kout = sk) AND ord + 1 < 2 * n + 3""")
    cte(f"rings{suffix}", f"walk{suffix}", f"""
SELECT imageid, root, count(*) AS vertices, list(x ORDER BY ord) AS xs, list(y ORDER BY ord) AS ys
FROM walk{suffix} GROUP BY imageid, root""")
    for name, keep in ((f"found{suffix}", ""), (f"kept{suffix}", "WHERE vertices <= 50")):
        source = f"stats{suffix} s" + (f" JOIN rings{suffix} USING (imageid, root)" if keep else "")
        cte(name, f"stats{suffix} images" + (f" rings{suffix}" if keep else ""), f"""
SELECT row_number() OVER (ORDER BY imageid, root) AS obsid, imageid, time, cycle, averageDist, pixelSum, n, root,
       trunc(cx)::INTEGER + xstart AS centerx, trunc(cy)::INTEGER + ystart AS centery,
       minx + xstart AS boxxstart, miny + ystart AS boxystart, maxx + xstart AS boxxend, maxy + ystart AS boxyend
       {", list_transform(xs, lambda v: v + xstart) AS xs, list_transform(ys, lambda v: v + ystart) AS ys" if keep else ""}
FROM {source} JOIN images USING (imageid) {keep}""")


define_regions("", 14000)
define_regions("_low", 13500)

cte("cooked_pairs", "found", pair_body("found", 2, 2))
cte("cooked_members", "cooked_pairs", group_body("cooked_members", "cooked_pairs"))
cte("cooked_summary", "cooked_members found", summary_body("cooked_members", "found"))
cte("cooked_steps", "cooked_members found", f"""
SELECT obsgroupid, fromtime, totime, min(boxxstart) AS minx, min(boxystart) AS miny,
       max(boxxend) AS maxx, max(boxyend) AS maxy
FROM ({step_member_body("cooked_members", "found")}) GROUP BY ALL""")


def cutout_sql(chosen: str, slab: tuple[int, int, int, int], dist: int) -> str:
    xs, xl, ys, yl = slab
    return f"""
, chosen AS (SELECT DISTINCT obsid FROM ({chosen})),
spots AS (
  SELECT c.obsid, i.imageid, xstart, ystart, c.centerx - xstart AS lx, c.centery - ystart AS ly,
         xend - xstart AS w, yend - ystart AS h
  FROM found c JOIN chosen USING (obsid), images i
  WHERE xend >= {xs} AND xstart <= {xs + xl} AND yend >= {ys} AND ystart <= {ys + yl}
    AND c.centerx BETWEEN xstart - {dist} AND xend + {dist} AND c.centery BETWEEN ystart - {dist} AND yend + {dist})
SELECT obsid, s.imageid, (lx + dx.d + xstart)::INTEGER AS x, (ly + dy.d + ystart)::INTEGER AS y,
       coalesce(pix, 0)::INTEGER AS pix
FROM spots s, range(-{dist}, {dist}) dx(d), range(-{dist}, {dist}) dy(d)
LEFT JOIN px p ON p.imageid = s.imageid AND p.x = lx + dx.d AND p.y = ly + dy.d
WHERE lx + dx.d >= 0 AND lx + dx.d < w AND ly + dy.d >= 0 AND ly + dy.d < h"""


SLAB = (60, 50, 40, 50)
CUT = 5

# --- regridding --------------------------------------------------------------------------------------


def regrid_sql(mode: str, rect: tuple[int, int, int, int] | None = None) -> str:
    xs, xl, ys, yl = rect or (0, 64, 0, 100)
    if mode == "area":
        # Share (in thirds) of the source interval [3v/10, 3(v+1)/10) inside the cell (c, c+1).
        share = "greatest(0, least(3 * ({v} + 1), 10 * ({c} + 1)) - greatest(3 * {v}, 10 * {c}))"
        fx, fy, scale = share.format(v="sx", c="x"), share.format(v="sy", c="y"), 100.0
        used = f"{fx} > 0 AND {fy} > 0"
    else:
        fx = "CASE WHEN x = sx * 3 // 10 THEN CASE WHEN sx % 10 = 3 THEN 2 ELSE 1 END ELSE CASE WHEN sx % 10 = 3 THEN 1 ELSE 2 END END"
        fy = "CASE WHEN y = sy * 3 // 10 THEN CASE WHEN sy % 10 = 3 THEN 6 ELSE 3 END ELSE 2 END"
        used, scale = "true", 300.0
    return f"""
SELECT i.imageid, c.x::INTEGER AS x, d.y::INTEGER AS y, coalesce(valid_and, 0)::INTEGER AS valid_and,
       coalesce(wpix, 0)::DOUBLE / {scale} AS pixavg, coalesce(wvar, 0)::DOUBLE / {scale} AS varavg
FROM images i, range(0, {xl} * 3 // 10 + 1) c(x), range(0, {yl} * 3 // 10 + 1) d(y)
LEFT JOIN (
  SELECT imageid, x, y, bit_and(valid) AS valid_and, sum(({fx}) * ({fy}) * pix)::BIGINT AS wpix,
         sum(({fx}) * ({fy}) * var)::BIGINT AS wvar
  FROM (SELECT imageid, p.x - {xs} AS sx, p.y - {ys} AS sy, pix, var, valid,
               (p.x - {xs}) * 3 // 10 + a.o AS x, (p.y - {ys}) * 3 // 10 + b.o AS y
        FROM px p, range(0, 2) a(o), range(0, 2) b(o)
        WHERE p.x BETWEEN {xs} AND {xs + xl - 1} AND p.y BETWEEN {ys} AND {ys + yl - 1})
  WHERE {used} GROUP BY imageid, x, y) s ON s.imageid = i.imageid AND s.x = c.x AND s.y = d.y"""


# --- generator ---------------------------------------------------------------------------------------

# Fixed values of the data set: multiplier, addend and range of the random numbers; below, the sequence of tile numbers.
RAND = "(((790388361::HUGEINT * ({t}) + 551188310) & 1073741823)::DOUBLE / 1073741824::DOUBLE)"


def rand(t: str) -> str:
    return RAND.format(t=t)


def norm(t: str) -> str:
    return "(" + " + ".join(rand(f"({t}) * 12 + {i}") for i in range(12)) + " - 6.0::DOUBLE)"


def positions_body(source: str, total: str, side: int, range_: int, world: int) -> str:
    def corner(k: int) -> str:
        r = rand(f"s + {k}")
        return (
            f"trunc(CASE WHEN {rand('s')} < 0.8::DOUBLE THEN {(world - range_) // 2} + {r} * {range_ - side} "
            f"ELSE {r} * {world - side} END)::INTEGER"
        )

    return f"""
SELECT t::INTEGER AS t, {corner(1)} AS x, {corner(2)} AS y, 'bench_' || CASE WHEN t < 10000 THEN lpad(t::VARCHAR, 4, '0') ELSE t::VARCHAR END AS filename
FROM (SELECT t, 3 * CASE WHEN t >= total // 2 THEN t - total // 2 ELSE t END AS s
      FROM {source}, (SELECT {total} AS total))"""


cte("image_times", "", "SELECT DISTINCT vec_id // 50 AS t FROM embeddings")
cte("corners", "image_times", positions_body("image_times", "(SELECT count(*) FROM image_times)", 100, 900, 1000))
cte("drawn", "corners base_px", """
SELECT t, x, y, wx, wy, inside, CASE WHEN inside THEN coalesce(pix, 0) ELSE 0 END AS raw
FROM (SELECT t, x, y, wx, wy, wx % 70 AS tx, wy % 60 AS ty, wx % 70 < 64 AND wy % 60 < 50 AS inside, t // 10 AS tile_set,
             substr('31415926535897932384626433832795028841971693993751058209749445923078164062862089986280348253421170679',
                    ((wx // 70 + (wy // 60) * (1000 // 70 + 1)) % 101 + 1)::INTEGER, 1)::INTEGER AS tile_num
      FROM (SELECT t, a.v AS x, b.v AS y, a.v + greatest(0, c.x + t % 3 - 1) AS wx,
                   b.v + greatest(0, c.y + (t // 3) % 3 - 1) AS wy
            FROM corners c, range(0, 100) a(v), range(0, 100) b(v))) s
LEFT JOIN (SELECT vec_id // 500 AS tile_set, vec_id % 10 AS tile_num, x AS tx, vec_id % 500 // 10 AS ty, pix FROM base_px) b
  USING (tile_set, tile_num, tx, ty)""")
cte("generated", "drawn", f"""
SELECT t::INTEGER AS imageid, ((y // 100) * 1000 + x // 100)::INTEGER AS tile, x::INTEGER AS x, y::INTEGER AS y, pix,
       trunc(sqrt(pix))::INTEGER AS var, (CASE WHEN inside THEN 1 ELSE 0 END)::INTEGER AS valid,
       (CASE WHEN raw = 65535 THEN 1 ELSE 0 END)::INTEGER AS sat,
       greatest(0, trunc((pix - 3000) * 65535.0::DOUBLE / 62535))::INTEGER AS v0,
       trunc(65535 * {norm("seed + 1")})::INTEGER AS v1,
       trunc(32768 + 32768 * {norm("seed + 2")})::INTEGER AS v2,
       trunc(-500000000 + 1000000 * {norm("seed + 3")})::INTEGER AS v3,
       trunc(10 * {norm("seed + 4")})::INTEGER AS v4,
       trunc(1000 + 100 * {norm("seed + 5")})::INTEGER AS v5,
       trunc(1 + 0.5::DOUBLE * {norm("seed + 6")})::INTEGER AS v6
FROM (SELECT *, least(65535, greatest(0, raw + (t % 5 - 2) * 10))::INTEGER AS pix,
             ((t * 3141 + wx * 592 + wy) % 65359) * 6 AS seed FROM drawn)""")

# --- queries -----------------------------------------------------------------------------------------

RASTER = "imageid, tile, x, y, pix, var, valid, sat, v0, v1, v2, v3, v4, v5, v6"
OBS = "obsid, imageid, time, cycle, averageDist, pixelSum, centerx, centery, boxxstart, boxystart, boxxend, boxyend"
RING = "'POLYGON((' || concat_ws(',', boxxstart || ' ' || boxystart, boxxend || ' ' || boxystart, boxxend || ' ' || boxyend, boxxstart || ' ' || boxyend, boxxstart || ' ' || boxystart) || '))'"
CENTRE = "centerx BETWEEN 3000 AND 6000 AND centery BETWEEN 3000 AND 6000"
OVERLAP = "boxxstart <= 6000 AND boxxend >= 3000 AND boxystart <= 6000 AND boxyend >= 3000"
Q7 = f"""SELECT 'group' AS kind, obsgroupid AS id FROM summary
WHERE minx >= 3000 AND maxx <= 6000 AND miny >= 3000 AND maxy <= 6000
UNION ALL SELECT 'observation', obsid FROM obs WHERE {CENTRE}"""
SIMILAR = """
SELECT n.obsid AS new_obsid, e.obsid AS existing_obsid, n.time AS new_time, e.time AS existing_time
FROM obs n JOIN obs e ON e.time < n.time AND abs(n.pixelSum - e.pixelSum) <= 1000
 AND abs(n.averageDist - e.averageDist) <= 2 AND {near}"""
cte("alike", "obs", SIMILAR.format(near="""
    (n.centerx - e.centerx)::BIGINT * (n.centerx - e.centerx)
  + (n.centery - e.centery)::BIGINT * (n.centery - e.centery)
  <= power(trunc(3 * (n.time::DOUBLE / 4 - e.time::DOUBLE / 4)), 2)"""))
cte("alike_members", "alike", group_body("alike_members", "alike"))
COOKED = """
SELECT {obsid}, """ + OBS.removeprefix("obsid, ").replace("averageDist", "round(averageDist, 6) AS averageDist") + """,
       'POLYGON((' || array_to_string(list_transform(list_zip(list_append(xs, xs[1]), list_append(ys, ys[1])), lambda p: p[1] || ' ' || p[2]), ',') || '))' AS outline
FROM {source}"""
Q1 = "SELECT coalesce(sum({a}), 0)::BIGINT AS total, count({a}) AS n, sum({a})::DOUBLE / count({a}) AS average FROM px JOIN images USING (imageid) WHERE cycle = {c}"
COOKED_SELECTION = """
SELECT obsid FROM cooked_members JOIN cooked_summary USING (obsgroupid)
WHERE minx >= 60 AND maxx <= 110 AND miny >= 40 AND maxy <= 90
UNION SELECT obsid FROM found WHERE centerx BETWEEN 60 AND 110 AND centery BETWEEN 40 AND 90"""
COOKED_AT_2 = """
SELECT obsid FROM cooked_members JOIN cooked_steps USING (obsgroupid)
WHERE fromtime <= 2 AND totime >= 2 AND minx <= 110 AND maxx >= 60 AND miny <= 90 AND maxy >= 40
UNION SELECT obsid FROM found
WHERE time = 2 AND boxxstart >= 60 AND boxxend <= 110 AND boxystart >= 40 AND boxyend <= 90"""


def oracle_sql() -> dict[str, str]:
    s = with_tables
    out = {
        # sources and sinks
        "scan_raster_csv": s("px", f"SELECT {RASTER} FROM px"),
        "scan_raster_bin": s("px", f"SELECT {RASTER} FROM px"),
        "scan_raster_attr": s("px", "SELECT imageid, tile, x, y, pix, v0 FROM px"),
        "image_catalog": s("corners", """
            SELECT t AS imageid, x AS xstart, y AS ystart, x + 100 AS xend, y + 100 AS yend, t AS time,
                   (t // 20)::INTEGER AS cycle, filename AS tablename FROM corners"""),
        "images_by_cycle": s("images", "SELECT * FROM images WHERE cycle = 1"),
        "gen_pixels": s("generated", f"SELECT {RASTER} FROM generated"),
        "gen_positions": "WITH " + "e AS (SELECT event_id AS t FROM events)"
            + positions_body("e", "(SELECT count(*) FROM e)", 7500, 31623, 1000000),
        "gen_piece": s("generated", """
            SELECT 'range' AS layout, n AS pieces, i AS piece, count(*) AS pixels, sum(pix)::BIGINT AS total
            FROM generated, (VALUES (3, 0), (3, 1), (3, 2)) p(n, i), (SELECT count(*) AS images FROM image_times)
            WHERE imageid >= images * i // n AND imageid < images * (i + 1) // n GROUP BY ALL
            UNION ALL
            SELECT 'robin', 3, imageid % 3, count(*), sum(pix)::BIGINT FROM generated GROUP BY imageid % 3"""),
        "write_raster": s("px images", f"SELECT {RASTER}, cycle FROM px JOIN images USING (imageid)"),
        "obs_wkt": s("obs", f"""
            SELECT concat_ws(';', obsid, imageid, time, cycle, printf('%.6f', averageDist), pixelSum, centerx, centery,
                   boxxstart, boxystart, boxxend, boxyend, 'POINT(' || centerx || ' ' || centery || ')', {RING}) AS value
            FROM obs"""),
        "obs_wkt_roundtrip": s("obs", f"SELECT {OBS}, {RING} AS outline FROM obs"),
        "obs_vertices": s("verts", "SELECT obsid, ord::INTEGER AS ord, x, y FROM verts"),
        "group_wkt": s("traj step_polygons", """
            SELECT concat_ws(';', obsgroupid, 'LINESTRING(' || string_agg(x || ' ' || y, ',' ORDER BY ord) || ')') AS value
            FROM traj GROUP BY obsgroupid
            UNION ALL
            SELECT concat_ws(';', obsgroupid, fromtime, totime, 'POLYGON((' || string_agg(x || ' ' || y, ',' ORDER BY ord) || '))')
            FROM step_polygons GROUP BY obsgroupid, fromtime, totime"""),
        "group_files_roundtrip": s("members traj step_polygons", """
            SELECT 'trajectory' AS kind, obsgroupid, -1::BIGINT AS obsid, -1 AS fromtime, -1 AS totime, ord, x, y
            FROM traj
            UNION ALL SELECT 'member', obsgroupid, obsid, -1, -1, -1, -1, -1 FROM members
            UNION ALL SELECT 'step', obsgroupid, -1, fromtime, totime, ord, x, y FROM step_polygons"""),
        "load_ignore": s("obs", "SELECT obsid, 'old' AS origin, centerx FROM obs WHERE time < 20 UNION ALL SELECT obsid, 'new', centery FROM obs WHERE time >= 20"),
        "load_replace": s("obs", "SELECT obsid, 'old' AS origin, centerx FROM obs WHERE time < 10 UNION ALL SELECT obsid, 'new', centery FROM obs WHERE time >= 10"),
        "merge_pieces": s("obs", "SELECT obsid, (time % 4)::INTEGER AS piece, pixelSum FROM obs"),
        "result_overwrite": s("obs", f"SELECT cycle, count(*) AS n FROM obs WHERE {CENTRE} GROUP BY cycle"),
        "distinct_ids": s("pairs", "SELECT DISTINCT existing_obsid AS id FROM pairs"),
        # scalar functions
        "tile_of": s("obs", """
            SELECT obsid, ((centery // 100) * 1000 + centerx // 100)::INTEGER AS tile, (centerx // 100)::INTEGER AS xtile,
                   (centery // 100)::INTEGER AS ytile FROM obs"""),
        "region_of": s("obs", "SELECT obsid, ((centery // 1000) * 65536 + centerx // 1000)::INTEGER AS region FROM obs"),
        "to_world": s("stats images", """
            SELECT imageid, (root // 100000)::INTEGER AS first_y, (root % 100000)::INTEGER AS first_x, time, cycle,
                   trunc(cx)::INTEGER + xstart AS centerx, trunc(cy)::INTEGER + ystart AS centery,
                   minx + xstart AS boxxstart, miny + ystart AS boxystart, maxx + xstart AS boxxend, maxy + ystart AS boxyend
            FROM stats JOIN images USING (imageid)"""),
        "obs_bbox": s("obs", "SELECT obsid, boxxstart, boxystart, boxxend, boxyend FROM obs"),
        "bench_rand": f"SELECT event_id, {rand('event_id')} AS r FROM events",
        "bench_rand_norm": f"SELECT event_id, {norm('event_id')} AS r FROM events",
        # filters
        "f_cycle": s("px images", f"SELECT {RASTER} FROM px JOIN images USING (imageid) WHERE cycle = 1"),
        "box_tiles": s("px", "SELECT imageid, tile, x, y, pix FROM px WHERE x BETWEEN 7 AND 46 AND y BETWEEN 13 AND 77"),
        "obs_in_box": s("obs", f"SELECT {OBS} FROM obs WHERE {CENTRE}"),
        "obs_overlap_box": s("obs", f"SELECT {OBS} FROM obs WHERE {OVERLAP}"),
        "groups_in_box": s("summary", "SELECT obsgroupid FROM summary WHERE minx >= 3000 AND maxx <= 6000 AND miny >= 3000 AND maxy <= 6000"),
        "obs_cutoff": s("walk_low", """
            SELECT imageid, (root // 100000)::INTEGER AS first_y, (root % 100000)::INTEGER AS first_x, count(*) AS vertices
            FROM walk_low GROUP BY imageid, root HAVING count(*) <= 50"""),
        "images_in_slab": s("images", "SELECT * FROM images WHERE xend >= 60 AND xstart <= 110 AND yend >= 40 AND ystart <= 90"),
        "obs_in_box_time": s("obs", f"SELECT {OBS} FROM obs WHERE time = 10 AND {CENTRE}"),
        # aggregates
        "q1_box": s("px images", Q1.format(a="pix", c=1) + " AND x BETWEEN 7 AND 46 AND y BETWEEN 13 AND 77"),
        "q1_all": s("px images", Q1.format(a="v0", c=1)),
        "q1_partials": s("px images", """
            SELECT (imageid % 2)::INTEGER AS node, sum(pix)::BIGINT AS total, count(*) AS n
            FROM px JOIN images USING (imageid) WHERE cycle = 1 GROUP BY imageid % 2"""),
        "q4": s("obs", f"SELECT coalesce(round(avg(pixelSum), 6), 0) AS average, count(*) AS n FROM obs WHERE cycle = 2 AND {CENTRE}"),
        "q5": s("obs", f"SELECT coalesce(round(avg(averageDist), 6), 0) AS average, count(*) AS n FROM obs WHERE cycle = 2 AND {OVERLAP}"),
        "q6_grid": s("obs", """
            SELECT (centerx // 100)::INTEGER AS dx, (centery // 100)::INTEGER AS dy, count(*) AS counts FROM obs
            WHERE cycle = 2 GROUP BY ALL HAVING count(*) >= 5"""),
        "q6_neighbours": s("obs", """
            SELECT a.obsid, a.centerx AS dx, a.centery AS dy, count(*) AS counts
            FROM obs a JOIN obs b ON b.cycle = a.cycle AND abs(a.centerx - b.centerx) <= 20 AND abs(a.centery - b.centery) <= 20
            WHERE a.cycle = 2 GROUP BY ALL HAVING count(*) >= 8"""),
        "q6_neighbours_slab": s("obs", f"""
            , chosen AS (SELECT * FROM obs WHERE cycle = 2 AND {CENTRE})
            SELECT a.obsid, a.centerx AS dx, a.centery AS dy, count(*) AS counts
            FROM chosen a JOIN chosen b ON abs(a.centerx - b.centerx) <= 20 AND abs(a.centery - b.centery) <= 20
            GROUP BY ALL HAVING count(*) >= 8"""),
        "q6_neighbours_wide": s("obs", """
            SELECT a.obsid, a.centerx AS dx, a.centery AS dy, count(*) AS counts
            FROM obs a JOIN obs b ON b.cycle = a.cycle AND abs(a.centerx - b.centerx) <= 1500 AND abs(a.centery - b.centery) <= 1500
            WHERE a.cycle = 2 GROUP BY ALL HAVING count(*) >= 40"""),
        "q3_area": s("px images", regrid_sql("area")),
        "q3_compat": s("px images", regrid_sql("compat")),
        "q3_box": s("px images", regrid_sql("area", (7, 40, 13, 65))),
        "obs_stats": s("stats", """
            SELECT imageid, (root // 100000)::INTEGER AS first_y, (root % 100000)::INTEGER AS first_x, n, round(averageDist, 6) AS averageDist,
                   pixelSum, trunc(cx)::INTEGER AS centerx, trunc(cy)::INTEGER AS centery FROM stats"""),
        "q7_count": s("summary obs", f"SELECT count(*) AS n FROM ({Q7})"),
        "pair_count": s("pairs", "SELECT 3.0::DOUBLE AS d2, 3 AS t, count(*) AS pairs FROM pairs"),
        "group_members": s("members", """
            SELECT obsgroupid, string_agg(obsid, ',' ORDER BY obsid) AS obsids, count(*) AS n FROM members GROUP BY obsgroupid"""),
        "groups_of_obs": s("members obs", "SELECT obsid, obsgroupid FROM members"),
        "batch_bbox": s("obs", "SELECT min(centerx) AS boxxstart, min(centery) AS boxystart, max(centerx) AS boxxend, max(centery) AS boxyend FROM obs"),
        "group_bbox": s("members obs", """
            SELECT obsgroupid, min(boxxstart) AS minx, min(boxystart) AS miny, max(boxxend) AS maxx, max(boxyend) AS maxy
            FROM members JOIN obs USING (obsid) GROUP BY obsgroupid"""),
        # joins
        "group_obs_semi": s("members summary", """
            SELECT obsgroupid, obsid FROM members WHERE obsgroupid IN (
              SELECT obsgroupid FROM summary WHERE minx >= 3000 AND maxx <= 6000 AND miny >= 3000 AND maxy <= 6000)"""),
        "candidates": s("obs narrow_frames", """
            SELECT i.imageid, o.obsid, o.time, o.centerx, o.centery
            FROM narrow_frames i, range(1, 4) b(b), obs o
            WHERE b.b <= i.time AND o.time = i.time - b.b
              AND power(greatest(xstart - centerx, centerx - xend, 0), 2)
                + power(greatest(ystart - centery, centery - yend, 0), 2) <= 9 * b.b * b.b + 0.0001"""),
        "motion_pairs": s("pairs", "SELECT * FROM pairs"),
        "obs_in_radius": s("obs", f"""
            SELECT {OBS} FROM obs WHERE time = 10
              AND (centerx - 5000) * (centerx - 5000) + (centery - 5000) * (centery - 5000) <= 2000 * 2000"""),
        "similar_pairs": s("obs", SIMILAR.format(near="""
            trunc(sqrt((n.centerx - e.centerx)::BIGINT * (n.centerx - e.centerx)
                     + (n.centery - e.centery)::BIGINT * (n.centery - e.centery))) <= n.time - e.time""")),
        "similar_pairs_radius": s("alike", "SELECT * FROM alike"),
        "q8": s("cooked_members cooked_summary found images px", cutout_sql(COOKED_SELECTION, SLAB, CUT)),
        "q9": s("cooked_members cooked_steps found images px", cutout_sql(COOKED_AT_2, SLAB, CUT)),
        "cutout_tiles": s("found images", """
            SELECT obsid, imageid, (ty.v * 1000 + tx.v)::INTEGER AS tile
            FROM found f JOIN (SELECT imageid AS img, xstart, ystart, xend, yend FROM images) i
              ON f.centerx BETWEEN xstart - 5 AND xend + 5 AND f.centery BETWEEN ystart - 5 AND yend + 5,
              range(0, 7) tx(v), range(0, 11) ty(v)
            WHERE tx.v BETWEEN trunc((centerx - xstart - 5) / 10) AND trunc((centerx - xstart + 5) / 10)
              AND ty.v BETWEEN trunc((centery - ystart - 5) / 10) AND trunc((centery - ystart + 5) / 10)"""
            ).replace("SELECT obsid, imageid, (ty", "SELECT obsid, img AS imageid, (ty"),
        "obs_union": s("cooked_members cooked_summary found", COOKED_SELECTION),
        # segmentation
        "label_components": s("lab_low", """
            SELECT imageid, (root // 100000)::INTEGER AS first_y, (root % 100000)::INTEGER AS first_x, x, y, pix FROM lab_low"""),
        "outline": s("walk_low", """
            SELECT imageid, (root // 100000)::INTEGER AS first_y, (root % 100000)::INTEGER AS first_x, ord::INTEGER AS ord, x, y FROM walk_low"""),
        "obs_ids": s("found", "SELECT obsid, imageid, (root // 100000)::INTEGER AS first_y, (root % 100000)::INTEGER AS first_x FROM found"),
        "q2_cook": s("kept_low", COOKED.format(obsid="obsid", source="kept_low")),
        "q2_image": s("kept_low", COOKED.format(
            obsid="row_number() OVER (ORDER BY obsid) AS obsid", source="kept_low WHERE imageid = 3")),
        "q2_pieces": s("kept_low", COOKED.format(
            obsid="row_number() OVER (PARTITION BY imageid % 3 ORDER BY obsid) + (imageid % 3) * 10000000::BIGINT AS obsid",
            source="kept_low")),
        "dedup_obs": s("obs", "SELECT obsid, time, centerx, 0 AS source FROM obs"),
        # groups
        "groups": s("members", "SELECT * FROM members"),
        "groups_singletons": s("members_all", "SELECT * FROM members_all"),
        "groups_incremental": s("members", "SELECT * FROM members"),
        "groups_similar": s("alike_members", "SELECT * FROM alike_members"),
        "center_traj": s("traj", "SELECT * FROM traj"),
        "polygon_traj": s("step_polygons", "SELECT * FROM step_polygons"),
        "group_summary": s("summary", "SELECT * FROM summary"),
        "q7": s("summary obs", Q7),
        "time_index": s("obs", """
            SELECT time, first_obsid, (sum(n) OVER (ORDER BY time) - n)::BIGINT AS first_index, n
            FROM (SELECT time, min(obsid) AS first_obsid, count(*) AS n FROM obs GROUP BY time)"""),
        # incremental
        "stream_groups": s("members", "SELECT * FROM members"),
        "stream_pairs": s("pairs", "SELECT * FROM pairs"),
    }
    out |= {f"{name}_stored": out[same] for name, same in (("q1", "q1_box"), ("q3", "q3_box"))}
    of_slabs = "q4 q5 q7 q8 q9 obs_in_box obs_overlap_box groups_in_box obs_in_box_time obs_in_radius"
    out |= {f"{name}_stored": out[name] for name in of_slabs.split()}
    out["gen_positions"] = "WITH e AS (SELECT event_id AS t FROM events)" + positions_body(
        "e", "(SELECT count(*) FROM e)", 7500, 31623, 1000000
    )
    return out
