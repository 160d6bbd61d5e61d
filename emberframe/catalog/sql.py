"""Building blocks of the SQL twins: named common table expressions and number formats."""

from __future__ import annotations

from emberframe import constants as k
from emberframe.catalog import fixtures
from emberframe.functions.geo import lambert_parameters


def num(v: float) -> str:
    """A DOUBLE literal (plain decimals would be DECIMAL)."""
    text = repr(float(v))
    return text if "e" in text else f"{text}e0"


def R(expr: str, digits: int = 6) -> str:
    """Rounded DOUBLE without negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"


_CONE = lambert_parameters()
TD = "year, tile_col, tile_row, dob"
SPAN = num(k.GRID_SIZE * k.PIXEL_SIZE)


def tiling(source: str, grid: int = k.GRID_SIZE, pixel: float = k.PIXEL_SIZE) -> str:
    span, px = num(grid * pixel), num(pixel)
    return f"""
SELECT *, least(greatest(cast(floor((easting - tile_col * {span}) / {px}) AS int), 0), {grid - 1}) AS pixel_x,
       least(greatest(cast(floor(((tile_row + 1) * {span} - northing) / {px}) AS int), 0), {grid - 1}) AS pixel_y
FROM (SELECT *, cast(floor(easting / {span}) AS int) AS tile_col, cast(floor(northing / {span}) AS int) AS tile_row
      FROM {source}) q"""


# name -> (names it needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "p1": (("burn_points",), f"SELECT *, {num(k.GRS80_E)} * sin(radians(lat)) AS es FROM burn_points"),
    "p2": (
        ("p1",),
        f"""SELECT *, {num(_CONE['scale'])} * pow(tan(pi() / 4 - radians(lat) / 2)
                 / pow((1 - es) / (1 + es), {num(k.GRS80_E / 2)}), {num(_CONE['n'])}) AS rho,
                 {num(_CONE['n'])} * radians(lon - {num(k.ORIGIN_LON_DEG)}) AS theta FROM p1""",
    ),
    "proj": (
        ("p2",),
        f"""SELECT id, year, dob, fireday, lon, lat, firearea, cumuarea, row_seq,
                 {num(k.FALSE_EASTING)} + rho * sin(theta) AS easting,
                 {num(k.FALSE_NORTHING + _CONE['rho0'])} - rho * cos(theta) AS northing FROM p2""",
    ),
    "tiled": (("proj",), tiling("proj")),
    "fires": (
        ("tiled",),
        f"SELECT {TD}, id, fireday, min(row_seq) AS first_seq FROM tiled GROUP BY {TD}, id, fireday",
    ),
    "days": (("fires",), f"SELECT DISTINCT {TD} FROM fires"),
    "pairs": (
        ("days",),
        "SELECT a.*, a.dob + 1 AS next_dob FROM days a JOIN days b ON a.year = b.year"
        " AND a.tile_col = b.tile_col AND a.tile_row = b.tile_row AND b.dob = a.dob + 1",
    ),
    "masks": (
        ("tiled",),
        """SELECT year, tile_col, tile_row, id, fireday, pixel_y, pixel_x FROM tiled
           GROUP BY ALL HAVING arg_max(cumuarea, row_seq) > 0""",
    ),
    "firstburn": (
        ("masks",),
        """SELECT year, tile_col, tile_row, id, pixel_y, pixel_x, min(fireday) AS first_fireday
           FROM masks GROUP BY ALL""",
    ),
    "cur": (
        ("fires", "firstburn"),
        """SELECT f.year, f.tile_col, f.tile_row, f.dob, b.pixel_y, b.pixel_x,
                  arg_min(b.first_fireday, f.first_seq) AS first_fireday
           FROM fires f JOIN firstburn b USING (year, tile_col, tile_row, id)
           WHERE b.first_fireday <= f.fireday GROUP BY ALL""",
    ),
    "today": (
        ("fires", "masks"),
        f"SELECT DISTINCT {TD}, pixel_y, pixel_x FROM fires JOIN masks USING (year, tile_col, tile_row, id, fireday)",
    ),
    "grown": (
        ("pairs", "cur", "today"),
        """SELECT p.year, p.tile_col, p.tile_row, p.dob, n.pixel_y, n.pixel_x
           FROM pairs p JOIN today n ON n.year = p.year AND n.tile_col = p.tile_col
                AND n.tile_row = p.tile_row AND n.dob = p.dob + 1
           WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.year = p.year AND c.tile_col = p.tile_col
                AND c.tile_row = p.tile_row AND c.dob = p.dob AND c.pixel_y = n.pixel_y AND c.pixel_x = n.pixel_x)""",
    ),
    "edges": (
        ("fires",),
        """SELECT DISTINCT a.id AS u, b.id AS v FROM fires a JOIN
           (SELECT year, tile_col, tile_row, dob, min(id) AS id FROM fires GROUP BY ALL) b
           USING (year, tile_col, tile_row, dob) WHERE a.id <> b.id""",
    ),
    "both_ways": (("edges",), "SELECT u, v FROM edges UNION SELECT v, u FROM edges"),
    "reach": (
        ("both_ways", "fires"),
        """SELECT DISTINCT id AS u, id AS v FROM fires
           UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u""",
    ),
    "members": (("reach",), "SELECT u AS id, min(v) AS super_id FROM reach GROUP BY u"),
    "superstats": (
        ("members", "burn_points"),
        """SELECT super_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
                  avg(lat) AS center_lat, avg(lon) AS center_lon,
                  (max(lat) - min(lat) + 1e-5) * (max(lon) - min(lon) + 1e-5) AS fire_size
           FROM burn_points JOIN members USING (id) GROUP BY super_id""",
    ),
    "firstrow": (
        ("tiled",),
        """SELECT year, tile_col, tile_row, id, fireday, arg_min(dob, row_seq) AS dob,
                  arg_min(lon, row_seq) AS lon, arg_min(lat, row_seq) AS lat
           FROM tiled GROUP BY year, tile_col, tile_row, id, fireday""",
    ),
    "meta": (
        ("firstrow", "tz_region"),
        """SELECT *, month(d) AS month, timezone('UTC', timezone(tz, d)) AS start_utc,
                  timezone('UTC', timezone(tz, d)) + INTERVAL 24 HOUR AS end_utc,
                  timezone('UTC', timezone(tz, d + INTERVAL 12 HOUR)) AS noon_utc
           FROM (SELECT f.*, coalesce(z.name, 'UTC') AS tz,
                        cast(make_date(f.year, 1, 1) + (f.dob - 1) AS timestamp) AS d
                 FROM firstrow f LEFT JOIN tz_region z ON f.lon >= z.lon_min AND f.lon < z.lon_max AND f.lat >= z.lat_min AND f.lat < z.lat_max) q""",
    ),
}
CTES |= {name: ((), fixtures.sql(name)) for name in fixtures.TEXTS}


def bins_of(source: str) -> str:
    """Size/place bins and strata of a table of super-fire statistics, as nested text."""
    q = f"""SELECT quantile_cont(fire_size, 0.5) AS s1, quantile_cont(fire_size, 0.8) AS s2,
                   quantile_cont(fire_size, 0.95) AS s3, quantile_cont(center_lat, 0.5) AS la,
                   quantile_cont(center_lon, 0.5) AS lo FROM {source}"""
    return f"""SELECT {source}.*, CASE WHEN fire_size <= s1 THEN 'Small' WHEN fire_size <= s2 THEN 'Med'
                      WHEN fire_size <= s3 THEN 'Large' ELSE 'Mega' END AS size_bin,
                      CASE WHEN center_lat <= la THEN 'South' ELSE 'North' END AS lat_bin,
                      CASE WHEN center_lon <= lo THEN 'West' ELSE 'East' END AS lon_bin
               FROM {source}, ({q}) q"""


CTES |= {
    "binned": (("superstats",), bins_of("superstats")),
    "s_first": (("binned",), "SELECT *, size_bin || '_' || lat_bin || '_' || lon_bin AS s0 FROM binned"),
    "s_second": (
        ("s_first",),
        f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY s0) < {k.MIN_STRATUM} THEN size_bin ELSE s0 END AS s1 FROM s_first",
    ),
    "stratified": (
        ("s_second",),
        f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY s1) < {k.MIN_STRATUM} THEN 'Large' ELSE s1 END AS stratum FROM s_second",
    ),
    # Places in proportion to the strata; the largest remainders get what the quotients leave.
    "alloc": (
        ("stratified",),
        """SELECT stratum, n, q + CASE WHEN row_number() OVER (ORDER BY r DESC, stratum) <= t - sum(q) OVER () THEN 1 ELSE 0 END AS n_train
           FROM (SELECT stratum, n, t, n * t // big AS q, n * t % big AS r FROM (SELECT stratum, n, sum(n) OVER () AS big,
                   sum(n) OVER () - cast(ceil(round(sum(n) OVER () * 3e-1, 6)) AS bigint) AS t
                 FROM (SELECT stratum, count(*) AS n FROM stratified GROUP BY stratum) a) b) c""",
    ),
    "halves": (
        ("alloc",),
        """SELECT stratum, n, n_train, q + CASE WHEN row_number() OVER (ORDER BY r DESC, stratum) <= t - sum(q) OVER () THEN 1 ELSE 0 END AS n_val
           FROM (SELECT *, rest * t // big AS q, rest * t % big AS r FROM (SELECT *, n - n_train AS rest, greatest(sum(n - n_train) OVER (), 1) AS big,
                   sum(n - n_train) OVER () // 2 AS t FROM alloc) b) c""",
    ),
    "ranked": (
        ("stratified", "halves"),
        """SELECT s.*, row_number() OVER (PARTITION BY s.stratum ORDER BY md5('42|' || super_id), super_id) AS rk, n_train, n_val, n
           FROM stratified s JOIN halves h ON h.stratum = s.stratum""",
    ),
    "rare": (("ranked",), "SELECT coalesce(max(CASE WHEN n - n_train = 1 THEN 1 ELSE 0 END), 0) AS rare FROM ranked"),
    "split": (
        ("ranked", "rare"),
        """SELECT super_id, stratum, CASE WHEN rk <= n_train THEN 'train'
                  WHEN rare = 1 AND rest_rk <= floor(n_rest / 2) THEN 'val'
                  WHEN rare = 0 AND rk - n_train <= n_val THEN 'val' ELSE 'test' END AS split
           FROM (SELECT *, row_number() OVER (PARTITION BY rk <= n_train ORDER BY md5('42|' || super_id), super_id) AS rest_rk,
                        count(*) OVER (PARTITION BY rk <= n_train) AS n_rest FROM ranked) q, rare""",
    ),
}


def query(body: str, *needs: str, instead: dict[str, str] | None = None, **extra: str) -> str:
    """``WITH RECURSIVE <needs and their needs> <extra> body``; ``instead`` replaces the text of named expressions."""
    order: list[str] = []
    instead = instead or {}

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0] if name in CTES else ():
            visit(dep)
        order.append(name)

    # Names of ``extra`` may stand among the needs, where others build on them; the rest come last.
    for name in (*needs, *extra):
        visit(name)
    parts = [f"{n} AS ({instead.get(n, extra.get(n) or CTES[n][1]).strip()})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()
