"""SQL statements that check the registered queries against DuckDB.

Each statement is built from common table expressions over the driver's views.
"""

from __future__ import annotations

import re

SNAPS = "('ball_snap', 'autoevent_ballsnap', 'snap_direct')"
CLIPS = "('qb_sack', 'pass_forward')"
SIX = "('Cover-0', 'Cover-1', 'Cover-3', 'Cover-2', 'Quarters', 'Cover-6')"
HIGH = "CAST(pff_passcoverage IN ('Cover-1', 'Cover-3') AS INT)"
CALL = "CASE WHEN pred1 > 0.5 THEN '1-High' ELSE '2-High' END"


def turned(shift: bool = True) -> str:
    up, down = ("+ 110", "- 10") if shift else ("", "")
    return f"""
 CASE playdirection WHEN 'right' THEN y ELSE 53.33e0 - y END AS newx,
 CASE playdirection WHEN 'right' THEN -x {up} ELSE x {down} END AS newy"""


def turned_spot() -> str:
    return """
 CASE playdirection WHEN 'right' THEN -spot_x + 110 ELSE spot_x - 10 END AS newspot_y,
 CASE playdirection WHEN 'right' THEN spot_y ELSE 53.33e0 - spot_y END AS newspot_x,
 CASE playdirection WHEN 'right' THEN -spot_x - yardstogo + 110 ELSE spot_x - yardstogo - 10 END AS line_to_gain"""


def bins(y_breaks=(-100, -20, -10, 0, 15), y_labels=("real deep", "deep", "hooks", "blitz"), x="width", y="depth"):
    xs = [(-50, -10, "left third"), (-10, 10, "middle"), (10, 50, "right third")]
    ys = list(zip(y_breaks, y_breaks[1:], y_labels))

    def case(c, parts):
        return "CASE " + " ".join(f"WHEN {c} > {a} AND {c} <= {b} THEN '{t}'" for a, b, t in parts) + " END"

    return f"{case(x, xs)} AS xzone, {case(y, ys)} AS yzone"


def zone_values(y_labels=("real deep", "deep", "hooks", "blitz")) -> str:
    rows = []
    flat_at = y_labels[-2]
    for x in ("left third", "middle", "right third"):
        for y in y_labels:
            if y == "blitz":
                z = "blitz"
            elif x == "middle":
                z = "hooks" if "hooks" in y else "middle"
            else:
                z = ("flat_" if y == flat_at else "third_") + x.split()[0]
            rows.append(f"('{x}', '{y}', '{z}')")
    return f"(VALUES {', '.join(rows)}) AS z(xzone, yzone, zone)"


SYM = "CASE WHEN contains(zone, '_') THEN split_part(zone, '_', 1) ELSE zone END"

CTES: dict[str, str] = {
    "plays": """
SELECT 2018000000 + k // 10 AS gameid, k AS playid,
 CASE (k // 10) % 3 WHEN 0 THEN 2018 WHEN 1 THEN 2021 ELSE 2022 END AS season,
 concat('Play ', k) AS playdescription, 1 + month(o_orderdate) % 4 AS quarter,
 1 + CAST(substr(o_orderpriority, 1, 1) AS INT) % 4 AS down,
 1 + CAST(floor(o_totalprice) AS BIGINT) % 15 AS yardstogo,
 concat('T', CASE WHEN k % 4 < 2 THEN (k // 10) % 16 ELSE (k // 10) % 16 + 16 END) AS possessionteam,
 concat('T', CASE WHEN k % 4 < 2 THEN (k // 10) % 16 + 16 ELSE (k // 10) % 16 END) AS defensiveteam,
 CASE (k * 5 + c) % 7 WHEN 0 THEN 'Cover-0' WHEN 1 THEN 'Cover-1' WHEN 2 THEN 'Cover-2' WHEN 3 THEN 'Cover-3'
  WHEN 4 THEN 'Quarters' WHEN 5 THEN 'Cover-6' ELSE '2-Man' END AS pff_passcoverage,
 (k * 7) % 40 AS presnaphomescore, (k * 11) % 40 AS presnapvisitorscore,
 concat(10 + k % 5, ':', 10 + k % 50, ':00') AS gameclock
FROM (SELECT o_orderkey AS k, o_custkey AS c, * FROM orders)""",
    "games": """
SELECT DISTINCT gameid, season, concat('T', (gameid - 2018000000) % 16) AS hometeamabbr,
 concat('T', (gameid - 2018000000) % 16 + 16) AS visitorteamabbr,
 concat('09/', 10 + gameid % 10, '/', season) AS gamedate
FROM plays""",
    "players": """
SELECT CAST(100 + n_nationkey + 25 * squad AS BIGINT) AS nflid, season,
 CASE WHEN squad = 2 AND n_nationkey = 5 THEN 'TE' WHEN n_nationkey <= 5 THEN 'OL' WHEN n_nationkey = 6 THEN 'QB'
  WHEN n_nationkey IN (7, 8, 11) THEN 'WR' WHEN n_nationkey = 9 THEN 'TE' WHEN n_nationkey = 10 THEN 'RB' ELSE 'CB' END AS position
FROM nation, (VALUES (0), (1), (2)) AS q(squad), (VALUES (2018), (2021), (2022)) AS s(season)""",
    "track": """
SELECT 2018000000 + k // 10 AS gameid, k AS playid,
 CASE WHEN n > 0 THEN 100 + n + 25 * (k % 3) END AS nflid, f AS frameid, CASE WHEN n > 0 THEN n END AS jerseynumber,
 CASE WHEN n = 0 THEN 'football' WHEN n <= 11 THEN concat('T', CASE WHEN k % 4 < 2 THEN (k // 10) % 16 ELSE (k // 10) % 16 + 16 END)
  ELSE concat('T', CASE WHEN k % 4 < 2 THEN (k // 10) % 16 + 16 ELSE (k // 10) % 16 END) END AS team,
 CASE WHEN k % 2 = 0 THEN 'right' ELSE 'left' END AS playdirection,
 CASE WHEN n = 0 THEN los + CAST(f AS DOUBLE) / 8
  WHEN n <= 11 THEN los - sgn * CAST((k * 31 + n * 17) % 60 AS DOUBLE) / 8
  ELSE los + sgn * CAST((k * 31 + n * 53 + q * 3) % 220 - 20 AS DOUBLE) / 8 END AS x,
 CASE WHEN n = 0 THEN 26.5e0 ELSE 1.5e0 + CAST((k * 13 + n * 97 + q) % 400 AS DOUBLE) / 8 END AS y,
 CASE WHEN n > 0 THEN CAST((k + n * 16) % 360 AS DOUBLE) END AS o,
 CASE WHEN flag = 'R' THEN CASE WHEN k % 3 = 0 THEN 'autoevent_ballsnap' ELSE 'ball_snap' END
  WHEN flag = 'A' THEN CASE WHEN k % 5 = 0 THEN 'qb_sack' ELSE 'pass_forward' END
  WHEN k % 2 = 0 THEN 'line_set' END AS event
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS sgn, 20 + (k * 37) % 60 AS los
 FROM (SELECT l_orderkey AS k, l_linenumber AS f, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, max(l_returnflag) AS flag
  FROM lineitem GROUP BY 1, 2), (SELECT unnest(range(23)) AS n))""",
    "color_grid": """
SELECT DISTINCT hometeamabbr AS team1, visitorteamabbr AS team2, '#FFFFFF' AS color1, '#002244' AS color2 FROM games
UNION ALL SELECT DISTINCT visitorteamabbr, hometeamabbr, '#AA0000', '#FFFFFF' FROM games WHERE hometeamabbr <> 'T3'""",
    "preds": """
SELECT gameid, playid, playid + 10000 AS clip_id, pff_passcoverage,
 CASE WHEN pff_passcoverage IN ('Cover-1', 'Cover-3') THEN '1-High' ELSE '2-High' END AS actual,
 CAST((playid * 7919) % 1009 AS DOUBLE) / 1009 AS pred1, CAST(1009 - (playid * 7919) % 1009 AS DOUBLE) / 1009 AS pred0,
 CASE WHEN playid % 10 < 6 THEN 'ana' WHEN playid % 10 < 8 THEN 'assess' ELSE 'test' END AS "set"
FROM plays""",
    "calls": f"SELECT *, {CALL} AS pred FROM preds",
    "crop": f"""
SELECT gameid, playid, min(CASE WHEN event IN {SNAPS} THEN frameid END) AS snap,
 min(CASE WHEN event IN {CLIPS} THEN frameid END) AS clip
FROM track GROUP BY 1, 2 HAVING snap IS NOT NULL OR clip IS NOT NULL""",
    "spots": """
SELECT t.gameid, t.playid, x AS spot_x, y AS spot_y
FROM track t JOIN crop c ON t.gameid = c.gameid AND t.playid = c.playid AND t.frameid = c.snap WHERE team = 'football'""",
    "positions": f"""
SELECT gameid, playid, nflid, jerseynumber, newspot_y, newspot_x, line_to_gain, avg(newx) AS newx, avg(newy) AS newy
FROM (SELECT t.gameid, t.playid, nflid, jerseynumber, {turned()}, {turned_spot()}
 FROM track t JOIN crop USING (gameid, playid) JOIN plays p USING (gameid, playid) LEFT JOIN spots USING (gameid, playid)
 WHERE frameid >= snap AND (clip IS NULL OR frameid <= clip) AND team = p.defensiveteam)
GROUP BY ALL""",
    "placed": f"""
SELECT gameid, playid, nflid, pff_passcoverage, round(newy - newspot_y, 6) AS depth, round(newx - newspot_x, 6) AS width,
 round(line_to_gain - newspot_y, 6) AS first_down
FROM positions JOIN (SELECT gameid, playid, pff_passcoverage FROM plays WHERE pff_passcoverage IN {SIX}) USING (gameid, playid)""",
    "depths": """
SELECT *, rank() OVER (PARTITION BY gameid, playid ORDER BY width DESC NULLS LAST) AS width_rk,
 rank() OVER (PARTITION BY gameid, playid ORDER BY depth ASC NULLS LAST) AS depth_rk,
 CASE WHEN width < 0 THEN 'L' WHEN width >= 0 THEN 'R' END AS side FROM placed""",
    "levels": """
SELECT pff_passcoverage, level, wr AS width_rk, count(*) AS count, avg(depth) AS depth, avg(width) AS width
FROM (SELECT *, rank() OVER (PARTITION BY gameid, playid, level ORDER BY width) AS wr
 FROM (SELECT *, CASE WHEN depth < -15 THEN 2 ELSE 1 END AS level FROM depths WHERE depth_rk <= 7)) GROUP BY 1, 2, 3""",
    "zoned": f"""
SELECT d.*, zone, {SYM} AS sym_zone FROM (SELECT *, {bins()} FROM depths) d LEFT JOIN {zone_values()} USING (xzone, yzone)""",
    "zone_prof": """
SELECT pff_passcoverage, zone, sym_zone, wr AS width_rk, count(*) AS count, avg(depth) AS depth, avg(width) AS width
FROM (SELECT *, rank() OVER (PARTITION BY gameid, playid, zone, sym_zone ORDER BY width) AS wr FROM zoned WHERE depth_rk <= 7)
GROUP BY ALL""",
    "zcounts": """
SELECT gameid, playid, pff_passcoverage, zone, sym_zone, count(*) AS count FROM zoned WHERE depth_rk <= 7 GROUP BY ALL""",
    "zfeat": f"""
SELECT gameid, playid, pff_passcoverage, {', '.join(f"CAST(coalesce(sum(count) FILTER (sym_zone = '{z}'), 0) AS BIGINT) AS {z}"
 for z in ('blitz', 'flat', 'hooks', 'middle', 'third'))}, {HIGH} AS hierarchy FROM zcounts GROUP BY ALL""",
    "deep2": """
SELECT gameid, playid, pff_passcoverage, round(max(depth) - min(depth), 6) AS depth_diff, max(abs(width)) AS max_width,
 CAST(sum(CAST(depth <= -15 AND abs(width) < 5 AS INT)) AS BIGINT) AS centerfielders
FROM depths WHERE depth_rk IN (1, 2) GROUP BY 1, 2, 3""",
    "deep3": """
SELECT gameid, playid, pff_passcoverage, round(max(depth) - min(depth), 6) AS depth_diff, max(abs(width)) AS max_width,
 avg(width) FILTER (width <> lw) AS wide_width
FROM (SELECT *, min(width) OVER (PARTITION BY gameid, playid) AS lw FROM depths WHERE depth_rk IN (1, 2, 3)) GROUP BY 1, 2, 3""",
    "align": f"""
SELECT gameid, playid, nflid, position, width, depth,
 CASE WHEN abs(width) < 1 THEN 'middle' WHEN width > 0 THEN 'right' ELSE 'left' END AS alignment,
 depth > 2 AND abs(width) < 5 AS backfield
FROM (SELECT gameid, playid, nflid, position, round(newy - newspot_y, 6) AS depth, round(newx - newspot_x, 6) AS width
 FROM (SELECT t.gameid, t.playid, t.nflid, pl.position, {turned()}, {turned_spot()}
  FROM track t
  JOIN (SELECT gameid, playid, frameid, x AS spot_x, y AS spot_y FROM track
   WHERE team = 'football' AND event IN ('autoevent_ballsnap', 'ball_snap')
   QUALIFY frameid = min(frameid) OVER (PARTITION BY gameid, playid)) s USING (gameid, playid, frameid)
  JOIN plays p USING (gameid, playid) LEFT JOIN players pl ON t.nflid = pl.nflid AND p.season = pl.season
  WHERE t.team <> 'football' AND t.team <> p.defensiveteam))""",
    "skilled": """
SELECT *, 1 + sum(CAST(split > 2.5 AS INT)) OVER g AS horiz_group,
 rank() OVER (PARTITION BY gameid, playid, alignment, backfield ORDER BY abs(width))
  + (count(*) OVER (PARTITION BY gameid, playid, alignment, backfield, abs(width)) - 1) / 2.0e0 AS wrk
FROM (SELECT *, abs(width) - lag(abs(width), 1, 0.0e0) OVER w AS split, abs(width) - lag(abs(width), 2, 0.0e0) OVER w AS split2
 FROM align WINDOW w AS (PARTITION BY gameid, playid, alignment, backfield ORDER BY abs(width), nflid))
WHERE position IN ('TE', 'WR', 'RB', 'FB')
WINDOW g AS (PARTITION BY gameid, playid, alignment, backfield ORDER BY abs(width), nflid ROWS UNBOUNDED PRECEDING)
QUALIFY count(*) OVER (PARTITION BY gameid, playid) = 5""",
    "flags": """
SELECT *, horiz_group = 1 AND NOT backfield AS core, split2 < 6 AND wrk >= 3 AND NOT backfield AS bunch FROM skilled""",
    "flanks": """
SELECT gameid, playid, alignment, mark, string_agg(flank, '' ORDER BY flank) AS flank FROM (
 SELECT gameid, playid, alignment, CASE WHEN b = 1 THEN '(bu)' ELSE '' END AS mark,
  concat(c, CASE WHEN core THEN 'c' ELSE 's' END, mark) AS flank
 FROM (SELECT gameid, playid, alignment, core, sum(CAST(bunch AS INT)) AS b, CAST(sum(CAST(NOT backfield AS INT)) AS BIGINT) AS c
  FROM flags WHERE alignment <> 'middle' GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3, 4""",
    "forms": """
SELECT * FROM (SELECT gameid, playid, CAST(sum(CAST(core AS INT)) AS BIGINT) AS core, CAST(sum(CAST(backfield AS INT)) AS BIGINT) AS backs,
 CAST(sum(CAST(bunch AS INT)) AS BIGINT) AS bunch FROM flags GROUP BY 1, 2)
LEFT JOIN (SELECT gameid, playid, string_agg(flank, 'x' ORDER BY flank DESC) AS formation FROM flanks GROUP BY 1, 2) USING (gameid, playid)""",
    "form_names": """
SELECT * FROM (VALUES ('3sx1s', '3x1 open'), ('2sx1c1s', 'slot'), ('2sx2s', '2x2 open'), ('3sx2s', 'empty open'),
 ('1sx1c2s', 'trey'), ('2sx1s', 'flex'), ('1sx1c1s', 'pro'), ('2sx2c', 'nub twins'), ('1s2cx1s', 'trey'),
 ('2sx1c2s', 'empty h'), ('1c1sx1c1s', 'ace'), ('3sx0s1c', 'nub trips'), ('2sx0s2c', 'flank'), ('3sx1c', 'nub trips'),
 ('1sx1s', 'bone'), ('2sx1c', 'twins'), ('3cx1s', 'trips bunch')) AS v(id, name)""",
    "named": """
SELECT p.*, core, backs, bunch, f.formation AS id, coalesce(name, f.formation) AS formation
FROM calls p LEFT JOIN forms f USING (gameid, playid) LEFT JOIN form_names v ON f.formation = v.id""",
    "by_form": """
SELECT formation, backs, actual, count, correct, pct FROM (
 SELECT *, sum(count) OVER (PARTITION BY formation) AS total FROM (
  SELECT formation, backs, actual, count(*) AS count, CAST(sum(CAST(actual = pred AS INT)) AS BIGINT) AS correct,
   CAST(correct AS DOUBLE) / count AS pct FROM named GROUP BY 1, 2, 3)) WHERE total > 500 AND count > 20""",
    "details": """
SELECT p.* EXCLUDE (season), g.season,
 CASE WHEN possessionteam = hometeamabbr THEN presnaphomescore ELSE presnapvisitorscore END AS possessionteam_score,
 CASE WHEN defensiveteam = hometeamabbr THEN presnaphomescore ELSE presnapvisitorscore END AS defensiveteam_score,
 concat(list_extract(['1st', '2nd', '3rd', '4th'], down), ' & ', yardstogo) AS down_distance,
 concat(possessionteam_score, ' - ', defensiveteam_score) AS scoreboard,
 concat(list_extract(['1st', '2nd', '3rd', '4th'], quarter), ' Quarter, ', substr(gameclock, 1, 5)) AS sitch,
 concat(possessionteam, CASE WHEN possessionteam = hometeamabbr THEN ' v ' ELSE ' @ ' END, defensiveteam, ' ', gamedate) AS location,
 concat_ws(chr(10), location, sitch, scoreboard, down_distance) AS caption
FROM plays p LEFT JOIN games g USING (gameid)""",
    "colors": """
SELECT gameid, playid, possessionteam AS team, color1 AS color FROM plays LEFT JOIN color_grid ON possessionteam = team1 AND defensiveteam = team2
UNION ALL
SELECT gameid, playid, defensiveteam, color2 FROM plays LEFT JOIN color_grid ON possessionteam = team1 AND defensiveteam = team2""",
    "drawn": f"""
SELECT t.gameid, t.playid, t.nflid, t.frameid, ball_snap, CASE WHEN t.team <> 'football' THEN jerseynumber END AS jerseynumber, position,
 {turned(False)},
 CASE playdirection WHEN 'right' THEN -(coalesce(o, 0) + 90) ELSE 90 - coalesce(o, 0) END AS newo,
 CASE playdirection WHEN 'right' THEN -spot ELSE spot END AS newspot, newspot - yardstogo AS line_to_gain,
 CASE WHEN position IN ('WR', 'FB', 'TE', 'RB') THEN 'black' END AS skill,
 CASE WHEN t.team = 'football' THEN '#8d4d37' ELSE c.color END AS color,
 CASE WHEN t.team = 'football' OR c.color <> '#FFFFFF' THEN 'white' WHEN c.color = '#FFFFFF' THEN 'black' END AS number_color,
 CASE WHEN t.team = 'football' THEN 18 ELSE 19 END AS shape, caption
FROM track t
JOIN (SELECT gameid, playid, min(frameid) AS ball_snap FROM track WHERE event = 'ball_snap' GROUP BY 1, 2) USING (gameid, playid)
JOIN (SELECT gameid, playid, frameid AS at, x AS spot FROM track WHERE team = 'football') s
 ON s.gameid = t.gameid AND s.playid = t.playid AND s.at = ball_snap - 1
LEFT JOIN details d ON d.gameid = t.gameid AND d.playid = t.playid
LEFT JOIN colors c ON c.gameid = t.gameid AND c.playid = t.playid AND c.team = t.team
LEFT JOIN players pl ON pl.nflid = t.nflid AND pl.season = d.season""",
    "mpreds": """
SELECT model, CAST(day AS DATE) AS date, CASE WHEN playid % 4 = 0 THEN 'test' ELSE 'assess' END AS "set", playid + 10000 AS clip_id,
 CAST(playid % 3 AS VARCHAR) AS actual,
 CAST((playid * 37 + length(model) + mon) % 101 AS DOUBLE) AS pred0,
 CAST((playid * 53 + length(model) * mon) % 101 AS DOUBLE) AS pred1,
 CAST((playid * 71 + mon) % 101 AS DOUBLE) AS pred2
FROM plays, (VALUES ('all_class'), ('one_high'), ('two_high')) AS m(model), (VALUES ('2025-02-01', 2), ('2025-03-01', 3)) AS d(day, mon)""",
    "mlong": """
SELECT model, date, "set", clip_id, '0' AS class, actual, pred0 AS odds FROM mpreds
UNION ALL SELECT model, date, "set", clip_id, '1', actual, pred1 FROM mpreds
UNION ALL SELECT model, date, "set", clip_id, '2', actual, pred2 FROM mpreds""",
    "mlatest": "SELECT * FROM mlong QUALIFY date = max(date) OVER (PARTITION BY model, clip_id)",
    "mapping": """
SELECT * FROM (VALUES ('all_class', '0', 'Cover-1'), ('all_class', '1', 'Cover-3'), ('all_class', '2', 'Quarters'),
 ('one_high', '0', 'Cover-2; Quarters; Cover-6; 2-Man'), ('one_high', '1', 'Cover-3; Cover-1'),
 ('two_high', '0', 'Cover-3; Cover-1'), ('two_high', '1', 'Cover-2'), ('two_high', '2', 'Cover-6')) AS v(model, class, coverages)""",
    "mraw": """
SELECT b.*, a.coverages AS ac, p.coverages AS pc, a.coverages = p.coverages AS match
FROM (SELECT * FROM mlatest WHERE "set" = 'assess' QUALIFY odds = max(odds) OVER (PARTITION BY model, clip_id)) b
LEFT JOIN mapping a ON a.model = b.model AND a.class = b.actual LEFT JOIN mapping p ON p.model = b.model AND p.class = b.class""",
    "mapped": """
SELECT *, CASE ac WHEN 'Cover-2; Quarters; Cover-6; 2-Man' THEN '2-High' WHEN 'Cover-3; Cover-1' THEN '1-High' ELSE ac END AS actual_coverage,
 CASE pc WHEN 'Cover-2; Quarters; Cover-6; 2-Man' THEN '2-High' WHEN 'Cover-3; Cover-1' THEN '1-High' ELSE pc END AS pred_coverage,
 CASE WHEN model <> 'all_class' THEN 'hierarchical' ELSE model END AS pool FROM mraw""",
}


def split_of(source: str) -> str:
    """Tag rows by the hash of their play."""
    h = "md5(concat_ws('|', gameid, playid, {}))"
    return (
        f"SELECT *, {HIGH} AS high, CASE WHEN {h.format(15)} >= 'cccccccc' THEN 'test' "
        f"WHEN {h.format(16)} < 'c0000000' THEN 'ana' ELSE 'assess' END AS \"set\" FROM {source}"
    )


CTES["split2"] = split_of("deep2")
CTES["zsplit"] = split_of("zfeat")
CTES["split3"] = split_of("(SELECT * EXCLUDE (wide_width), round(wide_width, 4) AS wide_width FROM deep3)")


def decimal_rounding(sql: str) -> str:
    """Round means as decimals: a binary product may fall on the wrong side of a half."""
    return re.sub(r"\bround\(((?:[^()]|\([^()]*\))*), 4\)", r"CAST(round(CAST(\1 AS DECIMAL(28, 10)), 4) AS DOUBLE)", sql)


def squares(features) -> str:
    return " + ".join(f"(q.{f} - t.{f}) * (q.{f} - t.{f})" for f in features)


def knn(train: str, queries: str, features, label: str, k_max: int, fold: bool = False) -> str:
    """Candidates of each distinct query point up to rank k_max: c(features, d, label, n, before)."""
    fs = ", ".join(features) + (", fold" if fold else "")
    qs = ", ".join(f"q.{f}" for f in features) + (", q.fold" if fold else "")
    cond = "q.fold <> t.fold" if fold else "TRUE"
    same = " AND ".join(f"b.{f} = q.{f}" for f in [*features] + (["fold"] if fold else []))
    return f"""tr AS MATERIALIZED ({train}), qu AS MATERIALIZED (SELECT DISTINCT {fs} FROM ({queries})),
bound AS MATERIALIZED (SELECT {qs}, list_last(min({squares(features)}, {k_max})) AS far FROM qu q JOIN tr t ON {cond} GROUP BY ALL),
near AS (SELECT {qs}, {squares(features)} AS d, t.{label} AS label, count(*) AS n
 FROM qu q JOIN bound b ON {same} JOIN tr t ON {cond} AND {squares(features)} <= b.far GROUP BY ALL),
cand AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY {fs} ORDER BY d RANGE UNBOUNDED PRECEDING)
 - sum(n) OVER (PARTITION BY {fs}, d) AS before FROM near)"""


def voted(features, ks: str, fold: bool = False) -> str:
    fs = ", ".join(features) + (", fold" if fold else "")
    return f"""ballot AS (SELECT {fs}, k, label, sum(n) AS v FROM cand, (SELECT unnest({ks}) AS k) WHERE before < k GROUP BY ALL),
won AS (SELECT {fs}, k, label AS pred FROM ballot
 QUALIFY row_number() OVER (PARTITION BY {fs}, k ORDER BY v DESC, CAST(label AS VARCHAR)) = 1)"""


def with_ctes(final: str, extra: str = "") -> str:
    """Prefix a statement with the expressions it uses, in the order they are declared."""
    needed: set[str] = set()
    todo = [final + " " + extra]
    while todo:
        body = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s*\(*\s*{name}\b", body) or (
                name not in needed and re.search(rf",\s*{name}\s+[a-z]\b", body)
            ):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {final}" if parts else final


def _tune(label: str) -> str:
    fs = ("depth_diff", "max_width")
    extra = knn("SELECT * FROM split2 WHERE \"set\" = 'ana'", "SELECT * FROM split2 WHERE \"set\" = 'assess'", fs, label, 200)
    extra += ", " + voted(fs, "range(10, 201, 10)")
    return with_ctes(
        f"""SELECT CAST(k AS INT) AS k, count(*) AS count, CAST(sum(CAST(a.{label} = pred AS INT)) AS BIGINT) AS correct,
 CAST(correct AS DOUBLE) / count AS accuracy
FROM split2 a JOIN won USING (depth_diff, max_width) WHERE "set" = 'assess' GROUP BY 1""",
        extra,
    )


def _cv(source: str, features, scaled, where: str = "TRUE") -> str:
    z = ", ".join(
        f"round(({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER (), 9) AS {f}" if f in scaled else f for f in features
    )
    h = "md5(concat_ws('|', gameid, playid, 15))"
    fold = (
        f"CASE WHEN {h} < '33333333' THEN 1 WHEN {h} < '66666666' THEN 2 WHEN {h} < '99999999' THEN 3 "
        f"WHEN {h} < 'cccccccc' THEN 4 ELSE 5 END AS fold"
    )
    rows = f"SELECT gameid, playid, high, {z}, {fold} FROM {source} WHERE \"set\" <> 'test' AND {where}"
    extra = f"folded AS MATERIALIZED ({rows}), " + knn("SELECT * FROM folded", "SELECT * FROM folded", features, "high", 150, True)
    extra += ", " + voted(features, "range(10, 151, 10)", True)
    on = ", ".join([*features, "fold"])
    return with_ctes(
        f"""SELECT CAST(k AS INT) AS k, count(*) AS count, CAST(sum(CAST(high = pred AS INT)) AS BIGINT) AS correct,
 CAST(correct AS DOUBLE) / count AS accuracy FROM folded JOIN won USING ({on}) GROUP BY 1""",
        extra,
    )


def _grid(features: dict[str, int], label: str = "high") -> str:
    points = "SELECT * FROM " + ", ".join(f"(SELECT CAST(unnest(range({n})) AS DOUBLE) AS {f})" for f, n in features.items())
    extra = knn("SELECT * FROM split2 WHERE \"set\" <> 'test'", points, tuple(features), label, 150)
    extra += ", " + voted(tuple(features), "[150]")
    return with_ctes(f"SELECT {', '.join(features)}, pred FROM won", extra)


def _top(source: str, keys: str, n: int, extra: str = "") -> str:
    return f"""SELECT * EXCLUDE (ord) REPLACE (round(depth, 4) AS depth, round(width, 4) AS width){extra} FROM (
 SELECT *, row_number() OVER (PARTITION BY pff_passcoverage ORDER BY {keys}) AS ord FROM (
  SELECT *, rank() OVER (PARTITION BY pff_passcoverage ORDER BY count DESC) AS rk FROM {source}) WHERE rk <= {n}) WHERE ord <= {n}"""


def _quartiles(by: str, source: str, where: str = "TRUE", col: str = "frames", digits: int = 9) -> str:
    quartile = f"round(quantile_cont({col}, {{}}), {digits})".format
    return f"""SELECT {by}, count(*) AS count, min({col}) AS low, {quartile(0.25)} AS q1, {quartile(0.5)} AS median,
 {quartile(0.75)} AS q3, max({col}) AS high FROM {source} WHERE {where} AND {col} IS NOT NULL GROUP BY {by}"""


def _hist(by: str, col: str, low: float, high: float, n: int, source: str) -> str:
    w = (high - low) / n
    return f"""SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {by}) AS pct FROM (
 SELECT {by}, CAST(least(floor(({col} - {low}e0) / {w}e0), {n - 1}) AS INT) AS bin, count(*) AS n
 FROM {source} WHERE {col} BETWEEN {low} AND {high} GROUP BY ALL)"""


def _solved(size: int) -> str:
    """Solution of a symmetric system by elimination, one nested select per column; ``a<i>_<j>`` and ``b<i>`` hold it."""
    sql = "{}"
    for k in range(size):
        below = range(k + 1, size)
        cells = [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in below for j in below]
        cells += [f"b{i} - a{i}_{k} * b{k} / a{k}_{k} AS b{i}" for i in below]
        if cells:
            sql = f"SELECT * REPLACE ({', '.join(cells)}) FROM ({sql})"
    for k in reversed(range(size)):
        rest = "".join(f" - a{k}_{j} * x{j}" for j in range(k + 1, size))
        sql = f"SELECT *, (b{k}{rest}) / a{k}_{k} AS x{k} FROM ({sql})"
    return sql


def _logistic(fit_on: str, score: str, features=("blitz", "middle", "hooks", "flat"), steps: int = 8) -> str:
    """The fit as a recursive statement: a row of weights per step over the counted cases."""
    x = ["1e0", *features]
    size = len(x)
    odds = "1 / (1 + exp(-(" + " + ".join(f"w{i} * {v}" for i, v in enumerate(x)) + ")))"
    sums = [f"sum((positive - n * p) * {v}) AS b{i}" for i, v in enumerate(x)]
    sums += [f"sum(n * p * (1 - p) * {x[i]} * {x[j]}) + {'1e-9' if i == j else '0'} AS a{i}_{j}" for i in range(size) for j in range(size)]
    kept = ", ".join(f"any_value(w{i}) AS w{i}" for i in range(size))
    system = f"SELECT step, {kept}, {', '.join(sums)} FROM (SELECT *, {odds} AS p FROM fits, cases WHERE step < {steps}) GROUP BY step"
    moved = ", ".join(f"w{i} + x{i} AS w{i}" for i in range(size))
    extra = f"""cases AS MATERIALIZED (SELECT {', '.join(features)}, count(*) AS n, sum(hierarchy) AS positive FROM zsplit WHERE {fit_on} GROUP BY ALL),
 fits AS (SELECT 0 AS step, {', '.join(f'0e0 AS w{i}' for i in range(size))}
 UNION ALL SELECT step + 1 AS step, {moved} FROM ({_solved(size).format(system)}))"""
    final = f"""SELECT "set", count(*) AS count, CAST(sum(CAST(hierarchy = pred AS INT)) AS BIGINT) AS correct,
 CAST(correct AS DOUBLE) / count AS accuracy FROM (SELECT "set", hierarchy, CAST({odds} > 0.5 AS INT) AS pred
 FROM ({score}), (SELECT * FROM fits WHERE step = {steps})) GROUP BY 1"""
    return with_ctes(final, extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _score(by: str, source: str, where: str = "TRUE", rate: str = "pct") -> str:
    return f"""SELECT {by}, count(*) AS count, CAST(sum(CAST(actual = pred AS INT)) AS BIGINT) AS correct,
 CAST(correct AS DOUBLE) / count AS {rate} FROM {source} WHERE {where} GROUP BY {by}"""


def _events(extra: str) -> str:
    return f"""WITH log AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
cropped AS (SELECT user_id, day, min(CASE WHEN event_type = 'signup' THEN event_id END) AS snap,
 min(CASE WHEN event_type = 'purchase' THEN event_id END) AS clip FROM log WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2) {extra}"""


def statements() -> dict[str, str]:
    frames = "(SELECT n.*, clip - snap AS frames, actual = pred AS match FROM named n LEFT JOIN crop USING (gameid, playid))"
    some = "formation IN ('nub twins', 'flank', 'empty open')"
    z15 = ("real deep", "deep", "deep hooks", "shallow hooks", "blitz")
    b15 = (-100, -20, -15, -10, 0, 15)

    def grid_counts(values, binned):
        return f"""SELECT z.xzone, z.yzone, zone, coalesce(count, 0) AS count, {SYM} AS sym_zone FROM {values}
LEFT JOIN (SELECT xzone, yzone, count(*) AS count FROM (SELECT {binned} FROM depths) GROUP BY 1, 2) USING (xzone, yzone)"""

    def pick(name, where, order, n):
        return (
            f"SELECT '{name}' AS pick, gameid, playid, pred1 FROM (SELECT *, row_number() OVER (ORDER BY pred1 {order}, gameid, playid) AS ord "
            f"FROM preds WHERE {where}) WHERE ord = {n}"
        )

    fs = ("depth_diff", "max_width")
    one = knn("SELECT * FROM split2 WHERE \"set\" = 'ana'", "SELECT * FROM split2 WHERE \"set\" = 'assess'", fs, "pff_passcoverage", 10)
    test = knn("SELECT * FROM split2 WHERE \"set\" <> 'test'", "SELECT * FROM split2 WHERE \"set\" = 'test'", fs, "high", 150)
    seven = ("Cover-1", "Cover-3", "Quarters", "1-High", "2-High", "Cover-2", "Cover-6")
    raw_team = "CASE WHEN playid % 17 = 0 THEN NULL WHEN playid % 19 = 0 THEN 'T99' ELSE possessionteam END"
    clean = "gameid, playid, playdescription, quarter, down, yardstogo, {} AS possessionteam, {} AS defensiveteam, {} AS pff_passcoverage, presnaphomescore, presnapvisitorscore, gameclock, {} AS season"

    season = "CASE (gameid - 2018000000) % 3 WHEN 0 THEN 2018 WHEN 1 THEN 2021 ELSE 2022 END"
    plain = {
        "tracking_union": """SELECT gameid, playid, team, playdirection, count(*) AS n, count(event) AS events,
 CAST(sum(nflid) AS BIGINT) AS nflid, CAST(sum(frameid) AS BIGINT) AS frameid, CAST(sum(jerseynumber) AS BIGINT) AS jerseynumber,
 sum(x) AS x, sum(y) AS y, sum(x / 8) AS s, sum(y / 8) AS a, sum((x + y) / 16) AS dis, sum(o) AS o, sum(o / 2) AS dir
FROM track GROUP BY 1, 2, 3, 4""",
        "release_load": f"""SELECT season, CASE WHEN odd THEN 'value' ELSE 'frames' END AS kind, count(*) AS n, CASE WHEN NOT odd THEN sum(x) END AS x,
 CASE WHEN NOT odd THEN count(event) END AS events
FROM (SELECT x, event, CAST({season} AS INT) AS season, (playid * 7 + frameid) % 97 = 0 AS odd FROM track) GROUP BY season, odd
UNION ALL SELECT 2022, 'unknown header', 1, NULL, NULL""",
        "table_round_trip": f"""SELECT gameid, playid, pff_passcoverage, count(*) AS n, min(frameid) AS first, max(frameid) AS last, sum(t.x) AS x, sum(t.y) AS y
FROM track t JOIN crop USING (gameid, playid) JOIN (SELECT gameid, playid, pff_passcoverage FROM plays) USING (gameid, playid)
WHERE frameid >= snap AND (clip IS NULL OR frameid <= clip) AND {season} = 2021 GROUP BY 1, 2, 3""",
        "preds_files": "SELECT * FROM mlong WHERE model <> 'one_high' OR class = '1'",
        "formations_file": "SELECT * REPLACE (CAST(gameid AS INT) AS gameid, CAST(playid AS INT) AS playid) FROM forms",
        "games_union": "SELECT *, CASE WHEN season = 2022 THEN gameid % 41 END AS visitorfinalscore FROM games",
        "players_union": """SELECT nflid, '6-2' AS height, 200 + nflid % 50 AS weight, '1995-01-01' AS birthdate, 'State' AS collegename, position,
 concat('Player ', nflid) AS displayname, season FROM players""",
        "plays_clean": f"""SELECT {clean.format("team", "other", "CASE pff_passcoverage WHEN '2-Man' THEN '2-Man' ELSE pff_passcoverage END", "2018")}
FROM (SELECT *, {raw_team} AS team, CASE WHEN team IS NULL THEN NULL ELSE side END AS other
 FROM plays JOIN (SELECT gameid, hometeamabbr AS side FROM games UNION ALL SELECT gameid, visitorteamabbr FROM games) USING (gameid)
 WHERE season = 2018) WHERE team IS NULL OR other <> team
UNION ALL SELECT {clean.format("possessionteam", "defensiveteam", "pff_passcoverage", "2021")} FROM plays WHERE season = 2021
UNION ALL SELECT {clean.format("possessionteam", "defensiveteam", '''CASE WHEN pff_passcoverage LIKE 'Cover%' THEN pff_passcoverage
 ELSE replace(pff_passcoverage, '-', ' ') || CASE WHEN playid % 2 = 0 THEN ' Left' ELSE '' END END''', "2022")}
 FROM plays WHERE season = 2022 AND playid % 5 <> 0""",
        "play_details": """SELECT gameid, playid, season, possessionteam_score, defensiveteam_score, down_distance, scoreboard, sitch, location, caption FROM details""",
        "team_colors": "SELECT * FROM colors",
        "play_crop": "SELECT * FROM crop",
        "ball_spots": "SELECT * FROM spots",
        "clip_frames": """SELECT gameid, playid, snap, clip, count(*) AS n, min(frameid) AS first, max(frameid) AS last, sum(x) AS x, sum(y) AS y
FROM track JOIN crop USING (gameid, playid) WHERE frameid >= snap AND (clip IS NULL OR frameid <= clip) GROUP BY 1, 2, 3, 4""",
        "orient_coords": f"""SELECT gameid, playid, team, round(min(newx), 6) AS min_newx, round(max(newx), 6) AS max_newx,
 min(newy) AS min_newy, max(newy) AS max_newy, min(newo) AS min_newo, max(newo) AS max_newo
FROM (SELECT gameid, playid, team, {turned()}, CASE playdirection WHEN 'right' THEN -(o + 90) ELSE 90 - o END AS newo FROM track) GROUP BY 1, 2, 3""",
        "mean_positions": "SELECT * REPLACE (round(newx, 6) AS newx, round(newy, 6) AS newy, round(newspot_x, 6) AS newspot_x) FROM positions",
        "depth_by_play": "SELECT gameid, playid, nflid, pff_passcoverage, depth, width, first_down, width_rk, depth_rk, side FROM depths",
        "play_frames": "SELECT * EXCLUDE (ball_snap) REPLACE (round(newx, 6) AS newx) FROM drawn",
        "route_paths": "SELECT gameid, playid, nflid, frameid, round(newx, 6) AS newx, newy FROM drawn WHERE skill = 'black' AND frameid >= ball_snap",
        "goal_lines_in_view": f"""SELECT * FROM (SELECT gameid, playid, min(newy) AS low, max(newy) AS high FROM (SELECT gameid, playid, {turned(False)} FROM track)
 GROUP BY 1, 2), (VALUES (10e0), (30e0), (50e0), (-30e0), (-50e0)) AS v(goal_line) WHERE goal_line BETWEEN low AND high""",
        "yard_labels": f"""SELECT CAST(floor(CASE WHEN abs(newy) > 60 THEN 110 - abs(newy) ELSE abs(newy) - 10 END) AS BIGINT) AS yard, count(*) AS n
FROM (SELECT {turned(False)} FROM track) GROUP BY 1""",
        "depth_by_level": "SELECT * REPLACE (round(depth, 4) AS depth, round(width, 4) AS width) FROM levels",
        "level_leaders": _top("levels", "level, width_rk", 11),
        "zone_dim": grid_counts(zone_values(), bins()),
        "zone_dim_15": grid_counts(zone_values(z15), bins(b15, z15)),
        "zone_heatmap": f"""SELECT x, y, w, h, v.xzone, v.yzone, zone, {SYM} AS sym_zone, coalesce(count, 0) AS count
FROM (SELECT x, y, w, h, {bins(x='x', y='y')} FROM (VALUES (-15e0, 10e0), (0e0, 20e0), (15e0, 10e0)) AS a(x, w),
 (VALUES (-15e0, 10e0), (-5e0, 10e0), (2.5e0, 5e0)) AS b(y, h)) v
JOIN {zone_values()} ON z.xzone = v.xzone AND z.yzone = v.yzone
LEFT JOIN (SELECT xzone, yzone, count(*) AS count FROM (SELECT {bins()} FROM depths) GROUP BY 1, 2) c ON c.xzone = v.xzone AND c.yzone = v.yzone""",
        "depth_by_zone": _top("zone_prof", "zone, sym_zone, width_rk", 7, ", CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY pff_passcoverage) AS pct"),
        "zone_profile": "SELECT * REPLACE (round(depth, 4) AS depth, round(width, 4) AS width) FROM zone_prof",
        "zone_counts_by_play": "SELECT * FROM zcounts",
        "zone_usage": "SELECT pff_passcoverage, sym_zone, count(DISTINCT playid) AS plays, round(avg(count), 4) AS count FROM zcounts GROUP BY 1, 2",
        "zone_features": "SELECT * FROM zfeat",
        "composition_grid": """SELECT blitz, middle, hooks, flat, third, coalesce(plays, 0) AS plays FROM (
 SELECT CAST(blitz AS INT) AS blitz, CAST(middle AS INT) AS middle, CAST(hooks AS INT) AS hooks, CAST(flat AS INT) AS flat, CAST(third AS INT) AS third
 FROM (SELECT unnest(range(1, 8)) AS blitz), (SELECT unnest(range(1, 8)) AS middle), (SELECT unnest(range(1, 8)) AS hooks),
  (SELECT unnest(range(1, 8)) AS flat), (SELECT unnest(range(1, 8)) AS third) WHERE blitz + middle + hooks + flat + third = 7)
LEFT JOIN (SELECT blitz, middle, hooks, flat, third, count(*) AS plays FROM zfeat GROUP BY ALL) USING (blitz, middle, hooks, flat, third)""",
        "deepest_players": "SELECT * EXCLUDE (centerfielders) FROM deep2",
        "deepest_players_3d": "SELECT * FROM deep2",
        "deepest_three": "SELECT * REPLACE (round(wide_width, 4) AS wide_width) FROM deep3",
        "spread_by_coverage": """SELECT pff_passcoverage, count(*) AS count, round(avg(depth_diff), 4) AS depth_diff, round(avg(max_width), 4) AS max_width
FROM deep2 GROUP BY 1""",
        "spread_density": _hist("pff_passcoverage", "depth_diff", 0.0, 30.0, 30, "deep2"),
        "side_profile": "SELECT pff_passcoverage, side, depth_rk, round(avg(width), 4) AS width, round(avg(depth), 4) AS depth FROM depths GROUP BY 1, 2, 3",
        "shallow_profile": """SELECT pff_passcoverage, width_rk, round(avg(width), 4) AS width, round(avg(depth), 4) AS depth
FROM depths WHERE depth_rk >= 5 GROUP BY 1, 2""",
        "rank_profile": """SELECT pff_passcoverage, width_rk, depth_rk, count(*) AS count, round(avg(width), 4) AS width, round(avg(depth), 4) AS depth,
 round(avg(first_down), 4) AS first_down, concat(depth_rk, '-', width_rk) AS pos FROM depths WHERE depth_rk <= 7 GROUP BY 1, 2, 3""",
        "random_play_depths": """SELECT gameid, playid, nflid, depth, width, depth_rk FROM depths
QUALIFY dense_rank() OVER (ORDER BY md5(concat_ws('|', gameid, playid, 15))) = 1""",
        "alignment_by_play": "SELECT * FROM align",
        "alignment_sides": """SELECT gameid, playid, count(*) FILTER (alignment = 'left') AS left, count(*) FILTER (alignment = 'middle') AS middle,
 count(*) FILTER (alignment = 'right') AS right, round(sum(abs(width)) FILTER (alignment = 'left'), 3) AS left_reach,
 round(sum(abs(width)) FILTER (alignment = 'right'), 3) AS right_reach, count(*) FILTER (backfield) AS backs, round(sum(depth), 3) AS depth
FROM align GROUP BY 1, 2""",
        "formation_by_play": "SELECT * FROM forms",
        "formation_frequency": """SELECT *, CAST(n AS DOUBLE) / sum(n) OVER () AS pct,
 CAST(sum(n) OVER (ORDER BY n DESC, backs, core, bunch, formation ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER () AS cumu_pct
FROM (SELECT backs, core, bunch, formation, count(*) AS n FROM forms GROUP BY ALL)""",
        "named_formation": """SELECT gameid, playid, core, backs, bunch, formation AS id, coalesce(name, formation) AS formation
FROM forms LEFT JOIN form_names v ON formation = v.id""",
        "accuracy": _score('"set", actual', "calls"),
        "class_recall": _score("actual", "calls"),
        "confusion_pct": """SELECT pff_passcoverage, CAST(count(*) FILTER (pred = '1-High') AS DOUBLE) / count(*) AS "1-High",
 CAST(count(*) FILTER (pred = '2-High') AS DOUBLE) / count(*) AS "2-High" FROM calls GROUP BY 1""",
        "accuracy_by_formation": "SELECT * FROM by_form",
        "accuracy_spread": """SELECT *, CASE WHEN pct = min(pct) OVER w THEN min(pct) OVER w - max(pct) OVER w ELSE -(min(pct) OVER w - max(pct) OVER w) END AS diff
FROM by_form WINDOW w AS (PARTITION BY actual, backs)""",
        "accuracy_by_defense": f"""SELECT actual, formation, defensiveteam, count(*) AS count, CAST(sum(CAST(actual = pred AS INT)) AS BIGINT) AS correct,
 CAST(correct AS DOUBLE) / count AS pct FROM named JOIN (SELECT gameid, playid, defensiveteam FROM plays) USING (gameid, playid) WHERE {some} GROUP BY 1, 2, 3""",
        "false_positive_mix": """SELECT *, CAST(n AS DOUBLE) / sum(n) OVER () AS pct FROM (
 SELECT backs, id AS formation, CASE pff_passcoverage WHEN 'Cover-6' THEN 'Quarters' ELSE pff_passcoverage END AS pff_passcoverage, count(*) AS n
 FROM named WHERE actual = '2-High' AND pred1 > 0.5 GROUP BY 1, 2, 3)""",
        "having_total": "SELECT gameid, playid, defensiveteam, presnaphomescore FROM plays QUALIFY sum(presnaphomescore) OVER (PARTITION BY gameid) > 200",
        "clip_length": _quartiles("formation, actual, match", frames, some),
        "depth_numbers": _quartiles("pff_passcoverage, side", "depths", col="depth", digits=6),
        "width_numbers": _quartiles("pff_passcoverage", "depths", col="width", digits=6),
        "odds_by_coverage": _hist(
            "formation, actual, pff_passcoverage", "pred1", 0.0, 1.0, 20,
            "(SELECT * FROM named WHERE formation IN ('empty open', '3x1 open', '2x2 open', 'trey'))",
        ),
        "odds_density": _hist("actual, pff_passcoverage", "pred1", 0.0, 1.0, 16, "preds"),
        "play_search": f"""SELECT gameid, playid, clip_id, formation, defensiveteam, season, pred0, frames FROM {frames}
 JOIN (SELECT gameid, playid, defensiveteam, season FROM plays) USING (gameid, playid)
WHERE pff_passcoverage IN ('Quarters', 'Cover-6') AND season = 2022 AND pred0 BETWEEN 0.4 AND 1 AND {some} AND frames >= 1""",
        "sample_play": """SELECT gameid, playid, pred0 FROM preds WHERE pred0 BETWEEN 0.45 AND 0.55
ORDER BY md5(concat_ws('|', gameid, playid, 15)) LIMIT 1""",
        "extreme_plays": " UNION ALL ".join(
            [
                pick("two_high", "actual = '2-High'", "ASC", 1),
                pick("quarters", "pff_passcoverage = 'Quarters'", "ASC", 1),
                pick("one_high", "actual = '1-High'", "DESC", 1),
                pick("missed_one_high", "actual = '1-High'", "ASC", 2),
                pick("false_one_high", "actual = '2-High' AND pred1 > 0.5", "DESC", 4),
            ]
        ),
        "preds_long": "SELECT * FROM mlong",
        "preds_latest": "SELECT * FROM mlatest",
        "preds_mapped": "SELECT model, date, clip_id, class, actual, odds, actual_coverage, pred_coverage, match FROM mapped",
        "preds_mapped_actual_only": "SELECT model, actual_coverage, pc AS pred_coverage, count(*) AS count FROM mapped GROUP BY 1, 2, 3",
        "model_confusion": "SELECT model, actual_coverage, "
        + ", ".join(f"CAST(count(*) FILTER (pred_coverage = '{v}') AS DOUBLE) / count(*) AS \"{v}\"" for v in seven)
        + " FROM mapped GROUP BY 1, 2",
        "pooled_confusion": """SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY model, actual_coverage) AS pct FROM (
 SELECT pool AS model, actual_coverage, pred_coverage, n FROM (SELECT model, pool, actual_coverage, pred_coverage, count(*) AS n FROM mapped GROUP BY ALL))""",
        "model_comparison": """SELECT pool AS model, count(*) AS count, CAST(sum(CAST(actual_coverage = pred_coverage AS INT)) AS BIGINT) AS correct,
 CAST(correct AS DOUBLE) / count AS pct FROM mapped GROUP BY 1""",
        "binary_outcome_class": _hist(
            "class", "pred1", 0.0, 1.0, 8,
            "(SELECT pred1, CASE WHEN pred <> actual THEN 'Wrong' WHEN pred = '1-High' THEN '1 High' ELSE '2 High' END AS class FROM calls)",
        ),
        "split_accuracy_report": """SELECT "set", actual, format('{:,}', count(*)) AS count,
 printf('%.1f%%', round(CAST(sum(CAST(actual = pred AS INT)) AS DOUBLE) / count(*), 3) * 100) AS accuracy
FROM (SELECT * REPLACE (CASE WHEN "set" IN ('ana', 'assess') THEN 'train' ELSE "set" END AS "set") FROM calls) GROUP BY 1, 2""",
        "importance_report": """SELECT pff_passcoverage AS category, printf('%.2e', round(avg(pred1), 6)) AS "importance mean",
 CASE WHEN pff_passcoverage = '2-Man' THEN '' ELSE printf('%.2e', round(stddev_samp(pred1), 6)) END AS "importance sd" FROM preds GROUP BY 1""",
        "scenario_grid": """SELECT CAST(spot_y AS INT) AS spot_y, CAST(distance AS INT) AS distance, CAST(down AS INT) AS down, coalesce(plays, 0) AS plays
FROM (SELECT * FROM (SELECT unnest(range(30, 81)) AS spot_y), (SELECT unnest(range(1, 16)) AS distance), (SELECT unnest(range(1, 5)) AS down))
LEFT JOIN (SELECT 30 + playid % 51 AS spot_y, yardstogo AS distance, down, count(*) AS plays FROM plays GROUP BY 1, 2, 3) USING (spot_y, distance, down)""",
        "scenario_curve": """SELECT list_extract(['1st', '2nd', '3rd', '4th'], down) AS down, yardstogo, spot_y, pred1 FROM (
 SELECT down, yardstogo, 30 + playid % 51 AS spot_y, round(avg(pred1), 4) AS pred1 FROM plays JOIN (SELECT gameid, playid, pred1 FROM preds) USING (gameid, playid)
 GROUP BY 1, 2, 3) WHERE down <> 1 OR yardstogo IN (5, 10, 15)""",
        "train_split": "SELECT \"set\", high AS hierarchy, count(*) AS n FROM split2 GROUP BY 1, 2",
        "training_plays": "SELECT gameid, playid, pred1 FROM preds SEMI JOIN (SELECT gameid, playid FROM split2 WHERE \"set\" <> 'test') USING (gameid, playid)",
        "folds": """SELECT fold, count(*) AS n FROM (SELECT CASE WHEN h < '33333333' THEN 1 WHEN h < '66666666' THEN 2 WHEN h < '99999999' THEN 3
 WHEN h < 'cccccccc' THEN 4 ELSE 5 END AS fold FROM (SELECT md5(concat_ws('|', gameid, playid, 15)) AS h FROM plays)) GROUP BY 1""",
        "zscores": """SELECT gameid, playid, round((yardstogo - avg(yardstogo) OVER ()) / stddev_samp(yardstogo) OVER (), 6) AS yardstogo,
 round((presnaphomescore - avg(presnaphomescore) OVER ()) / stddev_samp(presnaphomescore) OVER (), 6) AS presnaphomescore FROM plays""",
    }
    out = {name: with_ctes(sql) for name, sql in plain.items()}
    out["event_crop"] = _events("SELECT * FROM cropped")
    out["event_clip"] = _events(
        """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM log JOIN cropped USING (user_id, day)
WHERE event_id >= snap AND (clip IS NULL OR event_id <= clip) GROUP BY 1"""
    )
    out["knn_classify"] = with_ctes(
        "SELECT gameid, playid, depth_diff, max_width, pred FROM split2 JOIN won USING (depth_diff, max_width) WHERE \"set\" = 'assess'",
        one + ", " + voted(fs, "[10]"),
    )
    out["knn_test"] = with_ctes(
        """SELECT high AS hierarchy, count(*) AS count, CAST(sum(CAST(high = pred AS INT)) AS BIGINT) AS correct,
 CAST(correct AS DOUBLE) / count AS pct FROM split2 JOIN won USING (depth_diff, max_width) WHERE "set" = 'test' GROUP BY 1""",
        test + ", " + voted(fs, "[150]"),
    )
    out["logistic_fit_score"] = _logistic("\"set\" = 'ana'", "SELECT * FROM zsplit WHERE \"set\" IN ('ana', 'assess')")
    renamed = "CASE WHEN \"set\" = 'test' THEN 'test' ELSE 'train' END"
    out["logistic_full"] = _logistic("\"set\" IN ('ana', 'assess')", f"SELECT * REPLACE ({renamed} AS \"set\") FROM zsplit")
    out["knn_tune"] = _tune("pff_passcoverage")
    out["knn_tune_high"] = _tune("high")
    out["knn_cv"] = _cv("split2", fs, fs)
    out["knn_cv_3d"] = _cv("split2", (*fs, "centerfielders"), fs)
    out["knn_cv_three"] = _cv("split3", (*fs, "wide_width"), (*fs, "wide_width"), "wide_width IS NOT NULL")
    out["decision_grid"] = _grid({"depth_diff": 21, "max_width": 21})
    out["decision_grid_classes"] = _grid({"depth_diff": 21, "max_width": 21}, "pff_passcoverage")
    out["decision_grid_3d"] = _grid({"depth_diff": 21, "max_width": 21, "centerfielders": 3})
    return {name: decimal_rounding(sql) for name, sql in out.items()}
