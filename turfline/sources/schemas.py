"""Column layouts of the input files. Every file is read with one of these; nothing is inferred."""

# Three releases of the tracking files, columns by position.
TRACKING_2018 = (
    "time timestamp, x double, y double, s double, a double, dis double, o double, dir double, event string, "
    "nflid bigint, displayname string, jerseynumber smallint, position string, frameid smallint, team string, "
    "gameid int, playid int, playdirection string, route string"
)
TRACKING_2021 = (
    "gameid int, playid int, nflid bigint, frameid smallint, time timestamp_ntz, jerseynumber smallint, team string, "
    "playdirection string, x double, y double, s double, a double, dis double, o double, dir double, event string"
)
TRACKING_2022 = (
    "gameid int, playid int, nflid bigint, displayname string, frameid smallint, frametype string, "
    "time timestamp_ntz, jerseynumber smallint, club string, playdirection string, x double, y double, s double, "
    "a double, dis double, o double, dir double, event string"
)
TRACKING = {2018: TRACKING_2018, 2021: TRACKING_2021, 2022: TRACKING_2022}

PLAYERS = (
    "nflid bigint, height string, weight int, birthdate string, collegename string, position string, displayname string"
)
COVERAGES = "gameid int, playid int, coverage string"
COLOR_GRID = "team1 string, team2 string, color1 string, color2 string"
PREDICTIONS = (
    "gameid int, playid int, clip_id bigint, pff_passcoverage string, actual int, pred0 double, pred1 double, set string"
)
FORMATIONS = "gameid int, playid int, core bigint, backs bigint, bunch bigint, formation string"
IMPORTANCES = "category string, importance_mean double, importance_sd double"
SCENARIO_PREDICTIONS = "down int, yardstogo int, spot_y double, pred1 double"
CLASS_MAPPING = "class string, coverages string"
