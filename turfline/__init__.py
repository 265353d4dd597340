"""Player-tracking analytics on Spark DataFrames."""

from turfline.operators.formations import alignment_by_play, formation_by_play, formation_frequency, named_formation
from turfline.operators.plays import clean_plays, play_details, team_colors
from turfline.operators.tracking import (
    ball_spots,
    clip_frames,
    depth_by_play,
    goal_lines_in_view,
    mean_positions,
    orient_coords,
    play_crop,
    play_frames,
    route_paths,
)
from turfline.operators.zones import ZoneSpec, depth_by_level, depth_by_zone, zone_dim, zone_heatmap, zone_tiles
from turfline.functions.columns import yard_label
from turfline.sources.readers import load_games, load_players, load_plays, load_tracking

__all__ = [
    "ZoneSpec",
    "alignment_by_play",
    "ball_spots",
    "clean_plays",
    "clip_frames",
    "depth_by_level",
    "depth_by_play",
    "depth_by_zone",
    "formation_by_play",
    "formation_frequency",
    "goal_lines_in_view",
    "load_games",
    "load_players",
    "load_plays",
    "load_tracking",
    "mean_positions",
    "named_formation",
    "orient_coords",
    "play_crop",
    "play_details",
    "play_frames",
    "route_paths",
    "team_colors",
    "yard_label",
    "zone_dim",
    "zone_heatmap",
    "zone_tiles",
]
