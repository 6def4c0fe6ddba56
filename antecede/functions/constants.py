"""Fixed values. They must equal the published conventions for results to agree."""

# Outcome codes of one row of the event table.
STRIKEOUT_EVENTS = ("strikeout", "strikeout_double_play")
WALK_EVENTS = ("walk", "intent_walk")
HIT_EVENTS = ("single", "double", "triple", "home_run")
TRUNCATED_EVENT = "truncated_pa"
NOT_A_PITCH = "automatic_ball"

# Description codes.
WHIFF_CODES = ("swinging_strike", "swinging_strike_blocked")
CONTACT_CODES = ("foul", "foul_bunt", "foul_tip", "hit_into_play", "missed_bunt")
SWING_CODES = CONTACT_CODES + WHIFF_CODES
CALLED_STRIKE = "called_strike"
STRIKE_CODES = SWING_CODES + (CALLED_STRIKE,)
ZONE_RANGE = (1, 9)

# Outs credited to an event; any other event is worth 0.
EVENT_OUTS = {
    "field_out": 1,
    "force_out": 1,
    "strikeout": 1,
    "strikeout_double_play": 2,
    "grounded_into_double_play": 2,
    "double_play": 2,
    "triple_play": 3,
    "fielders_choice_out": 1,
    "other_out": 1,
    "sac_fly": 1,
    "sac_fly_double_play": 2,
    "caught_stealing_2b": 1,
    "caught_stealing_3b": 1,
    "caught_stealing_home": 1,
    "pickoff_1b": 1,
    "pickoff_2b": 1,
    "pickoff_3b": 1,
    "pickoff_caught_stealing_2b": 1,
    "pickoff_caught_stealing_3b": 1,
    "pickoff_caught_stealing_home": 1,
}
OUTS_METHOD = "statcast_events_with_completed_inning_reconciliation"

# Pitch categories in the feature table.
PITCH_TYPES = (
    "CH", "CU", "EP", "FC", "FF", "FO", "FS", "KC", "KN", "PO", "SC", "SI", "SL", "ST", "SV",
)
HANDS = ("R", "L")
CATEGORY_MIN_SAMPLE = 20

# Validation rules.
REQUIRED_COLUMNS = (
    "game_date", "game_pk", "pitcher", "batter", "at_bat_number", "inning", "inning_topbot",
    "pitch_number", "events", "description", "stand", "p_throws", "pitch_type",
)
CRITICAL_COLUMNS = (
    "game_date", "game_pk", "pitcher", "batter", "inning", "inning_topbot", "at_bat_number",
    "pitch_number",
)
IDENTIFIER_COLUMNS = ("game_pk", "pitcher", "batter")
DUPLICATE_KEY = ("game_pk", "at_bat_number", "pitch_number", "pitcher", "batter")
SIDES = ("top", "bottom")
HAND_CODES = ("L", "R", "S")
INNING_RANGE = (1, 30)
PITCH_NUMBER_RANGE = (1, 200)
PITCH_TYPE_LENGTH = 2

# Targets, their naive feature and their workload thresholds.
TARGETS = ("strikeouts", "outs_recorded", "pitches_thrown", "batters_faced")
NAIVE_FEATURE = {
    "strikeouts": "season_k_per_start",
    "outs_recorded": "season_outs_per_start",
    "batters_faced": "season_bf_per_start",
    "pitches_thrown": "season_pitches_per_start",
}
WORKLOAD_THRESHOLDS = (90, 100)

# Feature families, each one containing the ones before it.
FAMILIES = ("pitcher_history", "workload", "opponent", "recent", "full")
WORKLOAD_COLUMNS = (
    "season_pitches_per_start", "season_bf_per_start", "season_outs_per_start",
    "pitches_median_before_game", "pitcher_days_rest", "pitcher_starts_before_game",
    "pitches_previous_start", "starts_reaching_90_before_game",
    "starts_reaching_100_before_game", "workload_trend_last3_vs_prior3",
)

# Probability settings.
PROBABILITY_FLOOR = 1e-6
LINE_GRID = {
    "strikeouts": tuple(2.5 + k for k in range(9)),
    "outs_recorded": tuple(11.5 + k for k in range(11)),
}
# Bounds of a simulated value.
VALUE_BOUNDS = {"strikeouts": (0, 20), "outs_recorded": (0, 27)}
QUANTILE_BINS = 5
MIN_BIN_SIZE = 250
CHECKED_LINES = {
    "strikeouts": (3.5, 4.5, 5.5, 6.5, 7.5),
    "outs_recorded": (14.5, 15.5, 16.5, 17.5, 18.5),
}
# Left-closed ranges of the high-probability calibration table.
HIGH_PROBABILITY_BUCKETS = (
    ("55-60%", 0.55, 0.60),
    ("60-65%", 0.60, 0.65),
    ("65-70%", 0.65, 0.70),
    ("70%+", 0.70, 1.0000001),
)

# Quote handling.
MARKET_TARGETS = {"pitcher_strikeouts": "strikeouts", "pitcher_outs": "outs_recorded"}
TARGET_ALIASES = {
    "k": "strikeouts",
    "ks": "strikeouts",
    "strikeout": "strikeouts",
    "strikeouts": "strikeouts",
    "out": "outs_recorded",
    "outs": "outs_recorded",
    "outs_recorded": "outs_recorded",
}
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
BLANK_WORDS = ("none", "nan", "<na>", "null")

# Decision rules.
EXTRA_STRESS = (
    ("outs_recorded", 15.5, 1.0),
    ("outs_recorded", 16.5, 1.0),
    ("outs_recorded", 18.5, 1.0),
)
STALE_TIER = {
    "STRONG_CANDIDATE": "CANDIDATE_STALE_DATA",
    "CANDIDATE": "WATCH_STALE_DATA",
    "WATCH": "WATCH_STALE_DATA",
    "WATCH_FRAGILE": "WATCH_FRAGILE_STALE_DATA",
}
TIER_ORDER = (
    "STRONG_CANDIDATE", "CANDIDATE", "CANDIDATE_STALE_DATA", "WATCH", "WATCH_STALE_DATA",
    "WATCH_FRAGILE", "WATCH_FRAGILE_STALE_DATA", "PASS_ROLE_RISK", "PASS",
)

# Team abbreviations and the full names that map to them. OAK is the older code of ATH.
TEAM_CODES = {
    "AZ": ("arizona diamondbacks",),
    "ATL": ("atlanta braves",),
    "BAL": ("baltimore orioles",),
    "BOS": ("boston red sox",),
    "CHC": ("chicago cubs",),
    "CWS": ("chicago white sox",),
    "CIN": ("cincinnati reds",),
    "CLE": ("cleveland guardians",),
    "COL": ("colorado rockies",),
    "DET": ("detroit tigers",),
    "HOU": ("houston astros",),
    "KC": ("kansas city royals",),
    "LAA": ("los angeles angels",),
    "LAD": ("los angeles dodgers",),
    "MIA": ("miami marlins",),
    "MIL": ("milwaukee brewers",),
    "MIN": ("minnesota twins",),
    "NYM": ("new york mets",),
    "NYY": ("new york yankees",),
    "ATH": ("oakland athletics", "athletics"),
    "PHI": ("philadelphia phillies",),
    "PIT": ("pittsburgh pirates",),
    "SD": ("san diego padres",),
    "SF": ("san francisco giants",),
    "SEA": ("seattle mariners",),
    "STL": ("st louis cardinals",),
    "TB": ("tampa bay rays",),
    "TEX": ("texas rangers",),
    "TOR": ("toronto blue jays",),
    "WSH": ("washington nationals",),
}
OLD_TEAM_CODES = {"OAK": "ATH"}
