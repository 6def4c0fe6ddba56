"""Nested JSON documents turned into rows: odds boards and schedules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import constants as K
from antecede.functions.expr import lookup
from antecede.functions.text import last_first, normalize_text, team_code

ODDS_SCHEMA = """
struct<id: string, commence_time: string, home_team: string, away_team: string,
  bookmakers: array<struct<key: string, title: string, last_update: string,
    markets: array<struct<key: string, last_update: string,
      outcomes: array<struct<name: string, description: string, point: double, price: double>>>>>>>
"""
SCHEDULE_SCHEMA = """
struct<dates: array<struct<date: string, games: array<struct<gamePk: bigint,
  teams: struct<
    away: struct<team: struct<id: bigint>, probablePitcher: struct<id: bigint, fullName: string>>,
    home: struct<team: struct<id: bigint>, probablePitcher: struct<id: bigint, fullName: string>>>>>>>>
"""


def flatten_odds(
    documents: DataFrame, column: str = "payload", markets: Mapping[str, str] = K.MARKET_TARGETS
) -> DataFrame:
    """One row per over/under outcome of a known market that has player, point and price.

    ``outcome_seq`` keeps the order inside the document; team codes are found once per document,
    before it is exploded. No shuffle.
    """
    # Each step keeps only the scalars still needed: an exploded row must not drag the whole
    # document along.
    # Inlined, the parsed document is a generator's output: a condition on it, such as the one every explode
    # implies, then stays above and neither parses the document again nor makes it again.
    event = documents.select(F.inline(F.array(F.from_json(column, ODDS_SCHEMA)))).select(
        F.col("id").alias("event_id"), "commence_time", "home_team", "away_team", "bookmakers"
    ).withColumns({"home_code": team_code("home_team"), "away_code": team_code("away_team")})
    scalars = ["event_id", "commence_time", "home_team", "away_team", "home_code", "away_code"]
    books = event.select(*scalars, F.posexplode("bookmakers").alias("book_at", "b")).select(
        *scalars,
        "book_at",
        F.coalesce("b.title", "b.key", F.lit("UNKNOWN")).alias("sportsbook"),
        F.col("b.last_update").alias("bookmaker_last_update"),
        F.col("b.markets").alias("markets"),
    )
    scalars += ["book_at", "sportsbook", "bookmaker_last_update"]
    known = F.posexplode("markets").alias("market_at", "m")
    quoted = books.select(*scalars, known).where(F.col("m.key").isin(*markets)).select(
        *scalars,
        "market_at",
        F.col("m.last_update").alias("market_last_update"),
        lookup(dict(markets), "m.key").alias("target"),
        F.col("m.outcomes").alias("outcomes"),
    )
    scalars += ["market_at", "market_last_update", "target"]
    rows = quoted.select(*scalars, F.posexplode("outcomes").alias("at", "o")).where(
        (F.col("o.description") != "") & F.col("o.point").isNotNull() & F.col("o.price").isNotNull()
    )
    return rows.withColumn("side", normalize_text("o.name")).where(
        F.col("side").isin("over", "under")
    ).select(
        "event_id", "commence_time", "home_team", "away_team", "home_code", "away_code",
        "sportsbook", "bookmaker_last_update",
        "market_last_update", "target", "side",
        F.col("o.description").alias("player_name"),
        F.col("o.point").alias("line"),
        F.rint("o.price").cast("bigint").alias("price"),
        F.struct("book_at", "market_at", "at").alias("outcome_seq"),
    )


def schedule_sides(documents: DataFrame, column: str = "payload") -> DataFrame:
    """One row per game side; the probable starter is NULL where none is named."""
    games = documents.select(F.from_json(column, SCHEDULE_SCHEMA).alias("s")).select(
        F.inline("s.dates")
    ).select("date", F.inline("games"))
    away, home = F.col("teams.away"), F.col("teams.home")

    def side(name, own, other):
        return F.struct(
            F.lit(name).alias("home_away"),
            own["team"]["id"].alias("team"),
            other["team"]["id"].alias("opponent"),
            own["probablePitcher"]["id"].alias("pitcher_mlbam_id"),
            own["probablePitcher"]["fullName"].alias("full_name"),
        )

    return games.select(
        F.col("date").try_cast("date").alias("game_date"),
        F.col("gamePk").alias("game_id"),
        F.inline(F.array(side("away", away, home), side("home", home, away))),
    )


def scheduled_appearances(sides: DataFrame, hands: DataFrame | None = None) -> DataFrame:
    """Appearance rows of named starters with every target still NULL."""
    unknown = {c: F.lit(None).cast("bigint") for c in (*K.TARGETS, "hits", "walks", "runs")}
    named = sides.where(F.col("pitcher_mlbam_id").isNotNull())
    rows = named.select(
        "game_date", "game_id", "pitcher_mlbam_id",
        last_first(F.coalesce("full_name", F.col("pitcher_mlbam_id").cast("string"))).alias("pitcher_name"),
        "team", "opponent", "home_away",
        *[c.alias(n) for n, c in unknown.items()],
        F.lit(0).cast("bigint").alias("source_rows"),
        F.lit("pregame_unplayed").alias("outs_method"),
    )
    if hands is None:
        return rows
    return rows.join(hands.select("pitcher_mlbam_id", "pitcher_handedness"), "pitcher_mlbam_id", "left")


def missing_starters(sides: DataFrame) -> DataFrame:
    return sides.where(F.col("pitcher_mlbam_id").isNull()).select(
        "game_id", "team", "opponent", "home_away"
    )
