"""Parsing of scraped text: columns where a pattern does, a table function for HTML tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uncomment_tables(html: Column) -> Column:
    """Comments that hold a table give way to their content; other comments stay."""
    return F.regexp_replace(html, r"(?s)<!--((?:(?!-->).)*?<table(?:(?!-->).)*)-->", "$1")


def number(text: Column) -> Column:
    """A double, without thousands separators; null for blanks, NaN and anything else."""
    value = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(text: Column) -> Column:
    """A long, cut towards 0; null for what ``number`` does not read."""
    return number(text).cast("long")


def game_date(raw: Column) -> Column:
    """ISO date or datetime, or ``Jan 05, 2024``; null if neither."""
    iso = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.nullif(iso, F.lit("")).try_cast("date"), F.to_date(F.try_to_timestamp(raw, F.lit("MMM dd, yyyy"))))


def season_start(day: Column, month: int) -> Column:
    """The starting year of the season that ``day`` is in, seasons beginning in ``month``."""
    return F.year(day) - F.when(F.month(day) >= month, 0).otherwise(1)


def season_label(season: Column) -> Column:
    return F.concat(season.cast("string"), F.lit("-"), F.lpad(F.pmod(season + 1, F.lit(100)).cast("string"), 2, "0"))


def season_from_text(text: Column) -> Column:
    """The first year of a ``20YY-YY`` span, else a bare 20YY."""
    span = F.regexp_extract(text, r"\b(20\d\d)\s*[-/]\s*\d\d\b", 1)
    bare = F.regexp_extract(text, r"\b(20\d\d)\b", 1)
    return F.coalesce(F.nullif(span, F.lit("")), F.nullif(bare, F.lit(""))).cast("int")


def player_from_question(text: Column) -> Column:
    """Who a question ``Will X win`` is about; null for articles and other questions."""
    who = F.trim(F.regexp_extract(text, r"(?i)\bwill\s+(.+?)\s+win\b", 1))
    return F.when((who != "") & ~who.rlike(r"(?i)^(the|a|an)\b"), who)


def true_shooting(points: Column, attempts: Column, throws: Column) -> Column:
    weight = 2 * (attempts + 0.44 * throws)
    return F.when(weight > 0, points / weight)


def opponent(matchup: Column) -> Column:
    """The trailing token of ``X vs. Y`` or ``X @ Y``; null for other texts."""
    return F.nullif(F.regexp_extract(matchup, r"(?:vs\.|@)\s*(\S+)\s*$", 1), F.lit(""))


def history_points(landed: DataFrame, key: str, raw: str) -> DataFrame:
    """One row for each landed {t, p} point that has both: key, at (UTC), price, best_bid, best_ask."""
    points = F.from_json(raw, "struct<history:array<struct<t:bigint,p:double>>>")
    rows = landed.select(key, F.explode(points["history"]).alias("h")).filter("h.t is not null and h.p is not null")
    depth = [F.lit(None).cast("double").alias(n) for n in ("best_bid", "best_ask")]
    return rows.select(key, F.timestamp_seconds("h.t").cast("timestamp_ntz").alias("at"), F.col("h.p").alias("price"), *depth)


#: Positions as pages name them.
POSITIONS = {"Point Guard": "PG", "Shooting Guard": "SG", "Small Forward": "SF", "Power Forward": "PF", "Center": "C"}


def player_page(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, name, position (the first one listed), born, first_season, last_season of player pages."""
    text = F.col(html)
    listed = F.regexp_extract(text, f"Position:\\s*({'|'.join(POSITIONS)})", 1)
    codes = F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair])
    starts = F.transform(F.regexp_extract_all(text, F.lit(r'data-stat="season"[^>]*>(\d{4})-\d\d'), F.lit(1)), lambda x: x.cast("int"))
    name = F.nullif(F.trim(F.regexp_extract(text, r"<h1[^>]*>\s*(?:<span[^>]*>)?([^<]*)", 1)), F.lit(""))
    born = F.regexp_extract(text, r'data-birth="(\d{4}-\d\d-\d\d)"', 1).try_cast("date")
    return pages.select(key, name.alias("name"), codes[F.nullif(listed, F.lit(""))].alias("position"), born.alias("born"), F.array_min(starts).alias("first_season"), F.array_max(starts).alias("last_season"))


class _Table(HTMLParser):
    """Rows of the table with an id: data-stat -> (text, first link)."""

    def __init__(self, table_id: str):
        super().__init__()
        self.table_id, self.depth, self.rows = table_id, 0, []
        self.row: dict | None = None
        self.cell: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table" and (self.depth or a.get("id") == self.table_id):
            self.depth += 1
        if not self.depth:
            return
        if tag == "tr":
            self.row = {}
        elif tag in ("td", "th") and self.row is not None and a.get("data-stat"):
            self.cell = a["data-stat"]
            self.row[self.cell] = ["", ""]
        elif tag == "a" and self.cell and not self.row[self.cell][1]:
            self.row[self.cell][1] = a.get("href") or ""

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th"):
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell and self.row is not None:
            self.row[self.cell][0] += data


#: Alternative column names on the pages: fixed values.
VOTE_COLUMNS = {"first": ("votes_first", "first_place"), "points": ("points_won", "points"), "share": ("award_share", "share"), "rank": ("rank", "ranker")}


def _float(text: str) -> float | None:
    try:
        value = float(text.replace(",", "").strip())
    except ValueError:
        return None
    return value if value == value else None


class VoteTable:
    """Table function (html, table id) -> a row for each player with a link."""

    def eval(self, html: str, table_id: str) -> Iterator[tuple]:
        parser = _Table(table_id)
        parser.feed((html or "").replace("<!--", "").replace("-->", ""))

        def cell(row: dict, names: tuple[str, ...]) -> str:
            return next((row[n][0] for n in names if n in row), "")

        for row in parser.rows:
            text, link = row.get("player", ["", ""])
            slug = link.rsplit("/", 1)[-1].removesuffix(".html")
            if not slug:
                continue
            found = {k: _float(cell(row, names).rstrip("T")) for k, names in VOTE_COLUMNS.items()}
            rank = int(found["rank"]) if found["rank"] is not None else None
            yield slug, text.strip(), None if found["first"] is None else int(found["first"]), found["points"], found["share"], rank, int(rank == 1)


VOTE_SCHEMA = "bref_id string, name string, first_place_votes int, total_points double, vote_share double, rank int, won_flag int"


def vote_table():
    """The table function, for lateral joins: ``pages.lateralJoin(vote_table()(html, id))``."""
    return F.udtf(VoteTable, returnType=VOTE_SCHEMA)
