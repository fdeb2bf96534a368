"""Queries that parse, flatten and classify text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parse
from ..session import table
from .registry import query

#: Fixed test descriptions, by the number in an event's properties.
REPORTS = [
    "Injury/Illness - Both Acl; Torn",
    "Injury/Illness - Left Achilles; Soreness",
    "Injury/Illness - Right Knee; Meniscus Surgery",
    "Injury/Illness - Left Ankle; Sprain",
    "Injury/Illness - Back; Spasm",
    "Injury/Illness - N/A; Illness",
    "Rest",
    "Injury/Illness - Right Achilles; N/A",
    "Return to Competition Reconditioning",
    "Injury/Illness - Left Femur; Stress Fracture",
    "G League - Two-Way",
    "Not known",
]
TITLES = [
    ("Will Ann Lee win the MVP?", "nba-mvp-2024-25"),
    ("Who wins Finals MVP", "nba-finals-mvp"),
    ("Rookie of the Year 2023-24", "roty"),
    ("Defensive Player of the Year", "dpoy-2024"),
    ("NBA champion 2025", "nba-champion"),
    ("Will the Hawks win the NBA Finals", "hawks"),
    ("Most points tonight", "points-game-3"),
    ("Top rebounder in the playoffs", "rebounds-vs"),
    ("Will Bo Ray win the scoring title?", "scoring-leader-2024-25"),
    ("Sixth man of the year", "6moy"),
    ("Who will lead the league in assists", "assists-2024"),
    ("Most improved", "mip_2024"),
]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(text: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE {default} END"


_K = "CAST(json_extract_string(props, '$.k') AS INT) % 12"
_ONE = "lower(trim(regexp_replace(translate({0}, '-_', '  '), '\\s+', ' ', 'g')))"


def _numbered(spark, sf, values):
    k = F.get_json_object("props", "$.k").cast("int") % 12
    return table(spark, sf, "events").select("event_id", "event_type", F.element_at(F.array(*values), (k + 1).cast("int")).alias("text"))


@query(
    "reason_classifier",
    f"""WITH t AS (SELECT event_id, ({_list(REPORTS)})[{_K} + 1] AS text FROM events WHERE event_type = 'error'),
 s AS (SELECT *, regexp_replace(lower(trim(text)), '{classify.REPORT_PREFIX}', ' ', 'g') AS s FROM t)
SELECT event_id, {_case("s", classify.REASON_RULES, "'unknown'").replace("CASE ", f"CASE WHEN regexp_matches(s, '{classify.SEASON_ENDING}') OR (regexp_matches(s, '{classify.SEVERE_PART}') AND (regexp_matches(s, '{classify.SEVERE_TOKEN}') OR NOT regexp_matches(s, '{classify.BENIGN_TOKEN}'))) THEN 'season_ending' ", 1)} AS category FROM s""",
)
def reason_classifier(spark, sf):
    rows = _numbered(spark, sf, [F.lit(x) for x in REPORTS]).filter("event_type = 'error'")
    return rows.select("event_id", classify.reason(F.col("text")).alias("category"))


_TITLES = f"t AS (SELECT event_id, ({_list([a for a, _ in TITLES])})[{_K} + 1] AS title, ({_list([b for _, b in TITLES])})[{_K} + 1] AS slug FROM events), n AS (SELECT *, {_ONE.format("title || ' ' || slug")} AS x FROM t)"


def _titles(spark, sf):
    rows = _numbered(spark, sf, [F.struct(F.lit(a).alias("title"), F.lit(b).alias("slug")) for a, b in TITLES])
    return rows.select("event_id", "text.title", "text.slug")


@query(
    "award_classifier",
    f"WITH {_TITLES} SELECT event_id, " + _case("x", classify.AWARD_RULES, "'OTHER'").replace("CASE ", f"CASE WHEN regexp_matches(x, '{classify.FINALS_MVP}') THEN 'OTHER' ", 1) + r""" AS award,
 CAST(coalesce(nullif(regexp_extract(title || ' ' || slug, '\b(20\d\d)\s*[-/]\s*\d\d\b', 1), ''), nullif(regexp_extract(title || ' ' || slug, '\b(20\d\d)\b', 1), '')) AS INT) AS season,
 CASE WHEN trim(regexp_extract(title, '(?i)\bwill\s+(.+?)\s+win\b', 1)) <> '' AND NOT regexp_matches(trim(regexp_extract(title, '(?i)\bwill\s+(.+?)\s+win\b', 1)), '(?i)^(the|a|an)\b')
   THEN trim(regexp_extract(title, '(?i)\bwill\s+(.+?)\s+win\b', 1)) END AS player FROM n""",
)
def award_classifier(spark, sf):
    title, slug = F.col("title"), F.col("slug")
    season = parse.season_from_text(F.concat(title, F.lit(" "), slug))
    return _titles(spark, sf).select("event_id", classify.award(title, slug).alias("award"), season.alias("season"), parse.player_from_question(title).alias("player"))


@query("family_context", f"WITH {_TITLES} SELECT event_id, {_case('x', classify.FAMILY_RULES, 'NULL')} AS family, {_case('x', classify.CONTEXT_RULES, chr(39) + 'season' + chr(39))} AS context FROM n")
def family_context(spark, sf):
    text = classify.one_spaced(F.col("title"), F.col("slug"))
    return _titles(spark, sf).select("event_id", classify.family(text).alias("family"), classify.context(text).alias("context"))


_MARKET = "struct<id:bigint,question:string,slug:string,outcomes:string,tokens:string,closed:boolean,active:boolean,tags:array<string>>"


@query(
    "flatten_markets",
    """WITH m AS (SELECT r_name AS title, n_nationkey AS market_id, CASE WHEN n_nationkey % 5 = 0 THEN 'resolved' WHEN n_nationkey % 5 = 1 THEN 'closed' WHEN n_nationkey % 5 = 2 THEN 'open' END AS status,
  ['Yes', 'No'] AS o, CASE WHEN n_nationkey % 7 = 6 THEN ['t' || n_nationkey] ELSE ['t' || n_nationkey || 'a', 't' || n_nationkey || 'b'] END AS t
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 5)
SELECT title, market_id, status, unnest(o) AS outcome, unnest(t) AS token, unnest([0, 1]) AS idx FROM m WHERE len(t) = 2""",
)
def flatten_markets(spark, sf):
    """Events with nested markets as JSON text, malformed ones among them, to one row a token."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("long")
    short, pair = F.concat(F.lit('["t'), key, F.lit('"]')), F.concat(F.lit('["t'), key, F.lit('a","t'), key, F.lit('b"]'))
    tokens = F.when(key % 7 == 6, short).when(key % 7 == 5, F.lit("[broken")).otherwise(pair)
    market = F.struct(key.alias("id"), F.col("n_name").alias("question"), F.lit("nba").alias("slug"), F.lit('["Yes","No"]').alias("outcomes"), tokens.alias("tokens"), (key % 5 == 1).alias("closed"), (key % 5 == 2).alias("active"), F.array(F.lit("sports")).alias("tags"))
    landed = nation.groupBy("r_name").agg(F.to_json(F.struct(F.first("r_name").alias("title"), F.collect_list(market).alias("markets"))).alias("raw"))

    event = F.from_json("raw", f"struct<title:string,markets:array<{_MARKET}>>")
    rows = landed.select(event.alias("e")).select("e.title", F.explode("e.markets").alias("m")).filter(F.array_contains("m.tags", "sports"))
    status = F.when(F.col("m.id") % 5 == 0, "resolved").when(F.col("m.closed"), "closed").when(F.col("m.active"), "open")
    texts = "array<string>"
    rows = rows.select("title", F.col("m.id").cast("int").alias("market_id"), status.alias("status"), F.from_json("m.outcomes", texts).alias("o"), F.from_json("m.tokens", texts).alias("t"))
    legs = rows.filter((F.size("o") == F.size("t")) & (F.size("o") > 0)).select("title", "market_id", "status", F.posexplode(F.arrays_zip("o", "t")).alias("idx", "leg"))
    return legs.select("title", "market_id", "status", F.col("leg.o").alias("outcome"), F.col("leg.t").alias("token"), "idx")


@query(
    "uncomment_tables",
    """WITH p AS (SELECT page_id, html, '<table id="mvp"><tr><td>' || page_id || '</td></tr></table>' AS t, page_id % 3 = 0 AS hidden FROM pages)
SELECT page_id, length(html) AS n_before, (length(html) - length(replace(html, '<!--', ''))) // 4 AS comments, md5(CASE WHEN hidden THEN t || html ELSE html END) AS opened FROM p""",
)
def uncomment_tables(spark, sf):
    """Every third page gets a table in a comment, which has to come out; the page's own comments have to stay."""
    html = F.col("html")
    hidden = F.concat(F.lit('<!--<table id="mvp"><tr><td>'), F.col("page_id").cast("string"), F.lit("</td></tr></table>-->"))
    made = F.when(F.col("page_id") % 3 == 0, F.concat(hidden, html)).otherwise(html)
    comments = ((F.length(html) - F.length(F.replace(html, F.lit("<!--"), F.lit("")))) / 4).cast("long")
    return table(spark, sf, "pages").select("page_id", F.length(html).cast("long").alias("n_before"), comments.alias("comments"), F.md5(parse.uncomment_tables(made)).alias("opened"))


@query(
    "page_fields",
    r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host,
  CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS paragraphs, CAST(len(regexp_extract_all(html, 'href=')) AS INT) AS links FROM pages""",
)
def page_fields(spark, sf):
    def part(c, p):
        return F.nullif(F.regexp_extract(c, p, 1), F.lit(""))

    counts = [F.regexp_count("html", F.lit(p)).alias(n) for p, n in (("<p[ >]", "paragraphs"), ("href=", "links"))]
    return table(spark, sf, "pages").select("page_id", part("html", "<title>([^<]*)</title>").alias("title"), part("url", "^[a-z]+://([^/]+)").alias("host"), *counts)


@query(
    "coerce_and_derive",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END AS price, CAST(l_shipdate AS DATE) AS day,
  CASE WHEN l_quantity + 0.44e0 * l_linenumber > 0 THEN round(l_extendedprice / (2 * (l_quantity + 0.44e0 * l_linenumber)), 9) END AS ts_pct,
  CAST(year(l_shipdate) - CASE WHEN month(l_shipdate) >= 10 THEN 0 ELSE 1 END AS INT) AS season,
  (year(l_shipdate) - CASE WHEN month(l_shipdate) >= 10 THEN 0 ELSE 1 END) || '-' || lpad(CAST((year(l_shipdate) - CASE WHEN month(l_shipdate) >= 10 THEN 0 ELSE 1 END + 1) % 100 AS VARCHAR), 2, '0') AS label FROM lineitem""",
    dates=("day",),
)
def coerce_and_derive(spark, sf):
    """Numbers and dates from text as a feed has them: separators, NaN, blanks, two date forms."""
    day = F.to_date("l_shipdate")
    line = F.col("l_linenumber")
    money = F.when(line % 5 != 0, F.concat(F.lit(" "), F.format_number("l_extendedprice", 2))).otherwise(F.when(line % 2 == 0, "NaN").otherwise("n/a"))
    text = F.when(line % 2 == 0, F.date_format(day, "MMM dd, yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
    rows = table(spark, sf, "lineitem").select("*", parse.number(money).alias("price"), parse.game_date(text).alias("day"))
    season = parse.season_start(F.col("day"), 10)
    ts = parse.true_shooting(F.col("l_extendedprice"), F.col("l_quantity"), line)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "price", "day", F.round(ts, 9).alias("ts_pct"), season.alias("season"), parse.season_label(season).alias("label"))


_TALK = "t AS (SELECT conv_id, turn, lower(trim(regexp_replace(translate(coalesce(text, ''), '-_', '  '), '\\s+', ' ', 'g'))) AS x FROM conversations)"


@query(
    "family_matches",
    f"WITH {_TALK}, m AS (SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{v}' END" for p, v in classify.FAMILY_RULES) + "], lambda f: f IS NOT NULL) AS f FROM t) SELECT conv_id, turn, len(f) AS matches, f[1] AS first, array_to_string(f, ',') AS families FROM m",
)
def family_matches(spark, sf):
    """All families that a turn of conversation names, and the first of them."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", classify.one_spaced(F.coalesce("text", F.lit(""))).alias("x"))
    found = F.filter(F.array(*[F.when(F.col("x").rlike(p), F.lit(v)) for p, v in classify.FAMILY_RULES]), lambda f: f.isNotNull())
    rows = rows.select("conv_id", "turn", found.alias("f"))
    return rows.select("conv_id", "turn", F.size("f").cast("long").alias("matches"), F.get("f", F.lit(0)).alias("first"), F.array_join("f", ",").alias("families"))


@query(
    "text_reasons",
    f"""WITH p AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS d FROM documents), s AS (SELECT *, regexp_replace(d, '{classify.REPORT_PREFIX}', ' ', 'g') AS s FROM p)
SELECT doc_id, CASE WHEN d = '' THEN 'unknown' WHEN regexp_matches(s, '{classify.SEASON_ENDING}') OR (regexp_matches(s, '{classify.SEVERE_PART}') AND (regexp_matches(s, '{classify.SEVERE_TOKEN}') OR NOT regexp_matches(s, '{classify.BENIGN_TOKEN}'))) THEN 'season_ending'
  ELSE {_case("s", classify.REASON_RULES, "'unknown'")} END AS category, regexp_matches(d, '{classify.NON_INJURY}') AS other FROM s""",
)
def text_reasons(spark, sf):
    """The report rules over every whole document, most of which are no report."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", classify.reason(text).alias("category"), classify.non_injury(text).alias("other"))


#: Words that make a market relevant, wherever they stand in its fields.
KEYWORDS = ["steel", "brass", "#11"]


@query(
    "relevant_markets",
    "WITH p AS (SELECT p_partkey AS market_id, lower(concat_ws(' ', p_name, p_type, p_brand)) AS x, p_size FROM part) SELECT market_id, CASE WHEN p_size % 5 = 0 THEN 'resolved' WHEN p_size % 3 = 0 THEN 'closed' WHEN p_size % 2 = 0 THEN 'open' END AS status, CAST(("
    + " + ".join(f"contains(x, '{k}')::INT" for k in KEYWORDS)
    + ") AS INT) AS hits FROM p WHERE "
    + " OR ".join(f"contains(x, '{k}')" for k in KEYWORDS),
)
def relevant_markets(spark, sf):
    """Markets with any keyword in their fields, and what state they are in: resolved before closed before open."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    size = F.col("p_size")
    status = F.when(size % 5 == 0, "resolved").when(size % 3 == 0, "closed").when(size % 2 == 0, "open")
    hits = sum((text.contains(k).cast("int") for k in KEYWORDS), F.lit(0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("market_id"), status.alias("status"), hits.alias("hits")).filter("hits > 0")


@query(
    "whole_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(trunc(l_extendedprice) AS BIGINT) END AS units FROM lineitem""",
)
def whole_numbers(spark, sf):
    """Whole numbers from text: what stands after the point is cut, what is no number is null."""
    line = F.col("l_linenumber")
    text = F.when(line % 4 == 0, F.element_at(F.array(F.lit(""), F.lit("nan"), F.lit("-"), F.lit("n/a")), (F.pmod(F.col("l_orderkey"), F.lit(4)) + 1).cast("int"))).otherwise(F.format_number("l_extendedprice", 2))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parse.whole(text).alias("units"))
