"""Text classifiers as ordered pattern rules: one expression each, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pricing import first_match

# The award rules, first match wins, over title and slug in lower case.
FINALS_MVP = r"finals\s+mvp|finals\s+most\s+valuable"
AWARD_RULES = [
    (r"rookie\s+of\s+the\s+year|\broty\b|\brotys?\b", "ROTY"),
    (r"defensive\s+player\s+of\s+the\s+year|\bdpoy\b", "DPOY"),
    (r"most\s+valuable\s+player|\bmvp\b", "MVP"),
    (r"nba\s+champion|win\s+the\s+(?:nba\s+)?finals|to\s+win\s+the\s+(?:nba\s+)?title|\bnba\s+championship\b|\bchampions?\b", "CHAMPIONSHIP"),
]

# Statistical families in order, and the contexts of a question.
FAMILY_RULES = [
    (r"scoring (title|champion|leader)|most points|lead(s|er)?.{0,15}\bin scoring\b|lead(s|er)?.{0,12}\bpoints\b|top scorer|ppg leader", "scoring_leader"),
    (r"rebound|\brpg\b|top rebounder", "rebounds_leader"),
    (r"assist|\bapg\b", "assists_leader"),
    (r"\bblock(s|ed|ing)?\b|\bbpg\b", "blocks_leader"),
    (r"\bsteal(s|ing)?\b|\bspg\b", "steals_leader"),
    (r"lead the (nba|league) in|league leader", "generic_stat_leader"),
    (r"sixth[ -]?man|6th man|\b6moy\b", "sixth_man"),
    (r"most improved|\bmip\b", "most_improved"),
]
CONTEXT_RULES = [
    (r"\btonight\b|\bgame[ -]?\d\b|\btoday\b", "single_game"),
    (r"win the .*(finals|conference|championship|title)", "season"),
    (r"\bseries\b|\bin the .*finals|conference finals|playoff|\bvs\b|top scorer in|top rebounder|most .* in the .*finals", "finals_series"),
]

# Severity of an injury report, in order.
REPORT_PREFIX = r"injury\s*/\s*illness"
SEVERE_PART = r"\bacl\b|\ba\.c\.l|achilles|patell\w*\s+tendon|quad\w*\s+tendon"
SEVERE_TOKEN = r"\btear\b|\btorn\b|ruptur|\brepair\b|surgery|reconstruction"
BENIGN_TOKEN = r"soreness|tightness|tendinitis|tendonitis|tendinopathy|bursitis|inflammation|impingement|sprain|strain|spasm|contusion|bruise|irritation|management|maintenance|\bache\b|discomfort|\bsore\b|tendinosis"
SEASON_ENDING = r"ruptur|blood\s+clot|pulmonary|season[- ]ending|out\s+for\s+(the\s+)?season|(tibia|fibula|femur)\b.*?(fractur|stress|surgery)|navicular\b.*?fractur|jones\s+fracture|lisfranc"
REASON_RULES = [
    (r"sur?gery|\brepair\b|procedure|stress\s+fracture|stress\s+reaction|meniscus|labrum|plantar\s+fasc|microfracture|\bfusion\b|\bbroken\b|meniscectomy|arthroscop|thrombosis|pneumothorax|reconstruction|plantar[^a-z]*fasc", "major"),
    (r"sprain|strain|fracture|\btear\b|\btorn\b|bursitis|tendinitis|tendonitis|tendinopathy|impingement|dislocat|subluxation|\bpartial\b|\bhigh\s+ankle\b|effusion|hyperexten|chondromalacia|herniat|\bhernia\b|disc\b|bulge|tendinosis|periostitis|synovitis", "moderate"),
    (r"soreness|tightness|spasm|contusion|bruise|laceration|irritation|inflammation|stinger|cramp|\bache\b|discomfort|\bsore\b|\bpain\b|swelling|swollen|stiffness|\bstiff\b", "minor"),
    (r"illness|\bflu\b|covid|virus|gastro|\bsick\b|non[- ]covid|conditioning|respiratory|migraine|dental|concussion|\bnasal\b", "illness"),
    (r"injury\s+recovery|\brehab|injury\s+management|return\s+to\s+competition|reconditioning|injury\s+maintenance", "recovery"),
    (r"\brest\b|load\s+management|maintenance|\bcoach|personal|not\s+with\s+team|g[- ]?league|two[- ]way|suspension|\btrade\b|\bwaiv", "rest"),
]

#: Reports that are no injury, and the categories a report can have.
NON_INJURY = r"protocol|ineligible|not available|^\s*$"
CATEGORIES = ["season_ending", "major", "moderate", "minor", "illness", "recovery", "rest", "unknown"]


def non_injury(text: Column) -> Column:
    """Whether a report names something that is no injury, or nothing."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(NON_INJURY)


def one_spaced(*parts: Column) -> Column:
    """Non-null parts as one lower-case string, dashes and underscores as blanks."""
    joined = F.concat_ws(" ", *[F.when(p != "", p) for p in parts])
    return F.lower(F.trim(F.regexp_replace(F.translate(joined, "-_", "  "), r"\s+", " ")))


def award(title: Column, slug: Column) -> Column:
    text = one_spaced(title, slug)
    return F.when(text.rlike(FINALS_MVP), "OTHER").otherwise(first_match(text, AWARD_RULES, "OTHER"))


def family(text: Column) -> Column:
    return F.nullif(first_match(text, FAMILY_RULES, ""), F.lit(""))


def context(text: Column) -> Column:
    return first_match(text, CONTEXT_RULES, "season")


def reason(text: Column) -> Column:
    """A report's category; a severe body part alone is season-ending unless a mild word is there."""
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    s = F.regexp_replace(plain, REPORT_PREFIX, " ")
    ending = s.rlike(SEASON_ENDING) | (s.rlike(SEVERE_PART) & (s.rlike(SEVERE_TOKEN) | ~s.rlike(BENIGN_TOKEN)))
    return F.when(plain == "", "unknown").otherwise(first_match(s, [(ending, "season_ending"), *REASON_RULES], "unknown"))
