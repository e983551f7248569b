"""Track, status, venue and year from what a source says: venue ids, venue strings, proceedings tokens.

Every rule is a lookup or a condition on columns, so a classification of any
number of records is one projection. What no rule covers is ``unknown`` or
``other``, never ``main``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Track paths of venue ids by organisation ("" for any), with the years in which they hold.
TRACK_PATHS = (
    ("", "Conference", "main", 2013, 2099),
    ("NeurIPS", "Track/Datasets_and_Benchmarks/Round1", "datasets_benchmarks", 2021, 2021),
    ("NeurIPS", "Track/Datasets_and_Benchmarks/Round2", "datasets_benchmarks", 2021, 2021),
    ("NeurIPS", "Track/Datasets_and_Benchmarks", "datasets_benchmarks", 2022, 2024),
    ("NeurIPS", "Track/Datasets_and_Benchmarks_Track", "datasets_benchmarks", 2022, 2024),
    ("NeurIPS", "Datasets_and_Benchmarks_Track", "datasets_benchmarks", 2024, 2025),
    ("NeurIPS", "Evaluations_and_Datasets_Track", "datasets_benchmarks", 2026, 2099),
    ("NeurIPS", "Track/Competition", "competition", 2022, 2099),
    ("NeurIPS", "Competition_Track", "competition", 2024, 2099),
    ("NeurIPS", "Position_Paper_Track", "position", 2025, 2099),
    ("ICML", "Position_Paper_Track", "position", 2025, 2099),
    ("ICLR", "TinyPapers", "tiny_papers", 2023, 2024),
    ("ICLR", "BlogPosts", "blogpost", 2023, 2099),
)
#: Last segments that state a status, and what other status words look like.
STATUS_SUFFIXES = {"Submission": "unknown", "Rejected_Submission": "rejected", "Withdrawn_Submission": "withdrawn", "Desk_Rejected_Submission": "desk_rejected"}
STATUS_WORDS = r"(?i)^(\w*_)?(Submissions?|Withdrawn|Rejected|Post_Decision)$"
#: Years in which a venue's ids say nothing about status, and the track of an art programme.
NO_STATUS_YEARS = {"ICLR": (2013, 2023), "NeurIPS": (2021, 2022)}
CREATIVE = "Creative_AI_Track"
#: Venue strings of the older API (venue, year, track, status).
VENUE_STRINGS = {
    "ICLR 2017 Oral": ("ICLR", 2017, "main", "accepted"),
    "ICLR 2017 Poster": ("ICLR", 2017, "main", "accepted"),
    "Submitted to ICLR 2017": ("ICLR", 2017, "main", "rejected"),
    "ICLR 2017 Invite to Workshop": ("ICLR", 2017, "workshop", "unknown"),
    "ICLR 2021 Oral": ("ICLR", 2021, "main", "accepted"),
    "ICLR 2021 Spotlight": ("ICLR", 2021, "main", "accepted"),
    "ICLR 2021 Poster": ("ICLR", 2021, "main", "accepted"),
    "ICLR 2022 Oral": ("ICLR", 2022, "main", "accepted"),
    "ICLR 2022 Spotlight": ("ICLR", 2022, "main", "accepted"),
    "ICLR 2022 Poster": ("ICLR", 2022, "main", "accepted"),
    "ICLR 2022 Submitted": ("ICLR", 2022, "main", "rejected"),
    "ICLR 2023 notable top 5%": ("ICLR", 2023, "main", "accepted"),
    "ICLR 2023 notable top 25%": ("ICLR", 2023, "main", "accepted"),
    "ICLR 2023 poster": ("ICLR", 2023, "main", "accepted"),
    "Submitted to ICLR 2023": ("ICLR", 2023, "main", "rejected"),
    "Submitted to Tiny Papers @ ICLR 2023": ("ICLR", 2023, "tiny_papers", "unknown"),
    "Blogposts @ ICLR 2023": ("ICLR", 2023, "blogpost", "accepted"),
    "Submitted to Blogposts @ ICLR 2023": ("ICLR", 2023, "blogpost", "rejected"),
    "Blogposts @ ICLR 2023 Conditional": ("ICLR", 2023, "blogpost", "unknown"),
    "NeurIPS 2021 Oral": ("NeurIPS", 2021, "main", "accepted"),
    "NeurIPS 2021 Spotlight": ("NeurIPS", 2021, "main", "accepted"),
    "NeurIPS 2021 Poster": ("NeurIPS", 2021, "main", "accepted"),
    "NeurIPS 2021 Submitted": ("NeurIPS", 2021, "main", "rejected"),
    "NeurIPS 2022 Accept": ("NeurIPS", 2022, "main", "accepted"),
    "NeurIPS 2022 Submitted": ("NeurIPS", 2022, "main", "rejected"),
    "NeurIPS 2021 Datasets and Benchmarks Track (Round 1)": ("NeurIPS", 2021, "datasets_benchmarks", "accepted"),
    "NeurIPS 2021 Datasets and Benchmarks Track (Round 2)": ("NeurIPS", 2021, "datasets_benchmarks", "accepted"),
    "Submitted to NeurIPS 2021 Datasets and Benchmarks Track (Round 1)": ("NeurIPS", 2021, "datasets_benchmarks", "rejected"),
    "Submitted to NeurIPS 2021 Datasets and Benchmarks Track (Round 2)": ("NeurIPS", 2021, "datasets_benchmarks", "rejected"),
    "NeurIPS 2022 Datasets and Benchmarks ": ("NeurIPS", 2022, "datasets_benchmarks", "accepted"),
}
#: Track tokens of proceedings listings.
PROCEEDINGS = {"Conference": "main", "Datasets_and_Benchmarks_Track": "datasets_benchmarks", "Datasets_and_Benchmarks": "datasets_benchmarks", "Position_Paper_Track": "position", CREATIVE: "other"}
MAIN_HOSTS = ("proceedings.neurips.cc", "papers.nips.cc")
ROUNDS_HOST, ROUNDS, ROUNDS_YEAR = "datasets-benchmarks-proceedings.neurips.cc", ("round1", "round2"), 2021
LAST_WITHOUT_TOKEN, LAST_ALIAS = 2021, 2023
#: How accepted notes of the newer API state their presentation, per venue and year: the part of the
#: string that names the track, the track, and the words that follow it with what they mean (None: no presentation).
PRESENTATIONS = (
    ("ICLR", 2024, "main", {"ICLR 2024 oral": "oral", "ICLR 2024 spotlight": "spotlight", "ICLR 2024 poster": "poster"}),
    ("ICLR", 2024, "blogpost", {"BT@ICLR2024": None}),
    ("ICLR", 2024, "tiny_papers", {"Tiny Papers @ ICLR 2024 Archive": None, "Tiny Papers @ ICLR 2024 Present": None, "Tiny Papers @ ICLR 2024 Notable": None}),
    ("ICLR", 2025, "main", {"ICLR 2025 Oral": "oral", "ICLR 2025 Spotlight": "spotlight", "ICLR 2025 Poster": "poster"}),
    ("ICLR", 2025, "blogpost", {"ICLR 2025 Blogpost Track": None}),
    ("ICLR", 2026, "main", {"ICLR 2026 Oral": "oral", "ICLR 2026 Poster": "poster"}),
    ("ICML", 2023, "main", {"ICML 2023 OralPoster": "oral", "ICML 2023 Poster": "poster"}),
    ("ICML", 2024, "main", {"ICML 2024 Oral": "oral", "ICML 2024 Spotlight": "spotlight", "ICML 2024 Poster": "poster"}),
    ("ICML", 2025, "main", {"ICML 2025 oral": "oral", "ICML 2025 spotlightposter": "spotlight", "ICML 2025 poster": "poster"}),
    ("ICML", 2025, "position", {"ICML 2025 Position Paper Track oral": "oral", "ICML 2025 Position Paper Track spotlightposter": "spotlight", "ICML 2025 Position Paper Track poster": "poster"}),
    ("ICML", 2026, "main", {"ICML 2026 spotlight": "spotlight", "ICML 2026 regular": None}),
    ("ICML", 2026, "position", {"ICML 2026 Position Paper Track spotlight": "spotlight", "ICML 2026 Position Paper Track regular": None}),
    ("NeurIPS", 2023, "main", {"NeurIPS 2023 oral": "oral", "NeurIPS 2023 spotlight": "spotlight", "NeurIPS 2023 poster": "poster"}),
    ("NeurIPS", 2023, "datasets_benchmarks", {"NeurIPS 2023 Datasets and Benchmarks Oral": "oral", "NeurIPS 2023 Datasets and Benchmarks Spotlight": "spotlight", "NeurIPS 2023 Datasets and Benchmarks Poster": "poster"}),
    ("NeurIPS", 2024, "main", {"NeurIPS 2024 oral": "oral", "NeurIPS 2024 spotlight": "spotlight", "NeurIPS 2024 poster": "poster"}),
    ("NeurIPS", 2024, "datasets_benchmarks", {"NeurIPS 2024 Track Datasets and Benchmarks Oral": "oral", "NeurIPS 2024 Track Datasets and Benchmarks Spotlight": "spotlight", "NeurIPS 2024 Track Datasets and Benchmarks Poster": "poster"}),
    ("NeurIPS", 2024, "competition", {"NeurIPS 2024 Competition Track": None}),
    ("NeurIPS", 2025, "main", {"NeurIPS 2025 oral": "oral", "NeurIPS 2025 spotlight": "spotlight", "NeurIPS 2025 poster": "poster"}),
    ("NeurIPS", 2025, "datasets_benchmarks", {"NeurIPS 2025 Datasets and Benchmarks Track oral": "oral", "NeurIPS 2025 Datasets and Benchmarks Track spotlight": "spotlight", "NeurIPS 2025 Datasets and Benchmarks Track poster": "poster"}),
    ("NeurIPS", 2025, "position", {"NeurIPS 2025 Position Paper Track Oral": "oral", "NeurIPS 2025 Position Paper Track": None}),
)


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _workshop(segment: Column) -> Column:
    s = F.lower(segment)
    return (s == "workshop") | s.startswith("workshop_")


def without_status(venue: Column, year: Column) -> Column:
    """Whether venue ids of this venue and year say nothing about status."""
    return reduce(lambda a, b: a | b, [(venue == v) & year.between(lo, hi) for v, (lo, hi) in NO_STATUS_YEARS.items()])


def venue_id(text: Column) -> Column:
    """struct (track, status, venue, year, parsed) of ``<Org>.cc/<year>/<path>``."""
    form = r"^(NeurIPS|ICLR|ICML)\.cc/([0-9]{4})/([^\n]+)$"
    venue, year, rest = F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2).try_cast("int"), F.regexp_extract(text, form, 3)
    parts = F.split(rest, "/")
    n = F.size(parts)
    sound = (venue != "") & year.between(2013, 2099) & F.forall(parts, lambda s: (s != "") & (s != "-"))
    last, named = F.element_at(parts, -1), (n > 1) & _workshop(F.get(parts, n - 2))  # a workshop may be called Rejected
    suffixed = ~named & (last.isin(list(STATUS_SUFFIXES)) | last.rlike(STATUS_WORDS))
    path = F.slice(parts, F.lit(1), F.when(suffixed, n - 1).otherwise(n))
    joined = F.array_join(path, "/")
    rules = [F.when((F.lit(org == "") | (venue == org)) & (joined == at) & year.between(lo, hi), track) for org, at, track, lo, hi in TRACK_PATHS]
    track = F.when(F.exists(path, _workshop), "workshop").otherwise(F.coalesce(*rules, F.lit("other")))
    bare = F.when(track == "other", "unknown").otherwise("accepted")
    status = F.when(without_status(venue, year), "unknown").when(suffixed, F.coalesce(_lookup(STATUS_SUFFIXES, last), F.lit("unknown"))).otherwise(bare)
    fine = F.coalesce(sound & ~(suffixed & (n == 1)), F.lit(False))
    known = lambda c, otherwise: F.when(fine, c).otherwise(otherwise)
    return F.struct(known(track, "unknown").alias("track"), known(status, "unknown").alias("status"), F.when(fine, venue).alias("venue"), F.when(fine, year).alias("year"), fine.alias("parsed"))


def venue_string(text: Column) -> Column:
    """struct (track, status, venue, year, parsed) of an older note's venue string, matched exactly."""
    of = lambda i: _lookup({k: v[i] for k, v in VENUE_STRINGS.items()}, text)
    return F.struct(F.coalesce(of(2), F.lit("unknown")).alias("track"), F.coalesce(of(3), F.lit("unknown")).alias("status"), of(0).alias("venue"), of(1).alias("year"), of(0).isNotNull().alias("parsed"))


def proceedings_track(token: Column) -> Column:
    """The track that a proceedings listing's token names; a listing means accepted."""
    known = F.coalesce(_lookup(PROCEEDINGS, token), F.lit("unknown"))
    return F.when(F.exists(F.split(F.coalesce(token, F.lit("")), "/"), _workshop), "workshop").otherwise(known)


def listing_track(host: Column, year: Column, token: Column) -> Column:
    """struct (track, rule): the track of a paper listed in the proceedings of NeurIPS and the rule that gave it."""
    host = F.lower(host)
    rounds = (year == ROUNDS_YEAR) & token.isin(list(ROUNDS))
    alias = token == "Datasets_and_Benchmarks"
    by_token = proceedings_track(token)
    track = (
        F.when((host == ROUNDS_HOST) & rounds, "datasets_benchmarks")
        .when(~F.coalesce(host.isin(list(MAIN_HOSTS)), F.lit(False)), "unknown")
        .when(token.isNull(), F.when(year <= LAST_WITHOUT_TOKEN, "main").otherwise("unknown"))
        .when(alias & (year > LAST_ALIAS), "unknown")
        .otherwise(by_token)
    )
    rule = (
        F.when((host == ROUNDS_HOST) & rounds, "host and round")
        .when(host == ROUNDS_HOST, "no rule")
        .when(~F.coalesce(host.isin(list(MAIN_HOSTS)), F.lit(False)), "no proceedings host")
        .when(token.isNull() & (year <= LAST_WITHOUT_TOKEN), "host and year")
        .when(track == "unknown", "no rule")
        .when(alias, "alias")
        .otherwise("token")
    )
    return F.struct(track.alias("track"), rule.alias("rule"))


def presentation(venue: Column, year: Column, track: Column, text: Column) -> Column:
    """struct (value, mapped): oral, spotlight, poster or null, matched exactly in the table of its venue and year."""
    table = {f"{v}|{y}|{t}|{s}": p or "" for v, y, t, strings in PRESENTATIONS for s, p in strings.items()}
    hit = _lookup(table, F.concat_ws("|", venue, year.cast("string"), track, text))
    hit = F.when(text.isNotNull(), hit)
    return F.struct(F.nullif(hit, F.lit("")).alias("value"), hit.isNotNull().alias("mapped"))


def creative(text: Column, year: Column) -> Column:
    """Whether a venue id is the year's art programme, bare or with a status."""
    path = F.regexp_extract(text, r"^NeurIPS\.cc/([0-9]{4})/([^/\n]+)(/[^/\n]+)?$", 2)
    stated, suffix = F.regexp_extract(text, r"^NeurIPS\.cc/([0-9]{4})/", 1), F.regexp_extract(text, r"^NeurIPS\.cc/[0-9]{4}/[^/\n]+/([^/\n]+)$", 1)
    fine = (suffix == "") | suffix.isin(list(STATUS_SUFFIXES)) | suffix.rlike(STATUS_WORDS)
    return F.coalesce((path == CREATIVE) & fine & (stated == year.cast("string")), F.lit(False))
