"""Scalar functions as column expressions: pricing, names, remotes, globs, times, ids."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars for a million input and output tokens, by tier.
TIERS = {
    "opus-high": (15.0, 75.0),
    "opus-low": (5.0, 25.0),
    "sonnet": (3.0, 15.0),
    "haiku-45": (1.0, 5.0),
    "haiku-35": (0.8, 4.0),
    "haiku-3": (0.25, 1.25),
    "gpt4o": (2.5, 10.0),
    "gpt4": (30.0, 60.0),
    "o1": (15.0, 60.0),
    "o3": (10.0, 40.0),
    "gemini-pro": (1.25, 5.0),
    "gemini-flash": (0.075, 0.3),
    "default": (3.0, 15.0),
}
# A model belongs to the first tier all of whose groups occur in its name, any part of a group being enough.
TIER_RULES = (
    ("opus-low", (("opus",), ("4-5", "4-6", "4.5", "4.6"))),
    ("opus-high", (("opus",),)),
    ("sonnet", (("sonnet",),)),
    ("haiku-45", (("haiku",), ("4-5", "4.5", "4-6", "4.6"))),
    ("haiku-35", (("haiku",), ("3-5", "3.5"))),
    ("haiku-3", (("haiku",),)),
    ("gpt4o", (("gpt-4o", "gpt4o"),)),
    ("gpt4", (("gpt-4", "gpt4"),)),
    ("o3", (("o3",),)),
    ("o1", (("o1",),)),
    ("gemini-flash", (("gemini",), ("flash",))),
    ("gemini-pro", (("gemini",), ("pro",))),
)
# Display families, by the same kind of rule.
FAMILY_RULES = (
    ("Claude Opus", (("opus",),)),
    ("Claude Sonnet", (("sonnet",),)),
    ("Claude Haiku", (("haiku",),)),
    ("GPT-4o", (("gpt-4o", "gpt4o"),)),
    ("GPT-4", (("gpt-4",),)),
    ("o3", (("o3",),)),
    ("o1", (("o1",),)),
    ("Gemini Flash", (("gemini",), ("flash",))),
    ("Gemini Pro", (("gemini",), ("pro",))),
    ("Gemini", (("gemini",),)),
    ("Codex", (("codex",),)),
)
# Languages by file ending.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust", "java": "Java",
    "rb": "Ruby", "cpp": "C++", "c": "C", "swift": "Swift", "kt": "Kotlin", "php": "PHP", "css": "CSS", "html": "HTML", "vue": "Vue", "svelte": "Svelte",
}
CACHE_READ_SHARE, CACHE_WRITE_SHARE, MILLION = 0.1, 1.25, 1_000_000.0


def _first_rule(text: Column, rules: tuple, otherwise: Column) -> Column:
    low, out = F.lower(text), otherwise
    for name, groups in reversed(rules):
        holds = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (low.contains(p) for p in g)) for g in groups))
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def model_tier(model: Column) -> Column:
    return _first_rule(model, TIER_RULES, F.lit("default"))


def model_family(model: Column) -> Column:
    """A display name; of other models the last part of their path."""
    last = F.element_at(F.split(model, "/"), -1)
    return _first_rule(model, FAMILY_RULES, F.when(last == "", model).otherwise(last))


def prices(model: Column) -> Column:
    """(input, output): the dollars for a million tokens of a model's tier, from a constant map."""
    table = [x for name, (p, q) in TIERS.items() for x in (F.lit(name), F.struct(F.lit(p).alias("input"), F.lit(q).alias("output")))]
    return F.element_at(F.create_map(*table), model_tier(model))


def estimate_cost(price: Column, n_in: Column, n_out: Column, cache_read: Column, cache_write: Column) -> Column:
    """Dollars: cached input is read at a tenth of the input price and written at 1.25 times it.

    `price` is a column that holds `prices`: it is named four times here, and a column is worked out once.
    """
    p, q = price["input"], price["output"]
    n_in, n_out, cache_read, cache_write = (c.cast("double") for c in (n_in, n_out, cache_read, cache_write))
    return n_in * p / MILLION + cache_read * p * CACHE_READ_SHARE / MILLION + cache_write * p * CACHE_WRITE_SHARE / MILLION + n_out * q / MILLION


def normalize_remote(remote: Column) -> Column:
    """host/path of a repository address: no scheme, user, port-style colon, case, end slash or .git."""
    steps = ((r"^(?i)[a-z][a-z0-9+.-]*://", ""), (r"^[^@]+@([^:]+):", "$1/"), (r"^[^/]+@(?=[^/]+/)", ""))
    out = reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.trim(remote))
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), (r"/+$", r"\.git$", r"/+$"), F.lower(out))


def normalize_remote_text(remote: str) -> str:
    """The same of a pattern on the driver."""
    out = re.sub(r"^[a-z][a-z0-9+.-]*://", "", remote.strip(), flags=re.IGNORECASE)
    out = re.sub(r"^[^@]+@([^:]+):", r"\1/", out, count=1)
    out = re.sub(r"^[^/]+@(?=[^/]+/)", "", out).lower().rstrip("/")
    return out.removesuffix(".git").rstrip("/")


def glob_regex(pattern: str) -> str:
    """A whole-text regular expression: * is any run without line ends, ? any one character."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"([|\\{}()\[\]^$+.])", r"\\\1", c) for c in pattern) + "$"


def short_remote(remote: Column) -> Column:
    """The last two parts of a remote."""
    return F.regexp_extract(normalize_remote(remote), r"([^/]+/[^/]+)$", 1)


def activity(ended_at: str = "ended_at", started_at: str = "started_at") -> Column:
    """When a conversation was last active: its end, or its start while it has none."""
    return F.coalesce(F.nullif(F.col(ended_at), F.lit("")), F.col(started_at))


def iso_time(text: Column) -> Column:
    """A timestamp of an ISO text, null if it isn't one."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def duration_ms(started_at: Column, ended_at: Column) -> Column:
    """Milliseconds between two ISO texts; 0 if one is missing or wrong or the end comes first."""
    gap = F.unix_millis(iso_time(ended_at)) - F.unix_millis(iso_time(started_at))
    return F.greatest(F.lit(0).cast("long"), F.coalesce(gap, F.lit(0).cast("long")))


def week_start(day: Column) -> Column:
    """The Monday of a day's week, as text."""
    return F.date_format(F.date_trunc("week", F.to_timestamp(day, "yyyy-MM-dd")), "yyyy-MM-dd")


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 24)


def stable_id_sha1(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("␟", *parts))


def project_id(cwd: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(cwd, "/+$", ""), 256), 1, 12)


def project_name(cwd: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(cwd, "/+$", ""), "/"), -1)
    return F.when(last == "", cwd).otherwise(last)


def uri_component(text: Column) -> Column:
    """Percent encoding that keeps A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.url_encode(text)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;]*m", "")


def first_line_name(text: Column, limit: int = 120) -> Column:
    """White space collapsed, cut to `limit` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(4.0))).cast("long")


def since_text(value: str, now: datetime) -> str:
    """'12h', '3d', '30m' (minutes) or '2w' before `now` as ISO text; anything else as it is."""
    found = re.fullmatch(r"(\d+)([hdmw])", value.strip())
    if not found:
        return value
    unit = {"h": "hours", "d": "days", "m": "minutes", "w": "weeks"}[found[2]]
    return (now - timedelta(**{unit: int(found[1])})).strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
