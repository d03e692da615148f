"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
_OFFSET, _PRIME, _WORD = 2166136261, 16777619, 1 << 32


def strip(x: Column) -> Column:
    """Without white space at both ends (also tabs and line ends)."""
    return F.btrim(x, F.lit(" \t\n\r\f\v"))


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_name(x: Column) -> Column:
    """The key under which names match: lower case, collapsed."""
    return collapse(F.lower(x))


def first_non_blank(*xs: Column) -> Column:
    """The first that isn't blank, stripped, or ''."""
    return F.coalesce(*(F.nullif(strip(x), F.lit("")) for x in xs), F.lit(""))


def clamp(x: Column) -> Column:
    """Into 0..1; null counts as 0."""
    return F.greatest(F.least(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def tokens(x: Column) -> Column:
    """ASCII letter and digit runs of two or more, lower case, in order."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)


def token_set(*xs: Column) -> Column:
    """Distinct tokens of several texts."""
    return F.array_distinct(tokens(F.concat_ws(" ", *xs)))


def hash_token(t: Column) -> Column:
    """FNV-1a, 32 bits, of an ASCII token."""
    step = lambda h, i: (h.bitwiseXOR(F.ascii(F.substring(t, i, F.lit(1))).cast("bigint")) * _PRIME) % _WORD
    return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(_OFFSET).cast("bigint"), step)


def truncate(x: Column, n: int) -> Column:
    """Stripped; longer than n characters: cut to n, the last three as dots (n <= 3: just cut)."""
    s = strip(x)
    short = F.substring(s, 1, n) if n <= 3 else F.concat(F.substring(s, 1, n - 3), F.lit("..."))
    return F.when(F.length(s) <= n, s).otherwise(short)


def sentence(x: Column) -> Column:
    """A draft on one short line."""
    s = strip(F.coalesce(x, F.lit("")))
    return F.when(s == "", "No message draft available.").otherwise(truncate(s, 120))


def band(x: Column) -> Column:
    """low (up to .35), high (from .7) or mixed."""
    return F.when(x >= 0.7, "high").when(x <= 0.35, "low").otherwise("mixed")


def fixed(x: Column, places: int) -> Column:
    """With so many decimals, rounded from the exact binary value, ties to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places if places else "0"))


def score_text(x: Column) -> Column:
    """Clamped, two decimals, without zeros at the end; 0 is '0'."""
    return F.regexp_replace(F.regexp_replace(fixed(clamp(x), 2), "0+$", ""), r"\.$", "")


def bare_score(x: Column) -> Column:
    """As ``score_text``, but 0 is blank."""
    return F.regexp_replace(score_text(x), "^0$", "")


def contains_any(x: Column, cues: list[str]) -> Column:
    """Whether a text holds any of the cues."""
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(c)) for c in cues))


def synonyms(x: Column, groups: dict[str, list[str]], other: str) -> Column:
    """The name of the group that the stripped lower-case text is in."""
    key = F.lower(strip(F.coalesce(x, F.lit(""))))
    out = F.lit(other)
    for name, members in groups.items():
        out = F.when(key.isin(*members), name).otherwise(out)
    return out


STANCES = {"supports": ["supports", "support"], "weakens": ["questions", "weaken", "weakens"], "contradicts": ["contradict", "refutes", "contradicts"]}
WINNERS = {"augmented": ["memory_augmented", "memory", "augmented"], "baseline": ["stateless", "baseline"]}
MODES = {"communication_advice": ["communication", "communication_advice", "social_strategy"], "scenario_generation": ["scenarios", "scenario", "scenario_generation"]}


def stance(x: Column) -> Column:
    return synonyms(x, STANCES, "unknown")


def winner(x: Column) -> Column:
    return synonyms(x, WINNERS, "tie")


def response_mode(x: Column) -> Column:
    return synonyms(x, MODES, "normal_answer")


def slug(x: Column) -> Column:
    """An id: stripped, lower case, blanks and underscores as hyphens."""
    return F.translate(F.lower(strip(x)), " _", "--")


def quoted(x: Column) -> Column:
    """In double quotes, with quotes, backslashes and line ends escaped."""
    s = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(F.replace(s, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), F.replace(s, F.lit("\t"), F.lit("\\t")), F.lit('"'))


def identifier_like(part: Column) -> Column:
    """Whether a path segment looks like an id."""
    p = strip(part)
    n = F.length(p)
    hyphens = n - F.length(F.replace(p, F.lit("-"), F.lit("")))
    return (n >= 32) | ((hyphens >= 2) & (n >= 16)) | ((n >= 8) & p.rlike("^[A-Za-z0-9_-]+$") & p.rlike("[0-9_-]"))


def path_label(path: Column) -> Column:
    """A path with id-like segments replaced, and a slash in front."""
    parts = F.transform(F.split(strip(path), "/"), lambda x: F.when(identifier_like(x), ":id").otherwise(x))
    joined = F.array_join(parts, "/")
    return F.when(strip(path) == "", "/").when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def unfence(x: Column) -> Column:
    """Without the code fence around a JSON answer."""
    s = strip(x)
    return F.when(s.rlike(r"(?s)^```.*```$"), strip(F.regexp_replace(s, r"(?s)^```(?:json)?\s*|\s*```$", ""))).otherwise(s)


def truthy(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x, F.lit("")))).isin("on", "yes", "true", "1")


def join_or(xs: Column, sep: str, empty: str = "none") -> Column:
    return F.when(F.size(xs) > 0, F.array_join(xs, sep)).otherwise(empty)


def with_likelihood(label: Column, x: Column, show: Column) -> Column:
    return F.when(show, F.concat(label, F.lit(" (likelihood "), fixed(x * 100, 0), F.lit("%)"))).otherwise(label)


def instant(x: Column) -> Column:
    """An RFC 3339 time, null if it is none."""
    s = strip(x)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(s))


def labels_text(m: Column) -> Column:
    """A map as sorted k="v" pairs, values escaped."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"]))), ",")
