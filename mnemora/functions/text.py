"""Text functions on built-in expressions, all inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_GAP = r"[^\p{L}\p{N}\p{Co}]+"
NOT_ALNUM = r"[^\p{L}\p{N}]"
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
# Application types that hold text.
TEXT_TYPES = ("application/json", "application/xml", "application/yaml", "application/x-yaml")
TEXT_ENDS = ("+json", "+xml", "+yaml")
# The forms of identifiers, times, media types and roles; \z, as $ also stands before a last line break.
UUID7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"
MEDIA_TYPE = r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+\z"
ROLE = r"^[a-z][a-z0-9._-]{0,126}\z"
# What counts as white space at the ends of a text, beyond ASCII too.
WHITE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Conservative credential shapes of our own, by the name of their detector.
CREDENTIALS = (
    ("bearer-token", r"[Aa]uthorization:\s*[Bb]earer\s+[A-Za-z0-9._~+/-]{16,}"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{32,}"),
    ("openai-key", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}"),
    ("aws-key", r"AKIA[0-9A-Z]{16}"),
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("assigned-secret", r"(?i)\b(?:token|secret|password|passwd|api_?key)\s*[=:]\s*[\"'][0-9A-Za-z+/_=-]{16,}[\"']"),
)
# Dashed names and the dotted names they stand for.
ALIASES = ("representation-added", "retention-changed", "payload-evicted", "payload-missing-observed", "payload-restored", "payload-redacted")


def tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits."""
    return F.array_remove(F.split(F.translate(F.lower(text), ACCENTED, FOLDED), TOKEN_GAP), "")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits with a space between, accents as they are: `tokens` in one string."""
    return F.trim(F.regexp_replace(F.lower(text), TOKEN_GAP, " "))


def lowers_by_place(text: Column) -> Column:
    """Whether lower-casing before or after other characters are left out may differ: a sigma at a word's end, a dotted capital I,
    letters that patterns don't know yet; or whether a word may hold what `alnum` leaves out."""
    return ~is_ascii(text) & text.rlike(r"[\x{3a3}\x{130}\p{Co}\p{Cn}]")


def alnum(text: Column, most: int | None = None) -> Column:
    """What character grams are made of: letters and digits only, lower case; of the first `most` characters, where given."""
    return F.lower(F.regexp_replace(text if most is None else text.substr(1, most), NOT_ALNUM, ""))


def bigrams(text: Column, most: int | None = None) -> Column:
    """Distinct pairs of neighbouring letters and digits; one alone is a gram of itself."""
    plain = alnum(text, most)
    return F.when(F.length(plain) == 1, F.array(plain)).otherwise(F.array_distinct(F.regexp_extract_all(plain, F.lit("(?s)(?=(..))"), 1)))


def ascii_fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def contains_folded(text: Column, query: str) -> Column:
    """Substring search that ignores the case of ASCII letters only."""
    return F.contains(ascii_fold(text), F.lit(query.translate(str.maketrans(UPPER, LOWER))))


def html_escape(text: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#x27;")] * quotes
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def stripped(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def is_textual(media_type: Column) -> Column:
    kind = F.lower(stripped(F.split_part(media_type, F.lit(";"), F.lit(1))))
    out = kind.startswith("text/") | kind.isin(*TEXT_TYPES)
    for end in TEXT_ENDS:
        out = out | kind.endswith(end)
    return F.coalesce(out, F.lit(False))


def digest_of(reference: Column) -> Column:
    """The digest of a `sha256:` reference, or null; only its length is checked."""
    return F.when(reference.startswith("sha256:") & (F.length(reference) == 71), reference.substr(8, 64))


def is_uuid7(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID7), F.lit(False))


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text with an explicit offset, or null."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def sort_time(text: Column) -> Column:
    """Microseconds, 0 where the text is no time."""
    return F.coalesce(F.unix_micros(instant(text)), F.lit(0))


def turn_external_id(host: Column, session: Column, turn: Column) -> Column:
    """Null where a part is null: parts that are missing name no turn."""
    return F.concat(F.lit("turn-v1:"), F.sha2(F.concat(host, F.lit("\0"), session, F.lit("\0"), turn).cast("binary"), 256))


def dotted(event_type: Column) -> Column:
    """One name for the dashed and dotted spelling of a lifecycle event."""
    out = event_type
    for name in ALIASES:
        out = F.when(event_type == name, F.lit(name.replace("-", ".", 1))).otherwise(out)
    return out


def category(event_type: Column) -> Column:
    """The folder of an event: what stands before the first dash, made safe."""
    safe = F.regexp_replace(F.lower(F.split_part(event_type, F.lit("-"), F.lit(1))), r"[^a-z0-9._-]+", "-")
    safe = F.regexp_replace(safe, r"^[-.]+|[-.]+$", "")
    return F.when(safe == "", F.lit("general")).otherwise(safe)


def is_absolute_uri(uri: Column) -> Column:
    """A scheme, no white space, no user part, and a host for web addresses."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    good = (uri != "") & ~uri.rlike(r"\s") & (scheme != "") & ~F.contains(authority, F.lit("@"))
    return F.coalesce(good & (~scheme.isin("http", "https") | (authority != "")), F.lit(False))


def is_actor(actor: Column) -> Column:
    """Not blank, at most 256 characters, no control or format characters, no credentials."""
    return F.coalesce((stripped(actor) != "") & (F.length(actor) <= 256) & ~actor.rlike(r"\p{C}") & (F.size(credentials(actor)) == 0), F.lit(False))


def credentials(text: Column, detectors: tuple[tuple[str, str], ...] = CREDENTIALS) -> Column:
    """Names of the detectors that fire, in order; never what they found."""
    hits = F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in detectors])
    return F.filter(hits, lambda x: x.isNotNull())


def textual_type(media_type: Column) -> Column:
    """The media type without parameters, lower-cased, where it is well-formed and holds text; else null."""
    kind = F.lower(stripped(F.split_part(media_type, F.lit(";"), F.lit(1))))
    return F.when(kind.rlike(MEDIA_TYPE) & is_textual(media_type), kind)


def strict_digest_of(reference: Column) -> Column:
    """The digest of a `sha256:` reference of 64 lower-case hex digits, or null."""
    return F.nullif(F.regexp_extract(reference, r"^sha256:([0-9a-f]{64})\z", 1), F.lit(""))


def precision(text: Column) -> Column:
    """`date` or `datetime` for what is one, else null."""
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    return F.when(day, F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), "date")).when(instant(text).isNotNull(), "datetime")


def is_validity(start: Column, end: Column) -> Column:
    """Whether [start, end) is a time of one precision that is not empty; a missing end is open."""
    same = precision(start).eqNullSafe(precision(end)) & precision(start).isNotNull()
    earlier = F.when(precision(start) == "date", F.try_to_date(start, "yyyy-MM-dd") < F.try_to_date(end, "yyyy-MM-dd")).otherwise(instant(start) < instant(end))
    one = F.coalesce(start, end)
    return F.when(start.isNotNull() & end.isNotNull(), F.coalesce(same & earlier, F.lit(False))).otherwise(one.isNull() | precision(one).isNotNull())


def source_folder(name: Column) -> Column:
    """A source's folder name: lower case, other characters as one dash, never empty."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(safe == "", F.lit("unknown")).otherwise(safe)


def shown_parts(parts: Column, most: int = 1_000_000) -> Column:
    """The texts of an array of (text, synthetic, ignored) that are neither synthetic nor ignored, joined by newlines, at most `most` characters."""
    kept = F.filter(parts, lambda p: ~F.coalesce(p["synthetic"], F.lit(False)) & ~F.coalesce(p["ignored"], F.lit(False)) & p["text"].isNotNull())
    return F.substring(F.array_join(F.transform(kept, lambda p: p["text"]), "\n"), 1, most)
