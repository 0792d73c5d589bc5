"""Scalar functions on paths, keys and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages by file extension
LANGUAGES = {"py": "python", "swift": "swift", "rs": "rust"}
# fixed values: base names that define a specification
BASE_NAMES = ("Specification", "AsyncSpecification", "DecisionSpec", "AsyncDecisionSpec", "DecisionSpecification", "AutoContextSpecification")
BLANK = r"(?U)\s+"


def language(path: Column) -> Column:
    """Language of a path by its extension, case-sensitive; null for others."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def base_key(lang: Column, path: Column, kind: Column, text: Column, blank: str = BLANK) -> Column:
    """Key of equal decision sites: the text without white space, hashed."""
    return F.concat_ws(":", lang, path, kind, F.substring(F.sha2(F.regexp_replace(text, blank, ""), 256), 1, 16))


def excerpt(text: Column, length: int = 120) -> Column:
    """First line that isn't blank, stripped, cut to a number of code points."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"(?U)\S"))
    return F.substring(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"(?U)^\s+|\s+$", ""), 1, length)


def split_fingerprint(fingerprint: Column) -> Column:
    """key and occurrence; null unless what follows the last colon is a positive number."""
    n = F.regexp_extract(fingerprint, r"^(.*):([1-9]\d*)$", 2)
    return F.when(n != "", F.struct(F.regexp_extract(fingerprint, r"^(.*):([1-9]\d*)$", 1).alias("key"), n.cast("bigint").alias("occurrence")))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path: without src/, .py and /__init__."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.py$", ""), r"/__init__$", ""), "/", ".")


def is_base(name: Column) -> Column:
    """Whether a base-class expression names a specification: its last segment, without arguments."""
    head = F.regexp_replace(name, r"[\[<].*$", "")
    return F.regexp_extract(head, r"([^.:]*)$", 1).isin(*BASE_NAMES)


def evidence_points(*refs: Column) -> Column:
    out = F.lit(0)
    for r in refs:
        out = out + F.when(F.trim(r) != "", 1).otherwise(0)
    return out.cast("bigint")


def valid_path(path: Column) -> Column:
    """Relative, with forward slashes and no empty, `.` or `..` part."""
    bad = F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))
    return ~path.startswith("/") & ~path.contains("\\") & ~bad


def percent_encoded(text: Column) -> Column:
    """Bytes other than letters, digits and `-_./` as %XX."""
    plain = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    return F.replace(F.replace(plain, F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z or digits of the lower-case text, split at camel case."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def unicode_tokens(text: Column) -> Column:
    """Runs of letters or digits of any script, split between a small and a capital ASCII letter; case is folded."""
    return F.regexp_extract_all(casefolded(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def casefolded(text: Column) -> Column:
    """Full case folding but for rare ligatures and Cherokee: lower() of upper(), which opens sharp s, and the final sigma."""
    sigma = lambda c: F.translate(c, "ς", "σ")
    return sigma(F.lower(sigma(F.upper(text))))  # next to each other, Spark would drop upper()


def type_text(annotation: Column) -> Column:
    """A type annotation without the white space outside its quoted parts."""
    return F.regexp_replace(annotation, r"""("[^"]*"|'[^']*')|\s+""", "$1")


def repository(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def revision(text: Column) -> Column:
    return text.rlike(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")


def within_bytes(text: Column, limit: int) -> Column:
    """The longest start of text of at most limit UTF-8 bytes, and whether it was cut."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # a character cut in two has its first bytes at the end
    whole = F.try_validate_utf8(raw.cast("string"))
    out = whole
    for drop in (1, 2, 3):
        out = F.coalesce(out, F.try_validate_utf8(F.substring(raw, 1, limit - drop).cast("string")))
    return F.struct(out.alias("text"), (F.octet_length(text) > limit).alias("truncated"))


def unit_interval(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0) & ~F.isnan(value), F.lit(False))
