"""Scalar functions of the catalogue as Column builders: all JVM-side, none a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length_prefixed_digest(*parts: Column) -> Column:
    """sha256 over (length as 8 bytes, little-endian, then bytes) of each part (H1)."""
    pieces = []
    for p in parts:
        raw = F.encode(p, "UTF-8")
        pairs = F.regexp_extract_all(F.lpad(F.hex(F.octet_length(raw)), 16, "0"), F.lit("(..)"), F.lit(1))
        pieces += [F.unhex(F.array_join(F.reverse(pairs), "")), raw]
    return F.sha2(F.concat(*pieces), 256)


def capture_time(text: Column) -> Column:
    """RFC 3339, else camera text with colons, else with dashes, of UTC; with any fraction (H2). Null if
    it is none of these whole."""
    clock, rest = r"([0-9]{2}:[0-9]{2}:[0-9]{2})", r"(?:[.]([0-9]{1,9}))?"
    zoned = F.regexp_like(text, F.lit(rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ]{clock}(?:[.][0-9]+)?(?:[Zz]|[+-][0-9]{{2}}:[0-9]{{2}})$"))
    plain = rf"^([0-9]{{4}})([:-])([0-9]{{2}})\2([0-9]{{2}}) {clock}{rest}$"
    part = lambda k: F.regexp_extract(text, plain, k)
    camera = F.concat(part(1), F.lit("-"), part(3), F.lit("-"), part(4), F.lit("T"), part(5), F.when(part(6) != "", F.concat(F.lit("."), part(6))).otherwise(""), F.lit("Z"))
    return F.when(zoned, F.try_to_timestamp(F.upper(text))).when(F.regexp_like(text, F.lit(plain)), F.try_to_timestamp(camera))


def normal_stem(name: Column) -> Column:
    """ASCII lower case, without the extension and one edited, edit or final set off by a mark, letters and
    digits only; null if nothing is left (H3)."""
    stem = ascii_fold(F.trim(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")))
    stem = F.regexp_replace(F.regexp_replace(stem, r"[_ -](?:edited|edit|final)$", ""), r"[_ -]+$", "")
    return F.nullif(F.regexp_replace(stem, "[^a-z0-9]", ""), F.lit(""))


def safe_stem(name: Column) -> Column:
    """A file stem without control and reserved characters, at most 100, not framed by spaces or dots;
    photo if nothing is left (H5)."""
    kept = F.substring(F.regexp_replace(name, r"""[\p{Cc}<>:"/\\\\|?*]""", ""), 1, 100)
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("photo"))


def slug(text: Column, empty: str = "style") -> Column:
    """Lower-case words joined by dashes, at most 80 characters, or what stands for none (H4)."""
    words = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.coalesce(F.nullif(words, F.lit("")), F.lit(empty))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(r: Column) -> Column:
        digits = F.regexp_replace(r, "^0+", "")
        return F.when(F.regexp_like(r, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(r)

    return F.array_join(F.transform(runs, part), "")


def ascii_fold(text: Column) -> Column:
    """Lower case of A-Z alone, as a caseless ASCII collation compares (F2)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hamming64(a: Column, b: Column) -> Column:
    """Bits in which two 16-digit hex hashes differ, by halves: a signed long can't hold one."""
    half = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)), F.lit(0))


def stars(score: Column) -> Column:
    """1 to 5 stars of a score (H8)."""
    return F.when(score < 20, 1).when(score < 40, 2).when(score < 65, 3).when(score < 88, 4).otherwise(5)


def exposure_class(luminance: Column) -> Column:
    """Named class of a median luminance."""
    names = ("strongly_underexposed", "underexposed", "balanced", "overexposed")
    out = F.lit("strongly_overexposed")
    for name, below in reversed(list(zip(names, (0.025, 0.10, 0.55, 0.80)))):
        out = F.when(luminance < below, name).otherwise(out)
    return out


def exposure_ev(median: Column) -> Column:
    """Exposure value of a median luminance."""
    return F.log2(median + 0.005)


def upper_median(sorted_values: Column) -> Column:
    """The element at n div 2, not averaged; 0 if empty."""
    return F.coalesce(F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int")), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
