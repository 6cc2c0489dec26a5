"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed unit letters of sizes, by power of 1024.
UNITS = "KMGTP"


def parse_size(text: Column) -> Column:
    """Bytes of `4K`, `1.5kb`, ` 4 KB ` (half a byte rounds up); null for anything else."""
    pattern = rf"(?i)^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([{UNITS}]?)b?\s*$"
    number, unit = F.regexp_extract(text, pattern, 1), F.upper(F.regexp_extract(text, pattern, 2))
    power = F.when(unit == "", 0).otherwise(F.instr(F.lit(UNITS), unit))
    return F.when(text.rlike(pattern), F.floor(number.cast("double") * F.pow(F.lit(1024.0), power) + 0.5))


def parse_memory(text: Column) -> Column:
    """Megabytes of `2044K`, `1M`, `1G`; null for an empty text."""
    number = F.regexp_extract(text, r"^([0-9.]+)([KMG])$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([0-9.]+)([KMG])$", 2)
    return F.when(unit == "K", number / 1024).when(unit == "M", number).when(unit == "G", number * 1024)


def parse_duration(text: Column) -> Column:
    """Seconds of `[days-]hours:minutes:seconds`; null for anything else."""
    pattern = r"^(?:(\d+)-)?(\d+):(\d+):(\d+)$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("long"), F.lit(0))
    return F.when(text.rlike(pattern), ((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4))


def rerun_name(name: Column) -> Column:
    """The name with one `(rerun)` at its end."""
    bare = F.rtrim(name)
    return F.when(bare.endswith("(rerun)"), bare).otherwise(F.ltrim(F.concat(bare, F.lit(" (rerun)"))))


def argument(text: Column) -> Column:
    """Struct name, keyword (given by --name) and kind (* several, / directory) of one argument; null if malformed."""
    pattern = r"^(--)?(\w+)([*/])?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(2).alias("name"), (part(1) == "--").alias("keyword"), part(3).alias("kind")))


def dataset_name(argument_name: Column, run: Column) -> Column:
    """The argument's name with the run's number before its extension: `out_tar_gz` is `out_7.tar.gz`."""
    name = F.regexp_replace(argument_name, "_tar_gz$", ".tar.gz")
    name = F.regexp_replace(name, "_(csv|txt|fasta|fastq|json|pdf|zip|png|sam|bam)$", ".$1")
    return F.concat(F.regexp_extract(name, r"^([^.]*)", 1), F.lit("_"), run.cast("string"), F.regexp_extract(name, r"^[^.]*(.*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def first_timestamp(text: Column, *formats: str) -> Column:
    """The text as a time in the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def is_md5(text: Column) -> Column:
    """32 hex digits, or empty (the file was missing)."""
    return text.rlike("^(?:[0-9A-Fa-f]{32})?$")


def cutoff_label(cutoff: Column) -> Column:
    return F.when(cutoff.isNull(), "MAX").otherwise(F.format_string("%.3f", cutoff))


def longest_match(cigar: Column) -> Column:
    """The longest M run of a CIGAR text; null without one."""
    return F.array_max(F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)M"), F.lit(1)), lambda n: n.cast("int")))


def format_bytes(size: Column) -> Column:
    """A size for people: 1 byte, 12 bytes, 1.5 KB, 20.0 MB; a half goes to the even digit."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.when(size == 1, " byte").otherwise(" bytes")))
    for k, unit in enumerate(UNITS, 1):
        small = F.concat(F.format_string("%.1f", F.bround(size / float(1024**k), 1)), F.lit(f" {unit}B"))
        out = out.otherwise(small) if unit == UNITS[-1] else out.when(size < 1024 ** (k + 1), small)
    return out


def pluralized(n: Column, one: str = "", many: str = "s") -> Column:
    return F.when(n == 1, one).otherwise(many)


def natural_time(then: Column, now: Column) -> Column:
    """How long ago, in the largest unit that fits: 3 hours ago."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    out = F.when(seconds < 1, "now")
    for unit, span, least in (("second", 1, 60), ("minute", 60, 3600), ("hour", 3600, 86400), ("day", 86400, 7 * 86400), ("week", 7 * 86400, 2**62)):
        n = F.floor(seconds / span)
        out = out.when(seconds < least, F.concat(n.cast("string"), F.lit(f" {unit}"), pluralized(n), F.lit(" ago")))
    return out


def unique_file(name: Column, id_: Column) -> Column:
    """The name with the id before its last extension: `a.tar.gz` is `a.tar_7.gz`."""
    extension = F.regexp_extract(name, r"[^.](\.[^./]*)$", 1)
    return F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(extension)), F.lit("_"), id_.cast("string"), extension)


def directory_file(path: Column, run: Column, joined: str = "__") -> Column:
    """Name of an output below a directory: its folders joined, the run's number before all extensions."""
    folders = F.replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("/"), F.lit(joined))
    name = base_name(path)
    stem = F.regexp_extract(name, r"^(\.?[^.]*)", 1)
    return F.concat(folders, F.lit(joined), stem, F.lit("_"), run.cast("string"), F.substring(name, F.length(stem) + 1, F.length(name)))


def expanded(text: Column, pattern: str, template: str) -> Column:
    """The template with $1, $2, ... replaced by what the pattern caught; null where it doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, template))


def months_before(day: Column, n: int) -> Column:
    """The same day n months ago, or the last one of a shorter month."""
    return F.add_months(day, -n)


def ended_before(end: Column, limit: Column) -> Column:
    """ISO times compared as texts: `Unknown` comes after all digits, so what still runs has not ended."""
    return end.cast("string") < limit.cast("string")


def preview(text: Column, size: Column, most: int = 1000) -> Column:
    """The start of a log, and how much is left; what has no size was purged."""
    rest = F.concat(F.lit("[...download to see the remaining "), (size - most).cast("string"), F.lit(" characters.]"))
    return F.when(size.isNull(), "[purged]").when(size > most, F.concat(F.substring(text, 1, most), rest)).otherwise(text)


def argument_type(kind: Column, position: Column, several: Column) -> Column:
    """The class of an argument (kind I or O, place if it has a fixed one, several values); null for the others."""
    fixed = F.when(several, F.when(kind == "O", "fixed_directory_output")).otherwise(F.when(kind == "I", "fixed_input").when(kind == "O", "fixed_output"))
    return F.when(position.isNotNull(), fixed).when(kind == "I", F.when(several, "optional_multiple_input").otherwise("optional_input"))


def formatted_argument(name: Column, keyword: Column, kind: Column) -> Column:
    """The text of an argument, as argument() reads it."""
    return F.concat(F.when(keyword, "--").otherwise(""), name, kind)
