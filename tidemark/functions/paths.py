"""Path and URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that mean S3 storage.
S3_SCHEMES = ["s3", "s3a", "s3n", "s3p"]

# Scheme of files kept by the platform itself; every function takes another one.
PLATFORM_SCHEME = "store"


SEP = "://"


def _without_end(path: Column) -> Column:
    """The path without separators at its end; splitting drops the empty parts there."""
    return F.when(F.endswith(path, F.lit(SEP)), F.regexp_replace(path, f"({SEP})+$", "")).otherwise(path)


def scheme(path: Column) -> Column:
    """Text before the first "://", NULL unless something follows it."""
    at = F.instr(path, SEP)
    rest = F.replace(F.substr(path, at + len(SEP)), F.lit(SEP), F.lit(""))
    return F.when((at > 0) & (rest != ""), F.substring_index(path, SEP, 1))


def without_scheme(path: Column) -> Column:
    return F.substring_index(_without_end(path), SEP, -1)


def without_first_slash(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), F.substr(path, F.lit(2))).otherwise(path)


def pure_path(path: Column) -> Column:
    return without_first_slash(without_scheme(path))


def file_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def is_s3(path: Column) -> Column:
    """A bare "s3" without "://" counts too."""
    return F.trim(F.substring_index(path, SEP, 1)).isin(S3_SCHEMES)


def is_platform(path: Column, platform_scheme: str = PLATFORM_SCHEME) -> Column:
    return F.coalesce(scheme(path) == platform_scheme, F.lit(False))


def s3_to_s3p(path: Column) -> Column:
    """S3 paths with scheme s3p; of several "://" only the part after the first is kept."""
    second = F.substring_index(F.substring_index(path, SEP, 2), SEP, -1)
    return F.when(scheme(path).isin(S3_SCHEMES), F.concat(F.lit("s3p://"), second)).otherwise(path)


def to_http(
    path: Column, host: str, port: int, platform_scheme: str = PLATFORM_SCHEME
) -> Column:
    """Download address of a platform path, NULL for any other scheme."""
    url = F.concat(F.lit(f"http://{host}:{port}/fs/"), pure_path(path))
    return F.when(is_platform(path, platform_scheme), url)
