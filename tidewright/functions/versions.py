"""Semantic versions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: major.minor.patch with optional -prerelease and +build.
PATTERN = r"^(\d+)\.(\d+)\.(\d+)(?:-([^+]+))?(?:\+(.+))?$"


def parse_semver(version: Column) -> Column:
    """Struct of major, minor, patch, prerelease and build; NULL when the text is no version."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(version, PATTERN, i), F.lit(""))

    return F.when(
        version.rlike(PATTERN),
        F.struct(
            part(1).try_cast("int").alias("major"),
            part(2).try_cast("int").alias("minor"),
            part(3).try_cast("int").alias("patch"),
            part(4).alias("prerelease"),
            part(5).alias("build"),
        ),
    )


def version_compatible(a: Column, b: Column) -> Column:
    """Same major version."""
    return parse_semver(a).major == parse_semver(b).major


def next_version(current: Column, breaking: Column) -> Column:
    """Major step on a breaking change, minor step otherwise."""
    v = parse_semver(F.coalesce(current, F.lit("0.0.0")))
    return F.when(breaking, F.concat((v.major + 1).cast("string"), F.lit(".0.0"))).otherwise(
        F.concat(v.major.cast("string"), F.lit("."), (v.minor + 1).cast("string"), F.lit(".0"))
    )


def version_order(version: Column) -> Column:
    """Numbers of the dotted text, for comparing `1.10.0` above `1.9.0`."""
    return F.transform(F.split(F.regexp_extract(version, r"^([\d.]+)", 1), r"\."), lambda x: x.try_cast("int"))
