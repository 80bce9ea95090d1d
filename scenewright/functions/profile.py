"""Scalar functions of profiles, tracks and cache keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenewright.functions.text import rounded


def format_number(n: Column) -> Column:
    """1.2M, 3.4K with one digit always; smaller numbers as they are."""
    short = lambda d, unit: F.concat(F.format_string("%.1f", rounded(n / d, 1)), F.lit(unit))
    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "K")).otherwise(n.cast("string"))


def format_date(at: Column, now: Column) -> Column:
    """dd.MM in the year of `now`, dd.MM.yy else; null of what is no time."""
    return F.when(F.year(at) == F.year(now), F.date_format(at, "dd.MM")).otherwise(F.date_format(at, "dd.MM.yy"))


def large_image(url: Column) -> Column:
    """The address of an image in the size t500x500."""
    return F.regexp_replace(url, r"-(large|small|badge|tiny|crop|t\d+x\d+)(\.\w+)$", "-t500x500$2")


def location_line(*parts: Column) -> Column:
    """The parts that are not empty, with a middle dot between them."""
    return F.concat_ws(" · ", *[F.when(F.trim(p) != "", p) for p in parts])


def kind_of(followers_count: Column, followings_count: Column, is_album: Column, user: Column) -> Column:
    """user, playlist or track, told by the fields that are there."""
    return (
        F.when(followers_count.isNotNull() & followings_count.isNotNull(), "user").when(is_album.isNotNull(), "playlist").when(user.isNotNull(), "track")
    )


def cache_type(key: Column) -> Column:
    """The part of a cache key before its first colon; `other` without one."""
    return F.when(F.contains(key, F.lit(":")), F.substring_index(key, ":", 1)).otherwise("other")
