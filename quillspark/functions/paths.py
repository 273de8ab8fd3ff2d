"""What the paths of corpora say: splits, speakers, ids, dialects, and where a segment goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import milliseconds_id, safe_component

#: Folder names of splits, and what manifests call them (fixed values).
SPLIT_OF_FOLDER = {"train": "train", "dev": "validation", "test": "test"}
#: Scripts written without spaces between words (fixed values).
UNSPACED = ("Hani", "Hans", "Hant", "Jpan", "Thai", "Laoo", "Khmr", "Mymr", "Tibt")


def part(path: Column, at: int) -> Column:
    """A part of a path, counted from 1, or from the end by negative numbers; null beyond its ends."""
    return F.try_element_at(F.split(path, "/"), F.lit(at))


def stem(path: Column) -> Column:
    """The last part of a path without what follows its last dot."""
    return F.regexp_replace(part(path, -1), r"(?<=.)\.[^.]*$", "")


def folder_split(path: Column) -> Column:
    """The split named by the folder two above a file; null if there is none of that name."""
    names = F.create_map(*[F.lit(x) for pair in SPLIT_OF_FOLDER.items() for x in pair])
    return F.try_element_at(names, F.lower(part(path, -3)))


def speaker_folder(path: Column) -> Column:
    return part(path, -2)


def audio_id(path: Column) -> Column:
    """What follows the first hyphen of the stem; the whole stem if there is none."""
    name = stem(path)
    return F.when(F.contains(name, F.lit("-")), F.regexp_replace(name, "^[^-]*-", "")).otherwise(name)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\s+", "_")


def dialect(path: Column) -> Column:
    """The first folder of a path whose name ends in "dialect", as a slug; empty without one."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    found = F.filter(folders, lambda x: F.regexp_like(F.trim(x), F.lit("(?i)dialect$")))
    return slug(F.coalesce(F.get(found, F.lit(0)), F.lit("")))


def numbered_speaker(path: Column) -> Column:
    """dialect-speaker_X of the innermost folder "Speaker X"; null without one."""
    folders = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))
    named = F.filter(F.transform(folders, lambda x: F.regexp_extract(x, r"(?i)^speaker[\s_-]*(\S+)$", 1)), lambda x: x != "")
    key = F.concat(F.lit("speaker_"), F.get(named, F.lit(0)))
    return F.when(dialect(path) == "", key).otherwise(F.concat(dialect(path), F.lit("-"), key))


def without_corpus_prefix(path: Column, corpus: str) -> Column:
    """audio/... of corpus/audio/... or audio/...; null for a path that isn't under audio/."""
    rest = F.regexp_replace(path, "^" + corpus + "/", "")
    return F.when(F.startswith(rest, F.lit("audio/")), rest)


def segment_path(split: Column, subset: Column, recording: Column, start: Column, end: Column) -> Column:
    """audio/split/subset/recording/start-end.wav in whole milliseconds."""
    name = F.concat(milliseconds_id(start), F.lit("-"), milliseconds_id(end), F.lit(".wav"))
    return F.concat_ws("/", F.lit("audio"), split, safe_component(subset), safe_component(recording), name)


def word_boundary(script: Column) -> Column:
    """Are words written with spaces between them in a script?"""
    return ~script.isin(*UNSPACED)
